"""Dashboard rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logstrata.functions.text import clean_level

LEVELS = ["ERROR", "WARN", "NOTICE", "INFO", "DEBUG"]


def board_view(df: DataFrame, time: str) -> DataFrame:
    """Rows with a level of the board's own list and a service, `unknown` where missing."""
    level = clean_level(F.col("level"))
    level = F.when(level.isin(LEVELS), level).otherwise("UNKNOWN")
    service = F.coalesce(F.nullif(F.trim("component"), F.lit("")), F.lit("unknown"))
    return df.select("log_id", "seq", "dataset", service.alias("service"), level.alias("level"), F.unix_millis(time).alias("ts_ms"))


def summary(board: DataFrame) -> DataFrame:
    return board.agg(
        F.count("*").alias("total"), F.count_if(F.col("level") == "ERROR").alias("errors"), F.count_if(F.col("level") == "WARN").alias("warns"),
        F.count_distinct(F.when(F.col("service") != "unknown", F.col("service"))).alias("services"),
        F.coalesce(F.round(F.try_divide(F.count_if(F.col("level") == "ERROR") * 1000, F.count("*"))) / 10, F.lit(0.0)).alias("error_percent"), F.max("ts_ms").alias("latest_ms"),
    )


def _bucket(by_day: bool):
    start = F.timestamp_millis(F.floor(F.col("ts_ms") / 300_000) * 300_000)
    return F.date_format(start, "yyyy-MM-dd HH:mm" if by_day else "HH:mm")


def traffic(board: DataFrame, by_day: bool = False) -> DataFrame:
    """Counts per five minutes and level; without the day, days merge."""
    return board.filter("ts_ms IS NOT NULL").groupBy(_bucket(by_day).alias("bucket"), "level").agg(F.count("*").alias("n"))


def traffic_pivot(board: DataFrame, buckets: int = 13) -> DataFrame:
    """The last buckets with INFO, WARN and ERROR side by side."""
    wide = traffic(board, by_day=True).groupBy("bucket").agg(*[F.coalesce(F.sum(F.when(F.col("level") == x, F.col("n"))), F.lit(0)).alias(x.lower()) for x in ("INFO", "WARN", "ERROR")])
    return wide.orderBy(F.desc("bucket")).limit(buckets)


def resources(board: DataFrame) -> DataFrame:
    """The board's synthetic latency and CPU series."""
    total, e, w = F.sum("n"), F.coalesce(F.sum(F.when(F.col("level") == "ERROR", F.col("n"))), F.lit(0)), F.coalesce(F.sum(F.when(F.col("level") == "WARN", F.col("n"))), F.lit(0))
    latency = F.round(250 + total * 12 + e * 180 + w * 45).cast("bigint")
    cpu = F.least(F.lit(99), F.floor(25 + total * 0.35 + e * 7 + w * 2 + 0.5)).cast("bigint")
    return traffic(board).groupBy("bucket").agg(latency.alias("latency_ms"), cpu.alias("cpu_percent"))


def service_last(board: DataFrame) -> DataFrame:
    """The last row of every service."""
    last = F.max_by(F.struct("log_id", "level", "ts_ms"), "seq").alias("r")
    return board.groupBy("service").agg(last, F.count("*").alias("n")).select("service", "n", "r.log_id", "r.level", "r.ts_ms")


def recent(board: DataFrame, limit: int = 100) -> DataFrame:
    return board.orderBy(F.desc_nulls_last("ts_ms"), F.desc("seq")).limit(min(max(limit, 1), 500))


def local_day(board: DataFrame, zone: str = "Asia/Ho_Chi_Minh") -> DataFrame:
    """Rows of the newest local day."""
    day = F.to_date(F.from_utc_timestamp(F.timestamp_millis("ts_ms"), zone))
    newest = board.agg(F.max(day).alias("newest"))
    return board.join(F.broadcast(newest), day == F.col("newest")).drop("newest")


def recent_window(board: DataFrame, hours: int, limit: int = 5) -> DataFrame:
    """The newest rows within `hours` of the newest row."""
    newest = board.agg(F.max("ts_ms").alias("newest"))
    inside = board.join(F.broadcast(newest), F.col("ts_ms") >= F.col("newest") - hours * 3_600_000).drop("newest")
    return inside.orderBy(F.desc("ts_ms"), F.desc("seq")).limit(limit)


# What enumerated fields of the board may hold, the first being the fallback, and the reasons worth a root-cause search.
ANOMALY_LEVELS = ("unknown", "normal", "low", "medium", "high")
DECISIONS = ("not_scored", "normal", "watch", "anomalous", "warming_up")
BASELINES = ("disabled", "ready", "insufficient_history", "missing_baseline", "error")
STATUSES = ("unknown", "pending", "indexed", "failed")
WORTHY = ("new_template_transition", "new_previous_template_for_transition", "new_template_for_service", "window_error_ratio_spike")


def known(c: Column, values: tuple[str, ...]) -> Column:
    """A value of the list, else its first."""
    return F.when(F.trim(c).isin(*values), F.trim(c)).otherwise(F.lit(values[0]))


def board_records(df: DataFrame) -> DataFrame:
    """Records as the board shows them: whitelisted levels and states, a service, whole anomaly fields."""
    text = lambda n: F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) if n in df.columns else F.lit(None).cast("string")
    given = lambda n, kind: F.col(n) if n in df.columns else F.lit(None).cast(kind)
    dataset, level = F.coalesce(text("dataset"), F.lit("unknown")), F.upper(F.coalesce(text("level"), F.lit("UNKNOWN")))
    return df.select(
        "log_id", dataset.alias("dataset"), F.when(level.isin(LEVELS), level).otherwise("UNKNOWN").alias("level"), F.coalesce(text("service"), text("component"), text("logger"), F.concat(dataset, F.lit("-service"))).alias("service"),
        F.coalesce(text("message"), text("raw_log"), F.lit("")).alias("message"), given("ts_ms", "bigint").alias("ts_ms"), given("anomaly_score", "double").alias("anomaly_score"),
        known(text("anomaly_level"), ANOMALY_LEVELS).alias("anomaly_level"), known(text("anomaly_decision"), DECISIONS).alias("anomaly_decision"), known(text("anomaly_baseline_status"), BASELINES).alias("baseline_status"),
        F.coalesce(given("anomaly_reasons", "array<string>"), F.array().cast("array<string>")).alias("reasons"), known(F.lower(text("index_status")), STATUSES).alias("index_status"),
    )


def filtered(board: DataFrame, dataset: str | None = None, service: str | None = None, levels: list[str] | None = None) -> DataFrame:
    """Rows of the chosen data set, service and levels, newest first; `all` chooses all, rows without time come last."""
    out = board
    for name, value in (("dataset", dataset), ("service", service)):
        if value and value != "all":
            out = out.filter(F.col(name) == value)
    return out.filter(F.col("level").isin(levels or [*LEVELS, "UNKNOWN"])).orderBy(F.desc(F.coalesce("ts_ms", F.lit(0))), "log_id")


def day_or_newest(board: DataFrame, now_ms: int, zone: str = "Asia/Ho_Chi_Minh", newest: int = 200) -> DataFrame:
    """Rows of the local day of `now_ms`; where it has none, the newest rows. One scan decides."""
    day = lambda c: F.to_date(F.from_utc_timestamp(F.timestamp_millis(c), zone))
    marked = board.withColumn("today", F.coalesce(day(F.col("ts_ms")) == day(F.lit(now_ms)), F.lit(False)))
    if marked.filter("today").isEmpty():
        return board.orderBy(F.desc_nulls_last("ts_ms"), F.desc("seq")).limit(newest)
    return marked.filter("today").drop("today")


def flags(records: DataFrame) -> DataFrame:
    """`records` with actionable, signal and rca_worthy."""
    actionable = (F.col("anomaly_decision") == "anomalous") | (F.col("anomaly_level") == "high")
    signal = ~actionable & F.col("anomaly_score").isNotNull() & ((F.col("anomaly_decision") == "watch") | F.col("anomaly_level").isin("medium", "low"))
    serious = (F.col("level") == "ERROR") & (F.coalesce("anomaly_score", F.lit(0.0)) >= 0.6)
    worthy = actionable | (serious & F.arrays_overlap("reasons", F.array(*[F.lit(x) for x in WORTHY])))
    return records.withColumns({"actionable": actionable, "signal": signal, "rca_worthy": worthy})


def spike(pivot: DataFrame) -> DataFrame:
    """The bucket with the most errors, the first of equal ones."""
    return pivot.orderBy(F.desc("error"), "bucket").limit(1).select("bucket", "error")


def distinct_values(board: DataFrame, name: str) -> DataFrame:
    return board.select(name).filter(F.col(name).isNotNull()).distinct().orderBy(name)


def service_map(board: DataFrame, services: int = 10) -> DataFrame:
    """The last row of the services that appeared first."""
    last = F.max_by(F.struct("log_id", "level"), "seq").alias("r")
    per = board.groupBy("service").agg(F.min("seq").alias("first"), last)
    return per.orderBy("first").limit(services).select("service", "r.log_id", "r.level")
