"""Ingest records: parsing by dataset, normalisation, rejected rows, keyed upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logstrata.functions import text as tx

# The line layouts of the three datasets (groups: time, level, component, message).
PARSERS = {
    "apache": (r"^\[([^\]]+)\]\s+\[([^\]]+)\]\s*(.*)$", (1, 2, None, 3)),
    "openstack": (r"^(?:(\S+\.log(?:\.\S+)?)\s+)?(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}(?:[.,]\d+)?)\s+(\d+)\s+([A-Z]+)\s+([A-Za-z0-9_.$-]+)\s*(.*)$", (2, 4, 5, 6)),
    "hdfs": (r"^(\d{6}\s+\d{6})\s+(\d+)\s+([A-Z]+)\s+([^:\s]+):\s*(.*)$", (1, 3, 4, 5)),
}
MAX_RAW = 20_000
PARTITION_KEYS = ("trace_id", "request_id", "component", "service", "source_id", "source")


def optional(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def parse_line(dataset: Column, raw: Column) -> Column:
    """timestamp, level, component, message: the dataset's layout, else inferred."""
    generic = F.struct(tx.infer_timestamp(raw).alias("timestamp"), tx.infer_level(raw).alias("level"), F.lit(None).cast("string").alias("component"), raw.alias("message"))
    out = F
    for name, (pattern, groups) in PARSERS.items():
        ts, level, component, message = [optional(F.regexp_extract(raw, pattern, g)) if g else F.lit(None).cast("string") for g in groups]
        fields = F.struct(ts.alias("timestamp"), tx.clean_level(level).alias("level"), component.alias("component"), F.coalesce(tx.normalize_space(message), raw).alias("message"))
        out = out.when((dataset == name) & raw.rlike(pattern), fields)
    return out.otherwise(generic)


def normalize(df: DataFrame) -> DataFrame:
    """Ingest records with explicit fields before parsed ones, and `error` where a row must be rejected."""
    raw = tx.normalize_space(F.col("raw_log"))
    staged = df.withColumn("raw", F.nullif(raw, F.lit("")))
    staged = staged.withColumn("p", parse_line(F.col("dataset"), F.col("raw")))
    error = (
        F.when(F.col("raw").isNull(), "raw_log is required")
        .when(F.length("raw") > MAX_RAW, "raw_log is too long")
        .when(optional(F.col("dataset")).isNull(), "dataset is required")
        .when(optional(F.col("source_id")).isNull(), "source_id is required")
        .when(F.col("line_number") < 1, "line_number must be positive")
    )
    explicit = {c: optional(F.col(c)) for c in ("source", "service", "component", "timestamp", "host", "environment", "trace_id", "request_id")}
    component = F.coalesce(explicit["component"], F.col("p.component"))
    own_id = tx.stable_id(F.trim("dataset"), F.trim("source_id"), explicit["source"], explicit["service"], explicit["component"], explicit["timestamp"], F.col("raw"))
    return staged.select(
        "seq", F.coalesce(optional(F.col("log_id")), own_id).alias("log_id"), F.trim("dataset").alias("dataset"), F.col("raw").alias("raw_log"),
        F.col("p.message").alias("message"), F.coalesce(explicit["timestamp"], "p.timestamp").alias("timestamp"), component.alias("component"),
        F.coalesce(tx.clean_level(F.col("level")), "p.level").alias("level"), F.coalesce("line_number", F.lit(1)).alias("line_number"), F.trim("source_id").alias("source_id"),
        F.coalesce(explicit["source"], F.lit("api")).alias("source"), F.coalesce(explicit["service"], component).alias("service"),
        *[explicit[c].alias(c) for c in ("host", "environment", "trace_id", "request_id")], "kafka_topic", "kafka_partition", "kafka_offset", error.alias("error"),
    )


def partition_key(df: DataFrame) -> Column:
    return F.coalesce(*[optional(F.col(c)) for c in PARTITION_KEYS if c in df.columns], F.lit("unknown"))


def split_rejected(normalized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted records, rejected rows keyed by partition:offset)."""
    rejected = normalized.filter("error IS NOT NULL").select(
        F.concat_ws(":", "kafka_partition", "kafka_offset").alias("key"), "error", F.col("raw_log").alias("value")
    )
    return normalized.filter("error IS NULL").drop("error"), rejected


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of every key: a maximum per key, combined before the shuffle."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def merge_status(base: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Partial update: columns of an update that are null keep the old value."""
    shared = [c for c in updates.columns if c != key]
    renamed = updates.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in shared])
    joined = base.join(renamed, F.col(key) == F.col("__key"), "left")
    return joined.select(key, *[F.coalesce(f"__{c}", c).alias(c) if c in shared else F.col(c) for c in base.columns if c != key])


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of every group; limited per task before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= k)
