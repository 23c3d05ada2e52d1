"""What a chat asks of logs: identifiers, windows and lookbacks of a question, and how root-cause results are shown.

Questions are columns; everything here is an expression over them or a projection of results.

Defined results: null questions ask for nothing; windows and lookbacks have a least value of one
unit and the given default where none is named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logstrata.functions import text as tx
from logstrata.functions.timestamps import canonical, epoch_millis, let, read_parts
from logstrata.operators.ingest import optional
from logstrata.operators.planner import LATEST, NO_SUBJECT, _says, plain

# Phrases that ask for a root cause, units of time in two languages, the default lookback.
ROOT_CAUSE = ("nguyen nhan", "root cause", "rca", "vi sao", "tai sao", "why")
MINUTES, HOURS = "m|min|mins|minute|minutes|phut|p", "h|hour|hours|gio|tieng"
LOOKBACK_MS = 10 * 60 * 1000


def log_id(question: Column) -> Column:
    """The identifier a question names: `log_id: x`, else a bare `dataset:hash`."""
    named = tx.found(question, r"(?i)\blog[_ ]?id\s*[:=]?\s*([A-Za-z]+:[\w:-]+)", 1)
    return F.coalesce(named, tx.found(question, r"\b((?:apache|openstack|hdfs|online|demo):[0-9A-Za-z][\w-]{5,})\b", 1))


def is_recent(question: Column) -> Column:
    return F.coalesce(_says(plain(question), LATEST), F.lit(False))


def is_root_cause(question: Column) -> Column:
    """Whether a question is after a cause, or names a log along with an error."""
    said = plain(question)
    return F.coalesce(_says(said, ROOT_CAUSE) | (log_id(question).isNotNull() & _says(said, ("loi", "error", "incident"))), F.lit(False))


def window_hours(question: Column, default: int = 1) -> Column:
    hours = tx.found(plain(question), rf"\b(\d{{1,3}})\s*(?:h|gio|tieng|hour|hours)\b", 1).cast("int")
    # greatest() alone would take 1 for a question without hours
    return F.when(hours.isNotNull(), F.greatest(hours, F.lit(1))).otherwise(F.lit(default))


def lookback_ms(question: Column, default: int = LOOKBACK_MS) -> Column:
    """Minutes go before hours where both are named."""
    said = plain(question)

    def span(units: str, most: int, ms: int) -> Column:
        number = tx.found(said, rf"\b(\d{{1,{most}}})\s*(?:{units})\b", 1).cast("bigint")
        return F.when(number.isNotNull(), F.greatest(number, F.lit(1)) * ms)

    return F.coalesce(span(MINUTES, 4, 60_000), span(HOURS, 3, 3_600_000), F.lit(default)).cast("bigint")


def terms(question: Column) -> Column:
    """The words of a question that name its subject, in order, each once."""
    words = F.regexp_extract_all(plain(question), F.lit(r"[a-z_][a-z0-9_.$-]{2,}"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(*NO_SUBJECT)))


def chat_logs(rows: DataFrame) -> DataFrame:
    """Log records of any of the spellings a client sends, in one flat form; blocks and addresses come from the text."""
    lower = {c.lower().replace("_", ""): c for c in rows.columns}
    pick = lambda *names: F.coalesce(*[optional(F.col(lower[n]).cast("string")) for n in names if n in lower], F.lit(None).cast("string"))
    raw, said = pick("rawlog"), pick("message")
    text = F.concat_ws(" ", raw, said)
    stamp = F.upper(F.trim(pick("timestamp")))
    read = let(read_parts(canonical(stamp, F.lit(False))), lambda p: F.unix_millis(p["local"]) + p["millis"])
    given = [F.col(lower[n]).cast("bigint") for n in ("timestampms", "parsedms") if n in lower]
    service = F.coalesce(pick("service", "component", "logger"), F.concat(F.coalesce(pick("dataset"), F.lit("unknown")), F.lit("-service")))
    return rows.select(
        pick("logid").alias("log_id"), pick("dataset").alias("dataset"), service.alias("service"), F.upper(F.coalesce(pick("level"), F.lit("UNKNOWN"))).alias("level"), F.coalesce(said, raw, F.lit("")).alias("message"), F.coalesce(raw, said).alias("raw_log"),
        F.coalesce(*given, epoch_millis(stamp), read).alias("ts_ms"), F.coalesce(pick("blockid"), tx.found(text, tx.ENTITIES["block_id"])).alias("block_id"), F.coalesce(pick("ip"), tx.found(text, tx.ENTITIES["ip"])).alias("ip"),
    )


def rca_context(evidence: DataFrame, logs: DataFrame) -> DataFrame:
    """Ranked evidence (incident_log_id, log_id, rank, ts_ms, rca_score, reasons) and the incident itself in order of time, as lines L01, L02, ..."""
    from pyspark.sql.window import Window

    shown = logs.select("log_id", "level", "service", "message")
    own = evidence.select("incident_log_id").distinct().join(logs.select(F.col("log_id").alias("incident_log_id"), F.col("ts_ms")), "incident_log_id")
    own = own.select("incident_log_id", F.col("incident_log_id").alias("log_id"), "ts_ms", F.lit("incident").alias("rca_role"))
    rows = evidence.withColumn("rca_role", F.lit("evidence")).unionByName(own, allowMissingColumns=True)
    order = Window.partitionBy("incident_log_id").orderBy(F.asc_nulls_last("ts_ms"), F.col("log_id"))
    numbered = rows.withColumn("line_id", F.format_string("L%02d", F.row_number().over(order)))
    return numbered.join(shown, "log_id", "left").select("incident_log_id", "line_id", "log_id", "rca_role", "ts_ms", "level", "service", "message", "rca_score", "reasons")


def rca_summary(context: DataFrame) -> DataFrame:
    """Per incident: how many candidates it has, the best one, the reasons that were given."""
    evidence = F.col("rca_role") == "evidence"
    best = F.max(F.when(evidence, F.struct("rca_score", F.col("log_id").alias("log_id")))).alias("b")
    counted = context.groupBy("incident_log_id").agg(F.count_if(evidence).alias("candidates"), best, F.collect_set(F.when(evidence, F.split("reasons", ","))).alias("r"))
    reasons = F.array_join(F.sort_array(F.array_distinct(F.flatten("r"))), ",")
    return counted.select("incident_log_id", "candidates", F.col("b.rca_score").alias("best_score"), reasons.alias("reasons"))


def coverage(context: DataFrame) -> DataFrame:
    """Facts about a context (question_id, level, component, template, ts_ms): lines, templates, time range, errors."""
    return context.groupBy("question_id").agg(
        F.count("*").alias("n_lines"), F.count_distinct("template_ref").alias("n_templates"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"),
        F.count_if(F.col("level").isin("ERROR", "CRITICAL")).alias("n_errors"), F.count_distinct("component").alias("n_components"),
    )


def distinct_messages(rows: DataFrame, group: str, n: int = 3, most: int = 220) -> DataFrame:
    """The first n distinct messages of every group, cut to `most` characters."""
    from logstrata.operators.ingest import top_per_group

    first = rows.filter(optional(F.col("message")).isNotNull()).groupBy(group, "message").agg(F.min("seq").alias("seq"))
    return top_per_group(first, [group], [F.col("seq")], n).select(group, "rank", F.substring("message", 1, most).alias("message"))
