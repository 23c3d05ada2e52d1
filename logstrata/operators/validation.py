"""Validation of records and data sets: rows with the errors they have.

Every check is a column; a row's errors are a list, in the order of the checks, and nothing
stops at the first one. References are checked by anti-joins, orders by the row before.

Defined results: a null or missing value fails the checks that need one and no other; an empty
table has no errors; repeated identifiers are reported once each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What enumerated fields may hold.
DATASETS = ("apache", "openstack", "hdfs")
LABEL_SOURCES = ("auto_candidate", "template_rule", "keyword_rule", "human_reviewed")
SCENARIOS = ("explicit_root_cause", "silent_root_cause")
SEVERITIES = ("none", "low", "medium", "high")


def blank(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) == ""


def _missing(*names: str) -> list[Column]:
    return [F.when(blank(n), f"{n} must be a non-empty string") for n in names]


def _strings(name: str) -> Column:
    """Whether a list is missing or holds a null or empty string."""
    return F.col(name).isNull() | F.exists(name, lambda x: F.coalesce(x, F.lit("")) == "")


def with_errors(rows: DataFrame, checks: list[Column]) -> DataFrame:
    """`rows` with `errors`, the messages of the checks that fail."""
    return rows.withColumn("errors", F.array_compact(F.array(*checks)))


def log_errors(logs: DataFrame, datasets: tuple[str, ...] = DATASETS) -> DataFrame:
    checks = [
        F.when(~F.coalesce(F.col("dataset").isin(*datasets), F.lit(False)), "unknown dataset"), *_missing("log_id", "raw_log", "message", "source_file"),
        F.when(~F.coalesce(F.col("line_number") >= 1, F.lit(False)), "line_number must be a positive integer"),
    ]
    return with_errors(logs, checks)


def qrel_errors(qrels: DataFrame) -> DataFrame:
    checks = [
        *_missing("query_id"), *[F.when(_strings(c), f"{c} must be a list of non-empty strings") for c in ("positive_log_ids", "hard_negative_log_ids")],
        F.when(~F.coalesce(F.col("label_source").isin(*LABEL_SOURCES), F.lit(False)), "unknown label_source"), F.when(F.col("needs_review").isNull(), "needs_review must be a boolean"),
    ]
    return with_errors(qrels, checks)


def anomaly_errors(anomalies: DataFrame) -> DataFrame:
    low, high = F.get("expected_score_range", F.lit(0)), F.get("expected_score_range", F.lit(1))
    fits = F.coalesce((F.size("expected_score_range") == 2) & (low >= 0) & (low <= high) & (high <= 1), F.lit(False))
    checks = [
        *_missing("anomaly_id", "log_id"), F.when(F.col("expected_anomaly").isNull(), "expected_anomaly must be boolean"),
        F.when(~F.coalesce(F.col("expected_severity").isin(*SEVERITIES), F.lit(False)), "invalid expected_severity"), F.when(~fits, "invalid expected_score_range"), F.when(F.col("signals").isNull(), "missing list field: signals"),
    ]
    return with_errors(anomalies, checks)


def incident_errors(incidents: DataFrame) -> DataFrame:
    """Checks within an incident: scenario, membership of its logs in the evidence, silent root causes."""
    evidence = F.coalesce("evidence_log_ids", F.array().cast("array<string>"))
    explicit, silent = F.col("scenario_type") == "explicit_root_cause", F.col("scenario_type") == "silent_root_cause"
    root = ~blank("root_cause_log_id")
    checks = [
        *_missing("incident_id"), F.when(~F.coalesce(F.col("scenario_type").isin(*SCENARIOS), F.lit(False)), "invalid scenario_type"), *_missing("incident_log_id"), F.when(F.col("evidence_log_ids").isNull(), "missing list field: evidence_log_ids"),
        F.when(~blank("incident_log_id") & ~F.coalesce(F.array_contains(evidence, F.col("incident_log_id")), F.lit(False)), "incident_log_id must be included in evidence_log_ids"),
        F.when(explicit & ~root, "explicit incident must have exactly one root_cause_log_id"), F.when(explicit & root & ~F.coalesce(F.array_contains(evidence, F.col("root_cause_log_id")), F.lit(False)), "root_cause_log_id must be included in evidence_log_ids"),
        F.when(silent & F.col("root_cause_log_id").isNotNull(), "silent incident must not have root_cause_log_id"), *_missing("root_cause_summary"),
    ]
    return with_errors(incidents, checks)


def report(checked: DataFrame) -> DataFrame:
    """(error, n): how many rows have each error."""
    return checked.select(F.explode("errors").alias("error")).groupBy("error").agg(F.count("*").alias("n"))


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """Identifiers that occur more than once."""
    return rows.filter(~blank(key)).groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def chain_errors(incidents: DataFrame, logs: DataFrame) -> DataFrame:
    """(incident_id, error): evidence that is not in order of time, root causes after their incident.

    incidents: one row an incident; logs: (log_id, at), one row a log. Chains with a log that
    is not there are not judged.
    """
    listed = incidents.select("incident_id", F.posexplode("evidence_log_ids").alias("k", "log_id"))
    timed = listed.join(logs, "log_id", "left").groupBy("incident_id").agg(F.sort_array(F.collect_list(F.struct("k", "at"))).alias("c"), F.count_if(F.col("at").isNull()).alias("lost"))
    times = F.transform("c", lambda x: x["at"])
    unordered = timed.filter((F.col("lost") == 0) & (times != F.sort_array(times))).select("incident_id", F.lit("evidence chain is not time ordered").alias("error"))
    at = logs.select(F.col("log_id").alias("id"), "at")
    roots = incidents.join(at.select(F.col("id").alias("root_cause_log_id"), F.col("at").alias("root_at")), "root_cause_log_id").join(at.select(F.col("id").alias("incident_log_id"), F.col("at").alias("incident_at")), "incident_log_id")
    late = roots.filter("scenario_type = 'explicit_root_cause' AND root_at > incident_at").select("incident_id", F.lit("root cause occurs after incident log").alias("error"))
    return unordered.unionByName(late)


def manifest_errors(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(file, error) of two manifests (file, bytes, sha256): files that are missing, new or changed."""
    left, right = expected.select("file", F.col("sha256").alias("want")), actual.select("file", F.col("sha256").alias("have"))
    error = F.when(F.col("have").isNull(), "missing file").when(F.col("want").isNull(), "unexpected file").when(F.col("have") != F.col("want"), "checksum mismatch")
    return left.join(right, "file", "full_outer").select("file", error.alias("error")).filter("error IS NOT NULL")
