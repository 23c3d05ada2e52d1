"""Time-bounded ranking of evidence before incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logstrata.operators.ingest import optional, top_per_group

# The lookback, the weights of the scores and the reason codes.
LOOKBACK_MS = 10 * 60 * 1000
#: Distinct buckets of incidents up to which their table is broadcast.
MAX_BROADCAST_BUCKETS = 200_000
ENTITIES = ("trace_id", "request_id", "session_id", "block_id", "instance_id", "host")


def investigation_window(logs: DataFrame, incidents: DataFrame, lookback_ms: int = LOOKBACK_MS) -> DataFrame:
    """Pairs of an incident and a log of its dataset at most `lookback_ms` before it.

    An equi-join on the dataset and a bucket of time; every log lies in its own bucket and
    the one after it, which together hold all incidents it can precede.
    """
    # only buckets with an incident matter: their table is small and thins the logs before anything is shuffled
    wanted = incidents.select(F.col("dataset").alias("w_dataset"), F.floor(F.col("ts_ms") / lookback_ms).alias("w_bucket")).distinct()
    wanted = F.broadcast(wanted) if wanted.limit(MAX_BROADCAST_BUCKETS + 1).count() <= MAX_BROADCAST_BUCKETS else wanted
    left = logs.select([F.col(c).alias(f"c_{c}") for c in logs.columns])
    left = left.withColumn("bucket", F.explode(F.array(F.floor(F.col("c_ts_ms") / lookback_ms), F.floor(F.col("c_ts_ms") / lookback_ms) + 1)))
    left = left.join(wanted, (F.col("c_dataset") == F.col("w_dataset")) & (F.col("bucket") == F.col("w_bucket")), "left_semi")
    right = incidents.select([F.col(c).alias(f"i_{c}") for c in incidents.columns]).withColumn("bucket_i", F.floor(F.col("i_ts_ms") / lookback_ms))
    on = (F.col("c_dataset") == F.col("i_dataset")) & (F.col("bucket") == F.col("bucket_i"))
    inside = F.col("c_ts_ms").between(F.col("i_ts_ms") - lookback_ms, F.col("i_ts_ms")) & (F.col("c_log_id") != F.col("i_log_id"))
    return left.join(right, on & inside).drop("bucket", "bucket_i")


def _same(name: str) -> Column:
    return F.coalesce((F.trim(F.col(f"c_{name}").cast("string")) == F.trim(F.col(f"i_{name}").cast("string"))) & (F.trim(F.col(f"c_{name}").cast("string")) != ""), F.lit(False))


def _service(side: str, pairs: DataFrame) -> Column:
    """The first of service, component and logger that says something, else a name made of the data set."""
    there = [optional(F.col(f"{side}_{c}")) for c in ("service", "component", "logger") if f"{side}_{c}" in pairs.columns]
    return F.coalesce(*there, F.concat(F.coalesce(F.col(f"{side}_dataset"), F.lit("unknown")), F.lit("-service")))


def score_candidates(pairs: DataFrame, lookback_ms: int = LOOKBACK_MS) -> DataFrame:
    """Component scores, the weighted score and the reasons of every pair; scores above 0 only."""
    entity_names = [e for e in ENTITIES if f"c_{e}" in pairs.columns]
    anomaly = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("c_anomaly_score", F.lit(0.0))))
    temporal = F.greatest(F.lit(0.0), 1 - (F.col("i_ts_ms") - F.col("c_ts_ms")) / lookback_ms)
    service = F.when(_service("c", pairs) == _service("i", pairs), 1.0).otherwise(0.25)
    family = _same("event_family") if "c_event_family" in pairs.columns else F.lit(False)
    template = F.when(_same("template"), 1.0).when(family, 0.5).otherwise(0.0)
    entity = F.lit(False)
    for e in entity_names:
        entity = entity | _same(e)
    parts = {"anomaly": anomaly, "temporal": temporal, "service": service, "template": template, "entity": entity.cast("double")}
    scored = pairs.withColumns({f"s_{k}": v for k, v in parts.items()})
    total = 0.25 * F.col("s_anomaly") + 0.20 * F.col("s_temporal") + 0.15 * F.col("s_service") + 0.15 * F.col("s_template") + 0.25 * F.col("s_entity")
    reasons = F.array_compact(F.array(
        F.when(F.col("s_anomaly") >= 0.6, "candidate_has_high_anomaly_score"), F.when(F.col("s_temporal") > 0, "candidate_precedes_incident"),
        F.when(F.col("s_service") >= 1, "same_service_or_component"), F.when(F.col("s_template") >= 1, "same_template"),
        F.when(F.col("s_entity") > 0, "shared_entity_or_session"), F.when((F.col("s_entity") == 0) & (F.col("s_service") > 0), "service_window_fallback"),
    ))
    return scored.withColumns({"rca_score": F.round(total, 6), "reasons": reasons}).filter("rca_score > 0")


def rank_evidence(logs: DataFrame, incidents: DataFrame, lookback_ms: int = LOOKBACK_MS, limit: int = 10) -> DataFrame:
    """The `limit` best candidates of every incident, with their place in score and in time."""
    scored = score_candidates(investigation_window(logs, incidents, lookback_ms), lookback_ms)
    best = top_per_group(scored, ["i_log_id"], [F.desc("rca_score"), F.col("c_ts_ms"), F.col("c_log_id")], limit)
    return best.select(F.col("i_log_id").alias("incident_log_id"), F.col("c_log_id").alias("log_id"), "rank", F.col("c_ts_ms").alias("ts_ms"), "rca_score", F.array_join("reasons", ",").alias("reasons"))


def dashboard_scores(logs: DataFrame, incidents: DataFrame, lookback_ms: int = LOOKBACK_MS, limit: int = 8) -> DataFrame:
    """The dashboard's variant: four parts, three decimals."""
    pairs = score_candidates(investigation_window(logs, incidents, lookback_ms), lookback_ms)
    total = F.round(0.30 * F.col("s_anomaly") + 0.25 * F.col("s_temporal") + 0.20 * F.col("s_service") + 0.15 * F.col("s_template"), 3)
    best = top_per_group(pairs.withColumn("score", total), ["i_log_id"], [F.desc("score"), F.col("c_log_id")], limit)
    return best.select(F.col("i_log_id").alias("incident_log_id"), F.col("c_log_id").alias("log_id"), "rank", "score")
