"""Weak labels from pattern rules: category scores, labels and hard negatives."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logstrata.functions.timestamps import let
from logstrata.operators.ingest import top_per_group

# Patterns of the categories and thresholds of their scores.
LIFECYCLE = ["vm stopped", "vm started", "vm paused", "vm resumed", "lifecycle event", "completed successfully", "created successfully", "successfully", "deallocate network", "destroy instance"]


@dataclass(frozen=True)
class Profile:
    strong: list[str]
    weak: list[str]
    negative: list[str] = field(default_factory=lambda: list(LIFECYCLE))
    positive_from: int = 5
    uncertain_from: int = 2


PROFILES = {
    "timeout": Profile(["timeout", "timed out", "request timed out", "no response", "not responding", "stalled"], ["waiting", "wait"]),
    "connection": Profile(
        ["connection refused", "connection failed", "cannot connect", "failed to connect", "connection reset", "reset by peer", "broken pipe", "socket error", "unreachable"],
        ["connection", "socket"], ["connection established", "connected successfully", "successful connection"],
    ),
    "latency": Profile(["slow", "high latency", "delayed", "scheduling delay"], ["took", "seconds", "duration"], positive_from=6),
    "database": Profile(["database", "sql", "connection pool", "deadlock"], ["db", "query", "hypervisor"]),
    "permission": Profile(
        ["permission denied", "client denied", "access denied", "forbidden", "unauthorized", "authentication failed"], ["auth", "policy", "token"],
        ["access granted", "authorized", "authenticated successfully"], positive_from=4,
    ),
    "storage": Profile(
        ["replica", "datanode", "namenode", "disk", "pipeline", "replication", "imagecache", "image cache", "base file", "blockmap", "addstoredblock", "packetresponder", "fsdataset"],
        ["block", "blk_", "file", "_base"], ["verification succeeded", "completed successfully"],
    ),
    "network": Profile(
        ["network-vif", "neutron", "connection reset", "broken pipe", "socket error", "unreachable", "host down", "binding failed"],
        ["network", "socket", "host", "route", "packet", "port", "vif", "ip"], ["network allocated", "connection established", "plugged", "successful"],
    ),
    "service_unavailable": Profile(
        ["unavailable", "failed to start", "crashed", "not available", "no valid host", "instance failed", "exception while serving", "got exception while serving", "datanode dead", "node down",
         "error state", "file does not exist", "unable to serve", "failed to open", "script not found", "cannot serve", "refused"],
        ["down", "stopped", "closed", "exception", "failed", "not found"], [*LIFECYCLE, "closed normally", "stopped by request"], positive_from=4,
    ),
    "unknown": Profile(["traceback", "critical", "alert", "corrupt", "fatal"], ["error", "warn", "warning", "exception"], ["verification succeeded", "completed successfully", "lifecycle event"], positive_from=6),
}
# What makes a block line an issue, a lifecycle line no calm one.
BLOCK_ISSUES = ["exception", "failed", "missing", "corrupt", "pipeline error", "replica", "datanode dead"]
SERVICE_ISSUES = ["failed", "unavailable", "crashed", "exception", "no valid host", "error state", "refused", "cannot serve"]


def log_text(*columns: str) -> Column:
    return F.lower(F.concat_ws(" ", *columns))


def _hit(text: Column, pattern: str) -> Column:
    return text.rlike(r"\bslow\b") if pattern == "slow" else F.contains(text, F.lit(pattern))


def _count(text: Column, patterns: list[str]) -> Column:
    return sum((_hit(text, p).cast("int") for p in patterns), F.lit(0))


def _any(text: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | _hit(text, p)
    return out


def category_score(category: str, dataset: Column, level: Column, text: Column) -> Column:
    """category, score and label of one category; score and negatives are computed once."""
    p = PROFILES[category]
    score = 4 * _count(text, p.strong) + _count(text, p.weak) - 5 * _count(text, p.negative)
    negative = _count(text, p.negative)
    if category == "latency":
        seconds = F.nullif(F.regexp_extract(text, r"\btook\s+([0-9]+(?:\.[0-9]+)?)\s+seconds?\b", 1), F.lit("")).cast("double")
        score = score + F.coalesce(F.when(seconds >= 10, 7).when(seconds >= 5, 2).when(seconds < 5, -6), F.lit(0))
        negative = negative + F.coalesce((seconds < 5).cast("int"), F.lit(0))
    elif category == "storage":
        block = F.contains(text, F.lit("blk_")) | F.contains(text, F.lit("block"))
        in_hdfs = F.coalesce(dataset == "hdfs", F.lit(False))
        score = F.when(in_hdfs & block, F.when(_any(text, BLOCK_ISSUES), score + 5).otherwise(F.least(score, F.lit(3)))).otherwise(score)
    elif category == "service_unavailable":
        calm = _any(text, LIFECYCLE) & ~_any(text, SERVICE_ISSUES)
        score, negative = score - F.when(calm, 6).otherwise(0), negative + calm.cast("int")
    elif category == "unknown":
        score = score + F.when(level.isin("ERROR", "WARN", "WARNING"), 2).otherwise(0)

    def labelled(s: Column) -> Column:
        label = (
            F.when((s["negative"] > 0) & (s["score"] < p.positive_from), "hard_negative")
            .when(s["score"] >= p.positive_from, "positive")
            .when(s["score"] >= p.uncertain_from, "uncertain")
            .otherwise("none")
        )
        return F.struct(F.lit(category).alias("category"), s["score"].alias("score"), label.alias("label"))

    return let(F.struct(score.cast("int").alias("score"), negative.alias("negative")), labelled)


def category_scores(logs: DataFrame, key: str) -> DataFrame:
    """(key, category, score, label) for logs with dataset, level and text."""
    scores = let(F.col("text"), lambda t: F.array(*[category_score(c, F.col("dataset"), F.col("level"), t) for c in PROFILES]))
    return logs.select(key, F.explode(scores).alias("s")).select(key, "s.category", "s.score", "s.label")


def top_labels(scores: DataFrame, key: str, caps: dict[str, int]) -> DataFrame:
    """Per category the best rows of each label, at most its cap."""
    cap = F.lit(0)
    for label, k in caps.items():
        cap = F.when(F.col("label") == label, k).otherwise(cap)
    wanted = scores.filter(F.col("label").isin(list(caps)))
    return top_per_group(wanted, ["category", "label"], [F.desc("score"), F.col(key)], max(caps.values())).filter(F.col("rank") <= cap)
