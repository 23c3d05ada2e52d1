"""Baselines kept as tables: saving, loading, building where none is, and enriching events.

A saved baseline is a folder: Parquet for the counts, means and profiles and one JSON document
with the configuration and what it was trained on. It is written under a new name first and
renamed, so a reader never meets half of one.

Defined results: fields of the JSON that are not known are left out, missing ones take their
defaults, numbers take the type of the default; without a baseline events are enriched with
empty scores and the status `missing_baseline`.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, fields, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logstrata.operators import anomaly as an

TABLES = ("templates", "transitions", "means", "profile")
DETAILS = "metadata.json"


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, f"{path}/{DETAILS}")
    return fs.exists(target)


def write_json(spark: SparkSession, path: str, document: dict) -> None:
    """One JSON document with sorted keys."""
    fs, target = _fs(spark, path)
    out = fs.create(target, True)
    out.write(bytearray((json.dumps(document, indent=2, sort_keys=True) + "\n").encode()))
    out.close()


def read_json(spark: SparkSession, path: str) -> dict:
    """One JSON document; anything else than an object is an error."""
    (text,) = spark.read.text(path, wholetext=True).first()
    document = json.loads(text)
    if not isinstance(document, dict):
        raise ValueError(f"{path} holds no JSON object")
    return document


def save_baseline(baseline: an.Baseline, path: str, trained_at: str | None = None, **metadata: str) -> None:
    spark = baseline.templates.sparkSession
    staged = f"{path}-{uuid.uuid4().hex}"
    for name in TABLES:
        getattr(baseline, name).write.parquet(f"{staged}/{name}")
    details = metadata | {"trained_at": trained_at or datetime.now(timezone.utc).isoformat(), "config": asdict(baseline.config)}
    write_json(spark, f"{staged}/{DETAILS}", details)
    fs, target = _fs(spark, path)
    fs.delete(target, True)
    if not fs.rename(_fs(spark, staged)[1], target):
        raise OSError(f"could not move the baseline to {path}")


def load_baseline(spark: SparkSession, path: str) -> an.Baseline:
    given = read_json(spark, f"{path}/{DETAILS}").get("config", {})
    config = an.AnomalyConfig()
    known = {f.name: type(getattr(config, f.name))(given[f.name]) for f in fields(config) if f.name in given}
    return an.Baseline(*[spark.read.parquet(f"{path}/{name}") for name in TABLES], replace(config, **known))


def load_or_build(spark: SparkSession, path: str, training: DataFrame, config: an.AnomalyConfig, normal_only: bool = False) -> an.Baseline:
    """The baseline at `path`; where none is, it is trained and saved. `normal_only` learns from normal levels."""
    if not exists(spark, path):
        rows = training.filter(F.col("level").isin(an.NORMAL_LEVELS)) if normal_only else training
        save_baseline(an.train(rows, config), path, mode="normal_only" if normal_only else "all")
    return load_baseline(spark, path)


def as_document(baseline: an.Baseline, most_rows: int = 1_000_000) -> dict:
    """The baseline as one JSON document, for exchange; refused beyond `most_rows` rows a table."""
    out: dict = {"config": asdict(baseline.config)}
    for name in TABLES:
        rows = getattr(baseline, name).limit(most_rows + 1).collect()
        if len(rows) > most_rows:
            raise ValueError(f"{name} has more than {most_rows} rows: exchange the folder instead")
        out[name] = [r.asDict() for r in rows]
    return out


def missing_baseline(view: DataFrame, reason: str = "missing_baseline") -> DataFrame:
    """`view` with the anomaly columns of events that no baseline could score."""
    none = F.lit(None).cast("double")
    return view.withColumns({
        "anomaly_score": none, "anomaly_level": F.lit("unknown"), "anomaly_decision": F.lit("warming_up"), "anomaly_baseline_status": F.lit("missing_baseline"),
        "anomaly_reasons": F.array(F.lit(reason)), "anomaly_components": F.struct(none.alias("template_score"), none.alias("transition_score"), none.alias("window_score")),
    })


def flattened(scored: DataFrame) -> DataFrame:
    """Scores as the flat columns that records carry, keyed by log_id."""
    parts = F.struct("template_score", "transition_score", "window_score")
    return scored.select(
        "log_id", F.col("final_score").alias("anomaly_score"), "anomaly_level", F.col("decision").alias("anomaly_decision"), F.col("baseline_status").alias("anomaly_baseline_status"),
        F.col("reasons").alias("anomaly_reasons"), parts.alias("anomaly_components"),
    )


def enrich(view: DataFrame, path: str) -> DataFrame:
    """`view` (one row a log_id) with anomaly columns from the baseline at `path`, or the filler where none is."""
    spark = view.sparkSession
    if not exists(spark, path):
        return missing_baseline(view)
    return view.join(flattened(an.score(view, load_baseline(spark, path))), "log_id", "left")
