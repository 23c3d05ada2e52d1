"""Corpora from folders of log files: discovery, numbered lines, records with counters, configuration, generated data sets."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logstrata.functions import text as tx
from logstrata.operators import ingest
from logstrata.session import materialize

SUFFIXES = (".log", ".txt", ".csv")
STRUCTURED = "_structured.csv"
#: A listing of a folder is held by the driver; larger ones are refused.
MAX_FILES = 1_000_000


def discover(spark: SparkSession, folder: str) -> list[str]:
    """Log files below a folder in order of path; hidden ones do not count, structured CSV files win where there are any."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        raise FileNotFoundError(f"no such folder: {folder}")
    found, walk = [], fs.listFiles(root, True)
    while walk.hasNext():
        path = walk.next().getPath()
        name = path.getName()
        if name.lower().endswith(SUFFIXES) and not name.startswith(("." , "_")):
            found.append(path.toString())
        if len(found) > MAX_FILES:
            raise ValueError(f"more than {MAX_FILES} files below {folder}")
    structured = [p for p in found if p.endswith(STRUCTURED)]
    if not found:
        raise FileNotFoundError(f"no .log, .txt or .csv files below {folder}")
    return sorted(structured or found)


def numbered_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(source_file, line_number, line) of text files of any size, blank lines left out but counted.

    A file is read in splits; the lines of a split are numbered where they are read, and the
    counts of the splits before it are added. Undecodable bytes become replacement characters,
    a byte-order mark is dropped.
    """
    raw = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line")
    )
    raw = materialize(raw, "lines")
    splits = raw.groupBy("source_file", "split").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source_file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("source_file", "split", "first", before.alias("before"))
    numbered = raw.join(splits, ["source_file", "split"]).withColumn("line_number", (F.col("before") + F.col("id") - F.col("first") + 1).cast("int"))
    clean = F.regexp_replace(F.rtrim(F.regexp_replace("line", "\r$", "")), "^﻿", "")
    return numbered.select("source_file", "line_number", clean.alias("line"))


def build(spark: SparkSession, folder: str, dataset: str) -> tuple[DataFrame, DataFrame]:
    """(records, counters) of a folder of raw logs of one data set.

    Counters: lines read, records created, blank lines skipped, records without a level.
    """
    lines = numbered_lines(spark, discover(spark, folder))
    raw = tx.normalize_space(F.col("line"))
    staged = lines.withColumn("raw_log", F.nullif(raw, F.lit(""))).withColumn("p", ingest.parse_line(F.lit(dataset), F.col("raw_log")))
    name = F.regexp_extract("source_file", "([^/]+)$", 1)
    own = tx.stable_id(F.lit(dataset), name, F.col("line_number"), F.col("raw_log"))
    records = staged.filter("raw_log IS NOT NULL").select(
        own.alias("log_id"), F.lit(dataset).alias("dataset"), "raw_log", "p.message", "p.timestamp", "p.component", "p.level", F.lit(None).cast("string").alias("event_id"), "source_file", "line_number",
    )
    counters = staged.agg(F.count("*").alias("lines_read"), F.count("raw_log").alias("records_created"), F.count_if(F.col("raw_log").isNull()).alias("skipped_lines"), F.count_if(F.col("raw_log").isNotNull() & F.col("p.level").isNull()).alias("without_level"))
    return records, counters


def load_config(text: str) -> dict:
    """A configuration from JSON or from indented `key: value` lines with lists of `- item`."""
    stripped = text.strip()
    if stripped.startswith("{"):
        return json.loads(stripped)
    root: dict = {}
    levels: list[tuple[int, dict]] = [(-1, root)]
    last: tuple[dict, str] | None = None
    for number, line in enumerate(text.splitlines(), 1):
        body = line.split(" #")[0].rstrip()
        if not body.strip() or body.lstrip().startswith("#"):
            continue
        indent, item = len(body) - len(body.lstrip()), body.strip()
        if item.startswith("- "):
            if last is None:
                raise ValueError(f"line {number}: a list item without a key")
            held = last[0][last[1]]
            last[0][last[1]] = [*(held if isinstance(held, list) else []), _scalar(item[2:])]
            continue
        key, colon, value = item.partition(":")
        if not colon:
            raise ValueError(f"line {number}: no key")
        while levels[-1][0] >= indent:
            levels.pop()
        parent = levels[-1][1]
        parent[key.strip()] = _scalar(value) if value.strip() else {}
        if not value.strip():
            levels.append((indent, parent[key.strip()]))
        last = (parent, key.strip())
    return root


def _scalar(value: str):
    value = value.strip()
    if value[:1] in ("'", '"') and value[-1:] == value[:1] and len(value) > 1:
        return value[1:-1]
    if value.lower() in ("true", "false", "null", "~"):
        return {"true": True, "false": False}.get(value.lower())
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            continue
    return value


# --- generated data sets -----------------------------------------------------------------
def sequence_id(prefix: str, number) -> F.Column:
    return F.format_string(f"{prefix}:%06d", number)


def _chance(seed: int, salt: str, *parts) -> F.Column:
    """A number from 0 to 1 that is the same on every run."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(salt), *parts), 11) / float(1 << 53)


def generate(spark: SparkSession, incidents: int, noise: int = 20, seed: int = 42, start_ms: int = 1_735_689_600_000) -> dict[str, DataFrame]:
    """Logs with known causes: per incident a block of noise and a chain root, evidence, evidence, incident.

    Every second of the data set has one log; every fifth incident is silent, its root has no
    log of its own. Gives logs, incidents and anomalies; the same seed gives the same rows.
    """
    block = noise + 4
    rows = spark.range(incidents * block).withColumn("incident", F.floor(F.col("id") / block)).withColumn("place", F.col("id") % block)
    silent = F.col("incident") % 5 == 4
    role = (
        F.when(F.col("place") < noise, F.when(_chance(seed, "role", "id") < 0.65, "normal").otherwise("noise"))
        .when((F.col("place") == noise) & ~silent, "root_cause").when(F.col("place") == block - 1, "incident").otherwise("evidence")
    )
    service = F.concat(F.lit("svc-"), F.floor(_chance(seed, "service", "incident") * 5).cast("int"))
    level = F.when(role.isin("incident", "root_cause"), "ERROR").when(role == "evidence", "WARN").otherwise("INFO")
    logs = rows.select(
        sequence_id("demo", F.col("id") + 1).alias("log_id"), F.element_at(F.array(*[F.lit(x) for x in ("apache", "openstack", "hdfs")]), (F.col("incident") % 3 + 1).cast("int")).alias("dataset"), service.alias("service"),
        level.alias("level"), role.alias("ground_truth_role"), F.timestamp_millis(F.lit(start_ms) + F.col("id") * 1000).alias("at"), F.concat(role, F.lit(" of "), service).alias("message"), "incident", "place",
    )
    chain = F.transform(F.sequence(F.lit(noise), F.lit(block - 1)), lambda k: sequence_id("demo", F.col("incident") * block + k + 1))
    made = spark.range(incidents).withColumnRenamed("id", "incident")
    found = made.select(
        sequence_id("incident", F.col("incident") + 1).alias("incident_id"), F.when(silent, "silent_root_cause").otherwise("explicit_root_cause").alias("scenario_type"),
        sequence_id("demo", F.col("incident") * block + block).alias("incident_log_id"), F.when(~silent, sequence_id("demo", F.col("incident") * block + noise + 1)).alias("root_cause_log_id"),
        chain.alias("evidence_log_ids"), F.lit("the root precedes its evidence").alias("root_cause_summary"),
    )
    odd = F.col("ground_truth_role").isin("root_cause", "evidence", "incident")
    severity = F.when(F.col("level") == "ERROR", "high").when(F.col("level") == "WARN", "medium").otherwise("none")
    anomalies = logs.select(
        F.concat(F.lit("anomaly:"), "log_id").alias("anomaly_id"), "log_id", F.when(odd, sequence_id("incident", F.col("incident") + 1)).alias("incident_id"), odd.alias("expected_anomaly"), severity.alias("expected_severity"),
        F.when(odd, F.array(F.lit(0.5), F.lit(1.0))).otherwise(F.array(F.lit(0.0), F.lit(0.4))).alias("expected_score_range"), F.when(odd, F.array("level")).otherwise(F.array().cast("array<string>")).alias("signals"),
    )
    return {"logs": logs, "incidents": found, "anomalies": anomalies}
