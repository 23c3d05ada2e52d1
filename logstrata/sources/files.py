"""File sources and sinks: raw text, structured CSV, JSON lines, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logstrata.operators.ingest import optional
from logstrata.sources.corpus import numbered_lines

LOG_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("log_id", "dataset", "raw_log", "message", "timestamp", "component", "level", "event_id", "source_file")]
    + [T.StructField("line_number", T.IntegerType())]
)
# Header names of structured CSV files, by field and precedence.
CSV_FIELDS = {
    "message": ["Content", "Message", "message", "log_message", "EventTemplate", "Template"],
    "timestamp": ["Timestamp", "timestamp", "Time", "Date", "Datetime", "DateTime"],
    "component": ["Component", "component", "Logger", "logger", "Service", "service"],
    "level": ["Level", "level", "Severity", "severity"],
    "event_id": ["EventId", "EventID", "event_id", "EventTemplateId"],
}


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = LOG_SCHEMA) -> DataFrame:
    """JSON lines; a line that is no object fails the read."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_jsonl_lenient(spark: SparkSession, path: str, schema: T.StructType = LOG_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected lines): broken lines are kept apart instead of failing the read."""
    marked = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    lines = spark.read.text(path).select(F.from_json("value", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"), "value").filter(F.trim("value") != "")
    broken = F.col("r._corrupt_record").isNotNull() | F.col("r").isNull()
    return lines.filter(~broken).select("r.*").drop("_corrupt_record"), lines.filter(broken).select("value")


def write_jsonl(df: DataFrame, path: str, overwrite: bool = True) -> int:
    """JSON lines with sorted keys; without `overwrite` an existing path is an error. Gives the number of rows, counted as they are written."""
    seen = Observation()
    df.select(*sorted(df.columns)).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite" if overwrite else "errorifexists").json(path)
    return seen.get["n"]


def write_review(df: DataFrame, path: str) -> None:
    """A table for reviewers: CSV with a header, quoted so that line breaks survive."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").csv(path)


def read_review(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_collection(df: DataFrame, path: str, dimension: int, required: tuple[str, ...] = ("chunk_id", "dataset", "embedding")) -> None:
    """Vectors with their payload, partitioned by data set; rows without a required field or with another dimension are refused."""
    blank = F.lit(False)
    for name in required:
        blank = blank | F.col(name).isNull()
    problem = F.when(blank, "a required field is missing").when(F.size("embedding") != dimension, "unexpected vector dimension")
    checked = df.withColumn("embedding", F.when(problem.isNotNull(), F.raise_error(problem)).otherwise(F.col("embedding")))
    checked.write.mode("overwrite").partitionBy("dataset").parquet(path)


def snapshot(spark: SparkSession, enriched: str, plain: str) -> DataFrame:
    """The enriched records where they exist, else the plain ones."""
    target = spark._jvm.org.apache.hadoop.fs.Path(enriched)
    there = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    return spark.read.parquet(enriched if there else plain)


def read_raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, line_number, line) of text files of any size, byte-order mark and blank lines removed."""
    return numbered_lines(spark, [path]).filter(F.trim("line") != "")


def read_structured_csv(spark: SparkSession, path: str) -> DataFrame:
    """Structured CSV with a header; missing columns are null, Date and Time are joined."""
    raw = spark.read.option("header", True).csv(path)
    pick = lambda names: F.coalesce(*[optional(F.col(f"`{n}`")) for n in names if n in raw.columns], F.lit(None).cast("string"))
    fields = {k: pick(v) for k, v in CSV_FIELDS.items()}
    date, time = pick(["Date", "date"]), pick(["Time", "time"])
    fields["timestamp"] = F.coalesce(F.when(date.isNotNull() & time.isNotNull(), F.concat_ws(" ", date, time)), fields["timestamp"])
    fields["level"] = F.upper(fields["level"])
    return raw.select(F.input_file_name().alias("source_file"), *[c.alias(k) for k, c in fields.items()])


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of every file below `path`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def upsert_partitions(df: DataFrame, path: str, key: str, order: str, partition: str = "dataset") -> None:
    """Keyed merge into a partitioned table: touched partitions are rewritten, the last row of a key wins."""
    from logstrata.operators.ingest import last_wins
    from logstrata.session import materialize

    spark = df.sparkSession
    merged = df
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        old = spark.read.parquet(path)
        touched = df.select(partition).distinct()
        merged = old.join(touched, partition, "left_semi").select(*df.columns).unionByName(df)
    merged = materialize(last_wins(merged, key, order), "upsert")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
