"""A keyed store of runs: what a batch costs is the batch, not the table.

Every batch is collapsed to one row a key, cut into buckets by a hash of the key and written as
a run of its own; the run of a batch that is written again replaces itself. Reading collapses
the runs bucket by bucket, compaction writes them back as one.

Defined results: the row of the largest order wins, of equal ones that of the later run; rows
without key are not stored; an empty store has no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logstrata.operators.ingest import last_wins
from logstrata.session import materialize

BUCKETS = 64


def append_run(df: DataFrame, path: str, key: str, order: str, run: int, buckets: int = BUCKETS) -> None:
    """Writes `df` as run number `run`."""
    once = last_wins(df.filter(F.col(key).isNotNull()), key, order).select(*df.columns)
    bucketed = once.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    bucketed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/run={run}")


def read_store(spark: SparkSession, path: str, key: str, order: str) -> DataFrame:
    """One row a key over all runs."""
    rows = spark.read.option("basePath", path).parquet(path)
    columns = [c for c in rows.columns if c not in ("run", "bucket")]
    latest = rows.groupBy("bucket", key).agg(F.max(F.struct(order, "run", *[c for c in columns if c not in (key, order)])).alias("r"))
    return latest.select(*[F.col(key) if c == key else F.col(f"r.{c}").alias(c) for c in columns])


def compact(spark: SparkSession, path: str, key: str, order: str) -> None:
    """All runs as one, under the number of the last."""
    runs = [r.run for r in spark.read.option("basePath", path).parquet(path).select("run").distinct().collect()]
    merged = materialize(read_store(spark, path, key, order), "compacted")
    append_run(merged, path, key, order, max(runs))
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for run in runs:
        if run != max(runs):
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/run={run}"), True)
