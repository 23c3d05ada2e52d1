"""Messages delivered more than once: an idempotent, hash-bucketed store of sorted runs.

Every upsert writes one *run*: the batch is collapsed to one entry per identifier while it
is still partitioned as it arrived (so an identifier that holds a third of the batch is one
row per task before anything is shuffled), hash-partitioned by identifier into a fixed
number of buckets and written sorted inside each bucket. Writing the same run id again
replaces that run. Compaction merges two runs bucket by bucket: both sides have the same
bucketing and order, so Spark plans a merge join without an exchange, and equal identifiers
collapse to the entry with the smallest sequence number. The result is one run; the tables
and files of the others are dropped.

Defined results: a null or blank identifier names no message, its rows are never duplicates;
identifiers are compared without letter case and surrounding blanks; of rows with the same
identifier and the same sequence number all copies count as one row; an empty table gives an
empty store; extra columns of any name are carried untouched by `survivors`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logstrata.functions.ids import ident
from logstrata.session import scratch_path

KEY = ["tbl", "ident"]


class RunStore:
    """Keeps, per (tbl, identifier), the smallest sequence number seen so far."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or scratch_path(spark, "runs")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._tag = "runs_" + uuid.uuid4().hex[:12]
        self._runs: dict[str, str] = {}

    def upsert(self, run_id: str, entries: DataFrame) -> None:
        """Write `entries` (tbl, ident, seq) as the run `run_id`; again is a no-op in effect."""
        collapsed = entries.filter(F.col("ident").isNotNull()).groupBy(*KEY).agg(F.min("seq").alias("seq"))
        self._write(run_id, collapsed)

    def _write(self, run_id: str, df: DataFrame, merged: bool = False) -> None:
        """A run; the merge of two runs has their buckets and order already."""
        name = f"{self._tag}_{run_id}"
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        (
            (df if merged else df.repartition(self.buckets, *KEY))
            .write.bucketBy(self.buckets, *KEY)
            .sortBy(*KEY)
            .option("path", f"{self.path}/{run_id}")
            .mode("overwrite")
            .saveAsTable(name)
        )
        self._runs[run_id] = name

    def _drop(self, run_id: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._runs.pop(run_id)}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{run_id}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def compact(self) -> DataFrame:
        """One entry per identifier: runs are merged pairwise until one is left."""
        legacy = "spark.sql.legacy.bucketedTableScan.outputOrdering"
        before = self.spark.conf.get(legacy, "false")
        self.spark.conf.set(legacy, "true")  # one file per bucket: the scans are sorted already
        try:
            level = 0
            while len(self._runs) > 1:
                pending, level = list(self._runs), level + 1
                for k in range(0, len(pending) - 1, 2):
                    a, b = pending[k : k + 2]
                    self._write(f"m{level}_{k}", merge_runs(self.spark.table(self._runs[a]), self.spark.table(self._runs[b])), merged=True)
                    self._drop(a)
                    self._drop(b)
        finally:
            self.spark.conf.set(legacy, before)
        (last,) = self._runs
        found = self.spark.read.schema(self.spark.table(self._runs[last]).schema).parquet(f"{self.path}/{last}")
        self.spark.sql(f"DROP TABLE IF EXISTS {self._runs[last]}")  # of an external table the files stay
        return found


def merge_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Merge two sorted runs; equal identifiers collapse to the smallest sequence number."""
    b = b.select(F.col("tbl").alias("tbl_b"), F.col("ident").alias("ident_b"), F.col("seq").alias("seq_b"))
    joined = a.hint("merge").join(b, (F.col("tbl") == F.col("tbl_b")) & (F.col("ident") == F.col("ident_b")), "full_outer")
    return joined.select(
        F.coalesce("tbl", "tbl_b").alias("tbl"), F.coalesce("ident", "ident_b").alias("ident"), F.least("seq", "seq_b").alias("seq")
    )


def deliveries(df: DataFrame, tbl: str, id_column: str, batch: Column) -> DataFrame:
    """The store's view of a table of deliveries: (tbl, ident, seq, batch)."""
    return df.select(F.lit(tbl).alias("tbl"), ident(id_column).alias("ident"), F.col("seq"), batch.cast("bigint").alias("batch"))


def keepers(entries: DataFrame, runs: int = 2, buckets: int | None = None) -> DataFrame:
    """(tbl, ident, seq) of the one row to keep per identifier.

    Batches are dealt to `runs` runs, each of them one idempotent upsert; the number of
    Spark jobs does not depend on the number of batches.
    """
    store = RunStore(entries.sparkSession, buckets=buckets)
    for r in range(runs):
        store.upsert(f"r{r}", entries.filter(F.pmod(F.coalesce("batch", F.lit(0)), F.lit(runs)) == r))
    return store.compact()


def redundant(entries: DataFrame, runs: int = 2) -> DataFrame:
    """(tbl, seq) of every row that must go.

    The rows to keep are found by identifier, the rows to go by an anti-join on the unique
    sequence number, so an identifier with many copies never meets in one task.
    """
    kept = keepers(entries, runs).select("tbl", "seq")
    named = entries.filter(F.col("ident").isNotNull()).select("tbl", "seq")
    return named.join(kept, ["tbl", "seq"], "left_anti")


def survivors(df: DataFrame, id_column: str, seq_column: str = "seq") -> DataFrame:
    """`df` without its redundant deliveries; all columns, rows without identifier included."""
    entries = df.select(
        F.lit("t").alias("tbl"), ident(id_column).alias("ident"), F.col(seq_column).alias("seq"), F.lit(0).cast("bigint").alias("batch")
    )
    gone = redundant(entries, runs=1).select(F.col("seq").alias("__gone_seq"))
    return df.join(gone, F.col(seq_column) == F.col("__gone_seq"), "left_anti")
