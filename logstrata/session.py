"""Session helpers: configuration defaults and shared scratch storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "logstrata", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC timestamps and adaptive execution; `conf` overrides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir` as the cluster names it.

    Only where that setting is empty (local tests, one machine) a temporary folder of
    this machine is chosen, and remembered for the session.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    own = spark.conf.get("spark.logstrata.scratch", None)
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="logstrata-")
        spark.conf.set("spark.logstrata.scratch", own)
    return own


_written: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark)}/logstrata/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Deletes what this process wrote to the shared folder; results that still read from there must be stored before. Gives the number of paths."""
    gone = 0
    while _written:
        target = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        gone += bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True))
    return gone


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write `df` as Parquet to the shared folder and read it back.

    The files outlive lost executors, so nothing upstream is computed again, and the
    optimizer plans what follows with their real size.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan over at least as many tasks as there are cores.

    Work that takes much longer than its scan would otherwise run on as many cores as the
    table has splits; a table with enough splits is left as it is and shuffles nothing.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan._jdf.queryExecution().toRdd().getNumPartitions() >= cores else scan.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
