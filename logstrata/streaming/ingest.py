"""Structured Streaming: ingestion with rejected rows, keyed upserts, windows and per-stream state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logstrata.operators import ingest
from logstrata.operators.anomaly import ERROR_LEVELS
from logstrata.sources.keyed import append_run


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of a folder as they arrive; a single file is a folder with one name in it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).isFile():
        return reader.option("pathGlobFilter", target.getName()).parquet(target.getParent().toString())
    return reader.parquet(path)


def kafka_stream(spark: SparkSession, servers: str, topic: str, per_trigger: int = 100) -> DataFrame:
    """Messages of a topic with their metadata as columns; needs the Kafka connector."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", per_trigger).load()
    return raw.select(F.col("key").cast("string"), F.col("value").cast("string"), F.col("topic").alias("kafka_topic"), F.col("partition").alias("kafka_partition"), F.col("offset").alias("kafka_offset"))


MESSAGE = "log_id string, source_id string, dataset string, source string, service string, component string, level string, timestamp string, host string, environment string, trace_id string, request_id string, line_number int, raw_log string, seq long"


def decode(messages: DataFrame) -> DataFrame:
    """Messages (value, kafka_*) as ingest records; `undecoded` holds the text of those that are no JSON object."""
    schema = f"{MESSAGE}, _corrupt string"
    parsed = messages.withColumn("m", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("m").isNull() | F.col("m._corrupt").isNotNull()
    names = [x.strip().split()[0] for x in MESSAGE.split(",")]
    return parsed.select(*[F.when(~bad, F.col(f"m.{n}")).alias(n) for n in names], "kafka_topic", "kafka_partition", "kafka_offset", F.when(bad, F.coalesce("value", F.lit(""))).alias("undecoded"))


def accept(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of decoded records: undecodable ones and those that fail validation are kept apart with their place."""
    broken = records.filter("undecoded IS NOT NULL").select(F.concat_ws(":", "kafka_partition", "kafka_offset").alias("key"), F.lit("invalid JSON").alias("error"), F.col("undecoded").alias("value"))
    accepted, rejected = ingest.split_rejected(ingest.normalize(records.filter("undecoded IS NULL").drop("undecoded")))
    return accepted, rejected.unionByName(broken)


def run_ingest(stream: DataFrame, store: str, rejected: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Normalises every micro-batch: accepted rows become a run of the keyed store, others go to the rejected sink.

    Delivery is at least once; as a batch that runs again replaces its own run, it changes
    nothing. `trigger` is that of the stream, `{"processingTime": "2 seconds"}` for a worker
    that never ends; how many messages make a batch is an option of the source.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        records = batch if "undecoded" in batch.columns else batch.withColumn("undecoded", F.lit(None).cast("string"))
        accepted, bad = accept(records)
        append_run(accepted, store, "log_id", "seq", batch_id)
        bad.write.mode("overwrite").parquet(f"{rejected}/batch={batch_id}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def index_status(accepted: DataFrame, failure: str | None = None) -> DataFrame:
    """Status updates of a batch: indexed with its time and no error, or failed with one."""
    at = F.current_timestamp() if failure is None else F.lit(None).cast("timestamp")
    return accepted.select("log_id", F.lit("indexed" if failure is None else "failed").alias("index_status"), at.alias("indexed_at"), F.lit("" if failure is None else failure).alias("index_error"))


def tumbling_counts(stream: DataFrame, time: str, group: list[str], width: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Counts per window and group; state is bounded by the watermark."""
    windows = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *group).agg(F.count("*").alias("n"))
    return windows.select(F.col("w.start").alias("window_start"), *group, "n")


STATE = "template string, ts_ms long"
OUT = "log_id string, stream string, prev string, template string, ts_ms long"


def _previous(expire_ms: int | None):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["ts_ms", "line_number", "log_id"])
        prev = state.get[0] if state.exists else None
        rows["prev"] = [prev, *rows["template"].tolist()[:-1]]
        last = int(rows["ts_ms"].iloc[-1])
        state.update((rows["template"].iloc[-1], last))
        if expire_ms is not None:
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + expire_ms)
        yield rows[["log_id", "stream", "prev", "template", "ts_ms"]]

    return step


def previous_templates(view: DataFrame, expire_ms: int | None = None) -> DataFrame:
    """The template before, per stream key, in order of time within a batch and of arrival across batches.

    The state is one row a stream. With `expire_ms` the state of a stream that is quiet for so
    long in event time is dropped (and rows later than an hour are, too); without, it stays.
    """
    if expire_ms is None:
        return view.groupBy("stream").applyInPandasWithState(_previous(None), OUT, STATE, "append", GroupStateTimeout.NoTimeout)
    timed = view.withColumn("at", F.timestamp_millis("ts_ms")).withWatermark("at", "1 hour")
    return timed.groupBy("stream").applyInPandasWithState(_previous(expire_ms), OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


RECENT = 50
WINDOW_STATE = "levels array<string>, templates array<string>"
WINDOW_OUT = "log_id string, service string, n int, errors int, n_templates int"


def _recent(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    levels, templates = (list(x) for x in state.get) if state.exists else ([], [])
    rows = pd.concat(list(frames)).sort_values(["ts_ms", "line_number", "log_id"])
    out = []
    for log_id, level, template in zip(rows["log_id"], rows["level"], rows["template"]):
        levels, templates = [*levels, level][-RECENT:], [*templates, template][-RECENT:]
        out.append((log_id, key[0], len(levels), sum(x in ERROR_LEVELS for x in levels), len(set(templates))))
    state.update((levels, templates))
    yield pd.DataFrame(out, columns=["log_id", "service", "n", "errors", "n_templates"])


def recent_windows(view: DataFrame) -> DataFrame:
    """For every event how the last `RECENT` events of its service look; the state of a service is that many rows."""
    return view.groupBy("service").applyInPandasWithState(_recent, WINDOW_OUT, WINDOW_STATE, "append", GroupStateTimeout.NoTimeout)
