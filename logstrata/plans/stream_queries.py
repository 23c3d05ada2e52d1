"""Streaming queries run to the end of their input, and their batch SQL; file sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logstrata.operators import validation
from logstrata.operators.anomaly import scoring_view
from logstrata.plans import anomaly_queries
from logstrata.plans.anomaly_queries import _E
from logstrata.plans.engine_queries import _NORM
from logstrata.session import materialize, scratch_path, table
from logstrata.sources import corpus, files, keyed
from logstrata.streaming import ingest as streams


def _finish(frame: DataFrame, name: str, mode: str) -> DataFrame:
    spark = frame.sparkSession
    path = scratch_path(spark, name)
    query = frame.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", path + "-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(frame.schema).parquet(path)


def stream_tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    """Windows closed by the watermark, from a stream of files; events of windows still open at its end are in no row."""
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    events = streams.read_stream(spark, path, schema).withColumn("at", F.col("ts").cast("timestamp"))
    closed = _finish(streams.tumbling_counts(events, "at", ["event_type"], "1 hour"), "windows", "append")
    return closed.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n")


def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Ingest records streamed into the keyed store."""
    path = f"{d}/anomaly_candidate_logs.parquet"
    store = scratch_path(spark, "store")
    stream = streams.read_stream(spark, path, spark.read.parquet(path).schema)
    streams.run_ingest(stream, store, store + "-rejected", store + "-checkpoint").awaitTermination()
    return keyed.read_store(spark, store, "log_id", "seq").select("log_id", "seq", "dataset", "level")


def _damaged(spark: SparkSession, d: str) -> DataFrame:
    """Ingest records as messages; of every fifty one is no JSON, one has no text, one no line number."""
    rows = table(spark, d, "anomaly_candidate_logs")
    n = F.col("seq") % 50
    hurt = rows.withColumn("raw_log", F.when(n == 1, F.lit(None)).otherwise(F.col("raw_log"))).withColumn("line_number", F.when(n == 2, 0).otherwise(F.col("line_number")))
    fields = [x.strip().split()[0] for x in streams.MESSAGE.split(",")]
    value = F.when(n == 3, F.lit("{broken")).otherwise(F.to_json(F.struct(*fields)))
    return hurt.select(value.alias("value"), "kafka_topic", "kafka_partition", "kafka_offset")


def _messages(spark: SparkSession, d: str) -> tuple[str, str]:
    """Messages streamed in several batches; the paths of the store and of what was rejected."""
    path = scratch_path(spark, "messages")
    _damaged(spark, d).repartition(6).write.parquet(path)
    store = scratch_path(spark, "store")
    stream = streams.decode(streams.read_stream(spark, path, spark.read.parquet(path).schema, 2))
    streams.run_ingest(stream, store, store + "-rejected", store + "-checkpoint").awaitTermination()
    return store, store + "-rejected"


def stream_messages(spark: SparkSession, d: str) -> DataFrame:
    """The store after several batches, compacted."""
    store, _ = _messages(spark, d)
    keyed.compact(spark, store, "log_id", "seq")
    return keyed.read_store(spark, store, "log_id", "seq").select("log_id", "seq", "dataset")


def stream_rejected(spark: SparkSession, d: str) -> DataFrame:
    """What the stream kept apart, with its place in the topic."""
    _, rejected = _messages(spark, d)
    return spark.read.parquet(rejected).select("key", "error")


def _in_time_order(view: DataFrame, name: str, files: int = 5) -> str:
    """`view` as files that a stream takes one after the other: each later in time than the one before."""
    spark = view.sparkSession
    path = scratch_path(spark, name)
    view.repartitionByRange(files, "ts_ms", "line_number", "log_id").sortWithinPartitions("ts_ms", "line_number", "log_id").write.parquet(path)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted(str(f.getPath()) for f in fs.listStatus(root) if f.getPath().getName().startswith("part-"))
    for k, part in enumerate(parts):
        fs.setTimes(spark._jvm.org.apache.hadoop.fs.Path(part), 1_700_000_000_000 + k * 60_000, -1)
    return path


def stream_recent_windows(spark: SparkSession, d: str) -> DataFrame:
    """The last fifty events of a service kept as state over several batches."""
    view = materialize(anomaly_queries.events(spark, d), "events")
    stream = streams.read_stream(spark, _in_time_order(view, "ordered"), view.schema, 1)
    return _finish(streams.recent_windows(stream), "recent", "append").select("log_id", "service", "n", "errors", "n_templates")


def stream_previous_template(spark: SparkSession, d: str) -> DataFrame:
    """The previous template kept as state of a stream, over several batches."""
    rows = table(spark, d, "anomaly_input")
    once = rows.groupBy("log_id").agg(*[F.min(c).alias(c) for c in rows.columns if c not in ("log_id", "request_id")], F.min(F.nullif(F.nullif(F.lower(F.trim("request_id")), F.lit("")), F.lit("-"))).alias("request_id"))
    view = scoring_view(once, F.unix_millis("timestamp"))
    stream = streams.read_stream(spark, _in_time_order(materialize(view, "view"), "ordered"), view.schema, 1)
    return _finish(streams.previous_templates(stream), "previous", "append").select("log_id", "stream", F.md5("prev").alias("prev"))


def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """log_records written as JSON lines and read again."""
    path = scratch_path(spark, "jsonl")
    columns = [f.name for f in files.LOG_SCHEMA.fields]
    files.write_jsonl(table(spark, d, "log_records").select(*columns), path)
    return files.read_jsonl(spark, path).select("log_id", "dataset", "line_number", F.md5("raw_log").alias("raw_md5"))


def corpus_lines(spark: SparkSession, d: str) -> DataFrame:
    """raw_lines written as text files, found and numbered again."""
    path = scratch_path(spark, "raw")
    rows = table(spark, d, "raw_lines").select("source_file", "line_number", "line")
    rows.repartition("source_file").sortWithinPartitions("source_file", "line_number").select(F.col("source_file").alias("src"), F.col("line").alias("value")).write.partitionBy("src").text(path)
    found = corpus.numbered_lines(spark, corpus.discover(spark, path))
    return found.select(F.regexp_extract("source_file", "src=([^/]+)/", 1).alias("source_file"), "line_number", F.md5("line").alias("line_md5"))


def corpus_counters(spark: SparkSession, d: str) -> DataFrame:
    """What a build of the hdfs logs read, made and skipped."""
    path = scratch_path(spark, "hdfs")
    rows = table(spark, d, "log_records").filter("dataset = 'hdfs'")
    rows.select(F.when(F.col("seq") % 10 == 0, "").otherwise(F.regexp_extract("raw_log", r"^[^\r\n]*", 0)).alias("value")).write.text(path)
    return corpus.build(spark, path, "hdfs")[1]


def generated_errors(spark: SparkSession, d: str) -> DataFrame:
    """A generated data set has no errors of its own: rows, errors, broken chains."""
    made = corpus.generate(spark, 200)
    once = materialize(made["logs"], "generated")
    chains = validation.chain_errors(made["incidents"], once.select("log_id", "at"))
    bad = lambda df: df.filter(F.size("errors") > 0).count()
    counts = [("logs", once.count(), 0), ("incidents", made["incidents"].count(), bad(validation.incident_errors(made["incidents"])) + chains.count()), ("anomalies", made["anomalies"].count(), bad(validation.anomaly_errors(made["anomalies"])))]
    return spark.createDataFrame(counts, "tbl string, n_rows long, n_errors long")


def review_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents written for reviewers and read again."""
    path = scratch_path(spark, "review")
    rows = table(spark, d, "documents").select("doc_id", "source", "text")
    files.write_review(rows, path)
    return files.read_review(spark, path, rows.schema).select("doc_id", F.md5("text").alias("text_md5"))


def collection_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Vectors written as a partitioned collection and read again."""
    path = scratch_path(spark, "collection")
    rows = table(spark, d, "embeddings").select(F.concat(F.lit("chunk:"), "vec_id").alias("chunk_id"), F.concat(F.lit("d"), F.col("label") % 3).alias("dataset"), "vec_id", "embedding")
    files.write_collection(rows, path, len(rows.select("embedding").first()[0]))
    return files.snapshot(spark, path + "-none", path).select("chunk_id", "dataset", "vec_id", F.size("embedding").alias("n"))


QUERIES = {
    "review_round_trip": review_round_trip,
    "collection_round_trip": collection_round_trip,
    "corpus_lines": corpus_lines,
    "corpus_counters": corpus_counters,
    "generated_errors": generated_errors,
    "stream_tumbling_counts": stream_tumbling_counts,
    "stream_ingest": stream_ingest,
    "stream_messages": stream_messages,
    "stream_rejected": stream_rejected,
    "stream_recent_windows": stream_recent_windows,
    "stream_previous_template": stream_previous_template,
    "jsonl_round_trip": jsonl_round_trip,
}
ORACLE = {
    "review_round_trip": "SELECT doc_id, md5(text) AS text_md5 FROM documents",
    "collection_round_trip": "SELECT 'chunk:' || vec_id AS chunk_id, 'd' || (label % 3) AS dataset, vec_id, len(embedding)::int AS n FROM embeddings",
    "corpus_lines": "SELECT source_file, row_number() OVER (PARTITION BY source_file ORDER BY line_number)::int AS line_number, md5(rtrim(regexp_replace(line, '\\r$', ''), chr(32))) AS line_md5 FROM raw_lines",
    "corpus_counters": """WITH l AS (SELECT CASE WHEN seq % 10 = 0 THEN '' ELSE regexp_extract(raw_log, '^[^\\r\\n]*') END AS v FROM log_records WHERE dataset = 'hdfs'), r AS (SELECT nullif(trim(regexp_replace(v, '\\s+', ' ', 'g')), '') AS raw FROM l),
p AS (SELECT raw, CASE WHEN regexp_matches(raw, '^(\\d{6}\\s+\\d{6})\\s+(\\d+)\\s+([A-Z]+)\\s+([^:\\s]+):\\s*(.*)$') THEN true ELSE regexp_matches(raw, '(?i)\\b(DEBUG|INFO|NOTICE|WARN|WARNING|ERROR|ERR|FATAL|TRACE|CRITICAL|AUDIT)\\b') END AS levelled FROM r)
SELECT count(*) AS lines_read, count(raw) AS records_created, count(*) FILTER (raw IS NULL) AS skipped_lines, count(*) FILTER (raw IS NOT NULL AND NOT levelled) AS without_level FROM p""",
    "generated_errors": "SELECT * FROM (VALUES ('logs', 4800::bigint, 0::bigint), ('incidents', 200, 0), ('anomalies', 4800, 0)) v(tbl, n_rows, n_errors)",
    "stream_tumbling_counts": """SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n FROM events
WHERE time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' <= (SELECT max(ts) - INTERVAL '1 hour' FROM events) GROUP BY ALL""",
    "stream_ingest": _NORM + "SELECT log_id, max(seq) AS seq, arg_max(dataset, n.seq) AS dataset, arg_max(level, n.seq) AS level FROM (SELECT n.*, r.dataset FROM n JOIN anomaly_candidate_logs r USING (seq)) n WHERE error IS NULL GROUP BY log_id",
    "stream_messages": _NORM.replace("FROM anomaly_candidate_logs)", "FROM (SELECT * REPLACE (CASE WHEN seq % 50 = 1 THEN NULL ELSE raw_log END AS raw_log, CASE WHEN seq % 50 = 2 THEN 0 ELSE line_number END AS line_number) FROM anomaly_candidate_logs WHERE seq % 50 <> 3))", 1)
    + "SELECT log_id, max(seq) AS seq, arg_max(dataset, seq) AS dataset FROM (SELECT n.*, r.dataset FROM n JOIN anomaly_candidate_logs r USING (seq)) WHERE error IS NULL GROUP BY log_id",
    "stream_rejected": "SELECT kafka_partition || ':' || kafka_offset AS key, CASE seq % 50 WHEN 1 THEN 'raw_log is required' WHEN 2 THEN 'line_number must be positive' ELSE 'invalid JSON' END AS error FROM anomaly_candidate_logs WHERE seq % 50 IN (1, 2, 3)",
    "stream_recent_windows": _E + "SELECT log_id, service, len(l)::int AS n, len(list_filter(l, lambda x: x IN ('ERROR', 'CRITICAL', 'FATAL', 'ALERT', 'EMERG')))::int AS errors, len(list_distinct(t))::int AS n_templates FROM (SELECT log_id, service, list(level) OVER w AS l, list(template) OVER w AS t FROM e WINDOW w AS (PARTITION BY service ORDER BY ts_ms, line_number, log_id ROWS 49 PRECEDING))",
    "stream_previous_template": _E + "SELECT log_id, stream, md5(prev) AS prev FROM ep",
    "jsonl_round_trip": "SELECT log_id, dataset, line_number, md5(raw_log) AS raw_md5 FROM log_records",
}
