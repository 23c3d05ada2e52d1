"""Queries of the llm problems over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logstrata.llm import leakage, mixing, pii, rank, runs
from logstrata.operators import template_tree, timeline
from logstrata.plans import line_sql
from logstrata.session import materialize, spread, table


def _p1_scored(spark: SparkSession, d: str) -> DataFrame:
    """Candidates and hits are rows of scores side by side; hits of logs that are no candidates are not listed."""
    named = F.transform_keys(F.coalesce("components", F.create_map().cast("map<string,double>")), lambda k, v: F.concat(F.lit("component "), k))
    scores = F.map_concat(named, F.create_map(F.lit("rca"), F.col("rca_score")))
    candidates = table(spark, d, "rca_candidates").select("incident_id", "log_id", scores.alias("scores"), F.lit(True).alias("listed"))
    hits = table(spark, d, "retrieval_results").select("incident_id", F.col("primary_id").alias("log_id"), F.create_map(F.lit("semantic"), F.col("semantic_score")).alias("scores"), F.lit(False).alias("listed"))
    return rank.aggregate_ranks(candidates.unionByName(hits), "incident_id", "log_id", "scores", "listed")


def p1_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate with its rho, mean rank and number of scores."""
    return _p1_scored(spark, d).drop("log_rho")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return rank.first_ranked(_p1_scored(spark, d), "incident_id", "log_id")


P1_RANKING_SQL = """
WITH sem AS (SELECT incident_id, primary_id AS log_id, max(semantic_score) AS v FROM retrieval_results GROUP BY ALL),
raw AS (
  SELECT incident_id, log_id, 'rca' AS score, rca_score AS v FROM rca_candidates
  UNION ALL SELECT c.incident_id, c.log_id, 'semantic', sem.v FROM rca_candidates c LEFT JOIN sem USING (incident_id, log_id)
  UNION ALL SELECT incident_id, log_id, 'c ' || e.key, e.value FROM (SELECT incident_id, log_id, unnest(map_entries(components)) AS e FROM rca_candidates)),
names AS (SELECT incident_id, score, min(v) AS low FROM raw WHERE v IS NOT NULL GROUP BY ALL),
filled AS (SELECT c.incident_id, c.log_id, n.score, coalesce(max(r.v), any_value(n.low)) AS v
  FROM rca_candidates c JOIN names n USING (incident_id) LEFT JOIN raw r ON r.incident_id = c.incident_id AND r.log_id = c.log_id AND r.score = n.score
  GROUP BY c.incident_id, c.log_id, n.score),
ranked AS (SELECT *, (rank() OVER (PARTITION BY incident_id, score ORDER BY v DESC)
    + (count(*) OVER (PARTITION BY incident_id, score, v) - 1) / 2.0) / count(*) OVER (PARTITION BY incident_id, score) AS r FROM filled),
placed AS (SELECT *, row_number() OVER (PARTITION BY incident_id, log_id ORDER BY r) AS k, count(*) OVER (PARTITION BY incident_id, log_id) AS n FROM ranked),
tails AS (SELECT p.incident_id, p.log_id, p.k, p.n, any_value(p.r) AS r,
    sum((factorial(p.n::int) / (factorial(j::int) * factorial((p.n - j)::int)))::double * pow(p.r, j) * pow(1 - p.r, p.n - j)) AS t
  FROM placed p, generate_series(1, 64) g(j) WHERE j BETWEEN p.k AND p.n GROUP BY ALL)
SELECT incident_id, log_id, round(least(1.0, min(t) * max(n)), 12) AS rho, round(avg(r), 9) AS mean_rank, max(n)::int AS n_scores
FROM tails GROUP BY incident_id, log_id
"""
P1_SQL = f"""SELECT incident_id, log_id FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY CASE WHEN rho < 0.05 THEN rho ELSE 1 END, mean_rank, log_id) AS rn
FROM ({P1_RANKING_SQL})) WHERE rn = 1"""


def _p4_events(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """Events of log_records; a message that still is the whole line is parsed first."""
    logs = spread(table(spark, d, "log_records").select("seq", "source_file", "line_number", "message", "raw_log", *more))
    squeeze = lambda c: F.lower(F.regexp_replace(c, r"\x1b\[[0-9;]*m|\s+", ""))
    line = template_tree.first_line(F.col("raw_log"))
    whole = F.coalesce(F.startswith(squeeze(F.col("message")), squeeze(line)), F.lit(False))
    columns = ["seq", "source_file", "line_number", *more]
    parsed = template_tree.parse(logs.filter(whole).withColumn("line", line), "line", [*columns, "line"])
    text = template_tree.message_text(F.col("line"), F.col("tokens"), F.col("msg"), F.col("named"))
    plain = logs.filter(~whole).select(*columns, runs.message_key(F.col("message")).alias("key"))
    return plain.unionByName(parsed.select(*columns, runs.message_key(text).alias("key")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    events = _p4_events(spark, d).withColumn("ts_ms", F.lit(None).cast("bigint"))
    return runs.collapse_runs(events).filter("n_events >= 2").select("source_file", "first_line", "last_line", "n_events")


def p4_runs(spark: SparkSession, d: str) -> DataFrame:
    """All events with runs collapsed: count and duration of each."""
    candidates = timeline.host_candidates(table(spark, d, "host_zones"))
    times = timeline.instants(table(spark, d, "log_records").select("seq", "timestamp", "host", "ingested_at"), "timestamp", "host", "ingested_at", candidates, ["seq"])
    return runs.collapse_runs(_p4_events(spark, d).join(times, "seq", "left"))


_PARTS = "|".join(sorted(set(runs.PARTS)))
_RUNS = rf"""
WITH b AS (SELECT seq, source_file, line_number, message, trim(regexp_replace(regexp_extract(coalesce(raw_log, ''), '^[^\r\n]*'), '\x1b\[[0-9;]*m', '', 'g'), ' ') AS text FROM log_records WHERE source_file IS NOT NULL AND line_number IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY source_file, line_number ORDER BY seq) = 1),
w AS (SELECT *, coalesce(starts_with(lower(regexp_replace(message, '\x1b\[[0-9;]*m|\s+', '', 'g')), lower(regexp_replace(text, '\x1b\[[0-9;]*m|\s+', '', 'g'))), false) AS whole FROM b),
m AS (SELECT seq, source_file, line_number, message FROM w WHERE NOT whole UNION ALL SELECT seq, source_file, line_number, message FROM ({line_sql.fields('SELECT seq, source_file, line_number, text FROM w WHERE whole')})),
k AS (SELECT *, regexp_replace(regexp_replace(translate(lower(coalesce(message, '')), chr(160) || chr(8199) || chr(8239) || chr(12288), '    '), '\b({_PARTS})-([a-z]+)\b', '\1_\2', 'g'), '\b([a-z]+)-({_PARTS})\b', '\1_\2', 'g') AS said FROM m),
e AS (SELECT *, trim(regexp_replace(regexp_replace(said, '\S*[\d/]\S*|\b[a-z]+-[a-z]+\b', '#', 'g'), '\s+', ' ', 'g')) AS key FROM k),
t AS (SELECT e.*, i.ts_ms FROM e LEFT JOIN ({line_sql.instants("SELECT 'log_records' AS tbl, seq, timestamp, host FROM log_records")}) i USING (seq)),
n AS (SELECT *, coalesce((key <> lag(key) OVER (PARTITION BY source_file ORDER BY line_number))::int, 1) AS starts FROM t),
g AS (SELECT *, sum(starts) OVER (PARTITION BY source_file ORDER BY line_number) AS run FROM n)
SELECT source_file, min(line_number) AS first_line, max(line_number) AS last_line, count(*)::int AS n_events, arg_max(coalesce(ts_ms, -1), line_number) AS t1, arg_min(coalesce(ts_ms, -1), line_number) AS t0 FROM g GROUP BY source_file, run"""
P4_SQL = f"SELECT source_file, first_line, last_line, n_events FROM ({_RUNS}) WHERE n_events > 1"
P4_RUNS_SQL = f"SELECT source_file, first_line, last_line, n_events, CASE WHEN t0 >= 0 AND t1 >= 0 THEN t1 - t0 END AS duration_ms FROM ({_RUNS})"


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(spread(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "eval_items"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items per suite, with the number of documents that hold a piece of each."""
    found = p8_found(spark, d).groupBy("item_id").agg(F.count("*").alias("n_documents"))
    return table(spark, d, "eval_items").select("item_id", "suite").join(found, "item_id")


def p9_plan(spark: SparkSession, d: str) -> DataFrame:
    return mixing.plan(spread(table(spark, d, "documents").select("doc_id", "source", "text")), table(spark, d, "mix_targets"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of every source."""
    return mixing.report(p9_plan(spark, d), table(spark, d, "mix_targets"))


def p9_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Of every target: whether its tokens are met within the smallest document that is used, and its repeats kept."""
    planned = materialize(p9_plan(spark, d), "plan")
    shares = mixing.report(planned, table(spark, d, "mix_targets")).withColumn("all_tokens", F.sum("tokens").over(Window.partitionBy()))
    smallest = planned.filter("n_tokens > 0").groupBy("source").agg(F.min("n_tokens").alias("smallest"))
    missed = F.abs(F.col("tokens") - F.col("target_share") * F.col("all_tokens"))
    return shares.join(smallest, "source").select("source", (missed <= F.col("smallest") + 1).alias("share_met"), (F.col("most_copies") <= F.col("max_repeats")).alias("repeats_kept"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    found = pii.find_mentions(spread(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "staff_directory"))
    return found.select("doc_id", "pii_type", "pii_text").distinct()


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(spread(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "staff_directory"))


QUERIES = {"p9_plan": p9_plan, "p9_mix": p9_mix, "p9_invariants": p9_invariants, "p10_found": p10_found, "p10_redacted": p10_redacted, "p8_found": p8_found, "p8_report": p8_report, "p1_found": p1_found, "p1_ranking": p1_ranking, "p4_found": p4_found, "p4_runs": p4_runs}
ORACLE = {
    "p1_found": P1_SQL,
    "p1_ranking": P1_RANKING_SQL,
    "p4_found": P4_SQL,
    "p4_runs": P4_RUNS_SQL,
    "p9_invariants": "SELECT DISTINCT lower(trim(source)) AS source, true AS share_met, true AS repeats_kept FROM mix_targets",
}
