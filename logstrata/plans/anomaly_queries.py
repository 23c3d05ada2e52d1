"""Anomaly baseline and scoring queries over anomaly_input, and their SQL.

The baseline is trained on the first half of the year and scores the whole year.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logstrata.functions.ids import ident
from logstrata.operators import anomaly as an
from logstrata.operators import baseline, dashboard
from logstrata.session import materialize, scratch_path, table

CONFIG = an.AnomalyConfig(min_logs=100, min_windows=3)
SPLIT_MS = 1751328000000


def events(spark: SparkSession, d: str) -> DataFrame:
    """anomaly_input with repeated rows removed, in the scorer's shape."""
    rows = table(spark, d, "anomaly_input").withColumn("request_id", F.nullif(ident("request_id"), F.lit("-")))
    columns = ["dataset", "service", "component", "template_id", "level", "timestamp", "request_id", "host", "line_number", "raw_log"]
    once = rows.groupBy("log_id").agg(*[F.min(c).alias(c) for c in columns])
    return an.scoring_view(once, F.unix_millis("timestamp"))


def training(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).filter(F.col("ts_ms") < SPLIT_MS)


def template_counts(spark, d):
    return an.template_counts(training(spark, d))


def transition_counts(spark, d):
    return an.transition_counts(training(spark, d))


def template_p99(spark, d):
    counts = an.template_counts(training(spark, d))
    return an.surprise_p99(counts, ["service"], an.vocabulary(counts), CONFIG)


def transition_p99(spark, d):
    rows = training(spark, d)
    return an.surprise_p99(an.transition_counts(rows), ["service", "prev"], an.vocabulary(an.template_counts(rows)), CONFIG)


def window_profile(spark, d):
    _, profile = an.window_profile(an.window_vectors(training(spark, d), CONFIG))
    rounded = [F.round(c, 6).alias(c) for c in ("error_ratio_mean", "warn_ratio_mean", "unique_ratio_mean", "p99_distance")]
    return profile.select("service", "window_count", *rounded)


def window_template_means(spark, d):
    means, _ = an.window_profile(an.window_vectors(training(spark, d), CONFIG))
    return means.select("service", "template", F.round("mean", 6).alias("mean"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    rows = materialize(events(spark, d), "events")
    return an.score(rows, rows.filter(F.col("ts_ms") < SPLIT_MS), CONFIG)


def anomaly_scores(spark, d):
    return scored(spark, d).drop("reasons", "dataset").withColumn("template", F.md5("template"))


def anomaly_reasons(spark, d):
    return scored(spark, d).select("log_id", F.array_join("reasons", ",").alias("reasons"))


def anomaly_top(spark, d):
    return scored(spark, d).filter("final_score IS NOT NULL").orderBy(F.desc("final_score"), "log_id").limit(20).select("log_id", "service", "final_score", "decision")


def previous_template(spark, d):
    return an.with_previous(events(spark, d)).select("log_id", "stream", F.md5("prev").alias("prev"))


def anomaly_normal_only(spark, d):
    """Training rows of the mode that learns from normal levels only."""
    rows = events(spark, d).filter(F.col("level").isin(an.NORMAL_LEVELS))
    return rows.groupBy("service", "level").agg(F.count("*").alias("n"))


def baseline_scores(spark, d):
    """Scores against a baseline that was built, saved and loaded again."""
    path = scratch_path(spark, "baseline")
    rows = materialize(events(spark, d), "events")
    baseline.load_or_build(spark, path, rows.filter(F.col("ts_ms") < SPLIT_MS), CONFIG)
    columns = ["log_id", "anomaly_score", "anomaly_level", "anomaly_decision", "anomaly_baseline_status"]
    return baseline.enrich(rows, path).select(*columns)


def baseline_missing(spark, d):
    """What events carry where there is no baseline."""
    rows = baseline.enrich(events(spark, d), scratch_path(spark, "none"))
    return rows.select("log_id", "anomaly_score", "anomaly_level", "anomaly_decision", "anomaly_baseline_status", F.array_join("anomaly_reasons", ",").alias("reasons"))


def board_flags(spark, d):
    """What the board makes of every scored event."""
    rows = materialize(events(spark, d), "events")
    base = an.train(rows.filter(F.col("ts_ms") < SPLIT_MS), CONFIG)
    joined = rows.join(baseline.flattened(an.score(rows, base)), "log_id").withColumn("message", F.lit(""))
    return dashboard.flags(dashboard.board_records(joined)).select("log_id", "level", "service", "baseline_status", "index_status", "actionable", "signal", "rca_worthy")


def worker_order(spark, d):
    """Events in the order of the worker: by time, then by identifier; the place of each in its service."""
    rows = events(spark, d).withColumn("line_number", F.lit(0))
    return an.with_position(rows).select("log_id", "service", "pos")


_E = """
WITH once AS (SELECT log_id, min(dataset) AS dataset, min(service) AS service, min(component) AS component, min(template_id) AS template_id, min(level) AS level,
    min(timestamp) AS timestamp, min(nullif(nullif(lower(trim(request_id)), ''), '-')) AS request_id, min(host) AS host, min(line_number) AS line_number, min(raw_log) AS raw_log
  FROM anomaly_input GROUP BY log_id),
e AS (SELECT log_id, dataset, coalesce(nullif(trim(service), ''), nullif(trim(component), ''), dataset || '-service') AS service,
    coalesce(nullif(trim(template_id), ''), nullif(trim(raw_log), ''), 'unknown-template') AS template, coalesce(upper(nullif(trim(level), '')), 'UNKNOWN') AS level,
    (epoch_us(timestamp) // 1000)::bigint AS ts_ms, line_number,
    CASE WHEN request_id IS NOT NULL THEN 'request' WHEN nullif(trim(host), '') IS NOT NULL THEN 'host' ELSE 'service' END AS scope,
    CASE WHEN request_id IS NOT NULL THEN 'request:' || request_id WHEN nullif(trim(host), '') IS NOT NULL THEN 'host:' || trim(host)
      ELSE 'service:' || coalesce(nullif(trim(service), ''), nullif(trim(component), ''), dataset || '-service') END AS stream
  FROM once),
t AS (SELECT * FROM e WHERE ts_ms < 1751328000000),
ep AS (SELECT *, lag(template) OVER (PARTITION BY stream ORDER BY ts_ms, line_number, log_id) AS prev FROM e),
tp AS (SELECT *, lag(template) OVER (PARTITION BY stream ORDER BY ts_ms, line_number, log_id) AS prev FROM t),
tc AS (SELECT service, template, count(*)::bigint AS n FROM t GROUP BY ALL),
tr AS (SELECT service, prev, template AS cur, count(*)::bigint AS n FROM tp WHERE prev IS NOT NULL GROUP BY ALL),
vocab AS (SELECT service, count(*) AS v, sum(n)::bigint AS service_total, max(n) AS n_max FROM tc GROUP BY ALL),
pos AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY ts_ms, line_number, log_id) - 1 AS pos, count(*) OVER (PARTITION BY service) AS n FROM t),
win AS (SELECT service, w, template, level FROM (SELECT *, unnest(generate_series(0, ((n - 50) // 25)::bigint)) AS w FROM pos WHERE n >= 50) WHERE pos BETWEEN w * 25 AND w * 25 + 49),
per AS (SELECT service, w, template, count(*) / 50.0 AS ratio FROM win GROUP BY ALL),
whole AS (SELECT service, w, count(*) FILTER (level IN ('ERROR', 'CRITICAL', 'FATAL', 'ALERT', 'EMERG')) / 50.0 AS er, count(*) FILTER (level IN ('WARN', 'WARNING')) / 50.0 AS wr,
    count(DISTINCT template) / 50.0 AS ur FROM win GROUP BY ALL),
base AS (SELECT service, count(*)::bigint AS window_count, avg(er) AS erm, avg(wr) AS wrm, avg(ur) AS urm FROM whole GROUP BY ALL),
means AS (SELECT per.service, template, sum(ratio) / any_value(window_count) AS mean FROM per JOIN base USING (service) GROUP BY ALL),
msum AS (SELECT service, sum(mean) AS ms FROM means GROUP BY ALL),
near AS (SELECT per.service, w, sum(abs(ratio - mean) - mean) AS d FROM per JOIN means USING (service, template) GROUP BY ALL),
dist AS (SELECT near.service, w, d + ms + abs(er - erm) + abs(wr - wrm) + abs(ur - urm) AS dist FROM near JOIN whole USING (service, w) JOIN base USING (service) JOIN msum USING (service)),
prof AS (SELECT base.*, ms, p99 FROM base JOIN msum USING (service) JOIN (SELECT service, quantile_cont(dist, 0.99) AS p99 FROM dist GROUP BY ALL) USING (service))
"""
_S = (
    _E
    + """,
trail AS (SELECT log_id, list(template) OVER f AS wt, list(level) OVER f AS wl FROM e WINDOW f AS (PARTITION BY service ORDER BY ts_ms, line_number, log_id ROWS 49 PRECEDING)),
trow AS (SELECT log_id, len(wt) AS k, len(list_distinct(wt)) / 50.0 AS ur, len(list_filter(wl, lambda x: x IN ('ERROR', 'CRITICAL', 'FATAL', 'ALERT', 'EMERG'))) / 50.0 AS er,
    len(list_filter(wl, lambda x: x IN ('WARN', 'WARNING'))) / 50.0 AS wr FROM trail),
titem AS (SELECT log_id, service, template, count(*) / 50.0 AS r FROM (SELECT trail.log_id, e.service, unnest(wt) AS template FROM trail JOIN e USING (log_id)) GROUP BY ALL),
tgap AS (SELECT log_id, sum(abs(r - mean) - mean) AS g FROM titem JOIN means USING (service, template) GROUP BY ALL),
s1 AS (SELECT ep.*, tc.n AS tn, coalesce(v, 0) AS v, coalesce(service_total, 0) AS st, n_max FROM ep LEFT JOIN tc USING (service, template) LEFT JOIN vocab USING (service)),
s2 AS (SELECT *, (coalesce(tn, 0) + 0.5) / (st + 0.5 * (v + CASE WHEN tn IS NULL THEN 1 ELSE 0 END)) AS p FROM s1),
s3 AS (SELECT *, coalesce((n_max + 0.5) / (st + 0.5 * v), p) AS pm FROM s2),
s4 AS (SELECT *, greatest(0, least(1, (pm - p) / greatest(pm, 1e-6))) AS ts FROM s3),
pt AS (SELECT service, prev, sum(n) AS pn, max(n) AS pmx FROM tr GROUP BY ALL),
s5 AS (SELECT s4.*, pn, pmx, tr.n AS trn FROM s4 LEFT JOIN pt USING (service, prev) LEFT JOIN tr ON tr.service = s4.service AND tr.prev = s4.prev AND tr.cur = s4.template),
s6 AS (SELECT *, (coalesce(trn, 0) + 0.5) / (pn + 0.5 * (v + CASE WHEN tn IS NULL THEN 1 ELSE 0 END)) AS q, (pmx + 0.5) / (pn + 0.5 * v) AS qm FROM s5),
s7 AS (SELECT *, CASE WHEN prev IS NULL THEN 0.0 WHEN pn IS NULL THEN 1.0 ELSE greatest(0, least(1, (qm - q) / greatest(qm, 1e-6))) END AS xs FROM s6),
s8 AS (SELECT s7.*, coalesce(window_count >= 3, false) AS ready, k = 50 AS isfull, er, wr, ur, erm, wrm,
    greatest(0, least(1, (coalesce(g, 0) + ms + abs(er - erm) + abs(wr - wrm) + abs(ur - urm)) / greatest(p99, 1e-6))) AS ws0
  FROM s7 LEFT JOIN prof USING (service) JOIN trow USING (log_id) LEFT JOIN tgap USING (log_id)),
s9 AS (SELECT *, CASE WHEN ready AND isfull THEN ws0 ELSE 0.0 END AS ws, CASE WHEN scope = 'service' THEN 0.2 ELSE 0.35 END AS wx, CASE WHEN scope = 'service' THEN 0.4 ELSE 0.25 END AS ww FROM s8),
s AS (SELECT *, greatest(0, least(1, (0.4 * ts + wx * xs + ww * ws) / (0.4 + wx + ww))) AS f, st < 100 AS warming FROM s9)
"""
)
ORACLE = {
    "anomaly_template_counts": _E + "SELECT service, template, n FROM tc",
    "anomaly_transition_counts": _E + "SELECT service, prev, cur, n FROM tr",
    "anomaly_template_p99": _E + "SELECT service, round(quantile_cont(-ln((n + 0.5) / (service_total + 0.5 * v)), 0.99), 6) AS p99 FROM tc JOIN vocab USING (service) GROUP BY service",
    "anomaly_transition_p99": _E + """, pt AS (SELECT service, prev, sum(n) AS pn FROM tr GROUP BY ALL)
SELECT service, round(quantile_cont(-ln((n + 0.5) / (pn + 0.5 * v)), 0.99), 6) AS p99 FROM tr JOIN pt USING (service, prev) JOIN vocab USING (service) GROUP BY service""",
    "anomaly_window_profile": _E + "SELECT service, window_count, round(erm, 6) AS error_ratio_mean, round(wrm, 6) AS warn_ratio_mean, round(urm, 6) AS unique_ratio_mean, round(p99, 6) AS p99_distance FROM prof",
    "anomaly_window_template_means": _E + "SELECT service, template, round(mean, 6) AS mean FROM means",
    "anomaly_previous_template": _E + "SELECT log_id, stream, md5(prev) AS prev FROM ep",
    "anomaly_normal_only": _E + "SELECT service, level, count(*) AS n FROM e WHERE level IN ('INFO', 'NOTICE', 'DEBUG') GROUP BY ALL",
    "anomaly_scores": _S + """SELECT log_id, service, md5(template) AS template, scope, round(ts, 6) AS template_score, round(xs, 6) AS transition_score, round(ws, 6) AS window_score,
CASE WHEN NOT warming THEN round(f, 6) END AS final_score,
CASE WHEN warming THEN 'unknown' WHEN f >= 0.8 THEN 'high' WHEN f >= 0.6 THEN 'medium' WHEN f >= 0.4 THEN 'low' ELSE 'normal' END AS anomaly_level,
CASE WHEN warming THEN 'warming_up' WHEN f >= 0.8 THEN 'anomalous' WHEN f >= 0.4 THEN 'watch' ELSE 'normal' END AS decision,
CASE WHEN warming THEN 'insufficient_history' ELSE 'ready' END AS baseline_status FROM s""",
    "anomaly_reasons": _S + """SELECT log_id, array_to_string(list_filter([
CASE WHEN tn IS NULL THEN 'new_template_for_service' WHEN ts >= 0.8 THEN 'rare_template_for_service' END,
CASE WHEN prev IS NOT NULL AND pn IS NULL THEN 'new_previous_template_for_transition' END,
CASE WHEN prev IS NULL THEN NULL WHEN pn IS NULL OR trn IS NULL THEN 'new_template_transition' WHEN xs >= 0.8 THEN 'rare_template_transition' END,
CASE WHEN scope = 'service' AND (prev IS NULL OR pn IS NOT NULL) THEN 'service_level_transition_fallback' WHEN scope <> 'request' AND lower(dataset) = 'apache' AND prev IS NOT NULL AND pn IS NOT NULL THEN 'low_confidence_sequence_fallback' END,
CASE WHEN NOT ready THEN 'insufficient_window_history' WHEN NOT isfull THEN 'window_not_full' WHEN ws0 >= 0.7 THEN 'window_template_distribution_shift' END,
CASE WHEN ready AND isfull AND er > greatest(erm * 2, 0.1) THEN 'window_error_ratio_spike' END,
CASE WHEN ready AND isfull AND wr > greatest(wrm * 2, 0.1) THEN 'window_warn_ratio_spike' END,
CASE WHEN level IN ('ERROR', 'CRITICAL', 'FATAL', 'ALERT', 'EMERG') THEN 'error_severity_hint' WHEN level IN ('WARN', 'WARNING') THEN 'warn_severity_hint' END,
CASE WHEN warming THEN 'insufficient_service_history' END], lambda x: x IS NOT NULL), ',') AS reasons FROM s""",
    "baseline_scores": _S + """SELECT log_id, CASE WHEN NOT warming THEN round(f, 6) END AS anomaly_score, CASE WHEN warming THEN 'unknown' WHEN f >= 0.8 THEN 'high' WHEN f >= 0.6 THEN 'medium' WHEN f >= 0.4 THEN 'low' ELSE 'normal' END AS anomaly_level,
CASE WHEN warming THEN 'warming_up' WHEN f >= 0.8 THEN 'anomalous' WHEN f >= 0.4 THEN 'watch' ELSE 'normal' END AS anomaly_decision, CASE WHEN warming THEN 'insufficient_history' ELSE 'ready' END AS anomaly_baseline_status FROM s""",
    "baseline_missing": _E + "SELECT log_id, NULL::double AS anomaly_score, 'unknown' AS anomaly_level, 'warming_up' AS anomaly_decision, 'missing_baseline' AS anomaly_baseline_status, 'missing_baseline' AS reasons FROM e",
    "board_flags": _S + """SELECT log_id, CASE WHEN level IN ('ERROR', 'WARN', 'NOTICE', 'INFO', 'DEBUG') THEN level ELSE 'UNKNOWN' END AS level, service, CASE WHEN warming THEN 'insufficient_history' ELSE 'ready' END AS baseline_status, 'unknown' AS index_status,
NOT warming AND f >= 0.8 AS actionable, NOT warming AND f >= 0.4 AND f < 0.8 AS signal, NOT warming AND (f >= 0.8 OR (level = 'ERROR' AND round(f, 6) >= 0.6 AND (tn IS NULL OR (prev IS NOT NULL AND (pn IS NULL OR trn IS NULL)) OR (ready AND isfull AND er > greatest(erm * 2, 0.1))))) AS rca_worthy FROM s""",
    "worker_order": _E + "SELECT log_id, service, row_number() OVER (PARTITION BY service ORDER BY ts_ms, log_id) - 1 AS pos FROM e",
    "anomaly_top": _S + "SELECT log_id, service, round(f, 6) AS final_score, CASE WHEN f >= 0.8 THEN 'anomalous' WHEN f >= 0.4 THEN 'watch' ELSE 'normal' END AS decision FROM s WHERE NOT warming ORDER BY round(f, 6) DESC, log_id LIMIT 20",
}
QUERIES = {
    "anomaly_template_counts": template_counts, "anomaly_transition_counts": transition_counts, "anomaly_template_p99": template_p99,
    "anomaly_transition_p99": transition_p99, "anomaly_window_profile": window_profile, "anomaly_window_template_means": window_template_means,
    "anomaly_previous_template": previous_template, "anomaly_normal_only": anomaly_normal_only, "anomaly_scores": anomaly_scores,
    "anomaly_reasons": anomaly_reasons, "anomaly_top": anomaly_top, "baseline_scores": baseline_scores, "baseline_missing": baseline_missing, "worker_order": worker_order, "board_flags": board_flags,
}
