"""Queries of weak labels, their audit, and validation, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from logstrata.operators import metrics, qrels, rules, validation
from logstrata.plans.catalog_queries import _sql
from logstrata.plans.engine_queries import _RULES
from logstrata.session import materialize, spread, table

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


BANK = [
    ("q1", "openstack", "timeout", None, None, "easy", "calls that ran into the deadline"), ("q2", "openstack", "network", None, "ERROR", "medium", "network and port errors"), ("q3", "openstack", "storage", "cinder.array.manager", None, "easy", "volume attach trouble"),
    ("q4", "hdfs", "storage", None, None, "hard", "blocks that could not be served"), ("q5", "hdfs", "connection", "dfs.BlockNode", "ERROR", "medium", "peers that closed the channel"), ("q6", "hdfs", "unknown", None, None, "hard", "anything odd"),
    ("q7", "apache", "permission", None, None, "easy", "denied clients"), ("q8", "apache", "service_unavailable", None, "CRITICAL", "medium", "workers down or gone"), ("q9", "online", "latency", None, None, "easy", "slow orders"),
    ("q10", "online", "connection", "no.such.component", None, "easy", "nothing fits"), ("q11", "openstack", "database", None, None, "medium", "pool sessions used up"),
]
_BANK = "(VALUES " + ", ".join(f"({', '.join(map(_sql, q))})" for q in BANK) + ") b(query_id, dataset, category, component, level, difficulty, question)"
_PAIRS = _RULES + f""", lg AS (SELECT seq, dataset, component, level, line_number, raw_log, message FROM log_records),
oth AS (SELECT a.seq, a.category, max(o.score) AS other FROM c a JOIN c o ON o.seq = a.seq AND o.category <> a.category GROUP BY ALL),
pr AS (SELECT b.query_id, b.category, b.component AS qc, b.level AS ql, lg.*, c.score, c.label, oth.other, (b.component IS NULL OR coalesce(b.component = lg.component, false)) AND (b.level IS NULL OR coalesce(b.level = lg.level, false)) AS inside
  FROM {_BANK} JOIN lg ON lg.dataset = b.dataset JOIN c ON c.seq = lg.seq AND c.category = b.category JOIN oth ON oth.seq = lg.seq AND oth.category = b.category),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, coalesce(component, ''), coalesce(level, ''), coalesce(line_number, 0), seq)::int AS rank FROM pr WHERE inside AND label <> 'none') WHERE rank <= CASE label WHEN 'positive' THEN 20 ELSE 10 END),
ctx AS (SELECT query_id, list(DISTINCT component) FILTER (label = 'positive' AND component <> '') AS comps, list(DISTINCT level) FILTER (label = 'positive' AND level <> '') AS levels, count(*) FILTER (label = 'hard_negative') AS have, list(seq) FILTER (label = 'hard_negative') AS hard FROM kept GROUP BY ALL),
rs AS (SELECT pr.*, coalesce(have, 0) AS have, CASE WHEN qc = component THEN 50 WHEN list_contains(comps, component) THEN 35 ELSE 0 END + CASE WHEN ql = pr.level THEN 20 WHEN list_contains(levels, pr.level) THEN 10 ELSE 0 END AS shared
  FROM pr LEFT JOIN ctx USING (query_id) WHERE label <> 'positive' AND NOT coalesce(list_contains(hard, pr.seq), false)),
more AS (SELECT query_id, 'hard_negative' AS label, (rk + have)::int AS rank, seq, total AS score FROM (SELECT *, shared + other AS total, row_number() OVER (PARTITION BY query_id ORDER BY shared + other DESC, coalesce(component, ''), coalesce(level, ''), coalesce(line_number, 0), seq) AS rk FROM rs WHERE shared > 0 OR other >= 2) WHERE rk + have <= 10),
qr AS (SELECT query_id, label, rank, seq, score FROM kept UNION ALL SELECT * FROM more)
"""


def _labels(spark, d):
    return materialize(qrels.qrels(spread(table(spark, d, "log_records")), BANK), "labels")


@query(_PAIRS + "SELECT query_id, label, rank, seq, score FROM qr")
def qrel_labels(spark, d):
    """Positives, uncertain rows and hard negatives of every query of the bank."""
    return qrels.qrels(spread(table(spark, d, "log_records")), BANK)


@query(_PAIRS + f""", n AS (SELECT b.*, count(*) FILTER (qr.label = 'positive') AS p, count(*) FILTER (qr.label = 'uncertain') AS u, count(*) FILTER (qr.label = 'hard_negative') AS h FROM {_BANK} LEFT JOIN qr USING (query_id) GROUP BY ALL),
w AS (SELECT *, concat_ws(';', CASE WHEN category = 'unknown' THEN 'category unknown' END, CASE WHEN difficulty = 'hard' THEN 'hard query' END, CASE WHEN p = 0 THEN 'no positive above v2 threshold' WHEN p < 3 THEN 'too few positives' END,
  CASE WHEN u > 0 THEN 'has uncertain candidates' END, CASE WHEN h < 3 THEN 'too few hard negatives' END, CASE WHEN regexp_matches(lower(question), ' and | or | và | hoặc |cùng lúc|trước sau') THEN 'multi-clause query' END) AS reasons FROM n)
SELECT query_id, CASE WHEN p = 0 OR category = 'unknown' THEN 'auto_candidate' WHEN component IS NOT NULL OR level IS NOT NULL THEN 'template_rule' ELSE 'keyword_rule' END AS label_source, reasons <> '' AS needs_review, reasons FROM w""")
def qrel_reviews(spark, d):
    return qrels.reviews(_labels(spark, d), BANK)


@query(_PAIRS + """, n AS (SELECT query_id, category, count(*) AS total, count(*) FILTER (inside) AS filtered, count(*) FILTER (inside AND label IN ('positive', 'uncertain')) AS candidates FROM pr GROUP BY ALL)
SELECT query_id, filtered, candidates, concat_ws(';', CASE WHEN category = 'unknown' THEN 'unknown category uses ERROR/WARN-only fallback' END, CASE WHEN filtered = 0 THEN 'filter matches no logs' END, CASE WHEN candidates = 0 THEN 'no candidate logs found' END,
  CASE WHEN candidates > 0 AND candidates / CASE WHEN filtered > 0 THEN filtered ELSE total END >= 0.7 THEN 'candidate set is broad' WHEN candidates >= 500 THEN 'candidate set is large' END) AS reasons FROM n""")
def query_bank_report(spark, d):
    return qrels.bank_report(qrels.scored_pairs(spread(table(spark, d, "log_records")), BANK))


_ALONE = _RULES.replace("lower(concat_ws(' ', raw_log, message, component, level, event_id))", "lower(concat_ws(' ', coalesce(raw_log, ''), coalesce(message, ''), '', ''))").replace("SELECT seq, dataset, level, lower", "SELECT seq, dataset, '' AS level, lower")


@query("WITH p AS (SELECT query_id, seq FROM (" + _PAIRS + "SELECT * FROM qr) WHERE label = 'positive'), alone AS (" + _ALONE + """SELECT c.*, x.sec, x.t, x.dataset FROM c JOIN x USING (seq)),
r AS (SELECT b.query_id, b.category, p.seq, CASE WHEN b.category = 'latency' AND sec < 5 THEN 'latency false positive' WHEN b.category = 'latency' AND sec < 10 THEN 'latency uncertain'
  WHEN b.category = 'service_unavailable' AND regexp_matches(t, 'vm stopped|vm started|lifecycle event|completed successfully') THEN 'service_unavailable false positive: normal lifecycle event'
  WHEN b.category = 'storage' AND alone.dataset = 'hdfs' AND label <> 'positive' THEN 'storage false positive risk: block-only or normal storage event' WHEN b.category = 'unknown' THEN 'broad unknown positive: generic error/warn/exception requires review'
  WHEN label <> 'positive' THEN 'v2 scoring would mark as ' || label END AS reason FROM p JOIN """ + _BANK + """ USING (query_id) JOIN alone ON alone.seq = p.seq AND alone.category = b.category)
SELECT query_id, category, seq, reason FROM r WHERE reason IS NOT NULL""")
def qrel_suspicions(spark, d):
    """Positives that their own text does not bear out."""
    bank = spark.createDataFrame([(q[0], q[2]) for q in BANK], "query_id string, category string")
    rows = _labels(spark, d).filter("label = 'positive'").join(F.broadcast(bank), "query_id")
    return qrels.suspicions(rows.join(table(spark, d, "log_records").select("seq", "dataset", "raw_log", "message"), "seq"))


_STORAGE = rules.PROFILES["storage"]
_HITS = ", ".join(f"('{m}', '{m.lstrip('~')}')" for m in [*_STORAGE.strong, *[f"~{w}" for w in _STORAGE.weak]])


@query(f"SELECT m AS pattern, count(*) AS n FROM log_records, (VALUES {_HITS}) v(m, w) WHERE contains(lower(concat_ws(' ', raw_log, message, component, level, event_id)), w) GROUP BY m")
def pattern_frequency(spark, d):
    """How many logs show each storage pattern."""
    return qrels.pattern_counts(spread(table(spark, d, "log_records")), "storage")


@query(_PAIRS + """, a AS (SELECT query_id, seq, label FROM kept), z AS (SELECT query_id, seq, CASE WHEN label = 'uncertain' THEN 'positive' ELSE label END AS label FROM kept WHERE label <> 'hard_negative')
SELECT coalesce(a.query_id, z.query_id) AS query_id, coalesce(a.seq, z.seq) AS seq, a.label AS old, z.label AS new FROM a FULL JOIN z ON a.query_id = z.query_id AND a.seq = z.seq WHERE a.label IS DISTINCT FROM z.label""")
def qrel_comparison(spark, d):
    """A label set against one in which uncertain rows are positives and hard negatives are dropped."""
    labels = _labels(spark, d)
    direct = qrels.scored_pairs(table(spark, d, "log_records"), BANK).filter("inside AND label = 'hard_negative'").select(F.col("q.query_id").alias("query_id"), "seq")
    own = labels.join(direct, ["query_id", "seq"], "left_semi").filter("label = 'hard_negative'").unionByName(labels.filter("label <> 'hard_negative'"))
    other = labels.filter("label <> 'hard_negative'").withColumn("label", F.lit("positive"))
    return qrels.compare(own, other)


# --- validation --------------------------------------------------------------------------
_BLANK = lambda c: f"CASE WHEN coalesce({c}, '') = '' THEN '{c} must be a non-empty string' END"


def _errors(table_: str, key: str, checks: list[str]) -> str:
    return f"SELECT {key}, concat_ws(';', {', '.join(checks)}) AS errors FROM {table_}"


@query(_errors("log_records", "seq", ["CASE WHEN NOT coalesce(dataset IN ('apache', 'openstack', 'hdfs'), false) THEN 'unknown dataset' END", *map(_BLANK, ("log_id", "raw_log", "message", "source_file")), "CASE WHEN NOT coalesce(line_number >= 1, false) THEN 'line_number must be a positive integer' END"]))
def log_record_errors(spark, d):
    return validation.log_errors(table(spark, d, "log_records")).select("seq", F.array_join("errors", ";").alias("errors"))


_LIST = lambda c: f"CASE WHEN {c} IS NULL OR len(list_filter({c}, lambda x: coalesce(x, '') = '')) > 0 THEN '{c} must be a list of non-empty strings' END"


@query(_errors("qrels", "query_id", [_BLANK("query_id"), _LIST("positive_log_ids"), _LIST("hard_negative_log_ids"), "CASE WHEN NOT coalesce(label_source IN ('auto_candidate', 'template_rule', 'keyword_rule', 'human_reviewed'), false) THEN 'unknown label_source' END", "CASE WHEN needs_review IS NULL THEN 'needs_review must be a boolean' END"]))
def qrel_record_errors(spark, d):
    return validation.qrel_errors(table(spark, d, "qrels")).select("query_id", F.array_join("errors", ";").alias("errors"))


@query(_errors("anomalies", "anomaly_id", [_BLANK("anomaly_id"), _BLANK("log_id"), "CASE WHEN expected_anomaly IS NULL THEN 'expected_anomaly must be boolean' END", "CASE WHEN NOT coalesce(expected_severity IN ('none', 'low', 'medium', 'high'), false) THEN 'invalid expected_severity' END",
    "CASE WHEN NOT coalesce(len(expected_score_range) = 2 AND expected_score_range[1] >= 0 AND expected_score_range[1] <= expected_score_range[2] AND expected_score_range[2] <= 1, false) THEN 'invalid expected_score_range' END", "CASE WHEN signals IS NULL THEN 'missing list field: signals' END"]))
def anomaly_record_errors(spark, d):
    return validation.anomaly_errors(table(spark, d, "anomalies")).select("anomaly_id", F.array_join("errors", ";").alias("errors"))


_IN = lambda c: f"coalesce(list_contains(coalesce(evidence_log_ids, []), {c}), false)"
_INCIDENT = _errors("incidents", "incident_id", [
    _BLANK("incident_id"), "CASE WHEN NOT coalesce(scenario_type IN ('explicit_root_cause', 'silent_root_cause'), false) THEN 'invalid scenario_type' END", _BLANK("incident_log_id"), "CASE WHEN evidence_log_ids IS NULL THEN 'missing list field: evidence_log_ids' END",
    f"CASE WHEN coalesce(incident_log_id, '') <> '' AND NOT {_IN('incident_log_id')} THEN 'incident_log_id must be included in evidence_log_ids' END", "CASE WHEN scenario_type = 'explicit_root_cause' AND coalesce(root_cause_log_id, '') = '' THEN 'explicit incident must have exactly one root_cause_log_id' END",
    f"CASE WHEN scenario_type = 'explicit_root_cause' AND coalesce(root_cause_log_id, '') <> '' AND NOT {_IN('root_cause_log_id')} THEN 'root_cause_log_id must be included in evidence_log_ids' END",
    "CASE WHEN scenario_type = 'silent_root_cause' AND root_cause_log_id IS NOT NULL THEN 'silent incident must not have root_cause_log_id' END", _BLANK("root_cause_summary")])


@query(_INCIDENT)
def incident_record_errors(spark, d):
    return validation.incident_errors(table(spark, d, "incidents")).select("incident_id", F.array_join("errors", ";").alias("errors"))


@query(f"SELECT error, count(*) AS n FROM (SELECT unnest(string_split(errors, ';')) AS error FROM ({_INCIDENT}) WHERE errors <> '') GROUP BY error")
def incident_error_report(spark, d):
    return validation.report(validation.incident_errors(table(spark, d, "incidents")))


@query("SELECT incident_id, count(*) AS n FROM incidents WHERE incident_id <> '' GROUP BY 1 HAVING count(*) > 1")
def repeated_incidents(spark, d):
    return validation.repeated(table(spark, d, "incidents"), "incident_id")


@query("""WITH l AS (SELECT log_id, min(ingested_at) AS came FROM log_records GROUP BY 1), i AS (SELECT incident_id, min(scenario_type) AS st, min(incident_log_id) AS il, min(root_cause_log_id) AS rl, min(evidence_log_ids) AS ev FROM incidents GROUP BY 1),
e AS (SELECT incident_id, k, came FROM (SELECT incident_id, unnest(ev) AS log_id, unnest(range(len(ev))) AS k FROM i) LEFT JOIN l USING (log_id)),
o AS (SELECT incident_id, list(came ORDER BY k) AS ats, count(*) FILTER (came IS NULL) AS lost FROM e GROUP BY 1)
SELECT incident_id, 'evidence chain is not time ordered' AS error FROM o WHERE lost = 0 AND ats <> list_sort(ats)
UNION ALL SELECT incident_id, 'root cause occurs after incident log' FROM i JOIN l r ON r.log_id = rl JOIN l n ON n.log_id = il WHERE st = 'explicit_root_cause' AND r.came > n.came""")
def incident_chain_errors(spark, d):
    """Evidence out of order of its arrival, and root causes that arrived after their incident."""
    logs = table(spark, d, "log_records").groupBy("log_id").agg(F.min("ingested_at").alias("at"))
    rows = table(spark, d, "incidents")
    once = rows.groupBy("incident_id").agg(*[F.min(c).alias(c) for c in ("scenario_type", "incident_log_id", "root_cause_log_id", "evidence_log_ids")])
    return validation.chain_errors(once, logs)


# --- predictions -------------------------------------------------------------------------
_SEVERE = "CASE WHEN seq % 7 = 0 THEN NULL WHEN level IN ('ERROR', 'CRITICAL') THEN 'high' WHEN level = 'WARN' THEN 'medium' ELSE 'none' END"


def _predictions(spark, d):
    severe = F.when(F.col("seq") % 7 == 0, F.lit(None)).when(F.col("level").isin("ERROR", "CRITICAL"), "high").when(F.col("level") == "WARN", "medium").otherwise("none")
    return table(spark, d, "log_records").select("log_id", severe.alias("severity"), "seq")


@query("SELECT log_id, count(*) AS n FROM log_records GROUP BY 1 HAVING count(*) > 1")
def predictions_repeated(spark, d):
    return metrics.repeated_predictions(_predictions(spark, d))


@query(f"WITH p AS (SELECT log_id, arg_min({_SEVERE}, seq) AS severity FROM (SELECT *, min(seq) OVER (PARTITION BY log_id) AS f FROM log_records) WHERE seq = f GROUP BY 1) SELECT expected_severity, coalesce(severity, 'none') AS severity, count(*) AS n FROM anomalies LEFT JOIN p USING (log_id) GROUP BY ALL")
def severity_agreement(spark, d):
    """Expected against predicted severities."""
    first = _predictions(spark, d).groupBy("log_id").agg(F.min_by(F.struct("severity"), "seq").alias("s")).select("log_id", "s.severity")
    return metrics.severity_agreement(table(spark, d, "anomalies"), first)


@query("SELECT incident_id AS query_id, count(*) AS n FROM rca_candidates WHERE incident_id NOT IN (SELECT incident_id FROM incidents WHERE scenario_type = 'explicit_root_cause' AND incident_id IS NOT NULL) GROUP BY 1")
def results_of_unknown_queries(spark, d):
    """Results that belong to no query with an explicit cause."""
    asked = table(spark, d, "incidents").filter("scenario_type = 'explicit_root_cause'").select(F.col("incident_id").alias("query_id"))
    results = table(spark, d, "rca_candidates").withColumnRenamed("incident_id", "query_id")
    return metrics.unknown_queries(results, asked).groupBy("query_id").agg(F.count("*").alias("n"))
