"""Queries of the template route, scopes and fallbacks, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from logstrata.operators import registry, retrieval, scopes
from logstrata.plans.engine_queries import _V
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


# the vectors stand for templates: every tenth is one, its label names the template a line belongs to
_T = _V + """, tpl AS (SELECT vec_id, 'T' || vec_id AS template_id, label, ['apache', 'openstack', 'hdfs'][label % 3 + 1] AS dataset, CASE WHEN label % 2 = 0 THEN 'c' || (label % 4) END AS component, ['INFO', 'ERROR'][label % 2 + 1] AS level, (vec_id * 7 % 500)::bigint AS occurrences FROM embeddings WHERE vec_id % 10 = 0),
hit AS (SELECT * FROM (SELECT x.query_id, tpl.vec_id, template_id, score, occurrences, row_number() OVER (PARTITION BY x.query_id ORDER BY score DESC, x.vec_id) AS rk FROM x JOIN tpl USING (vec_id)) WHERE rk <= 8),
cand AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, template_id)::int AS rank FROM (SELECT query_id, template_id, score, round(round(score, 6) + CASE WHEN query_id % 200 = 0 THEN -1 ELSE 1 END * CASE WHEN occurrences > 0 THEN least(ln(1 + occurrences) / 10, 0.08) ELSE 0 END + 0.05, 6) AS s FROM hit)),
ln AS (SELECT query_id, vec_id AS id, 'T' || (vec_id // 10 * 10) AS template_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk FROM x) WHERE rk <= 200)
"""


def _registry(spark, d):
    label = F.col("label")
    return table(spark, d, "embeddings").filter("vec_id % 10 = 0").select(
        "vec_id", F.concat(F.lit("T"), "vec_id").alias("template_id"), F.element_at(F.array(*[F.lit(x) for x in ("apache", "openstack", "hdfs")]), (label % 3 + 1).cast("int")).alias("dataset"),
        F.when(label % 2 == 0, F.concat(F.lit("c"), label % 4)).alias("component"), F.element_at(F.array(F.lit("INFO"), F.lit("ERROR")), (label % 2 + 1).cast("int")).alias("level"), (F.col("vec_id") * 7 % 500).alias("occurrences"), "embedding",
    )


def _queries(spark, d):
    return table(spark, d, "embeddings").filter("vec_id % 100 = 0")


def _candidates(spark, d):
    known = _registry(spark, d)
    hits = registry.search_templates(known, _queries(spark, d), 8).drop("rank").join(known.select("vec_id", "template_id", "occurrences"), "vec_id")
    question = F.when(F.col("query_id") % 200 == 0, "rare templates").otherwise("frequent templates")
    hits = hits.select("query_id", F.col("template_id").alias("id"), F.round("score", 6).alias("semantic_score"), "occurrences", question.alias("question"), F.lit("template_registry").alias("source"))
    return materialize(registry.rerank_templates(hits, 8), "candidates")


def _lines(spark, d):
    found = retrieval.vector_topk(table(spark, d, "embeddings"), _queries(spark, d), 200).drop("rank")
    return found.select("query_id", F.col("vec_id").alias("id"), F.concat(F.lit("T"), F.floor(F.col("vec_id") / 10) * 10).alias("template_id"), F.lit(None).cast("string").alias("candidate_id"), F.round("score", 6).alias("score"))


@query(_T + "SELECT query_id, template_id AS id, s AS score, rank FROM cand")
def template_candidates(spark, d):
    """Templates nearest to a query, frequent ones ahead unless rare ones are asked for."""
    return _candidates(spark, d).select("query_id", "id", "score", "rank")


@query(_T + "SELECT query_id, max(s) FILTER (rank = 1) >= 0.2 AND round(max(s) FILTER (rank = 1) - coalesce(max(s) FILTER (rank = 2), 0), 9) >= 0.01 AS applies FROM cand GROUP BY query_id")
def template_gate(spark, d):
    return registry.gate(_candidates(spark, d), 0.2, 0.01)


_CL = _T + ", cl AS (SELECT * FROM (SELECT ln.*, row_number() OVER (PARTITION BY ln.query_id, ln.template_id ORDER BY ln.score DESC, id)::int AS rank FROM ln JOIN cand ON cand.query_id = ln.query_id AND cand.template_id = ln.template_id) WHERE rank <= 3)"


@query(_CL + "SELECT query_id, id, template_id, score, rank, 'template_filtered' AS source FROM cl")
def template_lines(spark, d):
    """The best lines of every candidate template."""
    return registry.candidate_lines(_lines(spark, d), _candidates(spark, d), 3).select("query_id", "id", "template_id", "score", "rank", "source")


@query(_T + "SELECT ln.query_id, id, ln.template_id, round(0.65 * ln.score + 0.35 * coalesce(s, ln.score), 8) AS final FROM ln LEFT JOIN cand ON cand.query_id = ln.query_id AND cand.template_id = ln.template_id")
def child_rerank(spark, d):
    """Lines weighed with their template's score."""
    return registry.rerank_children(_lines(spark, d), _candidates(spark, d)).select("query_id", "id", "template_id", "final")


@query(_T + ", k AS (SELECT *, row_number() OVER (PARTITION BY query_id, template_id ORDER BY score DESC, id) AS nth FROM ln) SELECT query_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::int AS rank FROM k WHERE nth <= 2) WHERE rank <= 24")
def template_cap(spark, d):
    return registry.cap_per_template(_lines(spark, d), 2, 24).select("query_id", "id", "rank")


@query(_T + """, w AS (SELECT DISTINCT query_id, template_id FROM ln) SELECT query_id, template_id AS id, 'template_registry' AS source FROM cand
UNION ALL SELECT w.query_id, w.template_id, 'template_lookup' FROM w JOIN tpl USING (template_id) WHERE NOT EXISTS (FROM cand WHERE cand.query_id = w.query_id AND cand.template_id = w.template_id)""")
def template_enrichment(spark, d):
    """Templates of a query and of its lines."""
    none = spark.createDataFrame([], "candidate_id string")
    return registry.enrich_from_lines(_lines(spark, d), _candidates(spark, d), _registry(spark, d), none)


@query("""WITH tpl AS (SELECT 'T' || vec_id AS template_id, ['apache', 'openstack', 'hdfs'][label % 3 + 1] AS dataset, CASE WHEN label % 2 = 0 THEN 'c' || (label % 4) END AS component, ['INFO', 'ERROR'][label % 2 + 1] AS level FROM embeddings WHERE vec_id % 10 = 0),
f(query_id, ds, c, l) AS (VALUES (1, 'hdfs', 'c0', 'INFO'), (2, 'hdfs', 'c9', 'ERROR'), (3, 'apache', 'c2', 'FATAL'), (4, 'apache', 'c9', 'FATAL'), (5, NULL, NULL, 'ERROR')),
m AS (SELECT query_id, template_id, CASE WHEN (c IS NULL OR coalesce(component = c, false)) AND (l IS NULL OR level = l) THEN 1 WHEN l IS NULL OR level = l THEN 2 WHEN c IS NULL OR coalesce(component = c, false) THEN 3 ELSE 4 END AS tier FROM tpl JOIN f ON ds IS NULL OR dataset = ds)
SELECT query_id, tier, template_id FROM m QUALIFY tier = min(tier) OVER (PARTITION BY query_id)""")
def registry_relaxation(spark, d):
    """Templates behind filters that give way one by one."""
    filters = spark.createDataFrame([(1, "hdfs", "c0", "INFO"), (2, "hdfs", "c9", "ERROR"), (3, "apache", "c2", "FATAL"), (4, "apache", "c9", "FATAL"), (5, None, None, "ERROR")], "query_id int, dataset string, component string, level string")
    return registry.relaxed(_registry(spark, d), filters).select("query_id", "tier", "template_id")


# --- scopes ------------------------------------------------------------------------------
def _flat(spark, d):
    rows = table(spark, d, "log_records")
    return rows.select("seq", "log_id", "dataset", F.coalesce("component", F.concat("dataset", F.lit("-service"))).alias("service"), "component", "level", "message", F.unix_millis("ingested_at").alias("ts_ms"))


_F = "WITH f AS (SELECT seq, log_id, dataset, coalesce(component, dataset || '-service') AS service, component, level, message, (epoch_us(ingested_at) // 1000)::bigint AS ts_ms FROM log_records)\n"


@query(_F + "SELECT seq, log_id FROM f WHERE log_id = (SELECT max(log_id) FROM f)")
def log_lookup(spark, d):
    """The deliveries of one log."""
    flat = _flat(spark, d)
    (last,) = flat.agg(F.max("log_id")).first()
    return scopes.point(flat, last or "").select("seq", "log_id")


@query("SELECT seq, source_id FROM anomaly_candidate_logs WHERE dataset = 'hdfs' AND host = 'dn-01' ORDER BY ingested_at, log_id, seq LIMIT 50")
def log_search(spark, d):
    rows = table(spark, d, "anomaly_candidate_logs").withColumn("ts_ms", F.unix_micros("ingested_at"))
    return scopes.search(rows, 50, dataset="hdfs", source_id=None, host="dn-01").select("seq", "source_id")


@query(_F + "SELECT seq FROM f WHERE dataset = 'openstack' AND (service = 'bus.messaging' OR component = 'bus.messaging') AND upper(coalesce(level, 'UNKNOWN')) IN ('WARN', 'UNKNOWN')")
def investigation_scope(spark, d):
    return _flat(spark, d).filter(scopes.in_scope("openstack", "bus.messaging", ["warning", "unknown"])).select("seq")


_TERMS = " + ".join(f"3 * coalesce(contains(lower(service), '{t}'), false)::int + 2 * coalesce(contains(lower(message), '{t}'), false)::int" for t in ("consumer", "disconnected"))
_FALL = _F + f", s AS (SELECT *, {_TERMS} AS score FROM f)\n" + " UNION ALL ".join(
    f"SELECT * FROM (SELECT {k} AS ask, seq, {tier} AS tier FROM s WHERE {where} ORDER BY {order}ts_ms DESC, seq DESC LIMIT 30)"
    for k, tier, where, order in [(1, 1, "dataset = 'openstack' AND score > 0", "score DESC, "), (2, 2, "score > 0", "score DESC, "), (3, 3, "dataset = 'openstack' AND level IN ('ERROR')", "")]
)


@query(_FALL)
def local_fallback(spark, d):
    """Matches in scope, matches anywhere, newest rows: what three questions come to."""
    flat = _flat(spark, d)
    asks = [(1, ["consumer", "disconnected"], {"dataset": "openstack"}), (2, ["consumer", "disconnected"], {"dataset": "no-such"}), (3, [], {"dataset": "openstack", "levels": ["error"]})]
    out = None
    for k, terms, scope in asks:
        rows = scopes.fallback_rows(flat, terms, 30, **scope).select(F.lit(k).alias("ask"), "seq", "tier")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""WITH a AS (SELECT seq, log_id FROM log_records WHERE dataset = 'hdfs'), b AS (SELECT seq, log_id FROM log_records WHERE level = 'ERROR')
SELECT seq, log_id, 'context' AS side FROM a WHERE coalesce(trim(log_id) NOT IN (SELECT trim(log_id) FROM b WHERE trim(log_id) <> ''), true) UNION ALL SELECT seq, log_id, 'semantic' FROM b""")
def identity_union(spark, d):
    rows = table(spark, d, "log_records")
    context = rows.filter("dataset = 'hdfs'").select("seq", "log_id", F.lit("context").alias("side"))
    return scopes.upsert_by_identity(context, rows.filter("level = 'ERROR'").select("seq", "log_id", F.lit("semantic").alias("side")))


_ASKED = _TERMS.replace("consumer", "attach").replace("disconnected", "deadline")


@query(_F + f", s AS (SELECT *, {_ASKED} AS score FROM f) SELECT seq, score FROM s WHERE upper(coalesce(level, '')) IN ('ERROR', 'CRITICAL') AND score > 0 ORDER BY score DESC, ts_ms DESC, seq DESC LIMIT 1")
def question_incident(spark, d):
    """The incident a question is about."""
    return scopes.incident_of(_flat(spark, d).withColumn("anomaly_score", F.lit(0.0)), ["attach", "deadline"]).select("seq", "score")


@query("SELECT dataset, seq, rank FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY s DESC, seq)::int AS rank FROM (SELECT dataset, seq, round(len(list_intersect(['peer', 'closed', 'the', 'channel'], list_distinct(regexp_extract_all(lower(message), '[a-z0-9_]+')))) / 4.0 + 0.05 * coalesce(list_sum(list_transform(list_intersect(['peer', 'closed', 'the', 'channel'], list_distinct(regexp_extract_all(lower(message), '[a-z0-9_]+'))), lambda t: 1 / sqrt(length(t)))), 0) + 2.0 * coalesce(contains(lower(concat_ws(' ', raw_log, message)), '50010'), false)::int + 1.0 * coalesce(component = 'dfs.BlockNode', false)::int + 0.35 * len(list_intersect(['peer', 'closed', 'the', 'channel'], list_distinct(regexp_extract_all(lower(replace(coalesce(template_id, ''), '_', ' ')), '[a-z0-9_]+')))) + CASE upper(level) WHEN 'ERROR' THEN 0.2 WHEN 'WARN' THEN 0.1 ELSE 0 END + 0.05 * (seq - (SELECT min(seq) FROM log_records)) / (SELECT count(*) FROM log_records), 6) AS s FROM log_records)) WHERE rank <= 20")
def template_first(spark, d):
    """Lines by terms, entities, service, template, level and place in the stream."""
    rows = spread(table(spark, d, "log_records"))
    scored = retrieval.template_first_scores(rows, "seq", ["channel", "closed", "peer", "the"], ["50010"], ["dfs.BlockNode"])
    from logstrata.operators.ingest import top_per_group

    return top_per_group(scored, ["dataset"], [F.desc("score"), F.col("seq")], 20).select("dataset", "seq", "rank")
