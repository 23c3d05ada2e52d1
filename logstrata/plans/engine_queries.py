"""Queries of ingestion, text, root cause, rules, retrieval, metrics, board and audit operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logstrata.functions import text as tx
from logstrata.functions.ids import ident
from logstrata.operators import catalog, chunks, dashboard, ingest, metrics, rca, retrieval, rules
from logstrata.plans import line_sql
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


# --- ingestion ---------------------------------------------------------------------------
_SP = r"trim(regexp_replace(raw_log, '\s+', ' ', 'g'))"
_NORM = rf"""
WITH r AS (SELECT *, nullif({_SP}, '') AS raw, nullif(trim(timestamp), '') AS xts, nullif(trim(component), '') AS xc, nullif(trim(service), '') AS xs, nullif(trim(source), '') AS xsrc FROM anomaly_candidate_logs),
p AS (SELECT *,
  dataset = 'apache' AND regexp_matches(raw, '^\[([^\]]+)\]\s+\[([^\]]+)\]\s*(.*)$') AS a,
  dataset = 'openstack' AND regexp_matches(raw, '^(?:(\S+\.log(?:\.\S+)?)\s+)?(\d{{4}}-\d{{2}}-\d{{2}}\s+\d{{2}}:\d{{2}}:\d{{2}}(?:[.,]\d+)?)\s+(\d+)\s+([A-Z]+)\s+([A-Za-z0-9_.$-]+)\s*(.*)$') AS o,
  dataset = 'hdfs' AND regexp_matches(raw, '^(\d{{6}}\s+\d{{6}})\s+(\d+)\s+([A-Z]+)\s+([^:\s]+):\s*(.*)$') AS h FROM r),
f AS (SELECT *,
  CASE WHEN a THEN upper(regexp_extract(raw, '^\[([^\]]+)\]\s+\[([^\]]+)\]\s*(.*)$', 2))
    WHEN o THEN regexp_extract(raw, '^(?:(\S+\.log(?:\.\S+)?)\s+)?(\d{{4}}-\d{{2}}-\d{{2}}\s+\d{{2}}:\d{{2}}:\d{{2}}(?:[.,]\d+)?)\s+(\d+)\s+([A-Z]+)\s+([A-Za-z0-9_.$-]+)\s*(.*)$', 4)
    WHEN h THEN regexp_extract(raw, '^(\d{{6}}\s+\d{{6}})\s+(\d+)\s+([A-Z]+)\s+([^:\s]+):\s*(.*)$', 3)
    ELSE nullif(upper(regexp_extract(raw, '(?i)\b(DEBUG|INFO|NOTICE|WARN|WARNING|ERROR|ERR|FATAL|TRACE|CRITICAL|AUDIT)\b', 1)), '') END AS lv,
  CASE WHEN o THEN regexp_extract(raw, '^(?:(\S+\.log(?:\.\S+)?)\s+)?(\d{{4}}-\d{{2}}-\d{{2}}\s+\d{{2}}:\d{{2}}:\d{{2}}(?:[.,]\d+)?)\s+(\d+)\s+([A-Z]+)\s+([A-Za-z0-9_.$-]+)\s*(.*)$', 5)
    WHEN h THEN regexp_extract(raw, '^(\d{{6}}\s+\d{{6}})\s+(\d+)\s+([A-Z]+)\s+([^:\s]+):\s*(.*)$', 4) END AS pc,
  CASE WHEN a THEN trim(regexp_extract(raw, '^\[([^\]]+)\]\s+\[([^\]]+)\]\s*(.*)$', 3))
    WHEN o THEN trim(regexp_extract(raw, '^(?:(\S+\.log(?:\.\S+)?)\s+)?(\d{{4}}-\d{{2}}-\d{{2}}\s+\d{{2}}:\d{{2}}:\d{{2}}(?:[.,]\d+)?)\s+(\d+)\s+([A-Z]+)\s+([A-Za-z0-9_.$-]+)\s*(.*)$', 6))
    WHEN h THEN trim(regexp_extract(raw, '^(\d{{6}}\s+\d{{6}})\s+(\d+)\s+([A-Z]+)\s+([^:\s]+):\s*(.*)$', 5)) ELSE raw END AS msg FROM p),
n AS (SELECT seq, coalesce(nullif(trim(log_id), ''), trim(dataset) || ':' || substring(sha1(concat_ws(chr(10), trim(dataset), trim(source_id), coalesce(xsrc, ''), coalesce(xs, ''), coalesce(xc, ''), coalesce(xts, ''), raw)), 1, 20)) AS log_id,
  coalesce(xc, pc) AS component, coalesce(xs, xc, pc) AS service, coalesce(CASE upper(nullif(trim(level), '')) WHEN 'WARNING' THEN 'WARN' ELSE upper(nullif(trim(level), '')) END, CASE lv WHEN 'WARNING' THEN 'WARN' ELSE lv END) AS level,
  msg AS message, coalesce(nullif(trim(trace_id), ''), nullif(trim(request_id), ''), xc, xs, nullif(trim(source_id), ''), xsrc, 'unknown') AS pkey,
  CASE WHEN raw IS NULL THEN 'raw_log is required' WHEN nullif(trim(source_id), '') IS NULL THEN 'source_id is required' WHEN line_number < 1 THEN 'line_number must be positive' END AS error,
  kafka_partition, kafka_offset, xsrc FROM f)
"""


@query(_NORM + "SELECT seq, log_id, component, service, level, message FROM n WHERE error IS NULL")
def ingest_normalized(spark: SparkSession, d: str) -> DataFrame:
    accepted, _ = ingest.split_rejected(ingest.normalize(table(spark, d, "anomaly_candidate_logs")))
    return accepted.select("seq", "log_id", "component", "service", "level", "message")


_HURT = "CASE WHEN seq % 40 = 1 THEN '  ' ELSE raw_log END AS raw_log, CASE WHEN seq % 40 = 2 THEN 0 ELSE line_number END AS line_number, CASE WHEN seq % 40 = 3 THEN '' ELSE dataset END AS dataset, CASE WHEN seq % 40 = 4 THEN NULL ELSE source_id END AS source_id"


@query(f"""SELECT kafka_partition || ':' || kafka_offset AS key, CASE seq % 40 WHEN 1 THEN 'raw_log is required' WHEN 2 THEN 'line_number must be positive' WHEN 3 THEN 'dataset is required' ELSE 'source_id is required' END AS error
FROM (SELECT * REPLACE ({_HURT}) FROM anomaly_candidate_logs) WHERE trim(raw_log) = '' OR line_number < 1 OR dataset = '' OR source_id IS NULL""")
def ingest_rejected(spark, d):
    """What is rejected of records of which one in ten lacks something."""
    rows, n = table(spark, d, "anomaly_candidate_logs"), F.col("seq") % 40
    hurt = {"raw_log": (1, "  "), "line_number": (2, 0), "dataset": (3, ""), "source_id": (4, None)}
    damaged = rows.withColumns({c: F.when(n == k, F.lit(v)).otherwise(F.col(c)) for c, (k, v) in hurt.items()})
    _, rejected = ingest.split_rejected(ingest.normalize(damaged))
    return rejected.select("key", "error")


@query(_NORM + "SELECT seq, pkey AS partition_key FROM n")
def ingest_partition_key(spark, d):
    rows = table(spark, d, "anomaly_candidate_logs")
    return rows.select("seq", ingest.partition_key(rows).alias("partition_key"))


@query("""SELECT dataset || ':' || substring(sha1(concat_ws(chr(10), dataset, source_file, line_number::varchar, raw_log)), 1, 20) AS stable_id, seq FROM log_records WHERE raw_log IS NOT NULL""")
def stable_log_ids(spark, d):
    rows = table(spark, d, "log_records").filter("raw_log IS NOT NULL")
    return rows.select("seq", tx.stable_id(F.col("dataset"), F.col("source_file"), F.col("line_number"), F.col("raw_log")).alias("stable_id"))


@query("SELECT log_id, seq, level, component FROM (SELECT lower(trim(log_id)) AS log_id, seq, level, component, row_number() OVER (PARTITION BY lower(trim(log_id)) ORDER BY seq DESC) AS rn FROM log_records WHERE trim(log_id) <> '') WHERE rn = 1")
def upsert_last_wins(spark, d):
    rows = table(spark, d, "log_records").select(ident("log_id").alias("log_id"), "seq", "level", "component").filter("log_id IS NOT NULL")
    return ingest.last_wins(rows, "log_id", "seq").select("log_id", "seq", "level", "component")


@query("""WITH u AS (SELECT lower(trim(rec_id)) AS k, max(deleted_at) AS at FROM tombstones WHERE tbl = 'incidents' GROUP BY ALL),
b AS (SELECT incident_id, min(scenario_type) AS scenario_type FROM incidents GROUP BY ALL)
SELECT incident_id, scenario_type, CASE WHEN k IS NULL THEN 'indexed' ELSE 'deleted' END AS status FROM b LEFT JOIN u ON k = incident_id""")
def status_merge(spark, d):
    base = table(spark, d, "incidents").groupBy("incident_id").agg(F.min("scenario_type").alias("scenario_type")).withColumn("status", F.lit("indexed"))
    gone = table(spark, d, "tombstones").filter("tbl = 'incidents'").select(ident("rec_id").alias("incident_id")).distinct().withColumn("status", F.lit("deleted"))
    return ingest.merge_status(base, gone, "incident_id")


# --- text --------------------------------------------------------------------------------
_CATS = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{'|'.join(k)}') THEN '{c}'" for c, k in tx.CATEGORIES.items()) + " ELSE 'unknown' END"


@query(rf"""SELECT doc_id, CASE WHEN l = 'WARNING' THEN 'WARN' ELSE l END AS level, category FROM
(SELECT doc_id, nullif(upper(regexp_extract(text, '(?i)\b(DEBUG|INFO|NOTICE|WARN|WARNING|ERROR|ERR|FATAL|TRACE|CRITICAL|AUDIT)\b', 1)), '') AS l, {_CATS} AS category FROM documents)""")
def inferred_level_category(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", tx.infer_level(t).alias("level"), tx.infer_category(t).alias("category"))


@query(r"""SELECT seq, coalesce(nullif(regexp_extract(raw_log, '\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?'), ''), nullif(regexp_extract(raw_log, '\d{2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2}(?: [+-]\d{4})?'), ''),
nullif(regexp_extract(raw_log, '\d{6}\s+\d{6}'), '')) AS ts FROM log_records""")
def inferred_timestamp(spark, d):
    return table(spark, d, "log_records").select("seq", tx.infer_timestamp(F.col("raw_log")).alias("ts"))


@query(r"""SELECT seq, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '\bblk_-?\d+\b'))), ',') AS block_id, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '\b(?:\d{1,3}\.){3}\d{1,3}:\d+\b'))), ',') AS ip_port,
array_to_string(list_sort(list_distinct(regexp_extract_all(t, '\b(?:\d{1,3}\.){3}\d{1,3}\b'))), ',') AS ip FROM (SELECT seq, coalesce(raw_log, '') || ' ' || coalesce(message, '') AS t FROM log_records)""")
def entity_arrays(spark, d):
    text = F.concat(F.coalesce("raw_log", F.lit("")), F.lit(" "), F.coalesce("message", F.lit("")))
    e = spread(table(spark, d, "log_records")).select("seq", tx.entities(text).alias("e"))
    return e.select("seq", *[F.array_join(F.sort_array(f"e.{k}"), ",").alias(k) for k in ("block_id", "ip_port", "ip")])


_U = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


def _ordered(values: str) -> str:
    """Distinct values in the order of their first place, as text."""
    return f"array_to_string(list_filter({values}, lambda elem, place: list_position({values}, elem) = place), ',')"


_INSTANCE_SQL = rf"""WITH t AS (SELECT seq, coalesce(raw_log, '') || ' ' || coalesce(message, '') AS t FROM log_records),
a AS (SELECT seq, t, regexp_extract_all(t, '\breq-{_U}\b') AS r, list_concat(regexp_extract_all(t, '(?i)\[instance:\s*({_U})\]', 1), regexp_extract_all(t, '(?i)\binstance\s+({_U})\b', 1)) AS i,
  regexp_extract_all(t, '\b{_U}\b') AS u, regexp_extract_all(t, '\b[0-9a-fA-F]{{32}}\b') AS h, regexp_extract_all(t, '(?:^|\W)(/(?:[A-Za-z0-9._@%+=:,~-]+/)*[A-Za-z0-9._@%+=:,~-]+)', 1) AS p FROM t),
o AS (SELECT *, list_filter(u, lambda x: NOT list_contains(i, x) AND NOT list_contains(r, 'req-' || x)) AS other FROM a)
SELECT seq, {_ordered('r')} AS request_id, {_ordered('i')} AS instance_id, {_ordered('other')} AS uuid, {_ordered('h')} AS hex_id, {_ordered('p')} AS path FROM o"""


@query(_INSTANCE_SQL)
def entity_instances(spark, d):
    text = F.concat(F.coalesce("raw_log", F.lit("")), F.lit(" "), F.coalesce("message", F.lit("")))
    e = spread(table(spark, d, "log_records")).select("seq", tx.entities(text).alias("e"))
    return e.select("seq", *[F.array_join(f"e.{k}", ",").alias(k) for k in ("request_id", "instance_id", "uuid", "hex_id", "path")])


@query(f"SELECT seq, {line_sql.template('message')} AS template, {line_sql.embed_message('message')} AS embed_message FROM log_records")
def normalized_templates(spark, d):
    return spread(table(spark, d, "log_records")).select("seq", tx.normalize_template(F.col("message")).alias("template"), tx.sanitize(F.col("message")).alias("embed_message"))


_GROUPS = f"""WITH r AS (SELECT coalesce(dataset, '') AS dataset, coalesce(component, '') AS component, coalesce(level, '') AS level, {line_sql.template('message')} AS template, seq, log_id, message, raw_log, line_number, ingested_at FROM log_records),
g AS (SELECT *, 'template::' || dataset || '::' || substring(sha1(concat_ws(chr(31), dataset, component, level, template)), 1, 16) AS group_id FROM r)
"""


def _template_groups(spark, d):
    rows = spread(table(spark, d, "log_records"))
    return chunks.template_groups(rows.withColumn("template", tx.normalize_template(F.col("message"))), "seq")


@query(_GROUPS + "SELECT group_id, any_value(template) AS template, count(*) AS occurrences, min(line_number) AS first_line, max(line_number) AS last_line, (epoch_us(min(ingested_at)) // 1000)::bigint AS first_ms, (epoch_us(max(ingested_at)) // 1000)::bigint AS last_ms FROM g GROUP BY group_id")
def template_groups(spark, d):
    """Templates with their counts, line and time ranges."""
    groups, _, _, _ = _template_groups(spark, d)
    return groups.select("group_id", "template", "occurrences", "first_line", "last_line", F.unix_millis("first_at").alias("first_ms"), F.unix_millis("last_at").alias("last_ms"))


@query(_GROUPS + "SELECT group_id, rank, log_id, message FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY seq)::int AS rank FROM g) WHERE rank <= 5")
def template_samples(spark, d):
    """The first five lines of every template."""
    return _template_groups(spark, d)[1]


@query(_GROUPS + "SELECT group_id, log_id FROM g")
def template_members(spark, d):
    return _template_groups(spark, d)[2]


@query(_GROUPS + r"""SELECT DISTINCT group_id, kind, unnest(vals) AS value FROM (SELECT group_id, 'block_id' AS kind, regexp_extract_all(t, '\bblk_-?\d+\b') AS vals FROM (SELECT *, coalesce(raw_log, '') || ' ' || coalesce(message, '') AS t FROM g)
UNION ALL SELECT group_id, 'ip', regexp_extract_all(t, '\b(?:\d{1,3}\.){3}\d{1,3}\b') FROM (SELECT *, coalesce(raw_log, '') || ' ' || coalesce(message, '') AS t FROM g))""")
def template_entities(spark, d):
    """The distinct blocks and addresses named under every template."""
    return _template_groups(spark, d)[3].filter(F.col("kind").isin("block_id", "ip"))


@query()
def template_matches(spark, d):
    """Every message against a catalog compiled from all mined templates, first rule by number, else its own template."""
    logs = spread(table(spark, d, "log_records").select("seq", "dataset", "message"))
    rows = materialize(logs.withColumn("template", tx.normalize_template(F.col("message"))), "messages")
    found = catalog.match_templates(rows, catalog.compile_catalog(rows), "seq")
    return found.select("seq", F.concat("dataset", F.lit("::T"), "k").alias("template_id"))


# --- root cause --------------------------------------------------------------------------
def logs_v(spark, d):
    """The events table as flat log records."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARN").when(F.col("event_type") == "purchase", "NOTICE").otherwise("INFO")
    dataset = F.element_at(F.array(F.lit("apache"), F.lit("openstack"), F.lit("hdfs")), (F.col("event_id") % 3 + 1).cast("int"))
    return e.select(
        F.concat(F.lit("events:"), F.col("event_id")).alias("log_id"), dataset.alias("dataset"), F.concat(F.lit("svc-"), F.col("user_id") % 5).alias("service"), F.col("user_id").alias("session_id"),
        F.concat("event_type", F.lit(":"), k % 4).alias("template"), level.alias("level"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.least(F.col("value") / 490.02, F.lit(1.0)).alias("anomaly_score"),
    )


_L = """WITH l AS (SELECT 'events:' || event_id AS log_id, ['apache', 'openstack', 'hdfs'][event_id % 3 + 1] AS dataset, 'svc-' || (user_id % 5) AS service, user_id AS session_id,
  event_type || ':' || (json_extract_string(props, '$.k')::int % 4) AS template, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' WHEN 'purchase' THEN 'NOTICE' ELSE 'INFO' END AS level,
  (epoch_us(ts) // 1000)::bigint AS ts_ms, least(value / 490.02, 1.0) AS a FROM events),
i AS (SELECT * FROM l WHERE level = 'ERROR'),
p AS (SELECT i.log_id AS incident_log_id, l.log_id, l.ts_ms, l.a AS sa, greatest(0, 1 - (i.ts_ms - l.ts_ms) / 600000.0) AS st, CASE WHEN l.service = i.service THEN 1.0 ELSE 0.25 END AS ss,
  CASE WHEN l.template = i.template THEN 1.0 ELSE 0.0 END AS sm, CASE WHEN l.session_id = i.session_id THEN 1.0 ELSE 0.0 END AS se
  FROM l JOIN i ON l.dataset = i.dataset AND l.ts_ms BETWEEN i.ts_ms - 600000 AND i.ts_ms AND l.log_id <> i.log_id),
s AS (SELECT *, round(0.25 * sa + 0.2 * st + 0.15 * ss + 0.15 * sm + 0.25 * se, 6) AS rca_score, round(0.3 * sa + 0.25 * st + 0.2 * ss + 0.15 * sm, 3) AS score FROM p)
"""


def _incidents(logs):
    return logs.filter("level = 'ERROR'")


@query(_L + """SELECT incident_log_id, log_id, rank, ts_ms, rca_score, array_to_string(list_filter([CASE WHEN sa >= 0.6 THEN 'candidate_has_high_anomaly_score' END, CASE WHEN st > 0 THEN 'candidate_precedes_incident' END,
CASE WHEN ss >= 1 THEN 'same_service_or_component' END, CASE WHEN sm >= 1 THEN 'same_template' END, CASE WHEN se > 0 THEN 'shared_entity_or_session' END, CASE WHEN se = 0 AND ss > 0 THEN 'service_window_fallback' END], lambda x: x IS NOT NULL), ',') AS reasons
FROM (SELECT *, row_number() OVER (PARTITION BY incident_log_id ORDER BY rca_score DESC, ts_ms, log_id)::int AS rank FROM s WHERE rca_score > 0) WHERE rank <= 10""")
def rca_evidence(spark, d):
    logs = logs_v(spark, d)
    return rca.rank_evidence(logs, _incidents(logs))


@query(_L + "SELECT incident_log_id, log_id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY incident_log_id ORDER BY score DESC, log_id)::int AS rank FROM s WHERE rca_score > 0) WHERE rank <= 8")
def rca_dashboard(spark, d):
    logs = logs_v(spark, d)
    return rca.dashboard_scores(logs, _incidents(logs))


# --- rules -------------------------------------------------------------------------------
def _score_sql(c: str) -> str:
    p = rules.PROFILES[c]
    hit = lambda x: r"regexp_matches(t, '\bslow\b')::int" if x == "slow" else f"contains(t, '{x}')::int"
    total = lambda xs: "(" + " + ".join(map(hit, xs)) + ")"
    either = lambda xs: "(" + " OR ".join(f"contains(t, '{x}')" for x in xs) + ")"
    score, neg = f"(4 * {total(p.strong)} + {total(p.weak)} - 5 * {total(p.negative)})", total(p.negative)
    if c == "latency":
        score = f"({score} + CASE WHEN sec >= 10 THEN 7 WHEN sec >= 5 THEN 2 WHEN sec < 5 THEN -6 ELSE 0 END)"
        neg = f"({neg} + CASE WHEN sec < 5 THEN 1 ELSE 0 END)"
    if c == "storage":
        score = f"(CASE WHEN dataset = 'hdfs' AND (contains(t, 'blk_') OR contains(t, 'block')) THEN CASE WHEN {either(rules.BLOCK_ISSUES)} THEN {score} + 5 ELSE least({score}, 3) END ELSE {score} END)"
    if c == "service_unavailable":
        calm = f"({either(rules.LIFECYCLE)} AND NOT {either(rules.SERVICE_ISSUES)})"
        score, neg = f"({score} - CASE WHEN {calm} THEN 6 ELSE 0 END)", f"({neg} + {calm}::int)"
    if c == "unknown":
        score = f"({score} + CASE WHEN level IN ('ERROR', 'WARN', 'WARNING') THEN 2 ELSE 0 END)"
    return f"SELECT seq, '{c}' AS category, {score}::int AS score, {neg} AS neg, {p.positive_from} AS pf, {p.uncertain_from} AS uf FROM x"


_RULES = (
    "WITH x AS (SELECT *, nullif(regexp_extract(t, '\\btook\\s+([0-9]+(?:\\.[0-9]+)?)\\s+seconds?\\b', 1), '')::double AS sec FROM (SELECT seq, dataset, level, lower(concat_ws(' ', raw_log, message, component, level, event_id)) AS t FROM log_records)), s AS ("
    + " UNION ALL ".join(map(_score_sql, rules.PROFILES))
    + "), c AS (SELECT seq, category, score, CASE WHEN neg > 0 AND score < pf THEN 'hard_negative' WHEN score >= pf THEN 'positive' WHEN score >= uf THEN 'uncertain' ELSE 'none' END AS label FROM s) "
)


def _category_scores(spark, d):
    rows = spread(table(spark, d, "log_records"))
    return rules.category_scores(rows.withColumn("text", rules.log_text("raw_log", "message", "component", "level", "event_id")), "seq")


@query(_RULES + "SELECT seq, category, score, label FROM c")
def category_scores(spark, d):
    return _category_scores(spark, d)


@query(_RULES + "SELECT category, label, seq, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY category, label ORDER BY score DESC, seq)::int AS rank FROM c WHERE label <> 'none') WHERE rank <= CASE label WHEN 'positive' THEN 20 ELSE 10 END")
def category_top_labels(spark, d):
    return rules.top_labels(_category_scores(spark, d), "seq", {"positive": 20, "uncertain": 10, "hard_negative": 10}).select("category", "label", "seq", "score", "rank")


@query(_RULES + "SELECT category, label, count(*) AS n FROM c GROUP BY ALL")
def category_label_counts(spark, d):
    return _category_scores(spark, d).groupBy("category", "label").agg(F.count("*").alias("n"))


# --- retrieval ---------------------------------------------------------------------------
_V = """WITH q AS (SELECT vec_id AS query_id, embedding AS qe FROM embeddings WHERE vec_id % 100 = 0),
x AS (SELECT query_id, vec_id, label, list_dot_product(qe::double[], embedding::double[]) AS score FROM q, embeddings)
"""


@query(_V + "SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::int AS rank FROM x) WHERE rank <= 10")
def vector_topk(spark, d):
    e = table(spark, d, "embeddings")
    return retrieval.vector_topk(e, e.filter("vec_id % 100 = 0"), 10).withColumn("score", F.round("score", 6))


_HITS = _V + """, h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM x) WHERE rn <= 50),
f AS (SELECT *, round(0.85 * greatest(0, least(1, score)) + 0.15 * CASE WHEN max(vec_id) OVER g > min(vec_id) OVER g THEN (vec_id - min(vec_id) OVER g) / (max(vec_id) OVER g - min(vec_id) OVER g)::double ELSE 0 END, 6) AS final FROM h WINDOW g AS (PARTITION BY query_id, label)),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY final DESC, vec_id DESC, score DESC) AS k FROM f) WHERE k <= 3)
"""


def _hits(spark, d, k=50):
    e = table(spark, d, "embeddings")
    top = retrieval.vector_topk(e, e.filter("vec_id % 100 = 0"), k).drop("rank")
    return top.join(e.select("vec_id", F.col("label").alias("grp")), "vec_id").select("query_id", F.col("vec_id").alias("id"), "grp", "score", F.col("vec_id").alias("ts"))


@query(_HITS + "SELECT query_id, vec_id AS id, label AS grp, final, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, vec_id DESC)::int AS rank FROM c) WHERE rank <= 24")
def vector_grouped_recency(spark, d):
    return retrieval.rerank_groups(_hits(spark, d)).select("query_id", "id", "grp", "final", "rank")


@query(_V + ", u AS (SELECT query_id, vec_id, max(round(score, 6)) AS score FROM x WHERE label = 1 OR label = 2 GROUP BY ALL) SELECT query_id, vec_id AS id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::int AS rank FROM u) WHERE rank <= 15")
def vector_filtered_merged(spark, d):
    e = table(spark, d, "embeddings")
    part = lambda label: retrieval.vector_topk(e.filter(F.col("label") == label), e.filter("vec_id % 100 = 0"), 15).select("query_id", F.col("vec_id").alias("id"), F.round("score", 6).alias("score"))
    return retrieval.merge_best(part(1), part(2), limit=15)


_GROUPED = _HITS + ", gr AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY top DESC, label) AS g FROM (SELECT *, max(final) OVER (PARTITION BY query_id, label) AS top FROM c))"


@query(_GROUPED + " SELECT query_id, vec_id AS id, label AS grp, final FROM gr WHERE g <= 2")
def vector_top_groups(spark, d):
    """The best lines of the two best groups of every query."""
    return retrieval.top_groups(retrieval.rerank_groups(_hits(spark, d), limit=10_000), 2).select("query_id", "id", "grp", "final")


QUERY_BANK = [
    ("q01", "upstream gave no answer"), ("q02", "worker initialisation aborted"), ("q03", "lease revoked"), ("q04", "backend reports not ready"), ("q05", "peer closed the channel"), ("q06", "volume is detached"),
    ("q07", "consumer disconnected"), ("q08", "damaged chunks found in scan"), ("q09", "segment lags"), ("q10", "order refused ledger unreachable"), ("q11", "spawn gave up no network port"), ("q12", "pool sessions used up"),
]
_LEX = "WITH qs AS (SELECT * FROM (VALUES " + ", ".join(f"('{i}', {sorted(set(q.split()))})" for i, q in QUERY_BANK) + r""") v(query_id, terms)),
lg AS (SELECT seq, log_id, coalesce(template_id, '') AS template, list_distinct(regexp_extract_all(lower(message), '[a-z0-9_]+')) AS toks FROM log_records),
o AS (SELECT query_id, log_id, template, seq, len(terms) AS n, list_intersect(terms, toks) AS ov FROM qs, lg),
sc AS (SELECT query_id, log_id, template, seq, round(len(ov)::double / n + 0.05 * list_sum(list_transform(ov, lambda t: 1 / sqrt(length(t)))), 6) AS score FROM o WHERE len(ov) > 0)
"""


def _lexical(spark, d):
    logs = spread(table(spark, d, "log_records")).select("seq", "log_id", F.coalesce("template_id", F.lit("")).alias("template"), F.col("message").alias("text"))
    return retrieval.lexical_scores(logs, QUERY_BANK)


@query(_LEX + "SELECT query_id, seq, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq)::int AS rank FROM sc) WHERE rank <= 20")
def lexical_topk(spark, d):
    return ingest.top_per_group(_lexical(spark, d), ["query_id"], [F.desc("score"), F.col("seq")], 20).select("query_id", "seq", "score", "rank")


@query(_LEX + ", nth AS (SELECT *, row_number() OVER (PARTITION BY query_id, template ORDER BY score DESC, seq) AS k FROM sc) SELECT query_id, seq, template, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (k > 3)::int, score DESC, seq)::int AS rank FROM nth) WHERE rank <= 10")
def lexical_diversified(spark, d):
    return retrieval.diversify(_lexical(spark, d)).select("query_id", "seq", "template", "score", "rank")


# --- metrics -----------------------------------------------------------------------------
def _results(spark, d):
    inc = table(spark, d, "incidents").groupBy("incident_id").agg(*[F.min(c).alias(c) for c in ("incident_log_id", "root_cause_log_id", "evidence_log_ids")])
    hits = table(spark, d, "rca_candidates").select("incident_id", "log_id", "template_id", "rca_score")
    top = ingest.top_per_group(hits, ["incident_id"], [F.desc_nulls_last("rca_score"), F.col("log_id")], 10)
    lists = top.groupBy("incident_id").agg(F.sort_array(F.collect_list(F.struct("rank", "log_id", "template_id"))).alias("r"))
    joined = inc.join(lists, "incident_id", "left")
    none = F.array().cast("array<string>")
    evidence = F.array_distinct(F.coalesce("evidence_log_ids", none))
    root = ident("root_cause_log_id")
    gains = F.map_from_entries(F.array_distinct(F.transform(evidence, lambda x: F.struct(x, F.when(x == root, 3.0).otherwise(2.0)))))
    return joined.select(
        F.col("incident_id").alias("query_id"), F.coalesce(F.transform("r", lambda x: x["log_id"]), none).alias("retrieved"), F.coalesce(F.transform("r", lambda x: x["template_id"]), none).alias("templates"),
        evidence.alias("expected"), gains.alias("relevance"), root.alias("root"), "incident_log_id",
    )


_M = """WITH inc AS (SELECT incident_id, min(incident_log_id) AS il, nullif(lower(trim(min(root_cause_log_id))), '') AS root, list_distinct(coalesce(min(evidence_log_ids), [])) AS ev FROM incidents GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY rca_score DESC NULLS LAST, log_id) AS rk FROM rca_candidates) WHERE rk <= 10),
r AS (SELECT inc.*, rk, log_id, template_id FROM inc LEFT JOIN top USING (incident_id)),
ideal AS (SELECT incident_id, sum(g / log2(n + 1)) AS idcg FROM (SELECT incident_id, g, row_number() OVER (PARTITION BY incident_id ORDER BY g DESC) AS n FROM (SELECT incident_id, CASE WHEN x = root THEN 3.0 ELSE 2.0 END AS g FROM (SELECT incident_id, root, unnest(ev) AS x FROM inc))) WHERE n <= 5 GROUP BY ALL),
m AS (SELECT incident_id, any_value(root) AS root, any_value(il) AS il, any_value(ev) AS ev, coalesce(1.0 / min(rk) FILTER (list_contains(ev, log_id)), 0.0) AS mrr, count(*) FILTER (rk <= 5 AND list_contains(ev, log_id)) AS hits, any_value(len(ev)) AS ne,
  coalesce(sum(CASE WHEN rk <= 5 AND list_contains(ev, log_id) THEN CASE WHEN log_id = root THEN 3.0 ELSE 2.0 END / log2(rk + 1) END), 0) AS d, count(DISTINCT template_id) FILTER (rk <= 5 AND template_id <> '') AS ut, count(template_id) FILTER (rk <= 5 AND template_id <> '') AS nt,
  coalesce(1.0 / min(rk) FILTER (log_id = root), 0.0) AS rm, coalesce(bool_or(log_id = root) FILTER (rk <= 5), false) AS rh, coalesce(list(log_id) FILTER (rk <= 5), []) AS got FROM r GROUP BY ALL),
pq AS (SELECT incident_id AS query_id, round(mrr, 6) AS mrr, (hits > 0)::int::double AS hit, round(CASE WHEN ne = 0 THEN 0 ELSE hits / ne END, 6) AS recall, round(hits / 5.0, 6) AS precision, round(CASE WHEN idcg > 0 THEN d / idcg ELSE 0 END, 6) AS ndcg,
  ut::double AS unique_templates, round(CASE WHEN nt > 0 THEN 1 - ut / nt ELSE 0 END, 6) AS duplicate_template_ratio, CASE WHEN root IS NOT NULL THEN round(rm, 6) END AS root_mrr, CASE WHEN root IS NOT NULL THEN rh::int::double END AS root_hit,
  round(CASE WHEN ne = 0 THEN 1 ELSE hits / ne END, 6) AS evidence_recall, CASE WHEN root IS NULL THEN 0.0 ELSE list_has_all(got, list_distinct(list_append(ev, il)))::int::double END AS chain_complete FROM m LEFT JOIN ideal USING (incident_id))
"""


@query(_M + "SELECT * FROM pq")
def retrieval_metrics(spark, d):
    return metrics.per_query(_results(spark, d), 5)


@query(_M + "SELECT count(*) AS n_queries, count(root_mrr) AS n_root, " + ", ".join(f"round(coalesce(avg({c}), 0), 6) AS {c}" for c in ("mrr", "hit", "recall", "precision", "ndcg", "unique_templates", "duplicate_template_ratio", "root_mrr", "root_hit", "evidence_recall", "chain_complete")) + " FROM pq")
def retrieval_metrics_macro(spark, d):
    return metrics.macro(metrics.per_query(_results(spark, d), 5))


_AM = """WITH t AS (SELECT log_id, bool_or(expected_anomaly) AS e, min(expected_score_range[1]) AS lo, max(expected_score_range[2]) AS hi, list_distinct(list_sort(min(signals))) AS sg FROM anomalies GROUP BY ALL),
p AS (SELECT log_id, max(rca_score) AS s, list_distinct(max(reasons)) AS rs FROM rca_candidates WHERE rca_score IS NOT NULL GROUP BY ALL),
j AS (SELECT *, coalesce(s >= 0.5, false) AS pr FROM t LEFT JOIN p USING (log_id)),
c AS (SELECT count(*) AS evaluated, count(*) FILTER (e AND pr) AS tp, count(*) FILTER (NOT e AND pr) AS fp, count(*) FILTER (e AND NOT pr) AS fn, count(*) FILTER (NOT e AND NOT pr) AS tn, count(*) FILTER (s BETWEEN lo AND hi) AS ir,
  avg(CASE WHEN len(list_distinct(list_concat(sg, coalesce(rs, [])))) = 0 THEN 1.0 ELSE len(list_intersect(sg, coalesce(rs, []))) / len(list_distinct(list_concat(sg, coalesce(rs, []))))::double END) FILTER (e) AS ov FROM j),
z AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS pp, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS rr FROM c)
SELECT evaluated, (SELECT count(*) FROM p WHERE log_id NOT IN (SELECT log_id FROM t)) AS unknown_predictions, tp, fp, fn, tn, round(pp, 6) AS precision, round(rr, 6) AS recall, round(CASE WHEN pp + rr > 0 THEN 2 * pp * rr / (pp + rr) ELSE 0 END, 6) AS f1,
round(CASE WHEN fp + tn = 0 THEN 0 ELSE fp / (fp + tn) END, 6) AS false_positive_rate, round(CASE WHEN fn + tp = 0 THEN 0 ELSE fn / (fn + tp) END, 6) AS false_negative_rate, round((tp + tn) / evaluated, 6) AS accuracy, round(ir / evaluated, 6) AS score_range_agreement, round(ov, 6) AS signal_overlap FROM z"""


@query(_AM)
def anomaly_metrics(spark, d):
    truth = table(spark, d, "anomalies").groupBy("log_id").agg(
        F.bool_or("expected_anomaly").alias("expected"), F.min(F.get("expected_score_range", F.lit(0))).alias("low"), F.max(F.get("expected_score_range", F.lit(1))).alias("high"), F.array_distinct(F.min("signals")).alias("signals")
    )
    predictions = table(spark, d, "rca_candidates").filter("rca_score IS NOT NULL").groupBy("log_id").agg(F.max("rca_score").alias("score"), F.array_distinct(F.max("reasons")).alias("reasons"))
    return metrics.anomaly_metrics(truth, predictions, 0.5)


# --- board -------------------------------------------------------------------------------
_B = r"""WITH b AS (SELECT log_id, seq, dataset, coalesce(nullif(trim(component), ''), 'unknown') AS service, CASE WHEN lv IN ('ERROR', 'WARN', 'NOTICE', 'INFO', 'DEBUG') THEN lv ELSE 'UNKNOWN' END AS level, ts_ms FROM
(SELECT *, CASE l0 WHEN 'WARNING' THEN 'WARN' ELSE l0 END AS lv FROM (SELECT *, upper(regexp_replace(trim(level), '^[\[\]]+|[\[\]]+$', '', 'g')) AS l0, (epoch_us(ingested_at) // 1000)::bigint AS ts_ms FROM log_records))),
tf AS (SELECT strftime(make_timestamp((ts_ms // 300000) * 300000000), '%Y-%m-%d %H:%M') AS bd, level, count(*) AS n FROM b GROUP BY ALL),
tm AS (SELECT substring(bd, 12, 5) AS bucket, level, sum(n)::bigint AS n FROM tf GROUP BY ALL)
"""


def board(spark, d):
    return dashboard.board_view(table(spark, d, "log_records"), "ingested_at")


@query(_B + "SELECT count(*) AS total, count(*) FILTER (level = 'ERROR') AS errors, count(*) FILTER (level = 'WARN') AS warns, count(DISTINCT nullif(service, 'unknown')) AS services, round(count(*) FILTER (level = 'ERROR') * 1000 / count(*)) / 10 AS error_percent, max(ts_ms) AS latest_ms FROM b")
def board_summary(spark, d):
    return dashboard.summary(board(spark, d))


@query(_B + "SELECT bucket, level, n FROM tm")
def board_traffic(spark, d):
    return dashboard.traffic(board(spark, d))


@query(_B + "SELECT bd AS bucket, level, n FROM tf")
def board_traffic_by_day(spark, d):
    return dashboard.traffic(board(spark, d), by_day=True)


@query(_B + "SELECT bd AS bucket, coalesce(sum(n) FILTER (level = 'INFO'), 0)::bigint AS info, coalesce(sum(n) FILTER (level = 'WARN'), 0)::bigint AS warn, coalesce(sum(n) FILTER (level = 'ERROR'), 0)::bigint AS error FROM tf GROUP BY bd ORDER BY bd DESC LIMIT 13")
def board_traffic_pivot(spark, d):
    return dashboard.traffic_pivot(board(spark, d))


@query(_B + ", w AS (SELECT bucket, sum(n) AS t, coalesce(sum(n) FILTER (level = 'ERROR'), 0) AS e, coalesce(sum(n) FILTER (level = 'WARN'), 0) AS w FROM tm GROUP BY bucket) SELECT bucket, round(250 + t * 12 + e * 180 + w * 45)::bigint AS latency_ms, least(99, floor(25 + t * 0.35 + e * 7 + w * 2 + 0.5))::bigint AS cpu_percent FROM w")
def board_resources(spark, d):
    return dashboard.resources(board(spark, d))


@query(_B + "SELECT service, count(*) AS n, arg_max(log_id, seq) AS log_id, arg_max(level, seq) AS level, arg_max(ts_ms, seq) AS ts_ms FROM b GROUP BY service")
def board_service_last(spark, d):
    return dashboard.service_last(board(spark, d))


@query(_B + "SELECT * FROM b ORDER BY ts_ms DESC, seq DESC LIMIT 100")
def board_recent(spark, d):
    return dashboard.recent(board(spark, d))


@query(_B + ", z AS (SELECT *, (make_timestamptz(ts_ms * 1000) AT TIME ZONE 'Asia/Ho_Chi_Minh')::date AS day FROM b) SELECT log_id, seq, dataset, service, level, ts_ms FROM z WHERE day = (SELECT max(day) FROM z)")
def board_local_day(spark, d):
    return dashboard.local_day(board(spark, d))


@query(_B + "SELECT * FROM b WHERE ts_ms >= (SELECT max(ts_ms) FROM b) - 24 * 3600000 ORDER BY ts_ms DESC, seq DESC LIMIT 5")
def board_recent_window(spark, d):
    return dashboard.recent_window(board(spark, d), 24)


_BV = "WITH bv AS (SELECT seq, log_id, dataset, coalesce(nullif(trim(component), ''), 'unknown') AS service, CASE WHEN lv IN ('ERROR', 'WARN', 'NOTICE', 'INFO', 'DEBUG') THEN lv ELSE 'UNKNOWN' END AS level, (epoch_us(ingested_at) // 1000)::bigint AS ts_ms FROM (SELECT *, CASE upper(trim(trim(level), '[]')) WHEN 'WARNING' THEN 'WARN' ELSE upper(trim(trim(level), '[]')) END AS lv FROM log_records)) "


@query(_BV + "SELECT seq, level FROM bv WHERE dataset = 'hdfs' AND level IN ('ERROR', 'UNKNOWN')")
def board_filtered(spark, d):
    return dashboard.filtered(board(spark, d), "hdfs", "all", ["ERROR", "UNKNOWN"]).select("seq", "level")


@query(_BV + "SELECT seq FROM bv ORDER BY ts_ms DESC, seq DESC LIMIT 200")
def board_newest(spark, d):
    """A day without rows shows the newest ones."""
    return dashboard.day_or_newest(board(spark, d), 4_000_000_000_000).select("seq")


@query(_BV + ", b AS (SELECT strftime(make_timestamp(ts_ms // 300000 * 300000000), '%Y-%m-%d %H:%M') AS bucket, count(*) FILTER (level = 'ERROR') AS error FROM bv WHERE ts_ms IS NOT NULL GROUP BY 1) SELECT bucket, error FROM (SELECT * FROM b ORDER BY bucket DESC LIMIT 13) ORDER BY error DESC, bucket LIMIT 1")
def board_spike(spark, d):
    return dashboard.spike(dashboard.traffic_pivot(board(spark, d)))


@query(_BV + "SELECT DISTINCT service FROM bv")
def board_services(spark, d):
    return dashboard.distinct_values(board(spark, d), "service")


@query(_BV + "SELECT service, arg_max(log_id, seq) AS log_id, arg_max(level, seq) AS level FROM bv GROUP BY service ORDER BY min(seq) LIMIT 10")
def board_service_map(spark, d):
    return dashboard.service_map(board(spark, d))


# --- audit -------------------------------------------------------------------------------
_FIELDS = ["component", "level", "event_id", "template_id", "host", "request_id", "timestamp", "message"]


@query("SELECT dataset, field, n, missing, round(missing / n, 6) AS null_rate FROM (" + " UNION ALL ".join(f"SELECT dataset, '{c}' AS field, count(*) AS n, count(*) FILTER ({c} IS NULL OR trim({c}) = '') AS missing FROM log_records GROUP BY dataset" for c in _FIELDS) + ")")
def field_presence(spark, d):
    counts = [F.count_if(F.col(c).isNull() | (F.trim(c) == "")).alias(c) for c in _FIELDS]
    wide = table(spark, d, "log_records").groupBy("dataset").agg(F.count("*").alias("n"), *counts)
    return wide.unpivot(["dataset", "n"], _FIELDS, "field", "missing").withColumn("null_rate", F.round(F.col("missing") / F.col("n"), 6))


@query("""SELECT a.query_id, count(*) AS n FROM (SELECT query_id, unnest(list_distinct(positive_log_ids)) AS x FROM qrels) a JOIN (SELECT query_id, unnest(list_distinct(hard_negative_log_ids)) AS x FROM qrels) b ON a.query_id = b.query_id AND a.x = b.x GROUP BY ALL""")
def qrel_overlap(spark, d):
    """Judgments that are positive and hard negative at once."""
    both = table(spark, d, "qrels").select("query_id", F.explode(F.array_intersect("positive_log_ids", "hard_negative_log_ids")).alias("x")).filter("x IS NOT NULL")
    return both.groupBy("query_id").agg(F.count("*").alias("n"))


@query("""SELECT source_file, count(*) AS n_backwards FROM (SELECT source_file, ingested_at < lag(ingested_at) OVER (PARTITION BY source_file ORDER BY line_number) AS back FROM
(SELECT source_file, line_number, min(ingested_at) AS ingested_at FROM log_records GROUP BY ALL)) WHERE back GROUP BY ALL""")
def order_violations(spark, d):
    """Files whose lines were ingested out of order, in blocks of lines."""
    from pyspark.sql.window import Window

    from logstrata.operators.blocks import carry

    once = table(spark, d, "log_records").groupBy("source_file", "line_number").agg(F.min("ingested_at").alias("at")).withColumn("block", F.floor(F.col("line_number") / 4096))
    once = carry(once, ["source_file"], "block", {"last": F.max(F.struct("line_number", "at"))}, {"prior": ("last", "last")})
    before = F.coalesce(F.lag("at").over(Window.partitionBy("source_file", "block").orderBy("line_number")), F.col("prior.at"))
    return once.withColumn("back", F.col("at") < before).filter("back").groupBy("source_file").agg(F.count("*").alias("n_backwards"))


@query("""SELECT dataset, tier, n FROM (SELECT dataset, tier, count(*) AS n, min(tier) OVER (PARTITION BY dataset) AS best FROM (SELECT dataset, CASE WHEN component IS NOT NULL AND level IS NOT NULL THEN 1 WHEN level IS NOT NULL THEN 2 WHEN component IS NOT NULL THEN 3 ELSE 4 END AS tier FROM log_records) GROUP BY dataset, tier) WHERE tier = best""")
def filter_relaxation(spark, d):
    """The strictest filter tier that has rows, per dataset."""
    tier = F.when(F.col("component").isNotNull() & F.col("level").isNotNull(), 1).when(F.col("level").isNotNull(), 2).when(F.col("component").isNotNull(), 3).otherwise(4)
    counts = table(spark, d, "log_records").groupBy("dataset", tier.alias("tier")).agg(F.count("*").alias("n"))
    best = counts.groupBy("dataset").agg(F.min(F.struct("tier", "n")).alias("b"))
    return best.select("dataset", "b.tier", "b.n")
