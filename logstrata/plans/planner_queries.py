"""Planned retrieval, contexts, pending templates and answer checks, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logstrata.operators import chunks, planner
from logstrata.session import table

QUESTIONS = [
    "show the latest ERROR logs of hdfs", "newest WARN logs of openstack at 10.1.2.3", "latest critical logs of apache", "why does Hdfs report blk_-4517 and req-1a2b3c4d?", "tóm tắt lỗi OpenStack gần đây",
    "http status 503 from apache", "show me 503 recent logs", "máy ảo 550e8400-e29b-41d4-a716-446655440000 bị lỗi", "tìm log của 550e8400-e29b-41d4-a716-446655440000", "connection to 999.1.1.1 and 10.0.0.5 reset, INFO",
    "who reads /srv/data/part-7.img on openstack?", "latest logs", "newest notice about leases", "",
]
LINES = ["L01", "L02", "L03"]


def _logs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "log_records")
    return rows.select("log_id", "seq", "dataset", "level", "component", "message", F.coalesce("template_id", F.lit("")).alias("template"), F.unix_millis("ingested_at").alias("ts_ms"))


def _plans(spark: SparkSession, first: int | None = None) -> DataFrame:
    return planner.plan_questions(spark.createDataFrame(list(enumerate(QUESTIONS[:first])), "question_id int, question string"))


def question_plans(spark: SparkSession, d: str) -> DataFrame:
    """The plans of questions in two languages."""
    return _plans(spark).drop("question")


def planned_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """The rows of all planned questions; an address no row has widens the second."""
    rows = planner.execute(_plans(spark), _logs(spark, d).withColumn("log_id", F.format_string("%012d", "seq")))
    return rows.select("question_id", "seq", "tier")


# the plan is read from the questions here as well, by other means: accents by DuckDB, identifiers by patterns over the whole text
_Q = "(VALUES " + ", ".join(f"({k}, '{q}')" for k, q in enumerate(QUESTIONS)) + ") v(question_id, question)"
_UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
_PLANS = f"""
WITH q AS (SELECT question_id, trim(question) AS question, replace(strip_accents(lower(trim(question))), 'đ', 'd') AS p FROM {_Q}),
e AS (SELECT *, nullif(regexp_extract(p, '\\breq-[0-9a-f-]{{8,}}'), '') AS request_id, nullif(regexp_extract(p, '\\bblk_-?[0-9]+'), '') AS block_id,
  nullif(regexp_extract(p, '(?:instance|vm|server|may ao|may chu) ({_UUID})', 1), '') AS instance_id,
  list_filter(regexp_extract_all(p, '[0-9]+(?:[.][0-9]+){{3}}'), lambda x: list_max(list_transform(string_split(x, '.'), lambda y: y::int)) < 256)[1] AS ip,
  try_cast(nullif(regexp_extract(p, '(?:status|http|code|ma loi)[ :=]+([1-5][0-9][0-9])\\b', 1), '') AS int) AS http_status,
  nullif(regexp_extract(question, '(?:^|[^\\w/])(/[\\w./-]*\\w)', 1), '') AS path,
  CASE WHEN regexp_matches(p, 'apache') THEN 'apache' WHEN regexp_matches(p, 'openstack') THEN 'openstack' WHEN regexp_matches(p, 'hdfs') THEN 'hdfs' END AS dataset,
  CASE WHEN regexp_matches(p, '\\bcritical\\b') THEN 'CRITICAL' WHEN regexp_matches(p, '\\berror\\b') THEN 'ERROR' WHEN regexp_matches(p, '\\bwarn(ing)?\\b') THEN 'WARN' WHEN regexp_matches(p, '\\binfo\\b') THEN 'INFO'
    WHEN regexp_matches(p, '\\bnotice\\b') THEN 'NOTICE' WHEN regexp_matches(p, '\\bdebug\\b') THEN 'DEBUG' END AS level,
  regexp_matches(p, 'latest|recent|newest|gan day|moi nhat|last logs') AS newest_first,
  CASE WHEN regexp_matches(p, 'summar|overview|recap|tong hop|tom tat') THEN 'summary' WHEN regexp_matches(p, 'root cause|rca|why|debug|diagnos|vi sao|tai sao|nguyen nhan|giai thich') THEN 'root_cause'
    WHEN regexp_matches(p, 'find|search|show|list|trace|tim|liet ke|truy van') THEN 'search_log' ELSE 'general' END AS answer_mode FROM q),
plans AS (SELECT *, NOT newest_first OR coalesce(request_id, block_id, instance_id, ip, http_status::varchar, path) IS NOT NULL
  OR len(list_filter(regexp_extract_all(p, '[a-z_][a-z0-9_.$-]{{2,}}'), lambda w: NOT list_contains([{', '.join(f"'{w}'" for w in planner.NO_SUBJECT)}], w))) > 0 AS by_meaning FROM e)
"""
_QUESTION_PLANS = _PLANS + "SELECT question_id, answer_mode, dataset, level, NULL::varchar AS component, request_id, block_id, instance_id, ip, http_status, path, newest_first, by_meaning FROM plans"
_RETRIEVAL = _PLANS + """, hits AS (SELECT question_id, seq, epoch_us(ingested_at) // 1000 AS ts,
    CASE WHEN coalesce(block_id, instance_id, ip, http_status::varchar, path, plans.request_id) IS NULL THEN 1 ELSE 2 END AS tier
  FROM plans JOIN log_records l ON (plans.dataset IS NULL OR l.dataset = plans.dataset) AND (plans.level IS NULL OR l.level = plans.level))
SELECT question_id, seq, tier FROM hits QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY ts DESC, seq) <= 24"""


def retrieval_context(spark: SparkSession, d: str) -> DataFrame:
    rows = planner.execute(_plans(spark, 3), _logs(spark, d).withColumn("log_id", F.format_string("%012d", "seq")))
    return planner.context(rows).select("question_id", "line_id", "template_ref", F.col("log_id").cast("bigint").alias("seq"), "message")


_CONTEXT = f"""WITH h AS ({_RETRIEVAL}), r AS (SELECT h.question_id, l.seq, l.message, nullif(trim(l.template_id), '') AS t, (epoch_us(l.ingested_at) // 1000) AS ts FROM h JOIN log_records l USING (seq) WHERE h.question_id < 3),
n AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY ts, seq) AS n FROM r), f AS (SELECT question_id, t, row_number() OVER (PARTITION BY question_id ORDER BY min(n)) AS k FROM n WHERE t IS NOT NULL GROUP BY question_id, t)
SELECT question_id, 'L' || lpad(n::varchar, 2, '0') AS line_id, CASE WHEN k IS NOT NULL THEN 'T' || lpad(k::varchar, 2, '0') END AS template_ref, seq, message FROM n LEFT JOIN f USING (question_id, t)"""


def pending_templates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates from the messages of rows without a template, one row per log."""
    rows = _logs(spark, d).groupBy(F.lower(F.trim("log_id")).alias("id")).agg(F.min_by(F.struct("dataset", "message", "template"), "seq").alias("r")).select("r.*")
    masked = F.regexp_replace(F.lower("message"), "[0-9]+", "<num>")
    return planner.pending_templates(rows.filter("template = ''").select("dataset", masked.alias("template")))


_PENDING = """WITH o AS (SELECT arg_min(dataset, seq) AS dataset, regexp_replace(lower(arg_min(message, seq)), '[0-9]+', '<num>', 'g') AS template, arg_min(coalesce(template_id, ''), seq) AS tid FROM log_records GROUP BY lower(trim(log_id)))
SELECT 'pending:' || substring(sha1(dataset || chr(10) || template), 1, 16) AS candidate_id, dataset, template, count(*) AS occurrences FROM o WHERE tid = '' AND trim(template) <> '' GROUP BY dataset, template"""


def pending_search(spark: SparkSession, d: str) -> DataFrame:
    return planner.search_pending(pending_templates(spark, d), "volume is detached from hdfs").select("candidate_id", "score", "occurrences")


_PENDING_SEARCH = f"""SELECT candidate_id, round(least(1.0, ov / 5.0 + least(occurrences, 20) / 200.0), 6) AS score, occurrences FROM (SELECT *, len(list_intersect(['detached', 'from', 'hdfs', 'is', 'volume'],
list_distinct(regexp_extract_all(lower(dataset || ' ' || template), '[a-zA-Z0-9_.$:-]+')))) AS ov FROM ({_PENDING})) WHERE ov > 0 ORDER BY score DESC, candidate_id LIMIT 8"""


def answer_checks(spark: SparkSession, d: str) -> DataFrame:
    """Ticket texts of the documents, taken as answers with a citation that depends on their length."""
    cite = F.element_at(F.array(*[F.lit(x) for x in (" [L01]", " [L02][L77]", "", " [L03] [T01]", " [L9]")]), (F.length("text") % 5 + 1).cast("int"))
    answers = table(spark, d, "documents").select(F.col("doc_id").alias("answer_id"), F.concat("text", cite).alias("answer"))
    return planner.check_answer(answers, LINES).select("answer_id", F.array_join("problems", ";").alias("problems"))


_ANSWERS = """WITH a AS (SELECT doc_id AS answer_id, text || [' [L01]', ' [L02][L77]', '', ' [L03] [T01]', ' [L9]'][(length(text) % 5 + 1)::int] AS answer FROM documents),
c AS (SELECT *, list_sort(list_filter(list_distinct(regexp_extract_all(answer, '\\[(L[0-9]+)\\]', 1)), lambda x: x NOT IN ('L01', 'L02', 'L03'))) AS bad, regexp_matches(answer, '\\[L[0-9]+\\]') AS cited,
  replace(strip_accents(lower(answer)), 'đ', 'd') AS p FROM a)
SELECT answer_id, concat_ws(';', CASE WHEN len(bad) > 0 THEN 'invalid line citations: ' || array_to_string(bad, ',') END, CASE WHEN regexp_matches(answer, '\\[T[0-9]+\\]') THEN 'template cited as evidence' END,
  CASE WHEN NOT cited AND regexp_matches(p, 'nguyen nhan|kha nang|ket luan|cho thay|do |vi |loi|bat thuong|root cause|cause|likely') AND NOT regexp_matches(p, 'chua du bang chung|khong du bang chung|khong tim thay|insufficient evidence|not enough evidence')
    THEN 'conclusion without citation' END) AS problems FROM c"""

QUERIES = {"question_plans": question_plans, "planned_retrieval": planned_retrieval, "retrieval_context": retrieval_context, "pending_templates": pending_templates, "pending_search": pending_search, "answer_checks": answer_checks}
ORACLE = {
    "question_plans": _QUESTION_PLANS,
    "planned_retrieval": _RETRIEVAL,
    "retrieval_context": _CONTEXT,
    "pending_templates": _PENDING,
    "pending_search": _PENDING_SEARCH,
    "answer_checks": _ANSWERS,
}


def local_rank(spark: SparkSession, d: str) -> DataFrame:
    return chunks.local_rank(_logs(spark, d), ["blocknode", "volume", "detached"], 50).select("seq", "score")


_LOCAL = """SELECT seq, score FROM (SELECT seq, (epoch_us(ingested_at) // 1000) AS ts, (""" + " + ".join(
    f"3 * coalesce(contains(lower(component), '{t}'), false)::int + 2 * coalesce(contains(lower(message), '{t}'), false)::int" for t in ["blocknode", "volume", "detached"]
) + """)::int AS score, level FROM log_records) WHERE score > 0{where} ORDER BY score DESC, ts DESC, seq DESC LIMIT {n}"""


def incident_pick(spark: SparkSession, d: str) -> DataFrame:
    return chunks.pick_incident(_logs(spark, d), ["blocknode", "volume", "detached"]).select("seq", "score")


def corpus_quality(spark: SparkSession, d: str) -> DataFrame:
    return chunks.quality(table(spark, d, "log_records"))


_QUALITY = """WITH c AS (SELECT dataset, nullif(trim(template_id), '') AS t, count(*) AS n, sum(length(message)) AS chars FROM log_records GROUP BY ALL),
top AS (SELECT dataset, sum(n) AS top20 FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY n DESC, t) AS k FROM c WHERE t IS NOT NULL) WHERE k <= 20 GROUP BY dataset),
p AS (SELECT dataset, sum(n) AS rows, coalesce(sum(n) FILTER (t IS NOT NULL), 0) AS matched, count(t) AS templates, count(*) FILTER (t IS NOT NULL AND n = 1) AS singletons, sum(chars) AS chars FROM c GROUP BY dataset)
SELECT dataset, rows::bigint AS rows, templates, round(matched / rows, 6) AS coverage, round(coalesce(singletons / nullif(templates, 0), 0), 6) AS singleton_ratio, round(coalesce(top20 / nullif(matched, 0), 0), 6) AS top20_coverage,
round(chars / rows, 6) AS mean_message_length FROM p LEFT JOIN top USING (dataset)"""
QUERIES |= {"local_rank": local_rank, "incident_pick": incident_pick, "corpus_quality": corpus_quality}
ORACLE |= {
    "local_rank": _LOCAL.format(where="", n=50),
    "incident_pick": _LOCAL.format(where=" AND level IN ('ERROR', 'CRITICAL')", n=1),
    "corpus_quality": _QUALITY,
}
