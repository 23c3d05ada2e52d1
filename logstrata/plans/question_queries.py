"""Queries of chat questions and shown results, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from logstrata.operators import planner, questions, rca
from logstrata.plans.engine_queries import ORACLE as _ENGINE
from logstrata.plans.engine_queries import _incidents, logs_v
from logstrata.plans.planner_queries import _CONTEXT, _logs, _plans
from logstrata.session import table

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


ASKED = [
    "vì sao log_id: hdfs:4ac7cff804ddfd62775c lỗi", "logs mới nhất trong 3 giờ", "root cause in the last 15 minutes, not 2 hours", "error of openstack:452a74d8277403aaa869", "show quota and volume of cinder, quota", "lookback 0 h", "",
]
_ASK = "(VALUES " + ", ".join(f"({k}, '{q}')" for k, q in enumerate(ASKED)) + ") v(k, question)"


@query(rf"""WITH a AS (SELECT k, question, replace(strip_accents(lower(question)), 'đ', 'd') AS p FROM {_ASK}),
b AS (SELECT *, coalesce(nullif(regexp_extract(question, '(?i)\blog[_ ]?id\s*[:=]?\s*([A-Za-z]+:[\w:-]+)', 1), ''), nullif(regexp_extract(question, '\b((?:apache|openstack|hdfs|online|demo):[0-9A-Za-z][\w-]{{5,}})\b', 1), '')) AS log_id,
  try_cast(nullif(regexp_extract(p, '\b(\d{{1,3}})\s*(?:h|gio|tieng|hour|hours)\b', 1), '') AS int) AS h, try_cast(nullif(regexp_extract(p, '\b(\d{{1,4}})\s*(?:m|min|mins|minute|minutes|phut|p)\b', 1), '') AS bigint) AS m FROM a)
SELECT k, log_id, regexp_matches(p, 'moi nhat|gan day|vua xay ra|latest|recent|newest|last logs') AS recent, regexp_matches(p, 'nguyen nhan|root cause|rca|vi sao|tai sao|why') OR (log_id IS NOT NULL AND regexp_matches(p, 'loi|error|incident')) AS root_cause,
  CASE WHEN h > 0 THEN h ELSE 1 END AS hours, CASE WHEN m IS NOT NULL THEN CASE WHEN m > 0 THEN m ELSE 1 END * 60000 WHEN h IS NOT NULL THEN CASE WHEN h > 0 THEN h ELSE 1 END::bigint * 3600000 ELSE 600000 END AS lookback_ms,
  array_to_string(list_filter(regexp_extract_all(p, '[a-z_][a-z0-9_.$-]{{2,}}'), lambda w, i: NOT list_contains([{', '.join(f"'{w}'" for w in planner.NO_SUBJECT)}], w) AND list_position(regexp_extract_all(p, '[a-z_][a-z0-9_.$-]{{2,}}'), w) = i), ' ') AS terms FROM b""")
def question_parts(spark, d):
    """What seven questions ask for."""
    q = F.col("question")
    rows = spark.createDataFrame(list(enumerate(ASKED)), "k int, question string")
    return rows.select(
        "k", questions.log_id(q).alias("log_id"), questions.is_recent(q).alias("recent"), questions.is_root_cause(q).alias("root_cause"), questions.window_hours(q).alias("hours"), questions.lookback_ms(q).alias("lookback_ms"),
        F.array_join(questions.terms(q), " ").alias("terms"),
    )


@query(r"""SELECT seq, coalesce(nullif(trim(message), ''), nullif(trim(raw_log), ''), '') AS message, coalesce(nullif(trim(component), ''), dataset || '-service') AS service, upper(coalesce(nullif(trim(level), ''), 'UNKNOWN')) AS level,
nullif(regexp_extract(concat_ws(' ', nullif(trim(raw_log), ''), nullif(trim(message), '')), '\bblk_-?\d+\b'), '') AS block_id, nullif(regexp_extract(concat_ws(' ', nullif(trim(raw_log), ''), nullif(trim(message), '')), '\b(?:\d{1,3}\.){3}\d{1,3}\b'), '') AS ip FROM log_records""")
def chat_records(spark, d):
    """Records as a chat client sends them, in one flat form."""
    rows = table(spark, d, "log_records").select(F.col("seq").cast("string").alias("logId"), "dataset", "component", "level", "message", F.col("raw_log").alias("rawLog"), "timestamp")
    return questions.chat_logs(rows).select(F.col("log_id").cast("bigint").alias("seq"), "message", "service", "level", "block_id", "ip")


_EVIDENCE = _ENGINE["rca_evidence"]


def _context(spark, d):
    logs = logs_v(spark, d).withColumn("message", F.col("template"))
    return questions.rca_context(rca.rank_evidence(logs, _incidents(logs)), logs)


@query(f"""WITH ev AS ({_EVIDENCE}), lg AS (SELECT 'events:' || event_id AS log_id, (epoch_us(ts) // 1000)::bigint AS ts_ms FROM events),
u AS (SELECT incident_log_id, log_id, ts_ms, 'evidence' AS rca_role, rca_score FROM ev UNION ALL SELECT i.incident_log_id, i.incident_log_id, lg.ts_ms, 'incident', NULL FROM (SELECT DISTINCT incident_log_id FROM ev) i JOIN lg ON lg.log_id = i.incident_log_id)
SELECT incident_log_id, 'L' || lpad((row_number() OVER (PARTITION BY incident_log_id ORDER BY ts_ms, log_id))::varchar, 2, '0') AS line_id, log_id, rca_role, rca_score FROM u""")
def rca_context_lines(spark, d):
    """Evidence and incident in order of time, as numbered lines."""
    return _context(spark, d).select("incident_log_id", "line_id", "log_id", "rca_role", "rca_score")


@query(f"""WITH ev AS ({_EVIDENCE}) SELECT incident_log_id, count(*) AS candidates, max(rca_score) AS best_score, array_to_string(list_sort(list_distinct(flatten(list(string_split(reasons, ','))))), ',') AS reasons FROM ev GROUP BY 1""")
def rca_summaries(spark, d):
    return questions.rca_summary(_context(spark, d))


@query(f"""WITH c AS ({_CONTEXT}) SELECT question_id, count(*) AS n_lines, count(DISTINCT template_ref) AS n_templates, min(epoch_us(ingested_at) // 1000)::bigint AS first_ms, max(epoch_us(ingested_at) // 1000)::bigint AS last_ms,
count(*) FILTER (level IN ('ERROR', 'CRITICAL')) AS n_errors, count(DISTINCT component) AS n_components FROM c JOIN log_records USING (seq) GROUP BY question_id""")
def context_coverage(spark, d):
    """What the contexts of three questions cover."""
    rows = planner.execute(_plans(spark, 3), _logs(spark, d).withColumn("log_id", F.format_string("%012d", "seq")))
    return questions.coverage(planner.context(rows))


@query("WITH m AS (SELECT dataset, message, min(seq) AS seq FROM log_records WHERE trim(message) <> '' AND dataset IS NOT NULL GROUP BY ALL) SELECT dataset, rank, message[:220] AS message FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY seq)::int AS rank FROM m) WHERE rank <= 3")
def sample_messages(spark, d):
    return questions.distinct_messages(table(spark, d, "log_records").filter("dataset IS NOT NULL"), "dataset")
