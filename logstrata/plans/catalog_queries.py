"""Queries of the rule catalog and enriched chunks, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logstrata.functions import text as tx
from logstrata.operators import chunks, matcher
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


#: (template_id, dataset, template, regex, component, level, priority, active)
RULES = [
    ("r:backend", "openstack", "Backend <*> reports ready", r"Backend (?P<backend>\S+) reports (?P<state>.*)$", None, None, 10, True),
    ("r:backend-down", "openstack", "Backend <*> reports not ready", None, None, None, None, None),
    ("r:spawn", "openstack", "spawn gave up, no network port after <num> tries", r"spawn gave up, .* after (?P<tries>\d+) tries", None, "ERROR", 50, True),
    ("r:pool", "openstack", "Pool of <num> sessions used up, oldest <num> ms", None, None, None, 100, True),
    ("r:pool-critical", "openstack", "Pool of <num> sessions used up, oldest <num> ms", None, "nova.db.pool", "CRITICAL", 200, True),
    ("r:consumer", "openstack", None, r"Consumer (?P<name>\S+) (?P<what>connected|disconnected)", None, None, 100, True),
    ("r:answer", "openstack", None, r"answered (?P<status>\d+)", None, None, 5, True),
    ("r:moved", "hdfs", "Moved <num> blocks from <ip> in <num> s", None, None, None, 100, True),
    ("r:responder", "hdfs", None, r"responder (?P<id>\d+) is done with (?P<block_id>blk_-?\d+)", None, None, 100, True),
    ("r:any-block", "hdfs", None, r"(?P<block_id>blk_-?\d+)", None, None, 1, True),
    ("r:checkpoint", "hdfs", "Checkpoint merged, image size <num> bytes", None, None, None, 100, True),
    ("r:off", "hdfs", None, r".", None, None, 999, False),
    ("r:plain", "online", "order <num> accepted in <num> ms", None, None, None, 100, True),
    ("r:unused", "apache", "this is said by no one", None, None, None, 100, True),
]
_COLUMNS = "template_id string, dataset string, template string, regex string, component string, level string, priority int, active boolean"


def _rules(spark: SparkSession) -> DataFrame:
    return matcher.rules_from_records(spark.createDataFrame(RULES, _COLUMNS))


def _matches(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(table(spark, d, "log_records").select("seq", "dataset", "component", "level", "message"))
    return materialize(matcher.match_rules(rows, _rules(spark), "seq"), "matches")


def _sql(value) -> str:
    return "NULL" if value is None else str(value).lower() if isinstance(value, bool) else str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def _pattern(rule: tuple) -> tuple[str, list[str]]:
    """The rule's regex for DuckDB, unnamed groups, and the names of the slots."""
    import re

    if rule[3]:
        return re.sub(r"\(\?P<\w+>", "(", rule[3]), re.findall(r"\(\?P<(\w+)>", rule[3])
    pattern, names = tx.regex_from_template(rule[2])
    return pattern.replace(r".*?", r".*?"), names


_CATALOG = "(VALUES " + ", ".join(f"({', '.join(map(_sql, r))}, {_sql(_pattern(r)[0])}, {_pattern(r)[1]}::varchar[])" for r in RULES) + ") v(template_id, dataset, template, regex, component, level, priority, active, pattern, names)"
_SLOT = lambda k: f"regexp_extract(message, {{p}}, {k}, 'is')"
_MATCH = f"""WITH c AS (SELECT * REPLACE (coalesce(priority, 100) AS priority) FROM {_CATALOG} WHERE coalesce(active, true)),
l AS (SELECT seq, lower(trim(dataset)) AS dataset, component, level, message, {line_sql.template('message')} AS normal FROM log_records),
h AS (SELECT seq, c.*, row_number() OVER (PARTITION BY seq ORDER BY priority DESC, template_id) AS k, count(*) OVER (PARTITION BY seq)::int AS n FROM l JOIN c ON c.dataset = l.dataset AND (c.component IS NULL OR c.component = l.component) AND (c.level IS NULL OR c.level = l.level)
  AND regexp_matches(l.message, c.pattern, 'is') WHERE trim(message) <> ''),
e AS (SELECT seq, c.*, row_number() OVER (PARTITION BY seq ORDER BY priority DESC, template_id) AS k, count(*) OVER (PARTITION BY seq)::int AS n FROM l JOIN c ON c.dataset = l.dataset AND c.template = l.normal AND (c.component IS NULL OR c.component = l.component) AND (c.level IS NULL OR c.level = l.level)),
m AS (SELECT l.*, coalesce(h.template_id, e.template_id) AS template_id, CASE WHEN h.template_id IS NOT NULL THEN h.template WHEN e.template_id IS NOT NULL THEN e.template ELSE normal END AS template,
  CASE WHEN h.template_id IS NOT NULL THEN 'regex' WHEN e.template_id IS NOT NULL THEN 'normalized_template' ELSE 'fallback_normalize' END AS match_method,
  CASE WHEN h.template_id IS NOT NULL THEN 1.0 WHEN e.template_id IS NOT NULL THEN 0.9 ELSE 0.0 END::double AS confidence, coalesce(h.n, e.n, 0) AS candidate_count, h.pattern, h.names
  FROM l LEFT JOIN h ON h.seq = l.seq AND h.k = 1 LEFT JOIN e ON e.seq = l.seq AND e.k = 1 AND h.seq IS NULL)
"""
_SLOTS = "CASE template_id " + " ".join(f"WHEN '{r[0]}' THEN list_filter([{', '.join(_sql(n + '=') + ' || ' + _SLOT(k + 1).format(p=_sql(_pattern(r)[0])) for k, n in enumerate(_pattern(r)[1]))}], lambda x: NOT ends_with(x, '='))" for r in RULES if _pattern(r)[1]) + " ELSE [] END"


@query(_MATCH + "SELECT seq, template_id, template, match_method, confidence, candidate_count FROM m")
def rule_matches(spark, d):
    """Every message with its rule, how it was matched and how many rules match."""
    return _matches(spark, d).drop("slots")


@query(_MATCH + f"SELECT seq, array_to_string(list_sort({_SLOTS}), ';') AS slots FROM m WHERE pattern IS NOT NULL")
def rule_slots(spark, d):
    """What the slots of a matched rule hold."""
    entries = F.transform(F.map_entries("slots"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return _matches(spark, d).filter("match_method = 'regex'").select("seq", F.array_join(F.sort_array(entries), ";").alias("slots"))


@query(_MATCH + "SELECT c.template_id, c.dataset, c.template FROM c WHERE template_id NOT IN (SELECT template_id FROM m WHERE template_id IS NOT NULL)")
def rules_never_matched(spark, d):
    return matcher.never_matched(_rules(spark), _matches(spark, d))


@query(_MATCH + "SELECT template, count(*) AS n FROM m WHERE template_id IS NULL GROUP BY template ORDER BY n DESC, template LIMIT 20")
def templates_unmatched(spark, d):
    """The most frequent forms no rule knows: candidates for the catalog."""
    return matcher.top_unmatched(_matches(spark, d))


_LEAK = " OR ".join(f"regexp_matches(template, '{p}')" for p in matcher.LEAKS.values())


@query(_MATCH + f""", k AS (SELECT template_id, count(*) AS n FROM m WHERE template_id IS NOT NULL GROUP BY 1),
s AS (SELECT m.*, len({_SLOTS}) AS nslots FROM m),
u AS (SELECT c.template, k.n, list_filter(regexp_split_to_array(c.template, '\\s+'), lambda t: t <> '') AS toks FROM c LEFT JOIN k USING (template_id) WHERE c.template IS NOT NULL),
v AS (SELECT *, len(list_filter(toks, lambda t: regexp_matches(t, '<[a-z0-9_*]+>'))) AS marked FROM u),
p AS (SELECT count(*) AS total_logs, count(template_id) AS matched, count(*) FILTER (candidate_count > 1) AS ambiguous, count(*) FILTER (pattern IS NOT NULL AND nslots > 0) AS slotted, round(avg(length(template)), 4) AS mean_template_length FROM s),
q AS (SELECT count(*) AS total_templates, count(*) FILTER (n IS NULL) AS never_seen, count(*) FILTER (n = 1) AS singletons, count(*) FILTER ({_LEAK}) AS with_leak, count(*) FILTER (len(toks) - marked <= 2 OR marked / len(toks) >= 0.65) AS over_normalized FROM v),
t AS (SELECT sum(n) AS top_20 FROM (SELECT n FROM k ORDER BY n DESC, template_id LIMIT 20))
SELECT total_logs, total_templates, matched, total_logs - matched AS unmatched, round(matched / total_logs, 6) AS coverage, never_seen, ambiguous, round(slotted / total_logs, 6) AS slot_coverage, round(total_templates / total_logs, 6) AS unique_template_ratio,
  round(singletons / total_templates, 6) AS singleton_ratio, round(top_20 / total_logs, 6) AS top_20_coverage, mean_template_length, with_leak, over_normalized FROM p, q, t""")
def catalog_quality(spark, d):
    return matcher.catalog_quality(_matches(spark, d), _rules(spark))


# --- chunks ------------------------------------------------------------------------------
_MEANS = lambda x: f"CASE WHEN lower(trim({x})) NOT IN ('', 'unknown', 'none', 'null', 'n/a', '-') THEN trim({x}) END"
_FIRST = lambda p, g=0: f"nullif(regexp_extract(t, '{p}', {g}), '')"
_CHUNKS = rf"""WITH x AS (SELECT *, coalesce(raw_log, '') || ' ' || coalesce(message, '') AS t, {line_sql.template('message')} AS normal, {line_sql.embed_message('message')} AS said FROM log_records),
c AS (SELECT seq, log_id, dataset, level, component, line_number, source_file, raw_log, message, template_id, normal AS template, coalesce({_FIRST(rf"\breq-{line_sql._UUID}\b")}, nullif(trim(request_id), '')) AS request_id,
  coalesce({_FIRST(rf"(?i)\[instance:\s*({line_sql._UUID})\]", 1)}, {_FIRST(rf"(?i)\binstance\s+({line_sql._UUID})\b", 1)}) AS instance_id, {_FIRST(r"\bblk_-?\d+\b")} AS block_id, {_FIRST(r"\b(?:\d{1,3}\.){3}\d{1,3}\b")} AS ip,
  try_cast(nullif(regexp_extract(message, '(?i)\bstatus:\s*(\d{{3}})\b', 1), '') AS int) AS http_status,
  1000 * try_cast(coalesce(nullif(regexp_extract(message, '(?i)\btime:\s*(\d+(?:\.\d+)?)\b', 1), ''), nullif(regexp_extract(message, '(?i)\btook\s+(\d+(?:\.\d+)?)\s+seconds?\b', 1), '')) AS double) AS duration_ms,
  nullif(regexp_extract(raw_log, '^(\S+\.log(?:\.\S+)?)\s+\d{{4}}-\d{{2}}-\d{{2}}\s+', 1), '') AS source_log, nullif(regexp_extract(message, '(?i)pending task \(([^)]+)\)', 1), '') AS task_state, nullif(regexp_extract(message, '\b(mod_[A-Za-z0-9_]+)\b', 1), '') AS apache_module,
  concat_ws(chr(10), 'dataset: ' || {_MEANS('dataset')}, 'level: ' || {_MEANS('level')}, 'component: ' || {_MEANS('component')}, 'template: ' || {_MEANS('normal')}, 'message: ' || {_MEANS('said')}) AS embed_text FROM x)
"""


@query(_CHUNKS + "SELECT log_id, template, request_id, instance_id, block_id, ip, duration_ms, source_log, task_state, apache_module, md5(embed_text) AS embed_md5 FROM c")
def line_chunks(spark, d):
    rows = chunks.line_chunks(table(spark, d, "log_records"))
    return rows.select("log_id", "template", "request_id", "instance_id", "block_id", "ip", "duration_ms", "source_log", "task_state", "apache_module", F.md5("embed_text").alias("embed_md5"))


_PRESENT = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN '{c}' END" for c in ("dataset", "level", "component", "line_number", "source_file", "raw_log", "message", "template_id", "template", "request_id", "instance_id", "block_id", "ip", "http_status", "duration_ms", "task_state", "apache_module", "source_log", "embed_text"))


@query(_CHUNKS + f"SELECT log_id, concat_ws(',', {_PRESENT}, 'entities') AS keys, md5(message) AS message_md5 FROM c")
def chunk_payloads(spark, d):
    """What the compact payload of every line holds: no nulls."""
    rows = chunks.payload(chunks.line_chunks(table(spark, d, "log_records")))
    said = F.get_json_object("payload", "$.message")
    return rows.select("log_id", F.array_join(F.json_object_keys("payload"), ",").alias("keys"), F.md5(said).alias("message_md5"))


@query("SELECT log_id, 'passage: ' || message AS passage, 'query: ' || message AS question FROM log_records WHERE trim(message) <> ''")
def embedding_prefixes(spark, d):
    """Texts as a two-sided embedding model expects them."""
    rows = table(spark, d, "log_records").filter(F.trim("message") != "")
    return rows.select("log_id", chunks.prefixed(F.col("message"), "passage").alias("passage"), chunks.prefixed(F.col("message"), "query").alias("question"))
