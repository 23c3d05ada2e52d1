"""Scalar functions on log text: inference, cleaning, entities, template normalisation, ids."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Level words, time stamp shapes and category keywords, in order of precedence.
LEVEL = r"(?i)\b(DEBUG|INFO|NOTICE|WARN|WARNING|ERROR|ERR|FATAL|TRACE|CRITICAL|AUDIT)\b"
TIMESTAMPS = [r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?", r"\d{2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2}(?: [+-]\d{4})?", r"\d{6}\s+\d{6}"]
CATEGORIES = {
    "timeout": ["timeout", "timed out", "deadline", "expired"],
    "connection": ["connection", "connect", "disconnect", "refused", "reset"],
    "latency": ["latency", "slow", "delay", "delayed", "took", "duration"],
    "database": ["database", "sql", "mysql", "postgres", "sqlite"],
    "permission": ["permission", "denied", "unauthorized", "forbidden", "auth"],
    "storage": ["disk", "volume", "block", "blockmap", "base file", "imagecache", "hdfs", "namenode", "datanode", "storage"],
    "network": ["network", "socket", "tcp", "udp", "dns", "host", "port"],
    "service_unavailable": ["service unavailable", "unavailable", "error state", "exception while serving", "down", "no route"],
}
# Shapes of identifiers, paths and requests.
UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
ENTITIES = {
    "request_id": rf"\breq-{UUID}\b",
    "block_id": r"\bblk_-?\d+\b",
    "ip_port": r"\b(?:\d{1,3}\.){3}\d{1,3}:\d+\b",
    "ip": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "hex_id": r"\b[0-9a-fA-F]{32}\b",
}
PATH = r"(?<!\w)/(?:[A-Za-z0-9._@%+=:,~-]+/)*[A-Za-z0-9._@%+=:,~-]+"
HTTP = r'"([A-Z]+)\s+(\S+)\s+HTTP/([^"]+)"'
# Rewrites of values to placeholders, in their order.
ID_REWRITES = [
    (rf"\breq-{UUID}\b", "<req_id>"), (rf"(?i)\[instance:\s*{UUID}\]", "[instance: <instance_id>]"), (rf"(?i)\binstance\s+{UUID}\b", "instance <instance_id>"),
    (r"\bblk_-?\d+\b", "<block_id>"), (r"\b(?:\d{1,3}\.){3}\d{1,3}:\d+\b", "<ip_port>"), (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "<ip>"),
    (rf"\b{UUID}\b", "<uuid>"), (r"\b[0-9a-fA-F]{32}\b", "<hex_id>"), (PATH, "<path>"),
]
_SLOW = r"0*(?:[5-9]|[1-9]\d+)(?:\.\d+)?"
VALUE_REWRITES = [
    (r"(?i)\bstatus:\s*(\d)\d\d\b", "status: <status_$1xx>"), (r"(?i)\blen:\s*\d+\b", "len: <len>"),
    (rf"(?i)\btime:\s*{_SLOW}\b", "time: <duration_slow>"), (r"(?i)\btime:\s*\d+(?:\.\d+)?\b", "time: <duration_normal>"),
    (rf"(?i)\btook\s+{_SLOW}\s+seconds?\b", "took <duration_slow> seconds"), (r"(?i)\btook\s+\d+(?:\.\d+)?\s+seconds?\b", "took <duration_normal> seconds"),
    (r"(?i)\berror state\s+-?\d+\b", "error state <state_code>"), (r"(?i)\berror code\s+-?\d+\b", "error code <error_code>"), (r"(?i)\bexit code\s+-?\d+\b", "exit code <exit_code>"),
    (r"(?i)\bretry\s+\d+\b", "retry <retry_count>"), (r"(?i)\bport\s+\d{2,5}\b", "port <port>"), (r"(?<![\w.])-?\d+(?:\.\d+)?(?![\w.])", "<num>"),
    (r"(?:<block_id>\s+){2,}<block_id>", "<block_id_list>"),
]
# What each placeholder of a template stands for.
PLACEHOLDERS = {
    "*": r".*?", "req_id": r"req-[0-9a-fA-F-]{36}", "instance_id": r"[0-9a-fA-F-]{36}", "uuid": r"[0-9a-fA-F-]{36}", "hex_id": r"[0-9a-fA-F]{32}",
    "block_id": r"blk_-?\d+", "block_id_list": r"blk_-?\d+(?:\s+blk_-?\d+)+", "ip_port": r"(?:\d{1,3}\.){3}\d{1,3}:\d+", "ip": r"(?:\d{1,3}\.){3}\d{1,3}", "path": r"/\S+",
    "status_2xx": r"2\d\d", "status_3xx": r"3\d\d", "status_4xx": r"4\d\d", "status_5xx": r"5\d\d", "len": r"\d+", "duration_normal": r"\d+(?:\.\d+)?", "duration_slow": r"\d+(?:\.\d+)?",
    "state_code": r"-?\d+", "error_code": r"-?\d+", "exit_code": r"-?\d+", "retry_count": r"\d+", "port": r"\d{2,5}", "num": r"-?\d+(?:\.\d+)?",
}


def found(c: Column, pattern: str, group: int = 0) -> Column:
    """The first match, null where there is none."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def normalize_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def infer_level(c: Column) -> Column:
    level = F.upper(found(c, LEVEL, 1))
    return F.when(level == "WARNING", "WARN").otherwise(level)


def clean_level(c: Column) -> Column:
    level = F.nullif(F.upper(F.regexp_replace(F.trim(c), r"^[\[\]]+|[\[\]]+$", "")), F.lit(""))
    return F.when(level == "WARNING", "WARN").otherwise(level)


def infer_timestamp(c: Column) -> Column:
    return F.coalesce(*[found(c, p) for p in TIMESTAMPS])


def infer_category(c: Column) -> Column:
    lowered, out = F.lower(c), F
    for category, keywords in CATEGORIES.items():
        out = out.when(lowered.rlike("|".join(keywords)), F.lit(category))
    return out.otherwise(F.lit("unknown"))


def stable_id(dataset: Column, *parts: Column) -> Column:
    """dataset:first 20 hex digits of the SHA-1 of the parts, one per line."""
    payload = F.concat_ws("\n", dataset, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(dataset, F.lit(":"), F.substring(F.sha1(F.encode(payload, "UTF-8")), 1, 20))


def entities(text: Column) -> Column:
    """A struct of ordered, distinct values per kind of entity."""
    every = lambda p, g=0: F.array_distinct(F.regexp_extract_all(text, F.lit(p), F.lit(g)))
    instance = F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(rf"(?i)\[instance:\s*({UUID})\]"), F.lit(1)), F.regexp_extract_all(text, F.lit(rf"(?i)\binstance\s+({UUID})\b"), F.lit(1))))
    requests = every(ENTITIES["request_id"])
    other = F.filter(every(rf"\b{UUID}\b"), lambda u: ~F.array_contains(instance, u) & ~F.array_contains(requests, F.concat(F.lit("req-"), u)))
    rest = [every(ENTITIES[k]).alias(k) for k in ("block_id", "ip_port", "ip", "hex_id")]
    return F.struct(requests.alias("request_id"), instance.alias("instance_id"), other.alias("uuid"), *rest, every(PATH).alias("path"))


def _route(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, rf"\b{UUID}\b", "<uuid>"), r"\b[0-9a-fA-F]{32}\b", "<hex_id>")


def http_request(c: Column) -> Column:
    return F.struct(found(c, HTTP, 1).alias("http_method"), _route(found(c, HTTP, 2)).alias("api_route"), found(c, HTTP, 3).alias("http_version"))


def _http_template(c: Column) -> Column:
    """The text with its (first) HTTP request normalised."""
    around = r'(?s)^(.*?)"[A-Z]+\s+\S+\s+HTTP/[^"]+"(.*)$'
    route = F.translate(F.regexp_replace(_route(F.regexp_extract(c, HTTP, 2)), "^/+|/+$", ""), "/", " ")
    route = F.when(route == "", "<api_route>").otherwise(route)
    request = F.concat(F.lit('"'), F.regexp_extract(c, HTTP, 1), F.lit(" route:"), route, F.lit(' HTTP/<version>"'))
    return F.when(c.rlike(HTTP), F.concat(F.regexp_extract(c, around, 1), request, F.regexp_extract(c, around, 2))).otherwise(c)


def _rewrite(c: Column, rewrites: list[tuple[str, str]]) -> Column:
    for pattern, target in rewrites:
        c = F.regexp_replace(c, pattern, target)
    return c


def normalize_template(c: Column) -> Column:
    return normalize_space(_rewrite(_http_template(c), ID_REWRITES + VALUE_REWRITES))


def sanitize(c: Column, most: int = 240) -> Column:
    """The message with identifiers masked, cut to `most` characters."""
    return truncate(normalize_space(_rewrite(_http_template(c), ID_REWRITES)), most)


def truncate(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.rtrim(F.substring(c, 1, most - 3)), F.lit("..."))).otherwise(c)


def duration_ms(c: Column) -> Column:
    seconds = F.coalesce(found(c, r"(?i)\btime:\s*(\d+(?:\.\d+)?)\b", 1), found(c, r"(?i)\btook\s+(\d+(?:\.\d+)?)\s+seconds?\b", 1))
    return seconds.try_cast("double") * 1000


def regex_from_template(template: str) -> tuple[str, list[str]]:
    """An anchored regex with positional groups, and the slot name of each group."""
    out, at, names, seen = "", 0, [], {}
    escape = lambda s: re.sub(r"\s+", lambda _: r"\s+", re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", s))
    for m in re.finditer(r"<(\*|[a-zA-Z0-9_]+)>", template):
        base = "wildcard" if m[1] == "*" else m[1]
        seen[base] = seen.get(base, 0) + 1
        names.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
        pattern = PLACEHOLDERS.get(m[1], r"\S+")
        out += escape(template[at : m.start()]) + f"({pattern})"
        at = m.end()
    return f"^{out}{escape(template[at:])}$", names
