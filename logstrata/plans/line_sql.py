"""SQL of lines and time stamps: every layout as one pattern, independent of the operators."""

from __future__ import annotations

BLANK = r"^[\s\x{A0}]+|[\s\x{A0}]+$"

# --- time stamps -------------------------------------------------------------------------
_FORMATS = "'%Y-%m-%d %H:%M:%S', '%Y%m%dT%H%M%S', '%d.%m.%Y %H:%M:%S', '%a %b %d %H:%M:%S %Y', '%a, %d %b %Y %H:%M:%S', '%d/%b/%Y:%H:%M:%S', '%y%m%d %H%M%S'"
_RAW = "SELECT 'log_records' AS tbl, seq, timestamp, host FROM log_records UNION ALL SELECT 'anomaly_candidate_logs', seq, timestamp, host FROM anomaly_candidate_logs"


def instants(source: str = _RAW) -> str:
    """(tbl, seq, ts_ms) of rows (tbl, seq, timestamp, host)."""
    return rf"""
WITH z AS (SELECT lower(trim(host)) AS h, min(tz_name) AS tz, bool_or(lower(trim(date_order)) = 'mdy') AS mdy FROM host_zones GROUP BY 1),
abbr(tz, a, minutes) AS (VALUES ('Europe/Berlin', 'CET', 60), ('Europe/Berlin', 'CEST', 120), ('America/New_York', 'EST', -300), ('America/New_York', 'EDT', -240), ('America/Chicago', 'CST', -360), ('America/Chicago', 'CDT', -300),
  ('Europe/London', 'BST', 60), ('Australia/Sydney', 'AEST', 600), ('Australia/Sydney', 'AEDT', 660), ('Asia/Kolkata', 'IST', 330)),
r AS (SELECT tbl, seq, upper(regexp_replace(timestamp, '{BLANK}', '', 'g')) AS t, coalesce(z.tz, 'UTC') AS tz, coalesce(z.mdy, false) AS mdy FROM ({source}) s LEFT JOIN z ON z.h = lower(regexp_replace(s.host, '{BLANK}', '', 'g'))),
k AS (SELECT *, regexp_matches(t, '^-?\d{{10}}(\.\d{{1,9}}|\d{{3}}|\d{{6}}|\d{{9}})?$') AS epoch, nullif(regexp_extract(t, '\d\s?(Z|[A-Z]{{3,5}}|[+-]\d\d:?\d\d)$', 1), '') AS zone FROM r),
b AS (SELECT *, CASE WHEN zone IS NULL THEN t ELSE trim(left(t, length(t) - length(zone))) END AS body FROM k),
f AS (SELECT *, rpad(regexp_extract(body, ':\d\d[.,](\d{{1,9}})', 1), 3, '0')[:3]::int AS ms, regexp_replace(regexp_replace(body, '(:\d\d)[.,]\d{{1,9}}', '\1'), '^(\d{{4}}-\d\d-\d\d)T', '\1 ') AS plain FROM b),
l AS (SELECT *, CASE WHEN epoch THEN NULL WHEN regexp_matches(plain, '^\d\d?/\d') THEN CASE WHEN mdy THEN try_strptime(plain, ['%m/%d/%Y %H:%M:%S', '%m/%d/%Y %I:%M:%S %p']) ELSE try_strptime(plain, ['%d/%m/%Y %H:%M:%S', '%d/%m/%Y %I:%M:%S %p']) END
  ELSE try_strptime(plain, [{_FORMATS}]) END AS local FROM f),
o AS (SELECT l.*, CASE WHEN zone IN ('Z', 'UTC', 'GMT') THEN 0 WHEN zone[1] IN ('+', '-') THEN (zone[1] || '1')::int * (replace(zone, ':', '')[2:3]::int * 60 + replace(zone, ':', '')[4:5]::int) ELSE abbr.minutes END AS east,
  timezone(l.tz, local) AS guess FROM l LEFT JOIN abbr ON abbr.tz = l.tz AND abbr.a = l.zone),
i AS (SELECT *, CASE WHEN epoch THEN CASE WHEN length(regexp_extract(t, '^\d+')) = 10 THEN regexp_extract(t, '^\d+')::bigint * 1000 + rpad(regexp_extract(t, '\.(\d+)', 1), 3, '0')[:3]::int ELSE regexp_extract(t, '^\d{{13}}')::bigint END
  WHEN zone IS NOT NULL THEN epoch_ms(local) - east * 60000 + ms
  WHEN timezone(tz, guess) <> local THEN NULL WHEN timezone(tz, guess - INTERVAL 1 HOUR) = local THEN epoch_ms(guess - INTERVAL 1 HOUR) + ms ELSE epoch_ms(guess) + ms END AS ts_ms FROM o)
SELECT tbl, seq, ts_ms FROM i WHERE ts_ms IS NOT NULL"""


# --- lines -------------------------------------------------------------------------------
_ISO = r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d"
_ASC = r"[A-Z][a-z]{2} [A-Z][a-z]{2} [ \d]\d \d\d:\d\d:\d\d(?:\.\d+)? \d{4}"
#: Each layout with the numbers of its groups for time, level, component and message (0 for none).
LAYOUTS = {
    "service": (rf"^(?:\S+\s+)?({_ISO})[.,]\d+ +\d+ +(\w+) +([\w$./-]+) +\[[^\]]*\]\s*(.*)$", 1, 2, 3, 4),
    "blocks": (r"^(\d{6} \d{6}) +\d+ +(\w+) +([^:\s]+):\s*(.*)$", 1, 2, 3, 4),
    "module": (rf"^\[({_ASC})\] +\[([\w$./-]+):(\w+)\]\s*(?:\[[^\]]*\]\s*)*(.*)$", 1, 3, 2, 4),
    "plain": (rf"^\[({_ASC})\] +\[(\w+)\]\s*(?:\[[^\]]*\]\s*)*(.*)$", 1, 2, 0, 3),
    "worker": (r"^(\d{4}/\d\d/\d\d \d\d:\d\d:\d\d) +\[(\w+)\] +\d+#\d+: +(?:\*\d+ +)?(.*)$", 1, 2, 0, 3),
    "thread": (rf"^({_ISO}),\d+ +(\w+) +\[[^\]]*\] +([\w$./-]+) +-\s*(.*)$", 1, 2, 3, 4),
    "pipes": (rf"^({_ISO})(?:\.\d+)? \| +(\w+) +\| +([\w$./-]+) +\|\s*(.*)$", 1, 2, 3, 4),
    "priority": (rf"^<(\d+)>1 ({_ISO})\S* +\S+ +([\w$./-]+) +\S+ +- +-\s*(.*)$", 2, 1, 3, 4),
    "letters": (r"^(\d{10})\.\d+\s+([A-Z])\s+([\w$./-]+)\s+(.*)$", 1, 2, 3, 4),
    "short": (r"^(\w+):([\w$./-]+):\s*(.*)$", 0, 1, 2, 3),
}
_NAMED = r'(?:^\{|^|[,\s])"?(?:NAMES)"?\s*[:=]\s*("(?:[^"\\]|\\.)*"|[^\s,}"]+)'
_FIELDS = {"ts": "ts|time|@timestamp|timestamp", "lv": "level|lvl|severity", "comp": "component|logger|module", "msg": "msg|message"}
_LEVEL = """CASE WHEN upper({x}) IN ('DEBUG', 'TRACE', 'VERBOSE', 'FINE', 'DBG', 'D', 'T') THEN 'DEBUG' WHEN upper({x}) IN ('INFO', 'INFORMATION', 'INFORMATIONAL', 'INF', 'I') THEN 'INFO' WHEN upper({x}) IN ('NOTICE', 'N') THEN 'NOTICE'
  WHEN upper({x}) IN ('WARN', 'WARNING', 'WRN', 'W') THEN 'WARN' WHEN upper({x}) IN ('ERROR', 'ERR', 'SEVERE', 'E') THEN 'ERROR' WHEN upper({x}) IN ('CRITICAL', 'CRIT', 'FATAL', 'ALERT', 'EMERG', 'EMERGENCY', 'PANIC', 'C', 'F') THEN 'CRITICAL'
  WHEN layout = 'priority' THEN ['CRITICAL', 'CRITICAL', 'CRITICAL', 'ERROR', 'WARN', 'NOTICE', 'INFO', 'DEBUG'][{x}::int % 8 + 1] END"""


def fields(source: str) -> str:
    """(source.*, ts_text, level, component, message) of rows with a column `text`, whose first line is read."""
    layout = " ".join(f"WHEN regexp_matches(line, '{p[0]}', 's') THEN '{name}'" for name, p in LAYOUTS.items() if name != "short")
    pick = lambda n: "CASE layout " + " ".join(f"WHEN '{name}' THEN regexp_extract(line, '{p[0]}', {p[n]}, 's')" for name, p in LAYOUTS.items() if p[n]) + f" WHEN 'named' THEN {named(n)} ELSE '' END"

    def named(n: int) -> str:
        found = f"regexp_extract(line, '{_NAMED.replace('NAMES', list(_FIELDS.values())[n - 1])}', 1)"
        inner = rf"regexp_replace(regexp_replace({found}, '^\"|\"$', '', 'g'), '\\([\"\\])', '\1', 'g')"
        return inner if n == 4 else f"replace({found}, '\"', '')"

    short = LAYOUTS["short"][0]
    level_word = _LEVEL.format(x=f"regexp_extract(line, '{short}', 1)").replace("WHEN layout", "WHEN false AND ''")
    return rf"""
SELECT * EXCLUDE (line, layout, t, l, c, m), CASE WHEN layout = 'letters' THEN strftime(make_timestamp(t::bigint * 1000000), '%Y-%m-%d %H:%M:%S') WHEN regexp_matches(t, '^\d{{10}}\.\d+$') THEN strftime(make_timestamp(t[:10]::bigint * 1000000), '%Y-%m-%d %H:%M:%S')
    WHEN regexp_matches(t, '^\d{{4}}[-/]') THEN replace(replace(t[:19], 'T', ' '), '/', '-') WHEN layout = 'blocks' THEN strftime(strptime(t, '%y%m%d %H%M%S'), '%Y-%m-%d %H:%M:%S')
    WHEN layout IN ('module', 'plain') THEN strftime(strptime(regexp_replace(regexp_replace(t, '\.\d+', ''), ' +', ' ', 'g'), '%a %b %d %H:%M:%S %Y'), '%Y-%m-%d %H:%M:%S') ELSE '' END AS ts_text,
  coalesce({_LEVEL.format(x='l')}, '') AS level, c AS component, CASE WHEN layout = '' OR (layout = 'named' AND m = '') THEN line ELSE trim(m, E' \t') END AS message
FROM (SELECT *, {pick(1)} AS t, {pick(2)} AS l, {pick(3)} AS c, {pick(4)} AS m FROM (
  SELECT *, CASE WHEN regexp_matches(line, '^\{{\s*"[\w@.-]+"\s*:|^[A-Za-z_@][\w@.]*=') THEN 'named' {layout} WHEN regexp_matches(line, '{short}') AND {level_word} IS NOT NULL THEN 'short' ELSE '' END AS layout
  FROM (SELECT *, trim(regexp_replace(regexp_extract(coalesce(text, ''), '^[^\r\n]*'), '\x1b\[[0-9;]*m', '', 'g'), ' ') AS line FROM ({source}))))"""


_BOTH = "SELECT 'log_records' AS tbl, seq AS rec_id, raw_log AS text FROM log_records UNION ALL SELECT 'anomaly_candidate_logs', seq, raw_log FROM anomaly_candidate_logs"
P3_FIELDS = f"SELECT tbl, rec_id, ts_text, level, component, message FROM ({fields(_BOTH)})"
P3_FOUND = rf"""
WITH p AS ({fields('SELECT line_id, source_file, line_number, line AS text FROM (SELECT line_id, source_file, line_number, line FROM raw_lines)')}),
e AS (SELECT *, count(*) FILTER (ts_text <> '' OR level <> '') OVER (PARTITION BY source_file ORDER BY line_number, line_id) AS entry FROM p)
SELECT tbl, rec_id, (length(text) - length(replace(text, chr(10), '')) + 1 - (text[-1] = chr(10))::int)::int AS n_lines, ts_text, level, component FROM ({fields(_BOTH)}) WHERE ts_text <> '' OR level <> ''
UNION ALL SELECT 'raw_lines', arg_min(line_id, (line_number, line_id)), count(*)::int, arg_min(ts_text, (line_number, line_id)), arg_min(level, (line_number, line_id)), arg_min(component, (line_number, line_id)) FROM e WHERE entry > 0 GROUP BY source_file, entry"""
P5_FOUND = instants()


# --- templates ---------------------------------------------------------------------------
_UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
_SLOW = r"0*(?:[5-9]|[1-9]\d+)(?:\.\d+)?"
_IDS = [
    (rf"\breq-{_UUID}\b", "<req_id>"), (rf"(?i)\[instance:\s*{_UUID}\]", "[instance: <instance_id>]"), (rf"(?i)\binstance\s+{_UUID}\b", "instance <instance_id>"), (r"\bblk_-?\d+\b", "<block_id>"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}:\d+\b", "<ip_port>"), (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "<ip>"), (rf"\b{_UUID}\b", "<uuid>"), (r"\b[0-9a-fA-F]{32}\b", "<hex_id>"),
    (r"(^|\W)/(?:[A-Za-z0-9._@%+=:,~-]+/)*[A-Za-z0-9._@%+=:,~-]+", r"\1<path>"),
]
_NUMBER = (r"(^|[^\w.])-?\d+(?:\.\d+)?($|[^\w.])", r"\1<num>\2")
_VALUES = [
    (r"(?i)\bstatus:\s*(\d)\d\d\b", r"status: <status_\1xx>"), (r"(?i)\blen:\s*\d+\b", "len: <len>"), (rf"(?i)\btime:\s*{_SLOW}\b", "time: <duration_slow>"), (r"(?i)\btime:\s*\d+(?:\.\d+)?\b", "time: <duration_normal>"),
    (rf"(?i)\btook\s+{_SLOW}\s+seconds?\b", "took <duration_slow> seconds"), (r"(?i)\btook\s+\d+(?:\.\d+)?\s+seconds?\b", "took <duration_normal> seconds"), (r"(?i)\berror state\s+-?\d+\b", "error state <state_code>"),
    (r"(?i)\berror code\s+-?\d+\b", "error code <error_code>"), (r"(?i)\bexit code\s+-?\d+\b", "exit code <exit_code>"), (r"(?i)\bretry\s+\d+\b", "retry <retry_count>"), (r"(?i)\bport\s+\d{2,5}\b", "port <port>"),
    # numbers share their delimiters, so the second pass finds those next to one of the first
    _NUMBER, (r"(?:(^|[^\w.>])-?|(<num>-)|(<num>>)-?)\d+(?:\.\d+)?($|[^\w.])", r"\1\2\3<num>\4"), (r"(?:<block_id>\s+){2,}<block_id>", "<block_id_list>"),
]


def rewritten(column: str, rewrites: list[tuple[str, str]]) -> str:
    for pattern, target in rewrites:
        column = f"regexp_replace({column}, '{pattern}', '{target}', 'g')"
    return rf"trim(regexp_replace({column}, '[\s\x{{A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{3000}}]+', ' ', 'g'))"


def template(column: str) -> str:
    return rewritten(column, _IDS + _VALUES)


def embed_message(column: str) -> str:
    return f"(SELECT CASE WHEN length(x) > 240 THEN rtrim(x[:237]) || '...' ELSE x END FROM (SELECT {rewritten(column, _IDS)} AS x))"
