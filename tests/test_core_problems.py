"""Small cases of the general problems: nulls, ties, repeats, empty tables, clashing names."""

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from logstrata.operators import orphans, run_store, sessions, template_tree, timeline
from logstrata.session import materialize


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- 2: messages delivered more than once
def entries(spark, data):
    return spark.createDataFrame(data, "tbl string, ident string, seq long, batch long")


def test_redundant_keeps_the_smallest_seq(spark):
    data = [("a", "x", 5, 1), ("a", "x", 3, 2), ("a", "x", 9, 2), ("a", "y", 4, 1), ("b", "x", 7, None), ("a", None, 1, 1), ("a", None, 2, 1)]
    assert rows(run_store.redundant(entries(spark, data))) == [("a", 5), ("a", 9)]


def test_redundant_against_brute_force_with_a_hot_key(spark):
    rng = random.Random(3)
    data = [("t", "hot" if rng.random() < 0.4 else f"k{rng.randint(0, 60)}", k, k // 50) for k in range(600)]
    first = {}
    for _, ident, seq, _ in data:
        first[ident] = min(seq, first.get(ident, seq))
    expected = sorted(("t", seq) for _, ident, seq, _ in data if seq != first[ident])
    for runs in (1, 2, 3):
        assert rows(run_store.redundant(entries(spark, data), runs)) == sorted(expected, key=repr)


def test_upsert_is_idempotent_and_empty_is_empty(spark):
    store = run_store.RunStore(spark, buckets=2)
    batch = entries(spark, [("a", "x", 2, 0), ("a", "y", 1, 0)])
    for _ in range(2):
        store.upsert("r0", batch)
    store.upsert("r1", entries(spark, [("a", "x", 1, 1)]))
    assert rows(store.compact()) == [("a", "x", 1), ("a", "y", 1)]
    assert run_store.redundant(entries(spark, [])).count() == 0


def test_survivors_keep_all_columns(spark):
    df = spark.createDataFrame([("A ", 1, "p", "q"), ("a", 2, "p", None), (None, 3, None, None), ("", 4, "r", "s")], "id string, seq long, tbl string, ident string")
    kept = run_store.survivors(df, "id")
    assert kept.columns == ["id", "seq", "tbl", "ident"]
    assert sorted(r.seq for r in kept.collect()) == [1, 3, 4]


def test_merge_of_sorted_runs_needs_no_exchange_and_no_sort(spark):
    store = run_store.RunStore(spark, buckets=2)
    store.upsert("a", entries(spark, [("t", "x", 1, 0)]))
    store.upsert("b", entries(spark, [("t", "x", 2, 0)]))
    plans = []
    write = store._write
    store._write = lambda run_id, df, merged=False: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(run_id, df, merged))
    assert rows(store.compact()) == [("t", "x", 1)]
    assert "SortMergeJoin" in plans[0] and "Exchange" not in plans[0] and "Sort [" not in plans[0]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(store._tag)]


# --- 3: log lines into fields
LINES = [
    ("2025-02-04 13:55:49.269 31737 INFO nova.virt.store [-] file 7 serves", ("2025-02-04 13:55:49", "INFO", "nova.virt.store")),
    ("nova.log.8 2025-01-03 06:53:00.495 21198 WARNING nova.guest [req-1a] x", ("2025-01-03 06:53:00", "WARN", "nova.guest")),
    ("250711 082612 25451 DEBUG dfs.Spreader: Moved 4 blocks", ("2025-07-11 08:26:12", "DEBUG", "dfs.Spreader")),
    ("[Sun Mar 30 02:55:23.374868 2025] [auth_file:error] [pid 2:tid 4] no group", ("2025-03-30 02:55:23", "ERROR", "auth_file")),
    ("[Sat Dec 27 22:11:36 2025] [crit] [client 10.0.0.1] gone", ("2025-12-27 22:11:36", "CRITICAL", "")),
    ("2025/11/15 04:26:36 [notice] 18753#0: *7222 child took slot", ("2025-11-15 04:26:36", "NOTICE", "")),
    ("2025-09-25 23:10:41,893 \x1b[32mINFO\x1b[0m  [pool-4-thread-30] dfs.Lease - granted", ("2025-09-25 23:10:41", "INFO", "dfs.Lease")),
    ("2025-10-22T23:12:37.725 | ERROR | session.store | refused", ("2025-10-22 23:12:37", "ERROR", "session.store")),
    ('level=warn time=2025-04-21T03:07:41+02:00 component=a.b msg="x \\"y\\" z"', ("2025-04-21 03:07:41", "WARN", "a.b")),
    ('{"msg": "level=INFO", "lvl":"err","ts":"2025-04-12T07:14:15.273Z","logger":"s.i"}', ("2025-04-12 07:14:15", "ERROR", "s.i")),
    ("<131>1 2025-02-23T15:17:38.059-06:00 dn-10 dfs.NameSpace 24568 - - map", ("2025-02-23 15:17:38", "ERROR", "dfs.NameSpace")),
    ("1741337083.922\tI\tdfs.Node\tTaking in", ("2025-03-07 08:44:43", "INFO", "dfs.Node")),
    ("WARNING:mail.relay:spool x holds 3", ("", "WARN", "mail.relay")),
    ("spool opened at 2025-01-01 00:00:00", ("", "", "")),
    ("", ("", "", "")),
    (None, ("", "", "")),
    ("x" * 100_000, ("", "", "")),
]


def test_layouts(spark):
    df = spark.createDataFrame([(k, line, "own") for k, (line, _) in enumerate(LINES)], "id long, line string, level string")
    got = {r.id: (r.ts_text, r.level, r.component) for r in template_tree.parse(df, "line", ["id", "level"]).collect()}
    assert got == {k: fields for k, (_, fields) in enumerate(LINES)}
    assert "level_in" in template_tree.parse(df, "line", ["id", "level"]).columns


def test_message_text(spark):
    df = spark.createDataFrame([(k, line) for k, (line, _) in enumerate(LINES[:13])], "id long, line string")
    p = template_tree.parse(df, "line", ["id", "line"])
    got = {r.id: r.m for r in p.select("id", template_tree.message_text(F.col("line"), F.col("tokens"), F.col("msg"), F.col("named")).alias("m")).collect()}
    assert got == dict(enumerate(["file 7 serves", "x", "Moved 4 blocks", "no group", "gone", "child took slot", "granted", "refused", 'x "y" z', "level=INFO", "map", "Taking in", "spool x holds 3"]))


def test_line_count(spark):
    df = spark.createDataFrame([("a",), ("a\nb",), ("a\r\nb\r\n",), ("a\n\nb",)], "t string")
    assert [r.n for r in df.select(template_tree.line_count(F.col("t")).alias("n")).collect()] == [1, 2, 2, 3]


def test_entries_across_blocks(spark):
    lines, expected, n = [], [], 1
    rng = random.Random(5)
    for e in range(40):
        size = rng.choice([1, 1, 2, 5, 9])
        lines.append((n, "f", n, f"2025-01-01 00:00:{e:02d}.000 1 INFO a.b [-] entry"))
        lines += [(n + k, "f", n + k, rng.choice(["\tat x.y", "", "}", "  last beat 2025-01-01 00:00:00 from x"])) for k in range(1, size)]
        expected.append((n, size))
        n += size
    rng.shuffle(lines)
    df = spark.createDataFrame(lines, "line_id long, source_file string, line_number int, line string")
    for block in (3, 4096):
        assert rows(template_tree.entries(df, block).select("line_id", "n_lines")) == sorted(expected, key=repr)
    assert template_tree.entries(df.limit(0)).count() == 0


def test_fields_behind_any_number_of_tokens(spark):
    more = ", ".join(f'"k{k}": "v {k}"' for k in range(40))
    groups = "".join(f"[g{k} x] " for k in range(30))
    data = [
        (1, f'{{{more}, "ts": "2025-01-02T03:04:05Z", "level": "warn", "logger": "a.b", "msg": "it {more.count(chr(34))}"}}'),
        (2, f"{' '.join(f'k{k}=v' for k in range(40))} time=2025-01-02T03:04:06Z severity=info module=c.d msg=\"x y\""),
        (3, f"[Sun Mar 30 02:55:23 2025] [m:error] {groups}it broke"),
        (4, '{"when_seen": "2025-01-02T03:04:07Z", "importance": "fatal", "logger": "e"}'),
    ]
    p = template_tree.parse(spark.createDataFrame(data, "id long, line string"), "line", ["id", "line"])
    message = template_tree.message_text(F.col("line"), F.col("tokens"), F.col("msg"), F.col("named"))
    got = {r.id: (r.ts_text, r.level, r.component, r.m) for r in p.withColumn("m", message).collect()}
    assert got[2] == ("2025-01-02 03:04:06", "INFO", "c.d", "x y")
    assert got[3] == ("2025-03-30 02:55:23", "ERROR", "m", "it broke")
    # fields of unknown names are learned from their values
    assert got[4][:3] == ("2025-01-02 03:04:07", "CRITICAL", "e")
    assert got[1][:3] == ("2025-01-02 03:04:05", "WARN", "a.b")


def test_large_leaves_are_split(spark, monkeypatch):
    monkeypatch.setattr(template_tree, "LEAF_ROWS", 3)
    df = spark.createDataFrame([(k, line) for k, (line, _) in enumerate(LINES)] + [(100 + k, f"2025-01-01 00:00:00 1 INFO a.b [-] {w} x y z") for k, w in enumerate("abcdefghij")], "id long, line string")
    got = {r.id: (r.ts_text, r.level, r.component) for r in template_tree.parse(df, "line", ["id"]).collect()}
    assert got == {k: f for k, (_, f) in enumerate(LINES)} | {100 + k: ("2025-01-01 00:00:00", "INFO", "a.b") for k in range(10)}


def test_similar_templates_merge_but_keys_do_not():
    templates, chosen, _ = template_tree.merge_templates([["<lv>", ":", "a", "b", "c"], ["<lv>", ":", "a", "b", "d"], ["<lv>", "=", "a", "b", "c"]])
    assert chosen == [0, 0, 1] and templates[0] == ["<lv>", ":", "a", "b", "<*>"]


# --- 5: time stamps
ZONES = [("h1", "Europe/Berlin", "dmy"), ("h2", "America/New_York", "mdy"), ("h3", "Asia/Kolkata", "dmy")]
STAMPS = [
    ("h1", "2025-07-01 12:00:00", "2025-07-01T10:00:00+00:00", 0),
    ("H1 ", " 2025-01-01 12:00:00,5 ", "2025-01-01T11:00:00+00:00", 500),
    ("h2", "07/04/2025 01:02:03 PM", "2025-07-04T17:02:03+00:00", 0),
    ("h3", "04/07/2025 12:00:00", "2025-07-04T06:30:00+00:00", 0),
    (None, "04.07.2025 12:00:00", "2025-07-04T12:00:00+00:00", 0),
    ("h1", "2025-10-26 02:30:00", "2025-10-26T00:30:00+00:00", 0),
    ("h1", "2025-10-26 02:30:00 CET", "2025-10-26T01:30:00+00:00", 0),
    ("h3", "2025-01-01 05:30:00 IST", "2025-01-01T00:00:00+00:00", 0),
    ("h1", "2025-01-06t08:14:29.9839z", "2025-01-06T08:14:29+00:00", 983),
    ("h1", "20250104T060414Z", "2025-01-04T06:04:14+00:00", 0),
    ("h1", "Sun, 05 Jan 2025 12:19:04 GMT", "2025-01-05T12:19:04+00:00", 0),
    ("h2", "03/Jan/2025:06:52:23 -0500", "2025-01-03T11:52:23+00:00", 0),
    ("h9", "Fri Jan  3 00:04:14 2025", "2025-01-03T00:04:14+00:00", 0),
    ("h9", "250103 000355", "2025-01-03T00:03:55+00:00", 0),
    ("h1", "1735970658", "2025-01-04T06:04:18+00:00", 0),
    ("h1", "1735970658.63", "2025-01-04T06:04:18+00:00", 630),
    ("h1", "1735970658632", "2025-01-04T06:04:18+00:00", 632),
    ("h1", "1735970658632999", "2025-01-04T06:04:18+00:00", 632),
]
BAD = ["", " ", "-", "n/a", "unknown", "0000-00-00 00:00:00", "2025-13-41 27:61:00", "2025-02-30 10:00:00", "13/01/2025 13:00:00 PM", "2025-03-30 02:30:00", None]


def test_instants(spark):
    candidates = timeline.host_candidates(spark.createDataFrame(ZONES, "host string, tz_name string, date_order string"))
    data = [(k, h, t, "z") for k, (h, t, _, _) in enumerate(STAMPS)] + [(100 + k, "h1", t, "z") for k, t in enumerate(BAD)]
    df = spark.createDataFrame(data, "seq long, host string, ts string, zone string")
    got = {r.seq: r.ts_ms for r in timeline.instants(df, "ts", "host", None, candidates, ["seq", "zone"]).collect()}
    assert got == {k: int(datetime.fromisoformat(i).timestamp()) * 1000 + ms for k, (_, _, i, ms) in enumerate(STAMPS)}
    assert timeline.instants(df.limit(0), "ts", "host", None, candidates, ["seq"]).count() == 0


def test_zone_estimate(spark):
    base, data = datetime(2025, 6, 1), []
    for h, shift in (("a", 120), ("b", -240), ("c", 0)):
        for k in range(40):
            at = base + timedelta(hours=7 * k)
            data.append((h, (at + timedelta(minutes=shift)).strftime("%Y-%m-%d %H:%M:%S"), (at + timedelta(seconds=5)).replace(tzinfo=timezone.utc)))
    df = spark.createDataFrame(data, "host string, ts string, ingested_at timestamp")
    zones = ["Europe/Berlin", "America/New_York", "UTC", "Asia/Kolkata"]
    none = timeline.host_candidates(spark.createDataFrame([], "host string, tz_name string, date_order string"))
    got = {r.host: (r.zone, r.violations) for r in timeline.estimate_zones(df, "ts", "host", "ingested_at", zones, none).collect()}
    assert got == {"a": ("Europe/Berlin", 0), "b": ("America/New_York", 0), "c": ("UTC", 0)}


def test_one_instant_for_an_abbreviation_with_several_offsets(spark):
    candidates = timeline.host_candidates(spark.createDataFrame([("m", "Europe/Moscow", "dmy")], "host string, tz_name string, date_order string"))
    data = [(1, "m", "2025-03-01 10:00:00 MSK"), (2, "m", "2012-03-01 10:00:00 MSK"), (3, "m", "2009-01-15 10:00:00 MSK"), (4, "m", "2025-03-01 10:00:00 EST")]
    got = rows(timeline.instants(spark.createDataFrame(data, "seq long, host string, ts string"), "ts", "host", None, candidates, ["seq"]))
    at = lambda s: int(datetime.fromisoformat(s).timestamp()) * 1000
    assert got == [(1, at("2025-03-01T07:00:00+00:00")), (2, at("2012-03-01T06:00:00+00:00")), (3, at("2009-01-15T07:00:00+00:00"))]


def test_hosts_without_listed_zone_take_the_history_that_fits(spark):
    candidates = timeline.host_candidates(spark.createDataFrame([("x", "Asia/Kolkata", "dmy")], "host string, tz_name string, date_order string"))
    base, data = datetime(2025, 6, 1), []
    for host, minutes, n in (("far", 330, 40), ("few", 330, 5), ("near", 0, 40), (None, 330, 40)):
        for k in range(n):
            at = base + timedelta(hours=7 * k)
            data.append((len(data), host, (at + timedelta(minutes=minutes)).strftime("%Y-%m-%d %H:%M:%S"), (at + timedelta(seconds=5)).replace(tzinfo=timezone.utc)))
    df = spark.createDataFrame(data, "seq long, host string, ts string, ingested timestamp")
    got = {r.seq: r.ts_ms for r in timeline.instants(df, "ts", "host", "ingested", candidates, ["seq"]).collect()}
    shift = {host: got[seq] + 5000 - int(at.timestamp()) * 1000 for seq, host, _, at in data}
    # five rows are no evidence against UTC; rows without host have no history
    assert shift == {"far": 0, "few": 330 * 60000, "near": 0, None: 330 * 60000}


# --- 6: orphans
def test_orphan_kinds(spark):
    t = lambda day: datetime(2025, 1, day, tzinfo=timezone.utc)
    refs = [("q", "1", "log", "a", t(5)), ("q", "1", "log", "a", t(5)), ("q", "2", "log", "b", t(5)), ("q", "3", "log", "c", t(5)), ("q", "4", "log", "none", t(5)), ("q", "5", "log", "c", None)]
    parents = [("log", "a", t(1)), ("log", "b", t(2)), ("log", "c", t(9)), ("log", "c", t(8)), ("log", None, t(1)), ("inc", "none", t(1))]
    refs = spark.createDataFrame(refs, "tbl string, rec_id string, parent_tbl string, ref_id string, created_at timestamp")
    parents = spark.createDataFrame(parents, "parent_tbl string, key string, available_at timestamp")
    deleted = spark.createDataFrame([("log", "b"), ("log", "b"), ("log", "zz")], "parent_tbl string, key string")
    found = orphans.orphans(refs, parents, deleted, 6)
    assert [r[1:4] for r in rows(found)] == [("2", "b", "deleted"), ("3", "c", "late"), ("4", "none", "missing")]
    assert {r.period for r in found.collect()} == {"2025-01"}
    assert orphans.orphans(refs.limit(0), parents, deleted, 6).count() == 0
    assert {r.kind for r in orphans.orphans(refs, parents.limit(0), deleted, 0).collect()} == {"missing"}


def test_filters_beyond_the_broadcast_bound_give_the_same_orphans(spark, monkeypatch):
    parents = spark.range(3000).select(F.lit("log").alias("parent_tbl"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("key"), F.lit(datetime(2025, 1, 1)).alias("available_at"))
    refs = spark.range(4000).select(F.lit("q").alias("tbl"), F.col("id").cast("string").alias("rec_id"), F.lit("log").alias("parent_tbl"), F.concat(F.lit("p"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string"))).alias("ref_id"), F.lit(datetime(2025, 2, 1)).alias("created_at"))
    deleted = spark.createDataFrame([("log", "p7")], "parent_tbl string, key string")
    wanted = rows(orphans.orphans(refs, parents, deleted, 3000))
    assert len(wanted) == 1334 + 667 and ("q", "7", "p7", "deleted", "2025-02") in wanted
    monkeypatch.setattr(orphans, "MAX_BROADCAST_WORDS", 0)
    assert rows(orphans.orphans(refs, parents, deleted, 3000)) == wanted


def test_filters_keep_sixteen_bits_a_key():
    for n in (10, 10**6, 10**8, 10**10):
        assert orphans.words_for(n) * 64 >= 16 * n


def test_bloom_never_misses_a_key(spark):
    keys = spark.range(5000).select(F.col("id").cast("string").alias("k"))
    for words in (64, 2048):
        hit = orphans.probe(keys, "k", orphans.bloom_words(keys, "k", words), words)
        assert hit.filter(~F.col("maybe")).count() == 0
    other = spark.range(5000, 10000).select(F.col("id").cast("string").alias("k"))
    assert orphans.probe(other, "k", orphans.bloom_words(keys, "k", 2048), 2048).filter("maybe").count() < 500


# --- 7: sessions
def brute_sessions(data, gap):
    by_key, seen, out = {}, {}, []
    for key, t, event in data:
        k = (key or "").strip().lower()
        if k in ("", "-") or t is None:
            continue
        if event is None:
            by_key.setdefault(k, []).append(t)
        elif (k, event) not in seen or t < seen[k, event]:
            seen[k, event] = t
    for (k, _), t in seen.items():
        by_key.setdefault(k, []).append(t)
    for k, times in by_key.items():
        times.sort()
        start = last = times[0]
        n = 1
        for t in times[1:]:
            if t - last > gap:
                out.append((k, start, last, n))
                start, n = t, 0
            last, n = t, n + 1
        out.append((k, start, last, n))
    return sorted(out, key=repr)


def test_sessions_against_brute_force(spark):
    rng = random.Random(11)
    data = []
    for k in range(500):
        key = rng.choice(["r1", "R1 ", "r1", "r2", "r3", None, "", "-", " r4"])
        data.append((key, rng.choice([None, *[rng.randint(0, 4000) * 1000 for _ in range(20)]]), rng.choice([None, f"e{k % 400}"])))
    df = spark.createDataFrame([(k, None if t is None else datetime.fromtimestamp(t / 1000, timezone.utc), e, 1) for k, t, e in data], "request_id string, timestamp timestamp, log_id string, key int")
    for block in (7_000, 3_600_000):
        got = sessions.sessionize(df, "request_id", "timestamp", "log_id", gap_ms=20_000, block_ms=block)
        assert rows(got.select("key", "start_ms", "end_ms", "n_events")) == brute_sessions(data, 20_000)
    assert sessions.sessionize(df.limit(0), "request_id", "timestamp", "log_id").count() == 0


def test_exact_gap_does_not_end_a_session(spark):
    t = lambda s: datetime.fromtimestamp(s, timezone.utc)
    df = spark.createDataFrame([("a", t(0), "1"), ("a", t(1800), "2"), ("a", t(3601), "3")], "request_id string, timestamp timestamp, log_id string")
    got = sessions.sessionize(df, "request_id", "timestamp", "log_id").select("start_ms", "end_ms", "n_events")
    assert rows(got) == [(0, 1800000, 2), (3601000, 3601000, 1)]


def test_materialize_survives_in_the_shared_folder(spark):
    df = materialize(spark.range(3).withColumn("x", F.col("id") * 2), "t")
    assert rows(df) == [(0, 0), (1, 2), (2, 4)]
