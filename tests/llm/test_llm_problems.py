"""Small cases of the llm problems against brute force, round trips and held-out accuracy."""

import math
import random

import pytest
from pyspark.sql import functions as F

from logstrata.llm import leakage, mixing, pii, rank, runs


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- 1: one ranking
def brute_rho(ranks):
    r, n = sorted(ranks), len(ranks)
    tails = [sum(math.comb(n, j) * r[k - 1] ** j * (1 - r[k - 1]) ** (n - j) for j in range(k, n + 1)) for k in range(1, n + 1)]
    return min(1.0, min(tails) * n)


def brute_ranking(items):
    """items: {group: {item: {score: value}}}"""
    out = {}
    for g, members in items.items():
        names = {s for v in members.values() for s, x in v.items() if x is not None and not math.isnan(x)}
        for i in members:
            ranks = []
            for s in names:
                known = [x for v in members.values() if (x := v.get(s)) is not None and not math.isnan(x)]
                value = lambda v, s=s, known=known: v.get(s) if v.get(s) is not None and not math.isnan(v.get(s)) else min(known)
                mine, all_ = value(members[i]), [value(v) for v in members.values()]
                ranks.append((sum(x > mine for x in all_) + (sum(x == mine for x in all_) + 1) / 2) / len(all_))
            out[g, i] = round(brute_rho(ranks), 9) if ranks else 1.0
    return out


def test_ranking_against_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    items = {f"g{g}": {f"i{k}": {s: rng.choice([None, float("nan"), rng.randint(0, 4) * 10.0**p, rng.random()]) for p, s in enumerate("abcd")} for k in range(rng.randint(1, 9))} for g in range(12)}
    items["none"] = {"i0": {}, "i1": {"a": None}}
    data = [(g, i, v) for g, m in items.items() for i, v in m.items()] + [(None, "x", {"a": 1.0}), ("g0", None, {"a": 9.0})]
    df = spark.createDataFrame(data, "grp string, item string, scores map<string,double>").withColumn("score", F.lit(1))
    expected = brute_ranking(items)
    for array_rows, block_rows in ((256, 20_000), (5, 20_000), (0, 3)):
        monkeypatch.setattr(rank, "ARRAY_ROWS", array_rows)
        monkeypatch.setattr(rank, "BLOCK_ROWS", block_rows)
        got = {(r.grp, r.item): round(r.rho, 9) for r in rank.aggregate_ranks(df, "grp", "item", "scores").collect()}
        assert got == pytest.approx(expected, abs=1e-8)
    assert rank.aggregate_ranks(df.limit(0), "grp", "item", "scores").count() == 0


def test_large_scale_does_not_dominate(spark):
    data = [("g", "big", {"a": 1e9, "b": 0.1, "c": 0.1}), ("g", "steady", {"a": 2.0, "b": 0.9, "c": 0.9}), ("g", "low", {"a": 1.0, "b": 0.5, "c": 0.5})]
    df = spark.createDataFrame(data, "grp string, item string, scores map<string,double>")
    first = rank.first_ranked(rank.aggregate_ranks(df, "grp", "item", "scores"), "grp", "item")
    assert rows(first) == [("g", "steady")]


def test_unlisted_rows_only_add_scores(spark, monkeypatch):
    data = [("g", "a", {"x": 1.0}, True), ("g", "b", {"x": 2.0}, True), ("g", "a", {"y": 3.0}, False), ("g", "a", {"y": 9.0}, False), ("g", "b", {"y": 4.0}, False), ("g", "c", {"y": 99.0, "x": 9.0, "z": 1.0}, False)]
    df = spark.createDataFrame(data, "grp string, item string, scores map<string,double>, own boolean")
    for array_rows in (256, 0):
        monkeypatch.setattr(rank, "ARRAY_ROWS", array_rows)
        got = {r.item: (r.mean_rank, r.n_scores) for r in rank.aggregate_ranks(df, "grp", "item", "scores", "own").collect()}
        assert got == {"a": (0.75, 2), "b": (0.75, 2)}


def test_chance_is_no_significance(spark):
    """rho of `peak` is smaller but no better than chance; `even` has the better mean rank."""
    data = [("g", "peak", 0.5, 0.60, math.log(0.5)), ("g", "even", 0.6, 0.40, math.log(0.6)), ("h", "clear", 0.01, 0.60, math.log(0.01)), ("h", "even", 0.2, 0.40, math.log(0.2))]
    df = spark.createDataFrame(data, "grp string, item string, rho double, mean_rank double, log_rho double")
    assert rows(rank.first_ranked(df, "grp", "item")) == [("g", "even"), ("h", "clear")]


# --- 4: runs
def test_runs_against_brute_force(spark):
    rng = random.Random(9)
    data = [(f"f{rng.randint(0, 2)}", n, n * 7 % 1000, rng.choice([1, 1, 1, 2, None]), n * 10) for n in range(300)]
    data += [(f, n, s + 5000, 99, t) for f, n, s, _, t in data[::7]] + [(None, 1, 1, 1, 1), ("f0", None, 1, 1, 1)]
    df = spark.createDataFrame(data, "source_file string, line_number int, seq long, key long, ts_ms long").withColumn("block", F.lit("x"))
    expected, by_file = [], {}
    for f, n, _, key, t in data[:300]:
        by_file.setdefault(f, []).append((n, key, t))
    for f, events in by_file.items():
        events.sort()
        k = 0
        while k < len(events):
            j = k
            while j + 1 < len(events) and events[j + 1][1] == events[k][1]:
                j += 1
            expected.append((f, events[k][0], events[j][0], j - k + 1, events[j][2] - events[k][2]))
            k = j + 1
    for block in (4, 50, 4096):
        assert rows(runs.collapse_runs(df, block)) == sorted(expected, key=repr)
    assert runs.collapse_runs(df.limit(0)).count() == 0


def test_message_keys(spark):
    same = [("Lease on /srv/a/1.db granted", "LEASE  on /srv/zz/9.tmp\u00a0granted"), ("worker slate-lynx left state 5", "worker ochre-owl left state 77")]
    different = [(f"Mounted {a} volume", f"Mounted {b} volume") for a, b in (("read-only", "write-only"), ("fail-over", "roll-back"), ("fast-path", "slow-path"), ("in-memory", "on-disk"))]
    different += [("Lease on /srv/a granted", "Lease on /srv/a revoked"), ("Backend a-b reports ready", "Backend a-b reports not ready")]
    df = spark.createDataFrame([(*p, True) for p in same] + [(*p, False) for p in different] + [(None, "", True)], "a string, b string, same boolean")
    got = df.withColumn("equal", runs.message_key(F.col("a")) == runs.message_key(F.col("b"))).collect()
    assert [r["equal"] for r in got] == [r["same"] for r in got]


# --- 8: leaks
WORDS = "alpha bravo copper delta ember frost gamma hotel indigo jasper karma lemon metal north ocean piano quartz river sable tango umber violet willow xenon yellow zebra anchor bridge castle dragon".split()


def edits_of(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j - 1] + (x != y), prev[j] + 1, cur[-1] + 1))
        prev = cur
    return prev[-1]


def brute_leaks(docs, items):
    found = set()
    for d, text in docs:
        w = leakage.words(text)
        for i, t in items:
            v = leakage.words(t)
            if any(
                edits_of(v[a : a + m], w[b : b + n]) <= e
                for m, e in leakage.PIECES
                for a in range(len(v) - m + 1)
                for b in range(len(w))
                for n in range(m - e, m + e + 1)
                if b + n <= len(w)
            ):
                found.add((d, i))
    return found


def test_leaks_against_brute_force(spark):
    rng = random.Random(4)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.choice([5, 12, 20, 30])))) for i in range(8)]
    docs = [(0, None), (1, ""), (None, items[3][1])]
    for d in range(2, 60):
        piece = rng.choice(items)[1].split()
        n = rng.choice([8, 11, 12, 13, 16, 18])
        a = rng.randint(0, max(0, len(piece) - n))
        piece = piece[a : a + n]
        for _ in range(rng.choice([0, 1, 2, 3])):
            k = rng.randrange(len(piece))
            piece[k : k + 1] = rng.choice([[], ["new"], [piece[k], "more"]])
        noise = lambda: [rng.choice(WORDS) for _ in range(rng.randint(0, 10))]
        text = noise() + [rng.choice([w, w.upper(), f"<b>{w}</b>", f'"{w},"', f"{w}\n"]) for w in piece] + noise()
        docs.append((d, " ".join(text)))
    expected = brute_leaks([x for x in docs if x[0] is not None], items)
    ddf = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(5))
    idf = spark.createDataFrame(items + [(None, "x"), (99, None)], "item_id long, text string")
    assert 5 < len(expected) < len(docs)
    assert {tuple(r) for r in leakage.find_leaks(ddf, idf, batch=7).collect()} == expected
    assert leakage.find_leaks(ddf.limit(0), idf).count() == 0 and leakage.find_leaks(ddf, idf.limit(0)).count() == 0


def test_markup_of_any_length_does_not_count():
    assert leakage.words("one <a title='" + "x y " * 500 + "'>two</a> &lt;three") == ["one", "two", "three"]


def test_items_in_blocks_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(leakage, "ITEM_BLOCK_CHARS", 100)
    monkeypatch.setattr(leakage, "SLICE", 64)
    rng = random.Random(8)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(15))) for i in range(5)]
    docs = [(i, "filler words here " * 2000 + t + " tail" * 500) for i, t in items]
    got = leakage.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} >= {(i, i) for i, _ in items}


# --- 9: mixing
def test_plan_meets_targets_within_repeats(spark):
    rng = random.Random(6)
    docs = [(k, rng.choice(["A", "a ", "b", "b", "b", "c", None, "other"]), " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 60)))) for k in range(900)] + [(1000, "a", None), (1001, "b", ""), (None, "a", "x")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("copies", F.lit("x"))
    targets = spark.createDataFrame([("a", 0.5, 2), ("B", 0.3, 1), ("c", 0.2, 3), ("absent", 0.1, 2), ("other", 0.0, 5)], "source string, target_share double, max_repeats int")
    planned = mixing.plan(df, targets).cache()
    caps = {"a": 2, "b": 1, "c": 3, "other": 0}
    assert planned.filter("source = 'other' AND rate <> 0").count() == 0
    used = {}
    for r in planned.collect():
        assert 0 <= r.copies <= caps[r.source] and (r.n_tokens > 0 or r.copies == 0)
        used[r.source] = used.get(r.source, 0) + r.copies * r.n_tokens
    total = sum(used.values())
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert used[s] / total == pytest.approx(share, abs=0.0003)
    report = {r.source: r.actual_share for r in mixing.report(planned, targets).collect()}
    assert report["absent"] == 0.0 and report["a"] == pytest.approx(0.5, abs=0.0003)
    assert mixing.plan(df.limit(0), targets).count() == 0


def test_rates_are_exponentially_tilted(spark):
    docs = [(k, "a" if k % 2 else "b", "word " * (1 + k % 40)) for k in range(400)]
    targets = spark.createDataFrame([("a", 0.9, 4), ("b", 0.1, 4)], "source string, target_share double, max_repeats int")
    planned = mixing.plan(spark.createDataFrame(docs, "doc_id long, source string, text string"), targets)
    rates = {r.n_tokens: r.rate for r in planned.filter("source = 'b'").collect()}
    slopes = [math.log(rates[t]) / t for t in rates if 0 < rates[t] < 4]
    assert max(slopes) - min(slopes) < 1e-3 and max(slopes) < 0


# --- 10: personal information
def test_field_on_held_out_texts():
    texts, given, family = pii.training_texts(250, seed=99)
    weights = pii.fitted()
    hit = wrong = missed = 0
    for text, gold in texts:
        found = set(pii.decode(pii.candidates(text, given, family), weights))
        hit, wrong, missed = hit + len(found & gold), wrong + len(found - gold), missed + len(gold - found)
    assert hit / (hit + wrong) > 0.97 and hit / (hit + missed) > 0.97


def brute_best(spans, weights):
    best = 0.0
    for mask in range(1 << len(spans)):
        chosen = [s for k, s in enumerate(spans) if mask >> k & 1]
        if all(a[1] <= b[0] or b[1] <= a[0] for k, a in enumerate(chosen) for b in chosen[k + 1 :]):
            best = max(best, sum(pii._score(weights, s) for s in chosen))
    return best


def test_decoding_and_gradient_against_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        spans = sorted(((a := rng.randint(0, 12)), a + rng.randint(1, 5), rng.choice(pii.TYPES), [f"f{k}"]) for k in range(rng.randint(1, 7)))
        spans = sorted(spans, key=lambda x: (x[1], x[0] - x[1]))
        weights = {f"f{k}": rng.uniform(-1, 2) for k in range(7)}
        chosen = pii.decode(spans, weights)
        # each span of a (start, end, type) has its best score
        score = sum(max(pii._score(weights, s) for s in spans if s[:3] == c) for c in chosen)
        assert score == pytest.approx(brute_best(spans, weights), abs=1e-6)

        def loglik(w, gold=frozenset(chosen)):
            total = gold_score = 0.0
            for mask in range(1 << len(spans)):
                c = [s for k, s in enumerate(spans) if mask >> k & 1]
                if all(a[1] <= b[0] or b[1] <= a[0] for k, a in enumerate(c) for b in c[k + 1 :]):
                    total += math.exp(sum(pii._score(w, s) for s in c))
            gold_score = sum(pii._score(w, s) for s in spans if s[:3] in gold)
            return gold_score - math.log(total)

        grad = {}
        pii.gradient(spans, set(chosen), weights, grad)
        f = spans[0][3][0]
        up = loglik(weights | {f: weights[f] + 1e-5})
        down = loglik(weights | {f: weights[f] - 1e-5})
        if len({s[:3] for s in spans}) == len(spans):
            assert grad[f] == pytest.approx((up - down) / 2e-5, abs=1e-4)


CASES = [
    ("Please ask Y. Vostrikel (ysolde.v@relay.invalid) first.", {("name", "Y. Vostrikel"), ("email", "ysolde.v@relay.invalid")}),
    ("Das Gerät geht an Am Fuchsgrund 115, 00643 Altdorf.", {("address", "Am Fuchsgrund 115")}),
    ("Gửi thiết bị đến số 158 đường Bến Đá Xanh, Xã Suối Bạc.", {("address", "số 158 đường Bến Đá Xanh")}),
    ("The spare parts went to 150B St. Maddock's Close, Apt 22, phone +1 595 555 0124 ext. 12.", {("address", "150B St. Maddock's Close"), ("phone", "+1 595 555 0124 ext. 12")}),
    ("id=773-00-9961;mail=lorcan84[at]corp[dot]test;tel=+44 20 7946 0409", {("id_number", "773-00-9961"), ("email", "lorcan84[at]corp[dot]test"), ("phone", "+44 20 7946 0409")}),
    ("Serial 268-653-9891 is printed; counter 223.977.8464 at 10.0.0.1:8080, git@mirror-29:ops/x.git, the Zephrine release", set()),
    ("My name is VOSTRIKEL, YSOLDE and my national insurance no. is QQ757325A.", {("name", "VOSTRIKEL, YSOLDE"), ("id_number", "QQ757325A")}),
    ("", set()), (None, set()),
]


def found(text, names=()):
    given, family = {pii.fold(n.split()[0]) for n in names}, {pii.fold(n.split()[-1]) for n in names}
    return {(kind, text[s:e]) for s, e, kind in pii.decode(pii.candidates(text, given, family), pii.fitted())}


def test_mentions_beyond_usual_sizes():
    long_street = "12 " + " ".join(["Quillmarsh"] * 9) + " Street"
    assert ("address", long_street) in found(f"Send the box to {long_street}, Newtown.") and len(long_street) > 93
    assert ("phone", "555 0142") in found("Reach the shift, phone 555 0142.")
    assert found("Please call Anna Smith at 555-0142.", ["Anna Smith"]) == {("name", "Anna Smith"), ("phone", "555-0142")}
    assert ("name", "Nguyễn Văn An") in found("Reported by Nguyễn Văn An, thanks.", ["An Nguyễn"])
    assert ("name", "Tomoko Yamamoto-Hernandez Garcia") in found("Please ask Tomoko Yamamoto-Hernandez Garcia (ops) first.", ["Tomoko Garcia"])


def test_full_stops_cues_and_clocks():
    assert found("Send the disk to 42 Northfold Blvd. | next") == {("address", "42 Northfold Blvd")}
    assert found("Send the disk to 42 Northfold Blvd., Fenwold") == {("address", "42 Northfold Blvd.")}
    assert found("Das Gerät geht an Rabensteiner Straße 211a, 00411 Altdorf. Das andere geht an Lindenweg 3.") == {("address", "Rabensteiner Straße 211a"), ("address", "Lindenweg 3")}
    assert found("went to 3 Osprey Lane, Port Ellery, phone 01632 960589.") == {("address", "3 Osprey Lane"), ("phone", "01632 960589")}
    assert found("Decorate the call with it and watch counter 916.963.2561.") == set()
    assert found("251025 083833 897 WARN ssl: handshake") == set()


def test_mentions_and_placeholders(spark):
    docs = spark.createDataFrame([(k, t, "n") for k, (t, _) in enumerate(CASES)] + [(None, "ask Ysolde Vostrikel", "n")], "doc_id long, text string, pii_type string")
    names = spark.createDataFrame([("Ysolde", "Vostrikel"), ("Zephrine", "Morvane"), (None, None)], "given_name string, family_name string")
    got = {}
    for r in pii.find_mentions(docs, names).collect():
        assert CASES[r.doc_id][0][r.start : r.end] == r.pii_text
        got.setdefault(r.doc_id, set()).add((r.pii_type, r.pii_text))
    assert {k: got.get(k, set()) for k in range(len(CASES))} == {k: c for k, (_, c) in enumerate(CASES)}
    redacted = {r.doc_id: r.text for r in pii.redact(docs, names).collect()}
    assert redacted[0] == "Please ask [NAME] ([EMAIL]) first." and redacted[8] is None and redacted[None] == "ask [NAME]"
    assert pii.find_mentions(docs.limit(0), names).count() == 0


def test_every_query_has_its_module():
    from logstrata.llm import queries

    assert {"p1_found", "p4_found", "p8_found", "p9_plan", "p10_found"} <= set(queries.QUERIES)
    assert set(queries.ORACLE) <= set(queries.QUERIES)
