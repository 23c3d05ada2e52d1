"""Catalog rules, labels, validation, template route, scopes and stores on small rows: nulls, ties, repeats, empty tables."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logstrata import session
from logstrata.operators import anomaly, baseline, blocks, matcher, qrels, questions, rca, registry, scopes, validation
from logstrata.sources import corpus, files, keyed


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- catalog
RULE = "template_id string, dataset string, template string, regex string, component string, level string, priority int, active boolean"


def test_highest_priority_names_a_message_and_fills_slots(spark):
    records = [
        ("r:block", "hdfs", None, r"block (?P<block_id>blk_-?\d+)", None, None, 10, True), ("r:served", "hdfs", "<*> Served block <block_id> to <ip>", None, None, None, None, None), ("r:same", "hdfs", None, r"Served", None, None, 100, True),
        ("r:only", "hdfs", None, r"Served", "c", "ERROR", 500, True), ("r:off", "hdfs", None, r".", None, None, 900, False), ("r:form", "apache", "moved <num> files", None, "x", None, 1, True),
    ]
    rules = matcher.rules_from_records(spark.createDataFrame(records, RULE))
    said = "n1 Served block blk_-5 to 10.0.0.1"
    data = [(1, "HDFS ", None, None, said), (2, "hdfs", "c", "ERROR", said), (3, "hdfs", None, None, "nothing 7"), (4, "apache", "x", None, "MOVED 3 files"), (5, "apache", "y", None, "moved 3 files"), (6, "hdfs", None, None, None), (7, None, None, None, said), (8, "hdfs", None, None, " ")]
    found = matcher.match_rules(spark.createDataFrame(data, "k int, dataset string, component string, level string, message string"), rules, "k")
    got = {r.k: (r.template_id, r.match_method, r.candidate_count, dict(r.slots)) for r in found.collect()}
    assert got[1] == ("r:same", "regex", 3, {}) and got[2][:3] == ("r:only", "regex", 4)
    assert got[3] == (None, "fallback_normalize", 0, {}) and got[4][0] == "r:form" and got[4][3] == {"num": "3"}
    assert [got[k][0] for k in (5, 6, 7, 8)] == [None] * 4
    assert matcher.never_matched(rules, found).count() == 2  # r:block and r:served lose to r:same
    assert matcher.match_rules(spark.createDataFrame(data, "k int, dataset string, component string, level string, message string").limit(0), rules, "k").count() == 0


def test_slots_of_templates_and_refused_records(spark):
    rules = matcher.rules_from_records(spark.createDataFrame([("r", "hdfs", "<*> Served block <block_id> to <ip> and <ip>", None, None, None, 1, True)], RULE))
    data = spark.createDataFrame([(1, "hdfs", None, None, "n1 Served block blk_-5 to 10.0.0.1 and 10.0.0.2")], "k int, dataset string, component string, level string, message string")
    (r,) = matcher.match_rules(data, rules, "k").collect()
    assert r.slots == {"wildcard": "n1", "block_id": "blk_-5", "ip": "10.0.0.1", "ip_2": "10.0.0.2"}
    with pytest.raises(Exception, match="template or regex is required"):
        matcher.rules_from_records(spark.createDataFrame([("r", "hdfs", " ", None, None, None, 1, True)], RULE))


# --- labels
def test_labels_fill_up_with_rows_of_the_same_context(spark):
    text = ["request timed out after 3 s"] * 3 + ["waiting for lock"] * 2 + ["vm started successfully"] + ["plain words"] * 15
    data = [(k, "openstack", "api" if k < 12 else "db", "ERROR" if k < 3 else "INFO", k, t, t, None) for k, t in enumerate(text)]
    logs = spark.createDataFrame(data, "seq int, dataset string, component string, level string, line_number int, raw_log string, message string, event_id string")
    bank = [("q", "openstack", "timeout", None, None, "easy", "calls and timeouts"), ("none", "hdfs", "timeout", None, None, "easy", "x")]
    found = qrels.qrels(logs, bank)
    by = {}
    for r in found.collect():
        by.setdefault((r.query_id, r.label), []).append((r["rank"], r.seq))
    assert [s for _, s in sorted(by["q", "positive"])] == [0, 1, 2] and len(by["q", "uncertain"]) == 2
    negatives = [s for _, s in sorted(by["q", "hard_negative"])]
    assert negatives[0] == 5 and sorted(negatives[1:]) == [3, 4, 6, 7, 8, 9, 10, 11] and [k for k, _ in sorted(by["q", "hard_negative"])] == list(range(1, 10))
    reviews = {r.query_id: r for r in qrels.reviews(found, bank).collect()}
    assert reviews["q"].reasons == "has uncertain candidates;multi-clause query" and reviews["none"].label_source == "auto_candidate"
    assert qrels.qrels(logs.limit(0), bank).count() == 0


# --- validation
def test_rows_with_their_errors(spark):
    data = [("i1", "explicit_root_cause", "l2", "l1", ["l1", "l2"], "s"), ("i2", "silent_root_cause", "l2", "l1", ["l1"], ""), ("i3", "other", None, None, None, None)]
    incidents = spark.createDataFrame(data, "incident_id string, scenario_type string, incident_log_id string, root_cause_log_id string, evidence_log_ids array<string>, root_cause_summary string")
    errors = {r.incident_id: r.errors for r in validation.incident_errors(incidents).collect()}
    assert errors["i1"] == [] and len(errors["i2"]) == 3 and errors["i3"] == ["invalid scenario_type", "incident_log_id must be a non-empty string", "missing list field: evidence_log_ids", "root_cause_summary must be a non-empty string"]
    at = datetime(2025, 1, 1)
    logs = spark.createDataFrame([("l1", at + timedelta(1)), ("l2", at)], "log_id string, at timestamp")
    assert rows(validation.chain_errors(incidents, logs)) == [("i1", "evidence chain is not time ordered"), ("i1", "root cause occurs after incident log")]
    assert validation.report(validation.incident_errors(incidents.limit(0))).count() == 0


def test_manifests(spark):
    a = spark.createDataFrame([("x", 1, "1"), ("y", 1, "1"), ("z", 1, "1")], "file string, bytes long, sha256 string")
    b = spark.createDataFrame([("x", 1, "1"), ("y", 1, "2"), ("w", 1, "1")], "file string, bytes long, sha256 string")
    assert rows(validation.manifest_errors(a, b)) == [("w", "unexpected file"), ("y", "checksum mismatch"), ("z", "missing file")]


# --- template route
def test_gate_and_pending_candidates(spark):
    c = spark.createDataFrame([("q", "t1", 0.9, 1), ("q", "t2", 0.5, 2), ("r", "t1", 0.9, 1)], "query_id string, id string, score double, rank int")
    assert rows(registry.gate(c, 0.8, 0.3)) == [("q", True), ("r", True)] and rows(registry.gate(c, 0.95)) == [("q", False), ("r", False)]
    lines = spark.createDataFrame([("q", "l1", "t1", None, 0.5), ("q", "l2", None, "p1", 0.4), ("q", "l3", "t9", "", 0.3), ("q", "l4", None, None, 0.2)], "query_id string, id string, template_id string, candidate_id string, score double")
    chosen = spark.createDataFrame([("q", "t1", "template_registry"), ("q", "p1", "pending_template_registry")], "query_id string, id string, source string")
    assert [(r.id, r.source) for r in registry.candidate_lines(lines, chosen).orderBy("id").collect()] == [("l1", "template_filtered"), ("l2", "candidate_filtered")]
    known = spark.createDataFrame([("t9",), ("t8",)], "template_id string")
    pending = spark.createDataFrame([("p1",)], "candidate_id string")
    assert ("q", "t9", "template_lookup") in rows(registry.enrich_from_lines(lines, chosen.filter("id = 't1'"), known, pending)) and registry.enrich_from_lines(lines, chosen, known, pending).count() == 3
    assert [r.id for r in registry.cap_per_template(lines, 1, 3).orderBy("rank").collect()] == ["l1", "l2", "l3"]


def test_scopes_and_fallbacks(spark):
    data = [(1, "a", "d1", "s", "c", "WARN", "disk full", 5), (2, "b", "d2", "s2", "c", None, "disk ok", 9), (3, None, "d1", "s", None, "ERROR", None, None)]
    logs = spark.createDataFrame(data, "seq int, log_id string, dataset string, service string, component string, level string, message string, ts_ms long")
    take = lambda df: [r.seq for r in df.collect()]
    assert take(logs.filter(scopes.in_scope("d1", "c", ["warning"]))) == [1] and take(logs.filter(scopes.in_scope(levels=["unknown"]))) == [2]
    assert take(scopes.fallback_rows(logs, ["disk"], 5, dataset="d1")) == [1] and take(scopes.fallback_rows(logs, ["ok"], 5, dataset="d1")) == [2]
    assert take(scopes.fallback_rows(logs, ["nowhere"], 5, dataset="d1")) == [1, 3] and take(scopes.fallback_rows(logs.limit(0), ["x"], 5)) == []
    assert take(scopes.search(logs, 0, dataset="d1")) == [1] and scopes.single_level(["UNKNOWN", "INFO"]) == "INFO" and scopes.chosen("all") is None
    assert sorted(take(scopes.upsert_by_identity(logs, logs.filter("seq <> 2")))) == [1, 2, 3, 3]
    assert take(scopes.incident_of(logs.withColumn("anomaly_score", F.lit(0.7)), ["disk"])) == [2] and take(scopes.incident_of(logs.withColumn("anomaly_score", F.lit(0.0)), ["x"], "a")) == [1]


def test_same_family_and_service_fallback(spark):
    one = [("l1", "d", None, "log", "f", 1000), ("l2", "d", None, "log", "f", 2000), ("l3", "d", None, None, None, 1500)]
    logs = spark.createDataFrame(one, "log_id string, dataset string, service string, logger string, event_family string, ts_ms long").withColumns({"template": F.col("log_id"), "anomaly_score": F.lit(0.0)})
    got = {r.c_log_id: (r.s_template, r.s_service) for r in rca.score_candidates(rca.investigation_window(logs, logs.filter("log_id = 'l2'"))).collect()}
    assert got == {"l1": (0.5, 1.0), "l3": (0.0, 0.25)}


# --- stores and files
def test_runs_replace_themselves_and_compact(spark, tmp_path):
    path = str(tmp_path / "store")
    batch = lambda *r: spark.createDataFrame(list(r), "id string, seq int, v string")
    keyed.append_run(batch(("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), (None, 9, "n")), path, "id", "seq", 0, 4)
    for _ in range(2):
        keyed.append_run(batch(("a", 2, "later"), ("c", 1, "w")), path, "id", "seq", 1, 4)
    wanted = [("a", 2, "later"), ("b", 1, "z"), ("c", 1, "w")]
    assert rows(keyed.read_store(spark, path, "id", "seq")) == wanted
    keyed.compact(spark, path, "id", "seq")
    assert rows(keyed.read_store(spark, path, "id", "seq")) == wanted and len([p for p in (tmp_path / "store").iterdir() if p.name.startswith("run=")]) == 1


def test_lines_are_numbered_over_splits(spark, tmp_path):
    (tmp_path / "a.log").write_bytes("﻿".encode() + b"".join(b"line %d\r\n\r\n" % k for k in range(300)))
    (tmp_path / "b.txt").write_text("one\ntwo")
    (tmp_path / ".hidden.log").write_text("no")
    (tmp_path / "notes.md").write_text("no")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500b")
    try:
        lines = corpus.numbered_lines(spark, corpus.discover(spark, str(tmp_path))).filter("line <> ''").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = sorted((r.source_file.rsplit("/", 1)[1], r.line_number, r.line) for r in lines)
    assert got == [("a.log", 2 * k + 1, f"line {k}") for k in range(300)] + [("b.txt", 1, "one"), ("b.txt", 2, "two")]
    (tmp_path / "x_structured.csv").write_text("h\n")
    assert [p.rsplit("/", 1)[1] for p in corpus.discover(spark, str(tmp_path))] == ["x_structured.csv"]
    with pytest.raises(FileNotFoundError):
        corpus.discover(spark, str(tmp_path / "none"))


def test_configuration():
    assert corpus.load_config("a: 1\nb:\n  c: 'x'  # note\n  d: true\ne:\n  - 1.5\n  - y\n") == {"a": 1, "b": {"c": "x", "d": True}, "e": [1.5, "y"]}
    assert corpus.load_config('{"a": null}') == {"a": None}


def test_collections_refuse_bad_vectors(spark, tmp_path):
    good = spark.createDataFrame([("c", "d", [1.0, 2.0])], "chunk_id string, dataset string, embedding array<double>")
    files.write_collection(good, str(tmp_path / "c"), 2)
    with pytest.raises(Exception, match="dimension"):
        files.write_collection(good, str(tmp_path / "e"), 3)
    assert files.write_jsonl(good, str(tmp_path / "j")) == 1


def test_baselines_are_loaded_with_defaults_for_what_is_missing(spark, tmp_path):
    path = str(tmp_path / "base")
    view = anomaly.scoring_view(spark.createDataFrame([(f"l{k}", "d", "s", "t", "INFO", k) for k in range(60)], "log_id string, dataset string, service string, template_id string, level string, line_number int"), F.lit(1).cast("bigint"))
    assert baseline.enrich(view, path).filter("anomaly_baseline_status = 'missing_baseline'").count() == 60
    made = baseline.load_or_build(spark, path, view, anomaly.AnomalyConfig(min_logs=10, min_windows=1))
    document = baseline.read_json(spark, f"{path}/metadata.json")
    baseline.write_json(spark, f"{path}/metadata.json", document | {"config": {"min_logs": 10.0, "size": 50, "unheard_of": 1}})
    again = baseline.load_baseline(spark, path)
    assert made.config.min_windows == 1 and again.config == anomaly.AnomalyConfig(min_logs=10) and isinstance(again.config.min_logs, int)
    assert baseline.enrich(view, path).filter("anomaly_baseline_status = 'ready'").count() == 60 and len(baseline.as_document(again)["templates"]) == 1


def test_percentiles_of_large_groups_are_exact(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), F.when(F.col("id") % 7 == 0, None).otherwise(F.pow("id", F.lit(1.5))).alias("v"))
    want = {r.g: r.p for r in df.groupBy("g").agg(F.percentile("v", 0.99).alias("p")).collect()}
    got = {r.g: r.p for r in blocks.exact_percentile(df, ["g"], "v", 0.99, "p").collect()}
    assert got == pytest.approx(want) and blocks.exact_percentile(df.limit(0), ["g"], "v", 0.5, "p").count() == 0


def test_questions(spark):
    q = F.col("q")
    df = spark.createDataFrame([(1, "trong 2 giờ hoặc 30 phút"), (2, None), (3, "0 h")], "k int, q string")
    assert [(r.h, r.l) for r in df.select("k", questions.window_hours(q).alias("h"), questions.lookback_ms(q).alias("l")).orderBy("k").collect()] == [(2, 1_800_000), (1, 600_000), (1, 3_600_000)]
    logs = spark.createDataFrame([("x", "at blk_-4", "2025-01-01T00:00:01Z"), ("y", None, None)], "logId string, rawLog string, timestamp string")
    got = {r.log_id: (r.service, r.level, r.block_id, r.ts_ms) for r in questions.chat_logs(logs).collect()}
    assert got == {"x": ("unknown-service", "UNKNOWN", "blk_-4", 1735689601000), "y": ("unknown-service", "UNKNOWN", None, None)}


def test_generated_data_are_the_same_every_time(spark):
    a, b = corpus.generate(spark, 5, seed=1), corpus.generate(spark, 5, seed=1)
    assert all(rows(a[k]) == rows(b[k]) for k in a) and rows(a["logs"]) != rows(corpus.generate(spark, 5, seed=2)["logs"])


def test_scratch_is_cleared(spark):
    path = session.scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    assert session.clear_scratch(spark) >= 1
    with pytest.raises(Exception):
        spark.read.parquet(path)
