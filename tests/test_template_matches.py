"""template_matches against a plain search of the whole catalog."""

import re
from collections import Counter

from pyspark.sql import functions as F

from logstrata.functions import text as tx
from logstrata.plans.engine_queries import template_matches


def first_rules(rows):
    """seq -> template_id by trying every rule in turn; rows: (seq, dataset, message, template)."""
    counts, rules, out = Counter((d, t) for _, d, _, t in rows if d and t), {}, {}
    for (d, t), _ in sorted(counts.items(), key=lambda x: (x[0][0], -x[1], x[0][1])):
        rules.setdefault(d, []).append((t, re.compile(tx.regex_from_template(t)[0], re.IGNORECASE)))
    for seq, d, m, t in rows:
        mine = rules.get(d, []) if t else []
        hits = [k for k, (_, p) in enumerate(mine) if p.search(m)] or [k for k, (rule, _) in enumerate(mine) if rule == t]
        out[seq] = f"{d}::T{hits[0]}" if hits else None
    return out


def names(n):
    return ["".join(chr(97 + int(c)) for c in f"{k:03d}") for k in range(n)]


MESSAGES = (
    [f"worker {x} left" for x in names(120)]
    + ["Replica blk_17 lost by 3 copies", "Replica blk_18 lost by 4 copies", "REPLICA BLK_19 LOST BY 5 COPIES", "replica  blk_20 lost by 6 copies"]
    + ["Took 3 seconds", "Took 30 seconds", "took 2.5 seconds", 'GET "GET /v2/x HTTP/1.1" done', "a <*> z", "a b c d z", "a b c d", "blk_1 blk_2 blk_3 gone", "blk_1  BLK_2 gone", "BLK_1 BLK_2 gone"]
    + ["  leading", "trailing  ", "x <name> y", "x other y", "", "   ", None]
)


def test_every_template_has_its_rule(spark, tmp_path):
    rows = [(k, f"d{k % 12:02d}" if k % 13 else "d00", m) for k, m in enumerate(MESSAGES * 3)]
    rows += [(10_000 + k, "one", m) for k, m in enumerate([*MESSAGES, *MESSAGES[::7]])]
    df = spark.createDataFrame(rows, "seq long, dataset string, message string")
    df.write.parquet(str(tmp_path / "log_records.parquet"))
    got = {r.seq: r.template_id for r in template_matches(spark, str(tmp_path)).collect()}
    normalised = df.withColumn("template", tx.normalize_template(F.col("message"))).collect()
    assert got == first_rules([tuple(r) for r in normalised])
    assert all(got[s] for s, d, m in rows if d and m and m.strip())
    assert got[10_000 + MESSAGES.index("REPLICA BLK_19 LOST BY 5 COPIES")] == got[10_000 + MESSAGES.index("Replica blk_17 lost by 3 copies")]


def test_no_dataset_no_rule(spark, tmp_path):
    spark.createDataFrame([(1, None, "worker abc left"), (2, "d", "worker abc left")], "seq long, dataset string, message string").write.parquet(str(tmp_path / "log_records.parquet"))
    assert {r.seq: r.template_id for r in template_matches(spark, str(tmp_path)).collect()} == {1: None, 2: "d::T0"}
