"""Weak relevance labels for a bank of queries: positives, uncertain rows, hard negatives, reviews and their audit.

The bank is a stated set of queries (query_id, dataset, category, component, level, difficulty,
question): a literal array that each log meets once. All cuts are limits per query and label
that run before the shuffle.

Defined results: a filter that is null holds for every row; logs without data set belong to no
query; a query without candidates has no rows and is reviewed for that reason.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logstrata.operators import rules
from logstrata.operators.ingest import top_per_group

# How many rows of a label a query keeps, and the points of a shared context.
POSITIVES, UNCERTAIN, NEGATIVES = 20, 10, 10
SAME_COMPONENT, LIKE_COMPONENT, SAME_LEVEL, LIKE_LEVEL = 50, 35, 20, 10
SEVERAL_INTENTS = (" và ", " hoặc ", " and ", " or ", "cùng lúc", "trước sau")
MAX_QUERIES = 1000
Bank = Sequence[tuple[str, str, str, str | None, str | None, str, str]]
FIELDS = ("query_id", "dataset", "category", "component", "level", "difficulty", "question")


def _order(score: str) -> list[Column]:
    return [F.desc(score), F.coalesce("component", F.lit("")), F.coalesce("level", F.lit("")), F.coalesce("line_number", F.lit(0)), F.col("seq")]


def scored_pairs(logs: DataFrame, bank: Bank) -> DataFrame:
    """Every log with every query of its data set: score and label in the query's category, the best other category, whether the filters hold."""
    if len(bank) > MAX_QUERIES:
        raise ValueError(f"more than {MAX_QUERIES} queries")
    text = rules.log_text("raw_log", "message", "component", "level", "event_id")
    scores = logs.withColumn("text", text)
    per = [rules.category_score(c, F.col("dataset"), F.col("level"), F.col("text")) for c in rules.PROFILES]
    scores = scores.withColumn("scores", F.array(*per)).drop("text")
    queries = F.array(*[F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(FIELDS, q)]) for q in bank])
    met = scores.withColumn("q", F.explode(F.filter(queries, lambda q: q["dataset"] == F.col("dataset"))))
    own = F.get(F.filter("scores", lambda s: s["category"] == F.col("q.category")), F.lit(0))
    other = F.array_max(F.transform(F.filter("scores", lambda s: s["category"] != F.col("q.category")), lambda s: s["score"]))
    inside = [F.col(f"q.{c}").isNull() | F.coalesce(F.col(c) == F.col(f"q.{c}"), F.lit(False)) for c in ("component", "level")]
    return met.select("q", "seq", "component", "level", "line_number", own["score"].alias("score"), own["label"].alias("label"), other.alias("other"), (inside[0] & inside[1]).alias("inside"))


def qrels(logs: DataFrame, bank: Bank) -> DataFrame:
    """(query_id, label, rank, seq, score): positives, uncertain rows and hard negatives of every query.

    Hard negatives are rows with evidence against the category; where they are too few, rows
    that share component or level with the query or its positives, or belong to another
    category, fill up.
    """
    pairs = scored_pairs(logs, bank)
    direct = pairs.filter("inside AND label <> 'none'").withColumn("query_id", F.col("q.query_id"))
    caps = F.when(F.col("label") == "positive", POSITIVES).when(F.col("label") == "uncertain", UNCERTAIN).otherwise(NEGATIVES)
    kept = top_per_group(direct, ["query_id", "label"], _order("score"), max(POSITIVES, UNCERTAIN, NEGATIVES)).filter(F.col("rank") <= caps)
    # at most a handful of values a query
    context = kept.groupBy("query_id").agg(
        F.collect_set(F.when(F.col("label") == "positive", F.nullif("component", F.lit("")))).alias("components"),
        F.collect_set(F.when(F.col("label") == "positive", F.nullif("level", F.lit("")))).alias("levels"),
        F.count_if(F.col("label") == "hard_negative").alias("have"), F.collect_list(F.when(F.col("label") == "hard_negative", F.col("seq"))).alias("hard"),
    )
    rest = pairs.filter("label <> 'positive'").withColumn("query_id", F.col("q.query_id")).join(F.broadcast(context), "query_id", "left")
    has = lambda c, among: F.coalesce(F.array_contains(F.col(among), F.col(c)), F.lit(False))
    same = lambda c: F.coalesce(F.col(f"q.{c}") == F.col(c), F.lit(False))
    shared = F.when(same("component"), SAME_COMPONENT).when(has("component", "components"), LIKE_COMPONENT).otherwise(0) + F.when(same("level"), SAME_LEVEL).when(has("level", "levels"), LIKE_LEVEL).otherwise(0)
    rest = rest.withColumn("shared", shared).filter("shared > 0 OR other >= 2").filter(~has("seq", "hard"))
    rest = rest.withColumn("score", F.col("shared") + F.col("other"))
    more = top_per_group(rest, ["query_id"], _order("score"), NEGATIVES)
    have = F.coalesce("have", F.lit(0))
    more = more.filter(F.col("rank") + have <= NEGATIVES).withColumn("rank", (F.col("rank") + have).cast("int")).withColumn("label", F.lit("hard_negative"))
    columns = ["query_id", "label", "rank", "seq", "score"]
    return kept.select(columns).unionByName(more.select(columns))


def reviews(labelled: DataFrame, bank: Bank) -> DataFrame:
    """(query_id, label_source, needs_review, reasons) of every query of the bank."""
    spark = labelled.sparkSession
    queries = spark.createDataFrame([tuple(q) for q in bank], ", ".join(f"{n} string" for n in FIELDS))
    n = lambda label: F.coalesce(F.col(label), F.lit(0))
    counts = labelled.groupBy("query_id").agg(*[F.count_if(F.col("label") == x).alias(x) for x in ("positive", "uncertain", "hard_negative")])
    joined = queries.join(counts, "query_id", "left")
    several = F.lit(False)
    for marker in SEVERAL_INTENTS:
        several = several | F.contains(F.lower("question"), F.lit(marker))
    reasons = F.array_compact(F.array(
        F.when(F.col("category") == "unknown", "category unknown"), F.when(F.col("difficulty") == "hard", "hard query"), F.when(n("positive") == 0, "no positive above v2 threshold"),
        F.when(n("positive").between(1, 2), "too few positives"), F.when(n("uncertain") > 0, "has uncertain candidates"), F.when(n("hard_negative") < 3, "too few hard negatives"), F.when(several, "multi-clause query"),
    ))
    source = F.when((n("positive") == 0) | (F.col("category") == "unknown"), "auto_candidate").when(F.coalesce("component", "level").isNotNull(), "template_rule").otherwise("keyword_rule")
    return joined.select("query_id", source.alias("label_source"), (F.size(reasons) > 0).alias("needs_review"), F.array_join(reasons, ";").alias("reasons"))


def suspicions(positives: DataFrame) -> DataFrame:
    """Positives (query_id, category, dataset, raw_log, message, seq) that a second look at their text alone doubts, with the reason."""
    text = F.lower(F.concat_ws(" ", F.coalesce("raw_log", F.lit("")), F.coalesce("message", F.lit("")), F.lit(""), F.lit("")))
    level = F.lit("")
    scored = F.array(*[rules.category_score(c, F.col("dataset"), level, text) for c in rules.PROFILES])
    own = F.get(F.filter(scored, lambda s: s["category"] == F.col("category")), F.lit(0))
    seconds = F.nullif(F.regexp_extract(text, r"\btook\s+([0-9]+(?:\.[0-9]+)?)\s+seconds?\b", 1), F.lit("")).cast("double")
    calm = text.rlike("vm stopped|vm started|lifecycle event|completed successfully")
    staged = positives.withColumns({"own": own, "seconds": seconds, "calm": calm})
    reason = (
        F.when((F.col("category") == "latency") & (F.col("seconds") < 5), "latency false positive")
        .when((F.col("category") == "latency") & (F.col("seconds") < 10), "latency uncertain")
        .when((F.col("category") == "service_unavailable") & F.col("calm"), "service_unavailable false positive: normal lifecycle event")
        .when((F.col("category") == "storage") & (F.col("dataset") == "hdfs") & (F.col("own.label") != "positive"), "storage false positive risk: block-only or normal storage event")
        .when(F.col("category") == "unknown", "broad unknown positive: generic error/warn/exception requires review")
        .when(F.col("own.label") != "positive", F.concat(F.lit("v2 scoring would mark as "), F.col("own.label")))
    )
    return staged.withColumn("reason", reason).filter("reason IS NOT NULL").select("query_id", "category", "seq", "reason")


def pattern_counts(logs: DataFrame, category: str) -> DataFrame:
    """How many logs show each pattern of a category; weak patterns are marked."""
    p = rules.PROFILES[category]
    marked = [*p.strong, *[f"~{w}" for w in p.weak]]
    text = logs.select(rules.log_text("raw_log", "message", "component", "level", "event_id").alias("text"))
    hits = F.array_compact(F.array(*[F.when(rules._hit(F.col("text"), m.lstrip("~")), m) for m in marked]))
    return text.select(F.explode(hits).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))


def bank_report(pairs: DataFrame) -> DataFrame:
    """Per query: rows behind its filters, candidates, and whether these are too many, too few or missing."""
    counts = pairs.groupBy(F.col("q.query_id").alias("query_id"), F.col("q.category").alias("category")).agg(
        F.count("*").alias("total"), F.count_if("inside").alias("filtered"), F.count_if(F.col("inside") & F.col("label").isin("positive", "uncertain")).alias("candidates"),
    )
    broad = F.col("candidates") / F.when(F.col("filtered") > 0, F.col("filtered")).otherwise(F.col("total")) >= 0.7
    reasons = F.array_compact(F.array(
        F.when(F.col("category") == "unknown", "unknown category uses ERROR/WARN-only fallback"), F.when(F.col("filtered") == 0, "filter matches no logs"), F.when(F.col("candidates") == 0, "no candidate logs found"),
        F.when((F.col("candidates") > 0) & broad, "candidate set is broad").when(F.col("candidates") >= 500, "candidate set is large"),
    ))
    return counts.select("query_id", "filtered", "candidates", F.array_join(reasons, ";").alias("reasons"))


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows (query_id, seq) whose label of two label sets differs or is missing in one."""
    left, right = old.select("query_id", "seq", F.col("label").alias("old")), new.select("query_id", "seq", F.col("label").alias("new"))
    return left.join(right, ["query_id", "seq"], "full_outer").filter(~F.col("old").eqNullSafe(F.col("new")))
