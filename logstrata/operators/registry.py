"""The template route of retrieval: a registry of templates with vectors, candidates, their lines, enrichment.

A registry is a table (template_id, dataset, component, level, template, search_text, priority,
embedding). Templates are searched exactly; filters that leave nothing are relaxed step by step.
The lines of the candidates are searched per template, both kinds of hits come out in one
schema with the route they took.

Defined results: templates without vector are not found; a query without candidates takes the
unfiltered route; equal scores are ordered by identifier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logstrata.operators.chunks import embed_text
from logstrata.operators.ingest import top_per_group
from logstrata.operators.retrieval import vector_topk

# Weights of the reranking and the words of a question for rare templates.
RARE = ("hiếm", "bất thường", "rare", "anomaly", "outlier")
REGISTRY_BOOST, MOST_BONUS = 0.05, 0.08
LINE_WEIGHT, TEMPLATE_WEIGHT = 0.65, 0.35
RESULT = ("query_id", "id", "template_id", "score", "semantic_score", "source")


def build_registry(rules: DataFrame, limit: int | None = None) -> DataFrame:
    """Active rules with the text that is embedded for them; `limit` takes the first by identifier."""
    kept = rules.orderBy("template_id").limit(limit) if limit is not None else rules
    text = embed_text({c: F.col(c) for c in ("dataset", "component", "level", "template")})
    return kept.select("template_id", "dataset", "component", "level", "template", text.alias("search_text"), "priority")


def attach_vectors(registry: DataFrame, vectors: DataFrame, dimension: int) -> DataFrame:
    """The registry with its vectors (template_id, embedding); other dimensions than `dimension` are refused."""
    wrong = F.size("embedding") != dimension
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("unexpected vector dimension of "), F.col("template_id")))).otherwise(F.col("embedding"))
    return registry.join(vectors.select("template_id", checked.alias("embedding")), "template_id", "left")


def lookup(registry: DataFrame, ids: DataFrame) -> DataFrame:
    """Registry rows of (k, template_id) in the order of k; unknown identifiers are dropped."""
    return ids.join(registry, "template_id").orderBy("k")


def relaxed(registry: DataFrame, filters: DataFrame) -> DataFrame:
    """(query_id, tier, registry.*) for filters (query_id, dataset, component, level): the strictest tier that has rows.

    1 all filters, 2 without the component, 3 without the level, 4 data set alone.
    """
    f = F.broadcast(filters.select("query_id", F.col("dataset").alias("f_dataset"), F.col("component").alias("f_component"), F.col("level").alias("f_level")))
    ok = lambda c: F.col(f"f_{c}").isNull() | F.coalesce(F.col(c) == F.col(f"f_{c}"), F.lit(False))
    tier = F.when(ok("component") & ok("level"), 1).when(ok("level"), 2).when(ok("component"), 3).otherwise(4)
    met = registry.join(f, ok("dataset")).withColumn("tier", tier)
    best = met.groupBy("query_id").agg(F.min("tier").alias("best"))
    return met.join(F.broadcast(best), "query_id").filter("tier = best").select("query_id", "tier", *registry.columns)


def occurrence_bonus(occurrences: Column, question: Column) -> Column:
    """Frequent templates a little ahead, behind where the question is after rare ones."""
    bonus = F.when(occurrences > 0, F.least(F.log1p(occurrences) / 10.0, F.lit(MOST_BONUS))).otherwise(0.0)
    return F.when(F.lower(question).rlike("|".join(RARE)), -bonus).otherwise(bonus)


def rerank_templates(hits: DataFrame, k: int) -> DataFrame:
    """Hits (query_id, id, semantic_score, occurrences, question, source) by similarity, occurrences and source."""
    boost = F.when(F.col("source").isin("template_registry", "template_lookup"), REGISTRY_BOOST).otherwise(0.0)
    score = F.col("semantic_score") + occurrence_bonus(F.coalesce("occurrences", F.lit(0)), F.col("question")) + boost
    return top_per_group(hits.withColumn("score", F.round(score, 6)), ["query_id"], [F.desc("score"), F.col("id")], k)


def gate(candidates: DataFrame, min_score: float | None = None, min_gap: float = 0.0) -> DataFrame:
    """(query_id, applies): whether the best template stands out enough to filter lines by templates."""
    first, second = [F.max(F.when(F.col("rank") == k, F.col("score"))) for k in (1, 2)]
    tops = candidates.groupBy("query_id").agg(first.alias("first"), F.coalesce(second, F.lit(0.0)).alias("second"))
    enough = F.lit(True) if min_score is None else F.col("first") >= min_score
    return tops.select("query_id", (enough & (F.round(F.col("first") - F.col("second"), 9) >= min_gap)).alias("applies"))


def candidate_lines(hits: DataFrame, candidates: DataFrame, per_template: int = 10) -> DataFrame:
    """Line hits (query_id, id, template_id, candidate_id, score) of the candidates (query_id, id, source), the best of each."""
    chosen = F.broadcast(candidates.select("query_id", F.col("id").alias("chosen"), F.col("source").alias("from")))
    pending = F.col("from") == "pending_template_registry"
    key = F.when(pending, F.col("candidate_id")).otherwise(F.col("template_id"))
    met = hits.join(chosen, "query_id").filter(key == F.col("chosen"))
    met = met.withColumn("source", F.when(pending, "candidate_filtered").otherwise("template_filtered"))
    return top_per_group(met, ["query_id", "chosen"], [F.desc("score"), F.col("id")], per_template).drop("from")


def rerank_children(lines: DataFrame, templates: DataFrame) -> DataFrame:
    """Line hits weighed with the score of their template; lines of unknown templates keep their own."""
    parents = templates.select("query_id", F.col("id").alias("template_id"), F.col("score").alias("parent"))
    joined = lines.join(F.broadcast(parents), ["query_id", "template_id"], "left")
    final = LINE_WEIGHT * F.col("score") + TEMPLATE_WEIGHT * F.coalesce("parent", "score")
    return joined.withColumn("final", F.round(final, 8)).drop("parent")


def cap_per_template(lines: DataFrame, per_template: int, limit: int) -> DataFrame:
    """The first `limit` lines of every query in rank order, at most `per_template` of a template; lines without one are their own."""
    group = F.coalesce(F.nullif("template_id", F.lit("")), F.concat(F.lit("line:"), F.col("id").cast("string")))
    order = [F.desc("score"), F.col("id")]
    capped = top_per_group(lines.withColumn("grp", group), ["query_id", "grp"], order, per_template).drop("rank")
    return top_per_group(capped, ["query_id"], order, limit).drop("grp")


def enrich_from_lines(lines: DataFrame, existing: DataFrame, registry: DataFrame, pending: DataFrame) -> DataFrame:
    """(query_id, id, source): the templates a query has and those of its lines; a candidate goes before a template."""
    have = existing.select("query_id", "id", "source")
    wanted = lines.select("query_id", F.nullif("candidate_id", F.lit("")).alias("candidate_id"), F.nullif("template_id", F.lit("")).alias("template_id")).distinct()
    missing = lambda df: df.distinct().join(have.select("query_id", "id"), ["query_id", "id"], "left_anti")
    by_candidate = missing(wanted.filter("candidate_id IS NOT NULL").select("query_id", F.col("candidate_id").alias("id"))).join(pending.select(F.col("candidate_id").alias("id")), "id").select("query_id", "id", F.lit("pending_template_registry").alias("source"))
    by_template = missing(wanted.filter("candidate_id IS NULL AND template_id IS NOT NULL").select("query_id", F.col("template_id").alias("id"))).join(registry.select(F.col("template_id").alias("id")), "id").select("query_id", "id", F.lit("template_lookup").alias("source"))
    return have.unionByName(by_candidate).unionByName(by_template)


def as_results(hits: DataFrame, source: str) -> DataFrame:
    """Any kind of hit in the one schema of results; what it lacks is null."""
    given = {c: F.col(c) if c in hits.columns else F.lit(None) for c in RESULT}
    semantic = F.coalesce(given["semantic_score"], given["score"]).cast("double")
    return hits.select(
        "query_id", given["id"].cast("string").alias("id"), given["template_id"].cast("string").alias("template_id"), given["score"].cast("double").alias("score"), semantic.alias("semantic_score"),
        F.lit(source).alias("source"),
    )


def search_templates(registry: DataFrame, queries: DataFrame, k: int, key: str = "vec_id") -> DataFrame:
    """The k templates nearest to every query vector (key, embedding); registry rows carry `key` and their vector."""
    return vector_topk(registry, queries, k, key)
