"""Retrieval: exact vector search, grouped and recency-aware reranking, lexical ranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logstrata.operators.ingest import top_per_group

#: Queries are compared in blocks of this many vectors, which bounds what is broadcast.
QUERY_BLOCK = 2048


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, vec_id, score, rank): the k nearest by inner product, every query against all rows.

    Each block of queries is one broadcast matrix; a task keeps its own k best per query, so
    only k rows per task and query are shuffled. Rows without vector match nothing.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("v")).filter("v IS NOT NULL")
    out, block = None, []

    def search(block: list) -> DataFrame:
        shared = spark.sparkContext.broadcast(([r[0] for r in block], np.array([r[1] for r in block], dtype=np.float64)))

        def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, matrix = shared.value
            best_s, best_i = np.full((len(ids), 0), 0.0), np.zeros((len(ids), 0), dtype=np.int64)
            for frame in frames:
                values = np.array(frame["v"].tolist(), dtype=np.float64)
                if not len(values):
                    continue
                best_s = np.concatenate([best_s, matrix @ values.T], axis=1)
                best_i = np.concatenate([best_i, np.broadcast_to(frame["vec_id"].to_numpy(), (len(ids), len(values)))], axis=1)
                order = np.lexsort((best_i, -best_s), axis=1)[:, :k]
                best_s, best_i = np.take_along_axis(best_s, order, 1), np.take_along_axis(best_i, order, 1)
            n = best_s.shape[1]
            yield pd.DataFrame({"query_id": np.repeat(np.array(ids, dtype=np.int64), n), "vec_id": best_i.ravel(), "score": best_s.ravel()})

        return rows.mapInPandas(scan, "query_id long, vec_id long, score double")

    for row in queries.select(vec_id, embedding).filter(F.col(embedding).isNotNull()).toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == QUERY_BLOCK:
            out = search(block) if out is None else out.unionByName(search(block))
            block = []
    if block:
        out = search(block) if out is None else out.unionByName(search(block))
    if out is None:
        return spark.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    return top_per_group(out, ["query_id"], [F.desc("score"), F.col("vec_id")], k)


def rerank_groups(hits: DataFrame, per_group: int = 3, limit: int = 24, semantic: float = 0.85, recency: float = 0.15) -> DataFrame:
    """Hits (query_id, id, grp, score, ts) reranked inside their template group, the best of each, best first.

    Recency is the place between the oldest and the newest hit of the group.
    """
    span = Window.partitionBy("query_id", "grp")
    low, high = F.min("ts").over(span), F.max("ts").over(span)
    fresh = F.coalesce(F.when(high > low, (F.col("ts") - low) / (high - low)), F.lit(0.0))
    meaning = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl("score", F.lit(0.0)), F.lit(0.0))))
    scored = hits.withColumn("final", F.round((semantic * meaning + recency * fresh) / (semantic + recency), 6))
    capped = top_per_group(scored, ["query_id", "grp"], [F.desc("final"), F.desc_nulls_last("ts"), F.desc("score"), F.col("id")], per_group).drop("rank")
    return top_per_group(capped, ["query_id"], [F.desc("final"), F.desc_nulls_last("ts"), F.col("id")], limit)


def top_groups(ranked: DataFrame, groups: int) -> DataFrame:
    """The rows of the first `groups` groups of every query, in order of their best row."""
    best = ranked.groupBy("query_id", "grp").agg(F.max("final").alias("best"))
    kept = top_per_group(best, ["query_id"], [F.desc("best"), F.col("grp")], groups).select("query_id", "grp")
    return ranked.join(kept, ["query_id", "grp"], "left_semi")


def merge_best(*groups: DataFrame, limit: int) -> DataFrame:
    """Union of hits (query_id, id, score): the best score per id, the first `limit` per query."""
    union = groups[0]
    for g in groups[1:]:
        union = union.unionByName(g)
    best = union.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return top_per_group(best, ["query_id"], [F.desc("score"), F.col("id")], limit)


def tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9_]+"), F.lit(0)))


def lexical_scores(logs: DataFrame, queries: list[tuple[str, str]]) -> DataFrame:
    """(query_id, log_id, template, seq, score): share of the query's terms found, longer terms weigh less.

    The queries are a stated set: a literal array exploded per log, no join.
    """
    bank = F.array(*[F.struct(F.lit(i).alias("query_id"), F.array(*[F.lit(t) for t in sorted(set(q.lower().split()))]).alias("terms")) for i, q in queries])
    rows = logs.withColumn("tokens", tokens(F.col("text"))).withColumn("q", F.explode(bank))
    overlap = F.array_intersect("q.terms", "tokens")
    score = F.size(overlap) / F.size("q.terms") + 0.05 * F.aggregate(overlap, F.lit(0.0), lambda a, t: a + 1 / F.sqrt(F.length(t)))
    return rows.withColumn("score", F.round(score, 6)).filter("score > 0").select(F.col("q.query_id").alias("query_id"), "log_id", "template", "seq", "score")


# What entities, services, template words, levels and a late place add to a score.
ENTITY_POINTS, SERVICE_POINTS, TEMPLATE_POINTS, LATE_POINTS = 2.0, 1.0, 0.35, 0.05
LEVEL_POINTS = {"ERROR": 0.2, "WARN": 0.1}


def template_first_scores(logs: DataFrame, order: str, terms: list[str], entities: list[str], services: list[str]) -> DataFrame:
    """`logs` with `score`: shared terms as in lexical ranking, and points for entities, service, template, level and a late place.

    The place is that of `order`, a gapless number of arrival, among all rows.
    """
    spans = logs.agg(F.min(order).alias("__first"), F.count("*").alias("__total"))
    asked = F.array(*[F.lit(t) for t in terms]).cast("array<string>")
    overlap = F.array_intersect(asked, tokens(F.coalesce("message", F.lit(""))))
    text = F.lower(F.concat_ws(" ", "raw_log", "message"))
    score = F.size(overlap) / float(max(len(terms), 1)) + 0.05 * F.aggregate(overlap, F.lit(0.0), lambda a, t: a + 1 / F.sqrt(F.length(t)))
    for e in entities:
        score = score + F.when(F.contains(text, F.lit(e.lower())), ENTITY_POINTS).otherwise(0.0)
    score = score + F.when(F.col("component").isin(services), SERVICE_POINTS).otherwise(0.0)
    named = F.array_intersect(asked, tokens(F.translate(F.coalesce("template_id", F.lit("")), "_", " ")))
    level = F.lit(0.0)
    for name, points in LEVEL_POINTS.items():
        level = F.when(F.upper("level") == name, points).otherwise(level)
    late = LATE_POINTS * (F.col(order) - F.col("__first")) / F.col("__total")
    scored = logs.join(F.broadcast(spans)).withColumn("score", F.round(score + TEMPLATE_POINTS * F.size(named) + level + late, 6))
    return scored.drop("__first", "__total")


def diversify(scored: DataFrame, k: int = 10, per_template: int = 3) -> DataFrame:
    """The first k per query with at most `per_template` of a template, deferred ones behind."""
    order = [F.desc("score"), F.col("seq")]
    # beyond the k best of a template no row can be chosen: the limit runs before the shuffle
    kept = top_per_group(scored, ["query_id", "template"], order, k).withColumnRenamed("rank", "nth")
    return top_per_group(kept, ["query_id"], [(F.col("nth") > per_template).cast("int"), *order], k)
