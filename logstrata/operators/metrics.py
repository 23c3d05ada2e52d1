"""Quality metrics of retrieval, root-cause ranking and anomaly detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b == 0, empty).otherwise(a / b)


def reciprocal_rank(retrieved: Column, relevant: Column) -> Column:
    position = F.array_position(F.transform(retrieved, lambda x: F.array_contains(relevant, x)), True)
    return F.when(position > 0, 1 / position).otherwise(0.0)


def dcg(gains: Column) -> Column:
    return F.aggregate(F.transform(gains, lambda g, i: g / F.log2(i + 2)), F.lit(0.0), lambda a, x: a + x)


def ndcg(retrieved: Column, relevance: Column, k: int) -> Column:
    """Linear gains; an id retrieved again gains nothing. relevance: map of id to gain."""
    top = F.slice(retrieved, 1, k)
    gains = F.transform(top, lambda x, i: F.when(F.array_position(top, x) == i + 1, F.coalesce(relevance[x], F.lit(0.0))).otherwise(0.0))
    ideal = dcg(F.slice(F.sort_array(F.filter(F.map_values(relevance), lambda v: v > 0), asc=False), 1, k))
    return F.when(ideal > 0, dcg(gains) / ideal).otherwise(0.0)


def per_query(results: DataFrame, k: int) -> DataFrame:
    """Metrics at k of rows (query_id, retrieved, templates, expected, relevance, root, incident_log_id)."""
    top, expected = F.slice("retrieved", 1, k), F.col("expected")
    hits = F.size(F.array_intersect(top, expected))
    templates = F.filter(F.slice("templates", 1, k), lambda t: t.isNotNull() & (t != ""))
    chain = F.array_union(expected, F.array_compact(F.array("incident_log_id")))
    silent = F.col("root").isNull()
    rounded = {
        "mrr": reciprocal_rank(F.col("retrieved"), expected),
        "hit": (hits > 0).cast("double"),
        "recall": _ratio(hits, F.size(expected)),
        "precision": hits / F.lit(k),
        "ndcg": ndcg(F.col("retrieved"), F.col("relevance"), k),
        "unique_templates": F.size(F.array_distinct(templates)).cast("double"),
        "duplicate_template_ratio": F.when(F.size(templates) > 0, 1 - F.size(F.array_distinct(templates)) / F.size(templates)).otherwise(0.0),
        "root_mrr": F.when(~silent, reciprocal_rank(F.col("retrieved"), F.array("root"))),
        "root_hit": F.when(~silent, F.array_contains(top, F.col("root")).cast("double")),
        "evidence_recall": _ratio(hits, F.size(expected), 1.0),
        "chain_complete": F.when(silent, 0.0).otherwise((F.size(F.array_except(chain, top)) == 0).cast("double")),
    }
    return results.select("query_id", *[F.round(c, 6).alias(name) for name, c in rounded.items()])


def macro(per: DataFrame) -> DataFrame:
    """Averages over queries; silent root causes do not count for the root metrics."""
    names = [c for c in per.columns if c != "query_id"]
    return per.agg(F.count("*").alias("n_queries"), F.count("root_mrr").alias("n_root"), *[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c) for c in names])


def anomaly_metrics(truth: DataFrame, predictions: DataFrame, threshold: float) -> DataFrame:
    """Confusion and agreement of truth (log_id, expected, low, high, signals) and predictions (log_id, score, reasons)."""
    joined = truth.join(predictions, "log_id", "left")
    predicted = F.coalesce(F.col("score") >= threshold, F.lit(False))
    expected = F.col("expected")
    n = lambda c: F.count_if(c)
    mine = F.coalesce("reasons", F.array().cast("array<string>"))
    union, common = F.size(F.array_union("signals", mine)), F.size(F.array_intersect("signals", mine))
    jaccard = F.when(union == 0, 1.0).otherwise(common / union)
    counts = joined.agg(
        F.count("*").alias("evaluated"), n(expected & predicted).alias("tp"), n(~expected & predicted).alias("fp"), n(expected & ~predicted).alias("fn"), n(~expected & ~predicted).alias("tn"),
        n(F.coalesce(F.col("score").between(F.col("low"), F.col("high")), F.lit(False))).alias("in_range"), F.avg(F.when(expected, jaccard)).alias("overlap"),
    )
    unknown = predictions.join(truth.select("log_id").distinct(), "log_id", "left_anti").agg(F.count("*").alias("unknown_predictions"))
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    ratios = {
        "precision": p, "recall": r, "f1": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0),
        "false_positive_rate": _ratio(F.col("fp"), F.col("fp") + F.col("tn")), "false_negative_rate": _ratio(F.col("fn"), F.col("fn") + F.col("tp")),
        "accuracy": _ratio(F.col("tp") + F.col("tn"), F.col("evaluated")), "score_range_agreement": _ratio(F.col("in_range"), F.col("evaluated")), "signal_overlap": F.col("overlap"),
    }
    return counts.join(F.broadcast(unknown)).select("evaluated", "unknown_predictions", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(k) for k, c in ratios.items()])


def unknown_queries(results: DataFrame, queries: DataFrame) -> DataFrame:
    """Results of queries that are not there: an evaluation with any is refused by its caller."""
    return results.join(queries.select("query_id").distinct(), "query_id", "left_anti")


def repeated_predictions(predictions: DataFrame) -> DataFrame:
    """Logs with more than one prediction."""
    return predictions.groupBy("log_id").agg(F.count("*").alias("n")).filter("n > 1")


def severity_agreement(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """Counts of expected against predicted severities, `none` where nothing was predicted."""
    joined = truth.select("log_id", "expected_severity").join(predictions.select("log_id", "severity"), "log_id", "left")
    return joined.groupBy("expected_severity", F.coalesce("severity", F.lit("none")).alias("severity")).agg(F.count("*").alias("n"))


def predicted_flag(flag: Column, score: Column, threshold: float) -> Column:
    """The flag where there is one, else whether the score reaches the threshold, else false."""
    return F.coalesce(flag, score >= threshold, F.lit(False))
