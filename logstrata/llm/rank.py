"""One ranking from several differently scaled scores: robust rank aggregation.

Every score is turned into normalised ranks inside its group (1 is best, ties share their
mean rank, rank / number of items). For an item with sorted normalised ranks r(1) <= ... <=
r(n), the chance that the k-th smallest of n uniform ranks is at most r(k) is the tail of a
binomial distribution; the smallest of these, times n (at most 1), is the item's rho, and
items are ranked by significance: by rho where it is below `SIGNIFICANT`; items beyond that
cannot be told from chance by their best ranks, they follow in order of their mean rank.
Scales and ranges play no part.

Defined results: a score an item lacks (null, NaN or not in the map) ties with the lowest
value of its group; a score that all items of a group lack does not count; a group without
any score ranks its items by identifier; significant items are ranked by the logarithm of rho, as rho itself
is rounded to 12 decimals in the output and 0 for the best of a large group; equal rho are ordered by mean rank, then by
identifier; rows without group or item are not ranked; an item listed more than once counts once, with its highest values.

A group of up to `ARRAY_ROWS` rows is ranked in one row of arrays, after one shuffle; larger
ones are ranked in blocks of values. The result is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logstrata.functions.timestamps import let
from logstrata.operators.blocks import carry
from logstrata.session import materialize

#: Items whose rho is not below this are no better than chance and ordered by mean rank.
SIGNIFICANT = 0.05
#: Groups of up to this many rows are ranked as arrays.
ARRAY_ROWS = 256
#: Groups above this many rows are ranked in blocks of values.
BLOCK_ROWS = 20_000
CUTS = 64
SALTS = 8


def tied_ranks(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, value, rank, n): mean rank from the top of every distinct value in its group.

    Equal values are counted before any shuffle of rows; large groups are cut into blocks at
    approximate quantiles, so no task ranks a whole large group.
    """
    quantiles = F.array(*[F.lit(k / CUTS) for k in range(1, CUTS)])
    sizes = rows.groupBy(*group).agg(F.count("*").alias("n"), F.percentile_approx(value, quantiles, F.lit(1000)).alias("cuts"))
    sizes = sizes.withColumn("cuts", F.when(F.col("n") > BLOCK_ROWS, F.col("cuts")).otherwise(F.array().cast("array<double>")))
    counts = rows.groupBy(*group, value).agg(F.count("*").alias("c"))
    counts = counts.join(sizes, group)
    counts = counts.withColumn("block", -F.size(F.filter("cuts", lambda x: x < F.col(value)))).drop("cuts")
    counts = carry(counts, group, "block", {"c": F.sum("c")}, {"above": ("sum", "c")})
    inside = Window.partitionBy(*group, "block").orderBy(F.col(value).desc()).rowsBetween(Window.unboundedPreceding, -1)
    above = F.col("above") + F.coalesce(F.sum("c").over(inside), F.lit(0))
    return counts.select(*group, value, (above + (F.col("c") + 1) / 2).alias("rank"), "n")


def _choose(n: Column, j: Column) -> Column:
    return F.aggregate(F.when(j < 1, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), j)), F.lit(1.0), lambda acc, i: acc * (n - j + i) / i)


def rho(ranks: Column) -> Column:
    """Corrected smallest beta order-statistic probability of an array of normalised ranks."""
    ordered = F.sort_array(ranks)
    n = F.size(ranks)

    def tail(r: Column, k: Column) -> Column:
        return F.aggregate(F.sequence(k + 1, n), F.lit(0.0), lambda acc, j: acc + _choose(n, j) * F.pow(r, j) * F.pow(1 - r, n - j))

    smallest = F.array_min(F.transform(ordered, tail))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), smallest * n))


def log_rho(ranks: Column) -> Column:
    """Logarithm of rho, which stays exact where rho is too small for its rounding."""
    ordered = F.sort_array(ranks)
    n = F.size(ranks)

    def log_tail(r: Column, k: Column) -> Column:
        # r ** k is left out of the sum, so that small ranks do not vanish
        rest = F.aggregate(F.sequence(k, n), F.lit(0.0), lambda acc, j: acc + _choose(n, j) * F.pow(r, j - k) * F.pow(1 - r, n - j))
        return k * F.ln(r) + F.ln(rest)

    smallest = F.array_min(F.transform(ordered, lambda r, i: log_tail(r, i + 1)))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.least(F.lit(0.0), smallest + F.ln(n)))


def _clean(scores: str) -> Column:
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    return F.map_filter(F.coalesce(scores, none), lambda k, v: v.isNotNull() & ~F.isnan(v))


def aggregate_ranks(items: DataFrame, group: str, item: str, scores: str, listed: str | None = None) -> DataFrame:
    """(group, item, rho, mean_rank, n_scores, log_rho) for items with a map of scores.

    Rows where `listed` is false only add scores to an item; without a listed row it is none.
    """
    rows = items.select(F.col(group).alias("g"), F.col(item).alias("i"), _clean(scores).alias("scores"), (F.col(listed) if listed else F.lit(True)).alias("listed"))
    rows = rows.filter("g IS NOT NULL AND i IS NOT NULL")
    large = materialize(rows.groupBy("g").count().filter(F.col("count") > ARRAY_ROWS).select("g"), "large_groups")
    if large.isEmpty():
        ranks = _array_ranks(rows)
    else:
        rows = materialize(rows, "scored")
        ranks = _array_ranks(rows.join(large, "g", "left_anti")).unionByName(_block_ranks(rows.join(large, "g", "left_semi")))
    return ranks.select(
        F.col("g").alias(group),
        F.col("i").alias(item),
        F.round(rho(F.col("ranks")), 12).alias("rho"),
        F.round(F.try_divide(F.aggregate("ranks", F.lit(0.0), lambda a, r: a + r), F.size("ranks")), 9).alias("mean_rank"),
        F.size("ranks").alias("n_scores"),
        log_rho(F.col("ranks")).alias("log_rho"),
    )


def _array_ranks(rows: DataFrame) -> DataFrame:
    """(g, i, ranks) of small groups, each in one row: one shuffle by group serves both steps."""
    higher = lambda a, b: F.map_zip_with(a, b, lambda k, x, y: F.greatest(x, y))
    none = F.create_map().cast("map<string,double>")
    per_item = rows.repartition("g").groupBy("g", "i").agg(F.max("listed").alias("listed"), F.collect_list("scores").alias("s"))
    merged = F.when(F.size("s") == 1, F.get("s", F.lit(0))).otherwise(F.aggregate("s", none, higher))
    per_item = per_item.filter("listed").select("g", F.struct("i", merged.alias("scores")).alias("item"))
    groups = per_item.groupBy("g").agg(F.collect_list("item").alias("items"))
    names = F.array_distinct(F.flatten(F.transform("items", lambda x: F.map_keys(x["scores"]))))

    def column(name: Column) -> Column:
        """The normalised ranks of one score, in the order of the items."""
        raw = F.transform("items", lambda x: x["scores"][name])
        filled = let(raw, lambda v: F.transform(v, lambda x: F.coalesce(x, F.array_min(v))))
        # from the top: equal values stand together, their mean place is their rank
        return let(
            F.struct(filled.alias("v"), F.sort_array(filled, asc=False).alias("o")),
            lambda c: F.transform(c["v"], lambda x: (F.array_position(c["o"], x) + (F.size(F.filter(c["v"], lambda y: y == x)) - 1) / 2) / F.size(c["v"])),
        )

    table = groups.select("g", "items", F.transform(names, column).alias("columns"))
    placed = table.select("g", "columns", F.posexplode("items").alias("k", "item"))
    return placed.select("g", F.col("item.i").alias("i"), F.transform("columns", lambda c: F.get(c, F.col("k"))).alias("ranks"))


def _block_ranks(rows: DataFrame) -> DataFrame:
    """(g, i, ranks) of groups of any size."""
    listed = rows.filter("listed").select("g", "i").distinct()
    entries = rows.select("g", "i", F.explode("scores").alias("score", "value")).groupBy("g", "i", "score").agg(F.max("value").alias("value"))
    entries = entries.join(listed, ["g", "i"], "left_semi")
    lowest = entries.groupBy("g", "score").agg(F.min("value").alias("low"))
    lows = lowest.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("score", "low"))).alias("lows"))
    salted = lows.withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
    whole = entries.groupBy("g", "i").agg(F.map_from_entries(F.collect_list(F.struct("score", "value"))).alias("scores"))
    bare = listed.join(whole.select("g", "i"), ["g", "i"], "left_anti")
    whole = whole.unionByName(bare, allowMissingColumns=True).withColumn("salt", F.pmod(F.xxhash64("i"), F.lit(SALTS)).cast("int"))
    full = whole.join(salted, ["g", "salt"], "left").select("g", "i", F.explode_outer("lows").alias("score", "low"), "scores")
    full = materialize(full.select("g", "i", "score", F.coalesce(F.col("scores")[F.col("score")], "low").alias("value")), "full")
    ranked = full.join(tied_ranks(full.filter(F.col("score").isNotNull()), ["g", "score"], "value"), ["g", "score", "value"], "left")
    return ranked.groupBy("g", "i").agg(F.collect_list(F.col("rank") / F.col("n")).alias("ranks"))


def first_ranked(ranked: DataFrame, group: str, item: str) -> DataFrame:
    """The item of every group that ranks first by significance."""
    # sums of doubles: equal rho may differ in their last digits
    significant = F.when(F.col("rho") < SIGNIFICANT, F.round("log_rho", 10)).otherwise(F.lit(0.0))
    best = F.min(F.struct(significant.alias("log_rho"), F.coalesce("mean_rank", F.lit(2.0)), item)).alias("b")
    return ranked.groupBy(group).agg(best).select(group, F.col("b")[item].alias(item))
