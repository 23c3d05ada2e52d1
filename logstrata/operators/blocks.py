"""Ordered work on groups of any size, cut into blocks.

A window over `partitionBy(group)` puts a whole group into one task. Here every group is
cut into blocks by a position (a line number, a time); windows run inside blocks, one
summary row per block goes through a second, much smaller window, and its results are
joined back on the same (group, block) key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logstrata.session import materialize


def carry(rows: DataFrame, group: list[str], block: str, summaries: dict[str, Column], carried: dict[str, tuple[str, str]]) -> DataFrame:
    """`rows` plus, in every row, values carried over from other blocks of its group.

    `summaries` are aggregates per (group, block). `carried` names each new column and how
    it comes from the summaries: ("sum", s) sums s over the earlier blocks (0 before the
    first), ("last", s) takes the last non-null s of the earlier blocks, ("next", s) the
    first non-null s of the later blocks, ("total", s) sums s and ("max", s) takes the largest
    s over all blocks.
    """
    per_block = rows.groupBy(*group, block).agg(*[c.alias(f"__s_{n}") for n, c in summaries.items()])
    ordered = Window.partitionBy(*group).orderBy(block)
    before, after = ordered.rowsBetween(Window.unboundedPreceding, -1), ordered.rowsBetween(1, Window.unboundedFollowing)
    how = {
        "sum": lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)),
        "last": lambda c: F.last(c, ignorenulls=True).over(before),
        "next": lambda c: F.first(c, ignorenulls=True).over(after),
        "total": lambda c: F.sum(c).over(Window.partitionBy(*group)),
        "max": lambda c: F.max(c).over(Window.partitionBy(*group)),
    }
    per_block = per_block.select(
        *[F.col(c).alias(f"__k_{c}") for c in [*group, block]],
        *[how[kind](F.col(f"__s_{source}")).alias(name) for name, (kind, source) in carried.items()],
    )
    on = [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in [*group, block]]
    return rows.join(per_block, on, "left").drop(*[f"__k_{c}" for c in [*group, block]])


#: Blocks that a group's values are cut into for an exact percentile.
CUTS = 64


def exact_percentile(rows: DataFrame, group: list[str], value: str, q: float, name: str) -> DataFrame:
    """(group, `name`): the linearly interpolated percentile of a group of any size; null values do not count.

    Equal values are counted first; approximate quantiles cut a group into blocks, counts of
    blocks are added up, and the two values at the wanted ranks are picked inside their block.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*group, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__c"))
    counts = materialize(counts, "values")
    sizes = counts.groupBy(*group).agg(F.sum("__c").alias("__n"), F.percentile_approx("__v", F.array(*[F.lit(k / CUTS) for k in range(1, CUTS)]), F.lit(1000)).alias("__cuts"))
    cut = counts.join(sizes, group).withColumn("__block", F.size(F.filter("__cuts", lambda x: x < F.col("__v")))).drop("__cuts")
    cut = materialize(cut, "cut")
    cut = carry(cut, group, "__block", {"c": F.sum("__c")}, {"__before": ("sum", "c")})
    upto = F.col("__before") + F.sum("__c").over(Window.partitionBy(*group, "__block").orderBy("__v"))
    rank = q * (F.col("__n") - 1)
    placed = cut.withColumn("__last", upto - 1).withColumn("__first", F.col("__last") - F.col("__c") + 1)
    at = lambda r: F.max(F.when(r.between(F.col("__first"), F.col("__last")), F.col("__v")))
    ends = placed.groupBy(*group).agg(at(F.floor(rank)).alias("__lo"), at(F.ceil(rank)).alias("__hi"), F.max(rank - F.floor(rank)).alias("__part"))
    return ends.select(*group, (F.col("__lo") + F.col("__part") * (F.col("__hi") - F.col("__lo"))).alias(name))
