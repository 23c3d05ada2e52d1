"""The first of a group so large that rounded rho are all 0."""

from pyspark.sql import functions as F

from logstrata.llm import rank

N = 40_000


def test_significance_decides_in_a_large_group(spark):
    """Item 0 has ranks (1, 1, 1, 1, n, n), item 99 has 100 or 99; the former is less likely by chance."""
    i = F.col("id")
    front, back = [F.when(i == 0, F.lit(at)).otherwise(-i.cast("double")) for at in (0.0, -1.0 * N)]
    pairs = [(f"s{k}", front if k < 4 else back) for k in range(6)]
    items = spark.range(N).select(F.lit("g").alias("grp"), F.format_string("%05d", N - i).alias("item"), F.map_from_arrays(F.array(*[F.lit(n) for n, _ in pairs]), F.array(*[v for _, v in pairs])).alias("scores"))
    ranked = rank.aggregate_ranks(items, "grp", "item", "scores").filter(F.col("item").isin(f"{N:05d}", f"{N - 99:05d}"))
    rows = {r.item: r for r in ranked.collect()}
    assert [rows[f"{N - k:05d}"].rho for k in (0, 99)] == [0.0, 0.0]
    assert rows[f"{N:05d}"].mean_rank > rows[f"{N - 99:05d}"].mean_rank
    assert rank.first_ranked(ranked, "grp", "item").collect()[0].item == f"{N:05d}"
