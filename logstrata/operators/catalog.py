"""Messages against the catalog compiled from their own templates.

1. Every distinct template of a dataset is a rule; rules are numbered from the most frequent
   on, and the first rule whose regex matches a message (letter case does not count) names it.
2. A message no regex matches takes the rule that equals its normalised template.
3. No message meets a whole catalog. The *shape* of a rule is its number of tokens and the
   positions of tokens without placeholders; a message is hashed once for each shape of its
   dataset and length, and meets the rules with the same hash only. Every rule whose regex
   can match is among these, and the regex decides.

Defined results: null and blank messages, and messages without dataset, have no rule.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from logstrata.functions import text as tx
from logstrata.functions.timestamps import let
from logstrata.operators.blocks import carry
from logstrata.session import materialize

#: Shapes are broadcast up to this many, more of them are joined by shuffle.
MAX_SHAPES = 50_000
PLACEHOLDER = r"<(?:\*|[a-zA-Z0-9_]+)>"
#: Placeholders that match a varying number of tokens.
OPEN = r"<(?:\*|block_id_list)>"
ANY_LENGTH = -1
#: Letter case, blanks, digits and line ends as in the regexes of Python.
FLAGS = "(?iUd)"


@F.pandas_udf(StringType())
def _pattern(template: pd.Series) -> pd.Series:
    return template.map(lambda t: FLAGS + tx.regex_from_template(t)[0])


def _literal(tokens: Column, positions: Column) -> Column:
    return F.filter(positions, lambda i: ~F.try_element_at(tokens, i).rlike(PLACEHOLDER))


def _shape(tokens: Column) -> Column:
    """Number of tokens and positions of literal ones; around open placeholders counted from both ends."""
    n = F.size(tokens)
    upto = lambda k: F.when(k < 1, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), k))
    open_at = F.filter(F.sequence(F.lit(1), n), lambda i: F.try_element_at(tokens, i).rlike(OPEN))
    ends = F.concat(upto(F.array_min(open_at) - 1), F.transform(upto(n - F.array_max(open_at)), lambda i: -i))
    closed = F.size(open_at) == 0
    positions = F.when(closed, F.sequence(F.lit(1), n)).otherwise(ends)
    return F.struct(F.when(closed, n).otherwise(ANY_LENGTH).alias("length"), _literal(tokens, positions).alias("at"))


def _hash(dataset: Column, tokens: Column, length: Column, at: Column) -> Column:
    return F.xxhash64(dataset, length, at, F.transform(at, lambda i: F.upper(F.try_element_at(tokens, i))))


def compile_catalog(rows: DataFrame) -> DataFrame:
    """(dataset, rule, k, pattern, length, at, h): all templates of `rows`, numbered from the most frequent on."""
    counts = rows.filter("dataset IS NOT NULL AND template <> ''").groupBy("dataset", "template").agg(F.count("*").alias("n"))
    ranges = materialize(counts, "templates").repartitionByRange("dataset", F.desc("n"), "template")
    ranges = materialize(ranges.withColumn("block", F.spark_partition_id()), "ranges")
    ranges = carry(ranges, ["dataset"], "block", {"c": F.count("*")}, {"before": ("sum", "c")})
    inside = Window.partitionBy("dataset", "block").orderBy(F.desc("n"), "template")
    numbered = ranges.select("dataset", F.col("template").alias("rule"), (F.col("before") + F.row_number().over(inside) - 1).alias("k"))
    tokens = F.split("rule", " ")
    shaped = numbered.withColumn("s", let(tokens, _shape)).select("dataset", "rule", "k", _pattern("rule").alias("pattern"), "s.length", "s.at")
    return materialize(shaped.withColumn("h", _hash(F.col("dataset"), tokens, F.col("length"), F.col("at"))), "catalog")


def _hashed(rows: DataFrame, shapes: DataFrame, group: tuple | list = ("dataset",)) -> DataFrame:
    """`rows`, once for each hash of the shapes of their group and length."""
    tokens = F.split(tx.normalize_space(F.col("message")), " ")
    cut = rows.withColumn("tokens", tokens).withColumn("length", F.explode(F.array(F.size("tokens"), F.lit(ANY_LENGTH))))
    joined = cut.join(shapes, [*group, "length"]).withColumn("at", F.explode("shapes"))
    return joined.select(*rows.columns, _hash(F.col("dataset"), F.col("tokens"), F.col("length"), F.col("at")).alias("h"))


def match_templates(rows: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """(key, dataset, k) of every row of (key, dataset, message, template); k is null where there is no rule."""
    shapes = catalog.select("dataset", "length", "at").distinct()
    few = shapes.limit(MAX_SHAPES + 1).count() <= MAX_SHAPES
    grouped = shapes.groupBy("dataset", "length").agg(F.collect_list("at").alias("shapes"))
    own = catalog.select("dataset", F.col("rule").alias("template"), "k", "pattern")
    # equal templates come together, so each pattern is compiled once
    owned = rows.join(own, ["dataset", "template"], "left").select(key, "dataset", "message", "k", F.rlike("message", F.col("pattern")).alias("matched"))
    owned = materialize(owned, "owned")
    ruled, same = owned.filter("k IS NOT NULL"), ["dataset", "k", "matched"]
    met = _hashed(ruled, F.broadcast(grouped) if few else grouped).select(*same, "h").distinct()
    # where the own regex matches, only earlier rules can be the first
    rules = catalog.select("dataset", "h", F.col("k").alias("other"), "pattern", "length", "at")
    others = materialize(met.join(rules, ["dataset", "h"]).filter("other < k OR (NOT matched AND other > k)"), "others")
    tried = others.groupBy(*same, "length").agg(F.collect_set("at").alias("shapes"))
    tested = _hashed(ruled, tried, same).join(others.drop("length", "at"), [*same, "h"])
    best = tested.filter(F.rlike("message", F.col("pattern"))).groupBy(key).agg(F.min("other").alias("best"))
    return owned.select(key, "dataset", "k").join(best, key, "left").select(key, "dataset", F.coalesce("best", "k").alias("k"))
