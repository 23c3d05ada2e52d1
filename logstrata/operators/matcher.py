"""Messages against a catalog of rules with priorities.

A rule has a template or a regex of its own, and may hold for one component or one level
only. Of all rules that match a message the one of highest priority, then of the smallest
identifier, names it; how many match is counted. A message that no regex matches takes the
rule whose template equals its normalised form, at lower confidence. What is left is a miss
with the normalised form as its pending template.

Rules with a template meet only messages of their shape (`operators/catalog.py`); rules with a
regex alone meet all messages of their data set.

Defined results: a record without template_id, dataset or both of template and regex is
refused; missing priorities are 100, missing `active` is true; null and blank messages miss.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from logstrata.functions import text as tx
from logstrata.functions.timestamps import let
from logstrata.operators.catalog import ANY_LENGTH, FLAGS, _hash, _hashed, _shape
from logstrata.operators.ingest import optional
from logstrata.session import materialize

#: A catalog of up to this many rules is broadcast, a larger one is joined by shuffle.
MAX_BROADCAST_RULES = 20_000
COMPILED = StructType([StructField("pattern", StringType()), StructField("names", ArrayType(StringType())), StructField("groups", ArrayType(IntegerType()))])


@F.pandas_udf(COMPILED)
def _compiled(regex: pd.Series, template: pd.Series) -> pd.DataFrame:
    """The regex with its groups unnamed, and the names and numbers of its slots."""
    out = []
    for own, text in zip(regex, template):
        if own:
            slots = sorted(re.compile(own).groupindex.items(), key=lambda x: x[1])
            out.append((FLAGS + re.sub(r"\(\?P<\w+>", "(", own), [n for n, _ in slots], [k for _, k in slots]))
        else:
            pattern, names = tx.regex_from_template(text)
            out.append((FLAGS + pattern, names, list(range(1, len(names) + 1))))
    return pd.DataFrame(out, columns=["pattern", "names", "groups"])


def rules_from_records(records: DataFrame) -> DataFrame:
    """Records (template_id, dataset, template, regex, component, level, priority, active) as compiled rules."""
    given = {c: F.col(c) if c in records.columns else F.lit(None) for c in ("regex", "template", "component", "level", "priority", "active")}
    text = lambda c: optional(given[c].cast("string"))
    problem = (
        F.when(optional(F.col("template_id")).isNull(), "template_id is required").when(optional(F.col("dataset")).isNull(), "dataset is required")
        .when(F.coalesce(text("regex"), text("template")).isNull(), "template or regex is required")
    )
    checked = records.select(
        F.when(problem.isNotNull(), F.raise_error(problem)).otherwise(F.col("template_id")).alias("template_id"), F.lower(F.trim("dataset")).alias("dataset"),
        text("template").alias("template"), text("regex").alias("regex"), text("component").alias("rule_component"), text("level").alias("rule_level"),
        F.coalesce(given["priority"].cast("int"), F.lit(100)).alias("priority"), F.coalesce(given["active"].cast("boolean"), F.lit(True)).alias("active"),
    ).filter("active")
    tokens = F.split(F.coalesce("template", F.lit("")), " ")
    anything = F.struct(F.lit(ANY_LENGTH).alias("length"), F.array().cast("array<int>").alias("at"))
    shaped = checked.withColumn("c", _compiled("regex", "template")).withColumn("s", F.when(F.col("regex").isNotNull(), anything).otherwise(let(tokens, _shape)))
    shaped = shaped.select("*", "s.length", "s.at").drop("s")
    return materialize(shaped.withColumn("h", _hash(F.col("dataset"), tokens, F.col("length"), F.col("at"))), "rules")


def match_rules(rows: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """(key, template_id, template, match_method, confidence, candidate_count, slots) for rows (key, dataset, component, level, message)."""
    rows = rows.select(key, F.lower(F.trim("dataset")).alias("dataset"), "component", "level", "message")
    small = lambda df: F.broadcast(df) if rules.count() <= MAX_BROADCAST_RULES else df
    shapes = rules.select("dataset", "length", "at").distinct().groupBy("dataset", "length").agg(F.collect_list("at").alias("shapes"))
    ranked = F.struct((-F.col("priority")).alias("order"), "template_id", "template", "c")
    fits = lambda c: F.col(f"rule_{c}").isNull() | (F.col(f"rule_{c}") == F.col(c))
    met = _hashed(rows.filter(optional(F.col("message")).isNotNull()), small(shapes)).join(small(rules.drop("template_regex")), ["dataset", "h"])
    hits = met.filter(fits("component") & fits("level") & F.rlike("message", F.col("c.pattern")))
    hits = hits.dropDuplicates([key, "template_id"]).groupBy(key).agg(F.min(ranked).alias("r"), F.count("*").alias("n"), F.first("message").alias("m"))
    slot = lambda k: F.call_function("regexp_extract", F.col("m"), F.col("r.c.pattern"), k)
    slots = F.map_from_arrays(F.col("r.c.names"), F.transform("r.c.groups", slot))
    by_regex = hits.select(key, F.col("r.template_id").alias("template_id"), F.col("r.template").alias("template"), F.col("n").cast("int").alias("candidate_count"), F.map_filter(slots, lambda k, v: v != "").alias("slots"))

    normal = rows.withColumn("normal", tx.normalize_template(F.col("message")))
    rest = normal.join(by_regex.select(key), key, "left_anti")
    own = rules.select(F.col("dataset"), F.col("template").alias("normal"), "template_id", "priority", "rule_component", "rule_level").filter("normal IS NOT NULL")
    equal = rest.join(small(own), ["dataset", "normal"]).filter(fits("component") & fits("level"))
    equal = equal.groupBy(key).agg(F.min(F.struct((-F.col("priority")).alias("order"), "template_id", "normal")).alias("r"), F.count("*").cast("int").alias("candidate_count"))
    none = F.create_map().cast("map<string,string>")
    by_form = equal.select(key, F.col("r.template_id").alias("template_id"), F.col("r.normal").alias("template"), "candidate_count", none.alias("slots"))
    missed = rest.join(by_form.select(key), key, "left_anti").select(key, F.lit(None).cast("string").alias("template_id"), F.col("normal").alias("template"), F.lit(0).alias("candidate_count"), none.alias("slots"))
    method = lambda df, name, confidence: df.withColumns({"match_method": F.lit(name), "confidence": F.lit(confidence)})
    return method(by_regex, "regex", 1.0).unionByName(method(by_form, "normalized_template", 0.9)).unionByName(method(missed, "fallback_normalize", 0.0))


def catalog_from_groups(groups: DataFrame, priority: int = 100) -> DataFrame:
    """Records of a first catalog: one rule per template group, for its component and level."""
    return groups.select(F.col("group_id").alias("template_id"), "dataset", "template", "component", "level", F.lit(priority).alias("priority"), F.lit(True).alias("active"))


def never_matched(rules: DataFrame, matches: DataFrame) -> DataFrame:
    """Rules no message took."""
    return rules.select("template_id", "dataset", "template").join(matches.select("template_id").filter("template_id IS NOT NULL").distinct(), "template_id", "left_anti")


def top_unmatched(matches: DataFrame, n: int = 20) -> DataFrame:
    """The most frequent normalised forms of missed messages, ties in order of text."""
    missed = matches.filter("template_id IS NULL").groupBy("template").agg(F.count("*").alias("n"))
    return missed.orderBy(F.desc("n"), "template").limit(n)


# Identifiers that must not be left in a template.
LEAKS = {
    "request_id": r"\breq-[0-9a-fA-F-]{36}\b", "uuid": rf"\b{tx.UUID}\b", "hex_id": r"\b[0-9a-fA-F]{32}\b", "block_id": r"\bblk_-?\d+\b", "ip": r"\b(?:\d{1,3}\.){3}\d{1,3}(?::\d+)?\b",
}
FEW_WORDS, MANY_PLACEHOLDERS = 2, 0.65


def catalog_quality(matches: DataFrame, rules: DataFrame, lines: int | None = None) -> DataFrame:
    """One row of counts and ratios: coverage, ambiguity, rules never seen, singletons, leaks, over-normalised rules."""
    per = matches.agg(
        F.count("*").alias("total_logs"), F.count("template_id").alias("matched"), F.count_if(F.col("candidate_count") > 1).alias("ambiguous"),
        F.count_if(F.size("slots") > 0).alias("with_slots"), F.coalesce(F.round(F.avg(F.length("template")), 4), F.lit(0.0)).alias("mean_template_length"),
    )
    counts = matches.filter("template_id IS NOT NULL").groupBy("template_id").agg(F.count("*").alias("n"))
    tokens = F.filter(F.split("template", r"\s+"), lambda t: t != "")
    marked = F.size(F.filter(tokens, lambda t: t.rlike(r"<[a-z0-9_*]+>")))
    leak = F.lit(False)
    for pattern in LEAKS.values():
        leak = leak | F.col("template").rlike(pattern)
    used = rules.filter("template IS NOT NULL").select("template_id", "template").join(counts, "template_id", "left")
    over = (F.size(tokens) - marked <= FEW_WORDS) | (F.coalesce(F.try_divide(marked, F.size(tokens)), F.lit(0.0)) >= MANY_PLACEHOLDERS)
    catalog = used.agg(
        F.count("*").alias("total_templates"), F.count_if(F.col("n").isNull()).alias("never_seen"), F.count_if(F.col("n") == 1).alias("singletons"),
        F.count_if(leak).alias("with_leak"), F.count_if(over).alias("over_normalized"),
    )
    largest = counts.orderBy(F.desc("n"), "template_id").limit(20).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("top_20"))
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)), 6)
    joined = per.join(F.broadcast(catalog)).join(F.broadcast(largest))
    return joined.select(
        "total_logs", "total_templates", "matched", (F.col("total_logs") - F.col("matched")).alias("unmatched"), ratio("matched", "total_logs").alias("coverage"), "never_seen", "ambiguous",
        ratio("with_slots", "total_logs").alias("slot_coverage"), ratio("total_templates", "total_logs").alias("unique_template_ratio"), ratio("singletons", "total_templates").alias("singleton_ratio"),
        ratio("top_20", "total_logs").alias("top_20_coverage"), "mean_template_length", "with_leak", "over_normalized",
    )
