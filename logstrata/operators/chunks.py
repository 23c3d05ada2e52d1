"""Enriched log lines: entities, template, embedding text and a compact payload; local ranking; corpus quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logstrata.functions import text as tx
from logstrata.operators.ingest import optional, top_per_group

# Texts that say nothing.
MEANINGLESS = ["", "unknown", "none", "null", "n/a", "-"]


def meaningful(c: Column) -> Column:
    value = optional(c.cast("string"))
    return F.when(~F.lower(value).isin(MEANINGLESS), value)


def embed_text(fields: dict[str, Column]) -> Column:
    """`name: value` lines of the fields that say something."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), meaningful(v)) for k, v in fields.items()])


def line_chunks(logs: DataFrame) -> DataFrame:
    """One enriched row per log line; explicit identifiers stay where none is found in the text."""
    text = F.concat(F.coalesce("raw_log", F.lit("")), F.lit(" "), F.coalesce("message", F.lit("")))
    staged = logs.withColumn("entities", tx.entities(text)).withColumn("normalized", tx.normalize_template(F.col("message")))
    first = lambda k: F.get(f"entities.{k}", F.lit(0))
    http = tx.http_request(F.col("message"))
    fields = {
        "dataset": F.col("dataset"), "level": F.col("level"), "component": F.col("component"), "template": F.col("normalized"), "message": tx.sanitize(F.col("message")),
    }
    chunk = staged.select(
        "log_id", "dataset", "level", "component", "line_number", "source_file", "raw_log", "message", F.col("template_id"), F.col("normalized").alias("template"),
        F.coalesce(first("request_id"), optional(F.col("request_id"))).alias("request_id"), first("instance_id").alias("instance_id"), first("block_id").alias("block_id"), first("ip").alias("ip"),
        http["http_method"].alias("http_method"), http["api_route"].alias("api_route"),
        F.regexp_extract("message", r"(?i)\bstatus:\s*(\d{3})\b", 1).try_cast("int").alias("http_status"), tx.duration_ms(F.col("message")).alias("duration_ms"),
        task_state(F.col("message")).alias("task_state"), apache_module(F.col("message")).alias("apache_module"),
        tx.found(F.col("raw_log"), r"^(\S+\.log(?:\.\S+)?)\s+\d{4}-\d{2}-\d{2}\s+", 1).alias("source_log"), embed_text(fields).alias("embed_text"), "entities",
    )
    return chunk


def payload(chunks: DataFrame) -> DataFrame:
    """(log_id, payload): the chunk as JSON without nulls and empty lists."""
    names = [c for c in chunks.columns if c not in ("log_id", "entities")]
    kinds = chunks.schema["entities"].dataType.names
    lists = [F.when(F.size(f"entities.{k}") > 0, F.col(f"entities.{k}")).alias(k) for k in kinds]
    return chunks.select("log_id", F.to_json(F.struct(*names, F.struct(*lists).alias("entities"))).alias("payload"))


def template_id(dataset: Column, component: Column, level: Column, template: Column) -> Column:
    """The identifier of a template group: data set and a hash of its four keys."""
    parts = [F.coalesce(c, F.lit("")) for c in (dataset, component, level, template)]
    return F.concat(F.lit("template::"), parts[0], F.lit("::"), F.substring(F.sha1(F.encode(F.concat_ws("\x1f", *parts), "UTF-8")), 1, 16))


def template_groups(lines: DataFrame, order: str, samples: int = 5) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Groups of lines with one dataset, component, level and template, as four tables.

    (groups, samples, members, entities): a group may hold any share of the lines, so its
    members and the entities it names are rows, not lists.
    """
    key = template_id(F.col("dataset"), F.col("component"), F.col("level"), F.col("template")).alias("group_id")
    groups = lines.groupBy(key).agg(
        *[F.min(c).alias(c) for c in ("dataset", "component", "level", "template")], F.count("*").alias("occurrences"),
        F.min("line_number").alias("first_line"), F.max("line_number").alias("last_line"), F.min("ingested_at").alias("first_at"), F.max("ingested_at").alias("last_at"),
    )
    first = top_per_group(lines.select(key, order, "log_id", "message"), ["group_id"], [F.col(order)], samples)
    text = F.concat(F.coalesce("raw_log", F.lit("")), F.lit(" "), F.coalesce("message", F.lit("")))
    named = lines.select(key, tx.entities(text).alias("e"))
    kinds = named.schema["e"].dataType.names
    of_kind = lambda k: F.transform(f"e.{k}", lambda v: F.struct(F.lit(k).alias("kind"), v.alias("value")))
    listed = F.flatten(F.array(*[of_kind(k) for k in kinds]))
    entities = named.select("group_id", F.explode(listed).alias("x")).select("group_id", "x.kind", "x.value").distinct()
    return groups, first.select("group_id", "rank", "log_id", "message"), lines.select(key, "log_id"), entities


def prefixed(text: Column, side: str) -> Column:
    """A text for an embedding model that tells queries from passages."""
    return F.concat(F.lit(f"{side}: "), text)


def task_state(message: Column) -> Column:
    return tx.found(message, r"(?i)pending task \(([^)]+)\)", 1)


def apache_module(message: Column) -> Column:
    return tx.found(message, r"\b(mod_[A-Za-z0-9_]+)\b", 1)


def local_rank(logs: DataFrame, terms: list[str], k: int) -> DataFrame:
    """Rows by 3 points a term in the component and 2 in the message, then by time."""
    has = lambda c, t: F.coalesce(F.contains(F.lower(c), F.lit(t)), F.lit(False)).cast("int")
    score = sum((3 * has("component", t) + 2 * has("message", t) for t in terms), F.lit(0))
    return logs.withColumn("score", score).filter("score > 0").orderBy(F.desc("score"), F.desc_nulls_last("ts_ms"), F.desc("seq")).limit(k)


def pick_incident(logs: DataFrame, terms: list[str]) -> DataFrame:
    """The best local hit of level ERROR or CRITICAL."""
    return local_rank(logs.filter(F.col("level").isin("ERROR", "CRITICAL")), terms, 1)


def quality(logs: DataFrame) -> DataFrame:
    """Per dataset: rows, coverage by templates, singletons, share of the twenty largest, mean message length."""
    template = optional(F.col("template_id"))
    counts = logs.groupBy("dataset", template.alias("t")).agg(F.count("*").alias("n"), F.sum(F.length("message")).alias("chars"))
    ranked = top_per_group(counts.filter("t IS NOT NULL"), ["dataset"], [F.desc("n"), F.col("t")], 20)
    top = ranked.groupBy("dataset").agg(F.sum("n").alias("top20"))
    per = counts.groupBy("dataset").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("t").isNotNull(), F.col("n"))), F.lit(0)).alias("matched"), F.count("t").alias("templates"),
        F.count_if(F.col("t").isNotNull() & (F.col("n") == 1)).alias("singletons"), F.sum("chars").alias("chars"),
    )
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    joined = per.join(top, "dataset", "left")
    return joined.select(
        "dataset", "rows", "templates", ratio(F.col("matched"), F.col("rows")).alias("coverage"), ratio(F.col("singletons"), F.col("templates")).alias("singleton_ratio"),
        ratio(F.col("top20"), F.col("matched")).alias("top20_coverage"), ratio(F.col("chars"), F.col("rows")).alias("mean_message_length"),
    )
