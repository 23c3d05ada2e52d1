"""Repeated consecutive events of a sequence, each run collapsed to one event.

Only boundary rows are kept: events whose key differs from their predecessor's. Each carries
its position and its predecessor's line and time, so the next boundary (`lead`) gives the
run's number of events as a difference of positions and its end as that predecessor.
Sequences are cut into blocks of lines; what crosses a block border is carried over.

Defined results: events without sequence or position belong to no run; of rows with one
position the one delivered first counts; null keys are equal to each other; a run's duration
is null where its first or last time is unknown; columns other than those named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logstrata.operators.blocks import carry

BLOCK_LINES = 4096


# Parts that make a hyphenated word part of a statement ("read-only", "fail-over")
# and no name of an object ("zinc-vole").
PARTS = (
    "only", "over", "back", "up", "down", "out", "in", "off", "on", "through", "away", "by", "to", "of", "free", "based", "aware", "side", "wide", "time", "end",
    "ready", "bound", "level", "order", "path", "memory", "disk", "state", "mode", "phase", "running", "lived", "way", "safe", "like", "term", "run", "scan", "known",
    "non", "re", "pre", "post", "multi", "sub", "un", "auto", "self", "co", "de", "mis", "cross", "inter", "intra", "semi", "half", "full", "read", "write", "fail", "roll",
    "log", "check", "hand", "shut", "start", "fast", "slow", "long", "short", "high", "low", "hot", "cold", "warm", "old", "new", "first", "last", "single", "double", "two", "three",
    "one", "open", "closed", "hard", "soft", "pass", "time", "look", "follow", "clean", "set", "not", "no", "so", "well", "then", "and", "or", "per", "out",
)


def message_key(message: Column) -> Column:
    """A hash of what a message says: letter case, spacing and the values in it do not count.

    Values are words with digits or slashes (ids, addresses, paths, numbers, durations) and
    hyphenated names. A hyphenated word with one of `PARTS` on either side belongs to the
    statement: "read-only" and "write-only" differ.
    """
    text = F.translate(F.lower(F.coalesce(message, F.lit(""))), "\u00a0\u2007\u202f\u3000", "    ")
    parts = "|".join(sorted(set(PARTS)))
    # the first look ahead keeps words without a hyphen from the long alternatives
    name = rf"\b(?=[a-z]+-[a-z])(?!(?:{parts})-)[a-z]+-(?!(?:{parts})\b)[a-z]+\b(?!-)"
    plain = F.regexp_replace(text, rf"\S*[\d/]\S*|{name}", "#")
    return F.xxhash64(F.trim(F.regexp_replace(plain, r"\s+", " ")))


def collapse_runs(events: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Runs of events (source_file, line_number, seq, key, ts_ms): every event is in one run.

    Gives source_file, first_line, last_line, n_events, duration_ms.
    """
    placed = events.filter(F.col("source_file").isNotNull() & F.col("line_number").isNotNull())
    placed = placed.withColumn("block", F.floor(F.col("line_number") / block_lines)).repartition("source_file", "block")
    once = placed.groupBy("source_file", "block", "line_number").agg(F.min(F.struct("seq", "key", "ts_ms")).alias("e"))
    once = once.select("source_file", "block", "line_number", F.struct("line_number", "e.key", "e.ts_ms").alias("e"))
    once = carry(
        once, ["source_file"], "block", {"n": F.count("*"), "last": F.max("e")},
        {"n_before": ("sum", "n"), "prior": ("last", "last"), "n_all": ("total", "n"), "final": ("max", "last")},
    )
    inside = Window.partitionBy("source_file", "block").orderBy("line_number")
    once = once.withColumn("pos", F.col("n_before") + F.row_number().over(inside))
    once = once.withColumn("prev", F.coalesce(F.lag("e").over(inside), "prior"))
    starts = once.filter(F.col("prev").isNull() | ~F.col("prev.key").eqNullSafe(F.col("e.key")))
    border = F.struct("pos", F.col("prev.line_number").alias("line"), F.col("prev.ts_ms").alias("ts_ms"))
    starts = starts.withColumn("border", border)
    starts = carry(starts, ["source_file"], "block", {"first": F.min("border")}, {"following": ("next", "first")})
    end = F.struct((F.col("n_all") + 1).alias("pos"), F.col("final.line_number").alias("line"), F.col("final.ts_ms").alias("ts_ms"))
    nxt = F.coalesce(F.lead("border").over(inside), F.col("following"), end)
    return starts.withColumn("nxt", nxt).select(
        "source_file",
        F.col("line_number").cast("int").alias("first_line"),
        F.col("nxt.line").cast("int").alias("last_line"),
        (F.col("nxt.pos") - F.col("pos")).cast("int").alias("n_events"),
        (F.col("nxt.ts_ms") - F.col("e.ts_ms")).alias("duration_ms"),
    )
