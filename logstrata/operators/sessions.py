"""Grouping activity into sessions by a sweep over +1 / -1 deltas.

Every event adds one at its time and takes one away `gap` later. Ordered by time, with
additions before subtractions at the same instant (a distance of exactly `gap` does not end
a session), the running sum returns to zero exactly where a session closes.

A key of any size is cut into blocks of time; the running sum of a block starts from the sum
of the earlier blocks. A session is then a group of deltas between two zero crossings; its
partial aggregates per block are merged by the number of crossings before them.

Defined results: null, empty and `-` keys have no sessions; an event without time is
dropped from no session because it belongs to none; an event identifier counts once, at
its earliest time; events at the same instant are one session; an empty table has none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logstrata.functions.ids import ident
from logstrata.operators.blocks import carry


def sessionize(events: DataFrame, key: str, time: str, event_id: str, gap_ms: int = 30 * 60 * 1000, block_ms: int = 6 * 3600 * 1000) -> DataFrame:
    """(key, start_ms, end_ms, duration_ms, n_events) of every session."""
    named = events.select(ident(key).alias("key"), F.unix_millis(F.col(time).cast("timestamp")).alias("t"), F.col(event_id).alias("event"))
    named = named.filter(F.col("key").isNotNull() & (F.col("key") != "-") & F.col("t").isNotNull())
    # a null event identifier cannot be compared: each such row is an event of its own
    once = named.filter(F.col("event").isNotNull()).groupBy("key", "event").agg(F.min("t").alias("t")).select("key", "t")
    per_instant = once.unionByName(named.filter(F.col("event").isNull()).select("key", "t"))
    deltas = per_instant.select(
        "key", F.explode(F.array(F.struct(F.col("t").alias("at"), F.lit(1).alias("d")), F.struct((F.col("t") + gap_ms).alias("at"), F.lit(-1).alias("d")))).alias("x")
    ).select("key", "x.at", "x.d")
    # many events of one instant are one delta with their number, before anything else
    deltas = deltas.groupBy("key", "at", "d").agg(F.sum("d").alias("n"))
    blocked = deltas.withColumn("block", F.floor(F.col("at") / block_ms))
    blocked = carry(blocked, ["key"], "block", {"n": F.sum("n")}, {"open": ("sum", "n")})
    inside = Window.partitionBy("key", "block").orderBy("at", F.col("d").desc()).rowsBetween(Window.unboundedPreceding, 0)
    swept = blocked.withColumn("level", F.col("open") + F.sum("n").over(inside)).withColumn("closes", (F.col("level") == 0).cast("bigint"))
    swept = swept.withColumn("local", F.coalesce(F.sum("closes").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = swept.groupBy("key", "block", "local").agg(
        F.min(F.when(F.col("d") > 0, F.col("at"))).alias("start_ms"),
        F.max(F.when(F.col("d") > 0, F.col("at"))).alias("end_ms"),
        F.sum(F.when(F.col("d") > 0, F.col("n")).otherwise(0)).alias("n"),
        F.max("closes").alias("closed"),
    )
    parts = carry(parts, ["key"], "block", {"closed": F.sum("closed")}, {"closed_before": ("sum", "closed")})
    return (
        parts.withColumn("session", F.col("closed_before") + F.col("local"))
        .groupBy("key", "session")
        .agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.sum("n").cast("int").alias("n_events"))
        .select("key", "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), "n_events")
    )
