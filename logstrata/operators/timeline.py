"""Mixed timestamp formats and time zones: one unambiguous instant per text.

Texts are rewritten to a canonical local time with an optional zone. Where the zone is
missing, the *offset history* of the host is chosen among candidate zones: local times are
converted under each candidate and compared with the times of ingestion; an instant after
its ingestion, or long before it, is a violation; the candidate with the fewest violations
wins. The listed zone of a host is its only candidate. A host without a listed zone is tried
with UTC and all listed zones; another zone than UTC must save at least `EVIDENCE` violations
and half of those that UTC has. Rows without host have no history of their own and are in UTC.

Defined results: null, blank, placeholder and impossible texts have no instant (a second 60,
February 30, a local time skipped by a clock change are impossible); a local time that
occurs twice is the earlier one; hosts are compared without letter case and blanks; slash
dates follow the host's date order, day first where unknown; abbreviations are those of the
host's zone in its own history (of an abbreviation with several offsets the one in use at that
time), and no instant where that zone never uses them; rows without time of ingestion take no
part in the choice.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logstrata.functions.ids import ident
from logstrata.functions.timestamps import canonical, epoch_millis, let, offset_seconds, read_parts
from logstrata.session import materialize

#: There are about 600 zones; a table of zones stays below this.
MAX_ZONES = 2000
#: Violations that a zone must save against UTC to be chosen for a host without a listed zone.
EVIDENCE = 20
#: Host tables up to this many rows are broadcast, larger ones are joined by shuffle.
MAX_BROADCAST_HOSTS = 100_000


def zone_abbreviations(spark: SparkSession, zones: list[str], first: int = 1970, last: int = 2038) -> DataFrame:
    """(__abbr_zone, __abbr, __abbr_uses): for each abbreviation of a zone when (epoch ms) it began to mean which offset (seconds east of UTC)."""
    uses: dict[tuple[str, str], list[tuple[int, int]]] = {}
    for name in zones:
        if name not in available_timezones():
            continue
        zone, at = ZoneInfo(name), datetime(first, 1, 1, tzinfo=timezone.utc)
        while at.year < last:
            local = at.astimezone(zone)
            use = uses.setdefault((name, local.tzname().upper()), [])
            offset = int(local.utcoffset().total_seconds())
            if not use or use[-1][1] != offset:
                use.append((int(at.timestamp() * 1000), offset))
            at += timedelta(days=7)
    rows = [(zone, abbr, use) for (zone, abbr), use in sorted(uses.items())]
    return spark.createDataFrame(rows, "__abbr_zone string, __abbr string, __abbr_uses array<struct<since:bigint,offset:int>>")


def abbreviation_offset(uses: Column, local_ms: Column) -> Column:
    """The offset the abbreviation has at a local time; before its first use that of the first."""
    begun = F.filter(uses, lambda u: u["since"] + u["offset"] * 1000 <= local_ms)
    return F.coalesce(F.try_element_at(begun, F.lit(-1))["offset"], F.get(uses, F.lit(0))["offset"])


def _small(df: DataFrame, limit: int) -> DataFrame:
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def host_candidates(host_zones: DataFrame) -> DataFrame:
    """(__zone_host, __cand_zone, __month_first): the listed zone is a host's one candidate history."""
    return host_zones.select(
        ident("host").alias("__zone_host"), F.col("tz_name").alias("__cand_zone"), (F.lower(F.trim("date_order")) == "mdy").alias("__month_first")
    ).filter(F.col("__zone_host").isNotNull()).groupBy("__zone_host").agg(F.min("__cand_zone").alias("__cand_zone"), F.max("__month_first").alias("__month_first"))


def local_times(df: DataFrame, text: str, host: str, candidates: DataFrame) -> DataFrame:
    """`df` with __host, its candidate zone, and __p: local, millis, zone, epoch_ms of the text."""
    joined = df.withColumn("__host", ident(host)).join(_small(candidates, MAX_BROADCAST_HOSTS), F.col("__host") == F.col("__zone_host"), "left")
    trimmed = F.upper(F.regexp_replace(F.col(text), r"^[\s\u00a0]+|[\s\u00a0]+$", ""))
    month_first = F.coalesce("__month_first", F.lit(False))
    parsed = let(trimmed, lambda t: let(read_parts(canonical(t, month_first)), lambda p: F.struct(p["local"].alias("local"), p["millis"].alias("millis"), p["zone"].alias("zone"), epoch_millis(t).alias("epoch_ms"))))
    return joined.withColumn("__p", parsed)


def listed_zones(candidates: DataFrame) -> list[str]:
    """UTC and the distinct listed zones; more than `MAX_ZONES` are refused."""
    rows = candidates.select("__cand_zone").filter("__cand_zone IS NOT NULL").distinct().limit(MAX_ZONES + 1).collect()
    if len(rows) > MAX_ZONES:
        raise ValueError(f"more than {MAX_ZONES} time zones")
    return ["UTC", *sorted({r[0] for r in rows} - {"UTC"})]


def chosen_zones(df: DataFrame, text: str, host: str, ingested: str, candidates: DataFrame) -> DataFrame:
    """`candidates` completed by the chosen history of every host without a listed zone."""
    unlisted = df.select(F.col(text).alias("__text"), F.col(host).alias("__of"), F.col(ingested).alias("__at")).withColumn("__name", ident("__of")).filter("__name IS NOT NULL")
    listed = candidates.filter("__cand_zone IS NOT NULL").select(F.col("__zone_host").alias("__name"))
    unlisted = unlisted.join(_small(listed, MAX_BROADCAST_HOSTS), "__name", "left_anti")
    scored = zone_violations(unlisted, "__text", "__of", "__at", listed_zones(candidates), candidates)
    utc = F.max(F.when(F.col("zone") == "UTC", F.col("violations")))
    best = scored.groupBy("host").agg(F.min(F.struct("violations", (F.col("zone") != "UTC").alias("other"), "zone")).alias("b"), utc.alias("utc"))
    clear = (F.col("utc") - F.col("b.violations") >= EVIDENCE) & (2 * F.col("b.violations") <= F.col("utc"))
    chosen = best.select(F.col("host").alias("__zone_host"), F.when(clear, F.col("b.zone")).otherwise("UTC").alias("__cand_zone"), F.lit(False).alias("__month_first"))
    return candidates.unionByName(chosen.join(_small(candidates.select("__zone_host"), MAX_BROADCAST_HOSTS), "__zone_host", "left_anti"))


def instants(df: DataFrame, text: str, host: str, ingested: str | None, candidates: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` columns and `ts_ms`, one row per text that denotes an instant.

    With times of ingestion the histories of hosts without a listed zone are chosen first.
    """
    spark = df.sparkSession
    zones = listed_zones(candidates)
    if ingested:
        candidates = materialize(chosen_zones(df, text, host, ingested, candidates), "zones")
    timed = local_times(df.select(*keep, F.col(text).alias("__raw"), F.col(host).alias("__of")), "__raw", "__of", candidates)
    known = zone_abbreviations(spark, zones)
    timed = timed.select(*keep, "__p", F.coalesce("__cand_zone", F.lit("UTC")).alias("__zone"))
    timed = timed.join(F.broadcast(known), (F.col("__zone") == F.col("__abbr_zone")) & (F.col("__p.zone") == F.col("__abbr")), "left")
    local, written, zone = F.col("__p.local"), F.col("__p.zone"), F.col("__zone")
    # a local time that the clock skipped does not come back from its conversion
    in_zone = let(F.to_utc_timestamp(local, zone), lambda utc: F.when(F.from_utc_timestamp(utc, zone) == local, F.unix_millis(utc)))
    offset = F.coalesce(offset_seconds(written), abbreviation_offset(F.col("__abbr_uses"), F.unix_millis(local)))
    at = F.when(written.isNull(), in_zone).otherwise(F.unix_millis(local) - offset * 1000)
    ts_ms = F.coalesce(F.col("__p.epoch_ms"), at + F.col("__p.millis"))
    # exploding what is there, unlike a filter, reads the text only once
    return timed.select(*keep, F.explode(F.array_compact(F.array(ts_ms))).alias("ts_ms"))


def zone_violations(df: DataFrame, text: str, host: str, ingested: str, names: list[str], candidates: DataFrame, late_ms: int = 15 * 60 * 1000) -> DataFrame:
    """(host, zone, violations, n): how badly each zone fits each host.

    Texts are first counted per (host, local hour, lag in minutes), so the zones meet counts,
    not rows.
    """
    timed = local_times(df.select(F.col(text).alias("__raw"), F.col(host).alias("__of"), F.unix_millis(F.col(ingested)).alias("__in")), "__raw", "__of", candidates)
    p = F.col("__p")
    lag = F.floor((F.col("__in") - F.unix_millis(p["local"]) - p["millis"]) / 60000)
    timed = timed.select("__host", p["zone"].isNull().alias("naive"), F.date_trunc("hour", p["local"]).alias("hour"), lag.alias("lag"))
    counts = timed.groupBy("__host", "naive", "hour", "lag").agg(F.count("*").alias("n"))
    counts = counts.filter(F.col("naive") & F.col("__host").isNotNull() & F.col("lag").isNotNull())
    tried = counts.withColumn("try_zone", F.explode(F.array(*[F.lit(n) for n in sorted(names)]).cast("array<string>")))
    offset = F.floor((F.unix_millis("hour") - F.unix_millis(F.to_utc_timestamp("hour", F.col("try_zone")))) / 60000)
    delay = F.col("lag") + offset
    wrong = (delay < -1) | (delay > late_ms // 60000)
    scored = tried.groupBy("__host", "try_zone").agg(F.sum(F.when(wrong, F.col("n")).otherwise(0)).alias("violations"), F.sum("n").alias("n"))
    return scored.select(F.col("__host").alias("host"), F.col("try_zone").alias("zone"), "violations", "n")


def estimate_zones(df: DataFrame, text: str, host: str, ingested: str, names: list[str], candidates: DataFrame, late_ms: int = 15 * 60 * 1000) -> DataFrame:
    """(host, zone, violations, n): of the zones in `names` the offset history that fits each host best."""
    scored = zone_violations(df, text, host, ingested, names, candidates, late_ms)
    best = scored.groupBy("host").agg(F.min(F.struct("violations", "zone", "n")).alias("b"))
    return best.select("host", F.col("b.zone"), F.col("b.violations"), F.col("b.n"))
