"""Mixing sources to target shares of tokens: entropy balancing.

Every document has a rate, the expected number of its copies. Among all rates that give each
source its target tokens and stay within its most repeats, those closest to one copy each (in
relative entropy) are `min(cap, exp(lambda_source * tokens))`; the lambdas solve a convex
dual, found by Newton steps kept inside a bracket. Each step is one distributed aggregation
over counts of documents per (source, tokens). Rates are then rounded into whole copies by a
hash of the document; a shift of the rounding threshold, found the same way, brings each
source within about one document of its target, and one copy more or less of a few out of
`SPARE` documents a source takes away what is left.

The total is the largest at which every target can be met within the most repeats.

Defined results: sources are compared without letter case and surrounding blanks, null and
blank belong to no source, documents without id are not planned, documents of sources without target get no copies; null and empty
texts have no tokens and get no copies; a target whose source has no tokens cannot be met:
its share is reported as 0 and the others keep their proportions; an empty table gives an
empty plan; of a target listed twice the first in order of share and repeats counts.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logstrata.functions.ids import ident
from logstrata.operators.ingest import top_per_group
from logstrata.session import materialize

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-splitting pattern published with the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_TARGETS = 10_000
GRID = 33
#: Documents a source of which single copies may be added or dropped to meet its target.
SPARE = 64


def count_tokens(documents: DataFrame, doc_id: str, text: str, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """`doc_id`, `keep` and n_tokens by a public byte-level BPE vocabulary."""

    # the file is read here once: executors need not have it
    shared = documents.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        cache = tiktoken.__dict__.setdefault("_encodings_by_path", {})
        if vocabulary not in cache:
            lines = map(bytes.split, shared.value.splitlines())
            ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
            cache[vocabulary] = tiktoken.Encoding("by_path", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        encoding = cache[vocabulary]
        for frame in frames:
            frame["n_tokens"] = [len(encoding.encode_ordinary(t)) if t else 0 for t in frame["__text"].tolist()]
            yield frame.drop(columns="__text")

    picked = documents.select(doc_id, *keep, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema if f.name != "__text")
    return picked.mapInPandas(scan, f"{schema}, n_tokens long")


class Targets:
    """Target tokens and most repeats per source; a small table by its checked size."""

    def __init__(self, targets: DataFrame, available: dict[str, int]):
        rows = targets.select(ident("source").alias("s"), "target_share", "max_repeats").filter("s IS NOT NULL").limit(MAX_TARGETS + 1).collect()
        if len(rows) > MAX_TARGETS:
            raise ValueError(f"more than {MAX_TARGETS} targets")
        self.share: dict[str, float] = {}
        self.cap: dict[str, int] = {}
        for r in sorted(rows, key=lambda r: (r.s, r.target_share or 0.0, r.max_repeats or 0)):
            self.share.setdefault(r.s, r.target_share or 0.0)
            self.cap.setdefault(r.s, r.max_repeats or 0)
        usable = {s: v for s, v in self.share.items() if v > 0 and self.cap[s] > 0 and available.get(s, 0) > 0}
        scale = sum(usable.values()) or 1.0
        self.total = min((self.cap[s] * available[s] / (v / scale) for s, v in usable.items()), default=0.0)
        self.tokens = {s: self.total * v / scale for s, v in usable.items()}
        self.full = {s for s, a in self.tokens.items() if a >= self.cap[s] * available[s] * (1 - 1e-9)}


def _lookup(source: Column, values: dict[str, float]) -> Column:
    pairs = [F.lit(x) for s, v in values.items() for x in (s, float(v))]
    return F.element_at(F.create_map(*pairs), source) if pairs else F.lit(None).cast("double")


def balance(histogram: DataFrame, targets: Targets, unit: dict[str, float], tolerance: float = 1e-7, steps: int = 60) -> dict[str, float]:
    """lambda per source, for tokens measured in `unit`s of the source."""
    open_ = {s: a for s, a in targets.tokens.items() if s not in targets.full}
    lam = {s: 0.0 for s in open_}
    low: dict[str, float] = {s: -1.0 for s in open_}
    high: dict[str, float] = {s: 1.0 for s in open_}
    below, above = set(), set()
    for _ in range(steps):
        if not open_:
            break
        x = F.col("n_tokens") / _lookup(F.col("source"), unit)
        rate = F.exp(F.least(_lookup(F.col("source"), lam) * x, F.lit(50.0)))
        cap = _lookup(F.col("source"), {s: float(targets.cap[s]) for s in lam})
        used = F.least(rate, cap) * F.col("n_tokens") * F.col("n")
        slope = F.when(rate < cap, rate * F.col("n_tokens") * x * F.col("n")).otherwise(0.0)
        sums = histogram.filter(F.col("source").isin(list(open_))).groupBy("source").agg(F.sum(used).alias("used"), F.sum(slope).alias("slope")).collect()
        for r in sums:
            s, gap = r.source, r.used - targets.tokens[r.source]
            if abs(gap) <= tolerance * targets.tokens[s]:
                open_.pop(s)
                continue
            if gap < 0:
                low[s], _ = lam[s], below.add(s)
            else:
                high[s], _ = lam[s], above.add(s)
            step = lam[s] - gap / r.slope if r.slope > 0 else None
            bracketed = s in below and s in above
            if step is not None and (not bracketed or low[s] < step < high[s]) and abs(step - lam[s]) < 20:
                lam[s] = step
            elif bracketed:
                lam[s] = (low[s] + high[s]) / 2
            else:
                lam[s] = lam[s] + 2.0 if gap < 0 else lam[s] - 2.0
    return lam


def plan(documents: DataFrame, targets_table: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens, rate, copies) of every document of a source with a target."""
    picked = documents.select(F.col(doc_id).alias("doc_id"), ident(source).alias("source"), F.col(text).alias("text")).filter("source IS NOT NULL AND doc_id IS NOT NULL")
    named = targets_table.select(ident("source").alias("source")).distinct()
    sized = count_tokens(picked.join(named, "source", "left_semi"), "doc_id", "text", ["source"], vocabulary)
    sized = materialize(sized, "sized")
    histogram = materialize(sized.filter("n_tokens > 0").groupBy("source", "n_tokens").agg(F.count("*").alias("n")), "token_counts")
    totals = histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("t"), F.sum("n").alias("n")).limit(MAX_TARGETS + 1).collect()
    targets = Targets(targets_table, {r.source: r.t for r in totals})
    unit = {r.source: r.t / r.n for r in totals}
    lam = balance(histogram, targets, unit)

    caps = _lookup(F.col("source"), {s: float(targets.cap[s]) for s in targets.tokens})
    tilted = F.least(F.exp(F.least(_lookup(F.col("source"), lam) * F.col("n_tokens") / _lookup(F.col("source"), unit), F.lit(50.0))), caps)
    full = F.col("source").isin(list(targets.full)) if targets.full else F.lit(False)
    rate = F.when((F.col("n_tokens") == 0) | caps.isNull(), 0.0).otherwise(F.coalesce(F.when(full, caps).otherwise(tilted), F.lit(0.0)))
    chance = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("copies")), 11)) / float(1 << 53)
    rated = sized.select("doc_id", "source", "n_tokens", rate.alias("rate"), chance.alias("chance"))

    def copies(shift: Column) -> Column:
        extra = F.col("chance") < F.col("rate") - F.floor("rate") + shift
        value = F.greatest(F.lit(0.0), F.least(F.floor("rate") + extra.cast("int") - (F.col("chance") >= 1 + shift).cast("int"), caps))
        return F.when((F.col("n_tokens") == 0) | caps.isNull(), 0).otherwise(value.cast("int"))

    wanted = {s: a for s, a in targets.tokens.items() if s not in targets.full}
    shift = rounding_shift(rated, copies, wanted)
    rounded = rated.withColumn("copies", copies(F.coalesce(_lookup(F.col("source"), shift), F.lit(0.0))))
    changes = single_copies(rounded, wanted, targets.cap)
    changed = documents.sparkSession.createDataFrame(changes, f"doc_id {rounded.schema['doc_id'].dataType.simpleString()}, change int")
    final = rounded.join(F.broadcast(changed), "doc_id", "left").withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0)))
    return final.select("doc_id", "source", "n_tokens", F.round("rate", 6).alias("rate"), F.col("copies").cast("int").alias("copies"))


def single_copies(rounded: DataFrame, wanted: dict[str, float], cap: dict[str, int]) -> list[tuple]:
    """(doc_id, 1 or -1) of the few documents whose changed copies bring each source to its wanted tokens.

    Of every source `SPARE` documents, chosen by hash, are looked at; each step makes the one
    change, or the one addition with one removal, that leaves the least difference.
    """
    if not wanted:
        return []
    open_ = rounded.filter(F.col("source").isin(list(wanted)) & (F.col("n_tokens") > 0))
    used = {r.source: r.used for r in open_.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("used")).collect()}
    spare: dict[str, list] = {}
    for r in top_per_group(open_, ["source"], [F.col("chance"), F.col("doc_id")], SPARE).select("source", "doc_id", "n_tokens", "copies").collect():
        spare.setdefault(r.source, []).append(r)
    changes = []
    for source, rows in spare.items():
        gap, done = wanted[source] - used[source], set()
        for _ in range(len(rows)):
            more = [(r.n_tokens, r.doc_id) for r in rows if r.doc_id not in done and r.copies < cap[source]]
            less = [(-r.n_tokens, r.doc_id) for r in rows if r.doc_id not in done and r.copies > 0]
            steps = [(abs(gap - t), t, ((d, 1 if t > 0 else -1),)) for t, d in more + less]
            steps += [(abs(gap - t - u), t + u, ((d, 1), (e, -1))) for t, d in more for u, e in less if d != e]
            best = min(steps, default=None, key=lambda x: x[0])
            if best is None or best[0] >= abs(gap):
                break
            gap -= best[1]
            changes += best[2]
            done |= {d for d, _ in best[2]}
    return changes


def rounding_shift(rated: DataFrame, copies, wanted: dict[str, float], passes: int = 4) -> dict[str, float]:
    """The threshold shift per source that brings its copies nearest to the wanted tokens.

    Each pass measures a grid of shifts at once and narrows it around the best one.
    """
    centre, width = {s: 0.0 for s in wanted}, 0.5
    best: dict[str, float] = dict(centre)
    for _ in range(passes if wanted else 0):
        offsets = [width * (2 * k / (GRID - 1) - 1) for k in range(GRID)]
        middle = _lookup(F.col("source"), centre)
        sums = [F.sum(copies(middle + o) * F.col("n_tokens")).alias(f"g{k}") for k, o in enumerate(offsets)]
        for r in rated.filter(F.col("source").isin(list(wanted))).groupBy("source").agg(*sums).collect():
            k = min(range(GRID), key=lambda k: abs((r[f"g{k}"] or 0) - wanted[r.source]))
            best[r.source] = centre[r.source] + offsets[k]
        centre, width = dict(best), width * 2 / (GRID - 1)
    return best


def report(planned: DataFrame, targets_table: DataFrame) -> DataFrame:
    """Target and actual share per source of `mix_targets`."""
    used = planned.groupBy("source").agg(
        F.count("*").alias("n_documents"), F.sum("n_tokens").alias("tokens_available"), F.sum("copies").alias("n_copies"),
        F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"), F.max("copies").alias("most_copies"),
    )
    total = used.agg(F.sum("tokens").alias("all_tokens"))
    wanted = targets_table.select(ident("source").alias("source"), "target_share", "max_repeats")
    joined = wanted.join(used, "source", "left").join(F.broadcast(total))
    filled = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_documents", "tokens_available", "n_copies", "tokens", "most_copies")]
    share = F.round(F.coalesce(F.col("tokens") / F.nullif(F.col("all_tokens"), F.lit(0)), F.lit(0.0)), 6)
    return joined.select("source", "target_share", "max_repeats", *filled, share.alias("actual_share"))
