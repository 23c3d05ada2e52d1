"""References to records that do not exist.

Filters are Bloom filters held as tables of 64-bit words, sixteen bits a key whatever the
number of keys. A filter over the distinct references thins the parents while they are
scanned; a filter over the parent keys that are left proves a reference that misses it an
orphan for certain; only the references it lets through are verified by an exact join. All
this happens once per distinct reference; the referring rows meet only the verdict. A filter
of up to `MAX_BROADCAST_WORDS` words is broadcast; a larger one keeps its sixteen bits a key
and is joined by shuffle, each part meeting the keys that hash to it.

Defined results: identifiers are compared without letter case and surrounding blanks; null
and empty references are no references; repeated references and repeated referring rows
count once, at the earliest creation time; a reference without creation time cannot be
`late`; empty parents make every reference `missing`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logstrata.session import materialize

#: 2^20 words of 64 bits, 8 MB of bits for four million keys: the bound of what is broadcast.
MAX_BROADCAST_WORDS = 1 << 20
#: Parents that are in no reference and pass its filter all the same, at most; sizes the second filter.
FALSE_HITS = 0.02
SALTS = 8


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(words))


def _mask(key: Column) -> Column:
    """Four bits of one word, from a second hash."""
    h = F.xxhash64(key, F.lit("bits"))
    bits = [F.shiftright(h, 6 * k).bitwiseAND(F.lit(63)).cast("int") for k in range(4)]
    one = "1L"
    mask = F.expr("0L")
    for b in bits:
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.expr(one), b))
    return mask


def bloom_words(keys: DataFrame, key: str, words: int) -> DataFrame:
    """(word, bits): at most `words` rows."""
    return keys.groupBy(_word(F.col(key), words).alias("word")).agg(F.bit_or(_mask(F.col(key))).alias("bits"))


def words_for(n_keys: int) -> int:
    """A power of two giving at least sixteen bits a key."""
    n = 1 << 10
    while n * 4 < n_keys:
        n *= 2
    return n


def probe(refs: DataFrame, key: str, bloom: DataFrame, words: int) -> DataFrame:
    """`refs` with `maybe`: false where the key is certainly not in the filter."""
    bloom = F.broadcast(bloom) if words <= MAX_BROADCAST_WORDS else bloom
    joined = refs.join(bloom, _word(F.col(key), words) == F.col("word"), "left")
    mask = _mask(F.col(key))
    return joined.withColumn("maybe", F.coalesce(F.col("bits").bitwiseAND(mask) == mask, F.lit(False))).drop("word", "bits")


def orphans(refs: DataFrame, parents: DataFrame, deleted: DataFrame, n_parents: int) -> DataFrame:
    """Orphan references with their kind and period.

    refs: (tbl, rec_id, parent_tbl, ref_id, created_at), ids normalised, one row per mention.
    parents: (parent_tbl, key, available_at), any number of rows per key.
    deleted: (parent_tbl, key). n_parents: number of rows of `parents`.
    """
    probe_key = lambda key: F.concat_ws("|", "parent_tbl", key)
    distinct = materialize(refs.groupBy("tbl", "rec_id", "parent_tbl", "ref_id").agg(F.min("created_at").alias("created_at")), "references")
    keys = materialize(distinct.select("parent_tbl", "ref_id").distinct().withColumn("probe_key", probe_key("ref_id")), "referenced")
    n_keys = keys.count()

    keyed = parents.filter(F.col("key").isNotNull()).withColumn("probe_key", probe_key("key"))
    near = probe(keyed, "probe_key", bloom_words(keys, "probe_key", words_for(n_keys)), words_for(n_keys)).filter("maybe")
    near = materialize(near.groupBy("parent_tbl", "key", "probe_key").agg(F.min("available_at").alias("available_at")), "parents")
    words = words_for(n_keys + int(FALSE_HITS * n_parents))
    probed = probe(keys, "probe_key", bloom_words(near, "probe_key", words), words)

    gone = deleted.filter(F.col("key").isNotNull()).select("parent_tbl", "key").distinct().withColumn("gone", F.lit(True))
    exact = near.select("parent_tbl", F.col("key").alias("ref_id"), "available_at", F.lit(True).alias("found"))
    exact = exact.join(gone.withColumnRenamed("key", "ref_id"), ["parent_tbl", "ref_id"], "left")
    rest = probed.filter("maybe").select("parent_tbl", "ref_id").join(exact, ["parent_tbl", "ref_id"], "left")
    verdict = probed.filter("NOT maybe").select("parent_tbl", "ref_id").unionByName(rest, allowMissingColumns=True)

    # one key may be referred to by a third of all rows: their join is salted
    salted = verdict.withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
    mentions = distinct.withColumn("salt", F.pmod(F.xxhash64("rec_id"), F.lit(SALTS)).cast("int"))
    checked = mentions.join(salted, ["parent_tbl", "ref_id", "salt"]).withColumn(
        "kind",
        F.when(F.col("found").isNull(), "missing").when(F.col("gone"), "deleted").when(F.col("available_at") > F.col("created_at"), "late"),
    )
    return checked.filter(F.col("kind").isNotNull()).select("tbl", "rec_id", "ref_id", "kind", F.date_format("created_at", "yyyy-MM").alias("period"))


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans per referring table, kind and period."""
    return found.groupBy("tbl", "kind", "period").agg(F.count("*").alias("n_orphans"), F.countDistinct("ref_id").alias("n_targets"))
