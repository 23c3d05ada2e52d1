"""Evaluation texts leaking into training text.

Candidate regions come from the q-gram lemma: a piece of `m` words that holds at most `m // 8`
changed, added or dropped words contains, for every such m from 12 up, a run of at least five
unchanged words, so on one diagonal (position in the document minus position in the item) at
least `(characters of the run) - Q + 1` character q-grams are shared. Shared q-grams are
counted in overlapping bands of diagonals; bands that reach the item's bound are kept, and
each is verified by an alignment of words in a band of two diagonals to either side.

It is enough to verify pieces of 12 words with one edit and of 16 words with two: any longer
piece within its budget contains one of these.

Defined results: letter case, punctuation, markup and line breaks do not count; null and
empty texts, and documents without id, match nothing; items below 12 words cannot leak; copies of a document are
documents of their own; texts of any length are read whole. Items are held in blocks of
`ITEM_BLOCK_CHARS` characters, one pass over the documents each, so what is broadcast is
bounded whatever the number of items.
"""

from __future__ import annotations

import html
import re
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Q = 8
BAND = 2
EDIT_SHARE = 8
PIECES = ((12, 1), (16, 2))
EXACT_RUN = 5
ITEM_BLOCK_CHARS = 4_000_000
SLICE = 1 << 20
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """The words of a text without case, punctuation and markup."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _WORD.findall(text.casefold())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _hashes(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every q-gram."""
    n = len(codes) - Q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(Q):
        h *= np.uint64(0x100000001B3)
        h += codes[k : k + n]
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class ItemIndex:
    """Q-grams of a block of items, with the bound each item's bands must reach."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        items = [(i, w) for i, w in items if len(w) >= PIECES[0][0]]
        self.ids = [i for i, _ in items]
        self.words = [w for _, w in items]
        hashes, owners, places, self.bounds = [], [], [], []
        for k, w in enumerate(self.words):
            h = _hashes(_codes(" ".join(w)))
            hashes.append(h)
            owners.append(np.full(len(h), k, dtype=np.int32))
            places.append(np.arange(len(h), dtype=np.int32))
            lengths = np.array([len(x) + 1 for x in w])
            runs = np.convolve(lengths, np.ones(EXACT_RUN, dtype=int), "valid") - 1
            self.bounds.append(max(1, int(runs.min()) - Q + 1))
        lengths = np.array([len(x) + 1 for w in self.words for x in w], dtype=np.int64)
        self.word_at = np.cumsum(lengths) - lengths
        sizes = np.array([len(w) for w in self.words], dtype=np.int64)
        self.word_of_item = np.cumsum(sizes) - sizes
        self.base = self.word_at[self.word_of_item] if len(sizes) else self.word_at
        h = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
        order = np.argsort(h, kind="stable")
        self.owner = np.concatenate(owners)[order] if hashes else np.zeros(0, np.int32)
        self.place = np.concatenate(places)[order] if hashes else np.zeros(0, np.int32)
        self.keys, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.bits = np.zeros(1 << 20, dtype=bool)
        self.bits[(self.keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text position, item, item position) of every shared q-gram."""
        at, owner, place = [], [], []
        for s in range(0, max(len(codes) - Q + 1, 0), SLICE):
            h = _hashes(codes[s : s + SLICE + Q - 1])
            maybe = np.flatnonzero(self.bits[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
            if not len(maybe) or not len(self.keys):
                continue
            k = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
            same = self.keys[k] == h[maybe]
            maybe, k = maybe[same], k[same]
            n = self.count[k]
            if not n.sum():
                continue
            ends = np.cumsum(n)
            posting = np.repeat(self.first[k] - (ends - n), n) + np.arange(ends[-1])
            at.append(np.repeat(maybe + s, n))
            owner.append(self.owner[posting])
            place.append(self.place[posting])
        if not at:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        return np.concatenate(at), np.concatenate(owner), np.concatenate(place)


def regions(at: np.ndarray, owner: np.ndarray, place: np.ndarray, bounds: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """Numbers of the hits that lie in a band reaching its item's bound.

    A text and an item that share fewer q-grams in all than the bound have no such band.
    """
    pair = text_of * len(bounds) + owner
    alive = np.flatnonzero(np.bincount(pair)[pair] >= bounds[owner])
    if not len(alive):
        return alive
    pair, diagonal, least = pair[alive], at[alive] - place[alive], bounds[owner[alive]]
    diagonal -= diagonal.min()
    width = int(diagonal.max()) // BAND + 2
    kept = np.zeros(len(alive), dtype=bool)
    for shift in (0, BAND // 2):
        order, new = _groups(pair * width + (diagonal + shift) // BAND)
        sizes = np.diff(np.append(new, len(order)))
        kept[order[np.repeat(sizes >= least[order[new]], sizes)]] = True
    return alive[kept]


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by key, and where in it each key begins."""
    order = np.argsort(key, kind="stable")
    sorted_ = key[order]
    return order, np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))


def unbroken(at: np.ndarray, owner: np.ndarray, place: np.ndarray, bounds: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """Numbers of the hits, in order of text position, that lie in as many hits in a row on one diagonal as `EXACT_RUN` unchanged words leave."""
    diagonal = at - place
    diagonal = diagonal - diagonal.min()
    order, new = _groups((text_of * len(bounds) + owner) * (int(diagonal.max()) + 1) + diagonal)
    first = np.zeros(len(order), dtype=bool)
    first[new] = True
    first[1:] |= np.diff(at[order]) != 1
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, len(order)))
    return np.sort(order[np.repeat(sizes >= bounds[owner[order[starts]]], sizes)])


def aligned(doc: list[str], item: list[str], diagonal: int) -> bool:
    """Whether a piece of the item within its edit budget runs along a word diagonal."""
    width = PIECES[-1][1]

    def unchanged(d: int) -> list[int]:
        """From each word of the item: unchanged words in a row along diagonal d."""
        run = [0] * (len(item) + 1)
        for i in range(min(len(item), len(doc) - d) - 1, max(0, -d) - 1, -1):
            if item[i] == doc[i + d]:
                run[i] = run[i + 1] + 1
        return run

    runs = {diagonal: unchanged(diagonal)}
    if max(runs[diagonal]) < EXACT_RUN:
        return False
    runs |= {d: unchanged(d) for d in range(diagonal - width, diagonal + width + 1) if d != diagonal}

    def reach(i: int, d: int, edits: int) -> int:
        """Most words of the item consumed from word i on diagonal d."""
        if d not in runs or i > len(item) or i < 0:
            return 0
        r = runs[d][i]
        if not edits:
            return r
        j = i + r
        best = r + reach(j, d + 1, edits - 1) if 0 <= j + d < len(doc) else r
        if j < len(item):
            best = max(best, r + 1 + reach(j + 1, d - 1, edits - 1))
            if 0 <= j + d < len(doc):
                best = max(best, r + 1 + reach(j + 1, d, edits - 1))
        return best

    for d, run in runs.items():
        for i in range(max(0, -d), len(item)):
            # a piece begins with up to `edits` words of the item that are changed or dropped
            if run[i] and not (i and i + d > 0 and run[i - 1]):
                for m, edits in PIECES:
                    if any(k + reach(i, d, edits - k) >= m for k in range(min(edits, i) + 1)):
                        return True
    return False


def leaks_of(texts: list[str | None], index: ItemIndex) -> list[tuple[int, int]]:
    """(number of the text, item id) of every leak in a batch of texts."""
    split = [words(t) for t in texts]
    joined = [" ".join(w) for w in split]
    lengths = np.array([len(j) + 1 for j in joined], dtype=np.int64)
    base = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if texts else np.zeros(0, np.int64)
    at, owner, place = index.hits(_codes("\x00".join(joined)))
    if not len(at):
        return []
    text_of, bounds = np.searchsorted(base, at, side="right") - 1, np.array(index.bounds)
    for kept_by in (regions, unbroken):
        kept = kept_by(at, owner, place, bounds, text_of)
        if not len(kept):
            return []
        at, owner, place, text_of = at[kept], owner[kept], place[kept], text_of[kept]
    # word numbers of the hits; word starts of all texts and of all items are one sorted array each
    word_at = np.concatenate([[0], np.cumsum([len(x) + 1 for w in split for x in (w or [""])])[:-1]])
    word_of_text = np.concatenate([[0], np.cumsum([max(len(w), 1) for w in split])[:-1]])
    j = np.searchsorted(word_at, at, side="right") - 1 - word_of_text[text_of]
    i = np.searchsorted(index.word_at, place + index.base[owner], side="right") - 1 - index.word_of_item[owner]
    found: set[tuple[int, int]] = set()
    low, span = int((j - i).min()), int((j - i).max() - (j - i).min()) + 1
    packed = np.unique((text_of * len(index.ids) + owner) * span + (j - i - low))
    pairs, shifts = np.divmod(packed, span)
    for t, k, d in zip((pairs // len(index.ids)).tolist(), (pairs % len(index.ids)).tolist(), (shifts + low).tolist()):
        if (t, k) not in found and aligned(split[t], index.words[k], d):
            found.add((t, k))
    return [(t, index.ids[k]) for t, k in found]


def item_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int, list[str]]]]:
    """Items as blocks of bounded size, read block by block."""
    block: list[tuple[int, list[str]]] = []
    size = 0
    for row in items.select(F.col(item_id).alias("i"), F.col(text).alias("t")).filter("t IS NOT NULL AND i IS NOT NULL").toLocalIterator():
        block.append((row.i, words(row.t)))
        size += len(row.t)
        if size >= ITEM_BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


_last_index: dict[str, ItemIndex] = {}


def _index_of(name: str, block) -> ItemIndex:
    """The index of a block of items, built once per worker process."""
    if name not in _last_index:
        _last_index.clear()
        _last_index[name] = ItemIndex(block.value)
    return _last_index[name]


def find_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", batch: int = 500) -> DataFrame:
    """(doc_id, item_id) of every document that holds a piece of an item."""
    spark = documents.sparkSession
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    out = None
    for block in item_blocks(items, item_id, text):
        shared, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def scan(frames: Iterator[pd.DataFrame], shared=shared, name=name) -> Iterator[pd.DataFrame]:
            index = _index_of(name, shared)
            for frame in frames:
                for s in range(0, len(frame), batch):
                    part = frame.iloc[s : s + batch]
                    pairs = leaks_of(part["text"].tolist(), index)
                    ids = part["doc_id"].tolist()
                    yield pd.DataFrame({"doc_id": [ids[t] for t, _ in pairs], "item_id": [i for _, i in pairs]}, dtype="int64")

        found = docs.mapInPandas(scan, "doc_id long, item_id long")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "doc_id long, item_id long")
    return out
