"""Benchmark decontamination by SimHash of item-sized windows.

A window is as many consecutive words of a document as a benchmark item has (a shorter
document is one window). Window and item are alike by their weighted shingles: five-word
shingles with their multiplicities, least counts over greatest counts. That is at least 0.8
only if all but a ninth of the shingles agree, in whatever order, so the windows that are
fingerprinted are all those that hold that many of the item's shingles.
Fingerprints are 64-bit SimHashes. Those of the items are indexed by blocks of bits, one
more block than the radius, so an item within the radius shares at least one block with
the window; what is within the radius is compared exactly. At a likeness of 0.8 the mean
distance is 10 bits with a deviation of 3, so the radius of 24 lies five deviations off.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ddl, slices, small_batches, unused
from tessera.llm.words import shingles, words_of

SHINGLE = 5
LEAST = 0.8
RADIUS = 24
#: Characters of benchmark texts that are sent to the tasks at a time; a larger benchmark takes several passes over the documents.
BLOCK_CHARS = 16_000_000
#: Bytes of text that ``clean`` takes at a time; the arrays of its words and shingles take many times as much.
CLEAN_BYTES = 1 << 20
#: Windows that are fingerprinted at a time, or as many as an item has words.
WINDOWS = 4096
_BITS = np.arange(64, dtype=np.uint64)


def _shingled(hashes: np.ndarray) -> np.ndarray:
    """Shingles of a text; a shorter text's whole sequence is its one shingle."""
    return shingles(hashes, min(SHINGLE, len(hashes))) if len(hashes) else np.zeros(0, np.uint64)


def _signs(of: np.ndarray) -> np.ndarray:
    return ((of[:, None] >> _BITS) & np.uint64(1)).astype(np.int32) * 2 - 1


def _fingerprint(sums: np.ndarray) -> np.ndarray:
    return ((sums > 0).astype(np.uint64) << _BITS).sum(-1, dtype=np.uint64)


def simhash(shingles_of: np.ndarray) -> int:
    return int(_fingerprint(_signs(shingles_of).sum(0)))


def weighted_jaccard(a: Counter, b: Counter) -> float:
    same = sum((a & b).values())
    return same / max(sum(a.values()) + sum(b.values()) - same, 1)


class Index:
    """Items' shingles, fingerprints, and the blocks of these for each length of item."""

    def __init__(self, items: list[tuple[int, str]], least: float = LEAST, radius: int = RADIUS) -> None:
        self.least, self.radius = least, radius
        words = words_of([t for _, t in items], lower=True)
        self.ids, self.sizes, self.sets, prints = [], [], [], []
        keys, owner = [], []
        for i, (item_id, _) in enumerate(items):
            own = words.hashes[words.first[i] : words.first[i + 1]]
            if not len(own):
                continue
            parts = _shingled(own)
            keys.append(parts)
            owner.append(np.full(len(parts), len(self.ids)))
            self.ids.append(item_id)
            self.sizes.append(len(own))
            self.sets.append(Counter(parts.tolist()))
            prints.append(simhash(parts))
        self.prints = np.asarray(prints, np.uint64)
        keys, owner = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, owner))
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner = keys[order].astype(np.uint64), owner[order].astype(np.int64)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.keys >> np.uint64(42)).astype(np.int64)] = True
        self.shortest = min(self.sizes, default=0)
        self.by_size = {n: np.asarray([i for i, m in enumerate(self.sizes) if m == n]) for n in set(self.sizes)}
        edges = np.linspace(0, 64, radius + 2).astype(int)
        self.blocks = [(np.uint64(a), np.uint64((1 << (b - a)) - 1)) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        self.tables = {}
        for n, own in self.by_size.items():
            tables = []
            for shift, mask in self.blocks:
                table = np.zeros((int(mask) + 1, len(own)), bool)
                table[((self.prints[own] >> shift) & mask).astype(np.int64), np.arange(len(own))] = True
                tables.append(table)
            self.tables[n] = tables

    def within(self, prints: np.ndarray, n: int) -> list[tuple[int, int]]:
        """(window, item) pairs of items of n words whose fingerprints are within the radius."""
        own = self.by_size[n]
        near = np.zeros((len(prints), len(own)), bool)
        for (shift, mask), table in zip(self.blocks, self.tables[n], strict=True):
            near |= table[((prints >> shift) & mask).astype(np.int64)]
        window, item = np.nonzero(near)
        fine = np.bitwise_count(prints[window] ^ self.prints[own[item]]) <= self.radius
        return list(zip(window[fine].tolist(), own[item[fine]].tolist(), strict=True))

    def hits(self, hashes: np.ndarray) -> list[tuple[int, int, float]]:
        """(item_id, start word, likeness) of the most alike window for each item that a document's words hold; the first of equals."""
        found: dict[int, tuple[float, int]] = {}
        for size in sorted({min(SHINGLE, n) for n in self.by_size}):
            every = shingles(hashes, size) if len(hashes) >= size else np.zeros(0, np.uint64)
            rows = np.flatnonzero(self.maybe[(every >> np.uint64(42)).astype(np.int64)])
            if not len(rows):
                continue
            low, high = (np.searchsorted(self.keys, every[rows], side) for side in ("left", "right"))
            shared: dict[int, list[int]] = {}
            for at, a, b in zip(rows.tolist(), low.tolist(), high.tolist(), strict=True):
                for k in range(a, b):
                    item = int(self.owner[k])
                    if min(SHINGLE, self.sizes[item]) == size:
                        own = shared.setdefault(item, [])
                        if not own or own[-1] != at:  # the item may have the shingle more than once
                            own.append(at)
            for item, places in shared.items():
                self._item(item, hashes, every, places, found)
        return sorted((self.ids[i], start, like) for i, (like, start) in found.items())

    def _item(self, item: int, hashes: np.ndarray, every: np.ndarray, places: list[int], found: dict) -> None:
        n = self.sizes[item]
        span = min(n, len(hashes))
        count = span - min(SHINGLE, n) + 1
        most = sum(self.sets[item].values())
        need = max(math.ceil(self.least * (count + most) / (1 + self.least) - 1e-9), 1)  # shingles that must agree
        if len(places) < need:  # too few shared shingles in the whole document
            return
        at = np.asarray(places)
        # starts whose window holds the need shared shingles from the i-th on
        low, high = np.maximum(at[need - 1 :] - (count - 1), 0), np.minimum(at[: len(at) - need + 1], len(hashes) - span)
        fits = low <= high
        low, high = low[fits], high[fits]
        parted = np.flatnonzero(low[1:] > high[:-1] + 1) + 1
        step = max(WINDOWS, count)
        for one in np.split(np.arange(len(low)), parted) if len(low) else ():
            end = int(high[one[-1]]) + 1
            for begin in range(int(low[one[0]]), end, step):
                self._windows(n, count, begin, min(begin + step, end), every, found)

    def _windows(self, n: int, count: int, begin: int, end: int, every: np.ndarray, found: dict) -> None:
        """Compare the windows that start from begin to before end with the items of n words."""
        signs = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(_signs(every[begin : end - 1 + count]), 0, dtype=np.int32)))
        prints = _fingerprint(signs[count:] - signs[:-count])
        for window, other in self.within(prints, n):
            start = begin + window
            like = weighted_jaccard(Counter(every[start : start + count].tolist()), self.sets[other])
            if like >= self.least and (other not in found or (-like, start) < (-found[other][0], found[other][1])):
                found[other] = (like, start)


def _indexes(benchmark: DataFrame, least: float, radius: int) -> Iterator[Index]:
    """The benchmark in blocks of about BLOCK_CHARS, each small enough for driver and tasks; usually one."""
    own = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    size = own.agg(F.sum(F.char_length("text"))).first()[0] or 0
    blocks = size // BLOCK_CHARS + 1
    for k in range(blocks):
        block = own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else own
        yield Index(sorted(map(tuple, block.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1])), least, radius)


def matches(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, start_word and similarity of every document and benchmark item that it holds.

    One row for each pair, with the most alike window, the first of equals. Null and empty
    documents and items match nothing. Very long documents are searched whole, some thousand windows at a time. Repeated rows each
    give theirs, as do items with the same text. Empty tables give no rows; extra columns are ignored, whatever they are called. A-Z count as a-z.
    """
    small_batches(docs.sparkSession)
    found = None
    for index in _indexes(benchmark, least, radius):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole):
                    words = words_of(batch.column("text").to_pylist(), lower=True)
                    out: list[tuple] = []
                    for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                        out += [(doc, *hit) for hit in index.hits(words.hashes[words.first[i] : words.first[i + 1]])]
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["doc_id", "item_id", "start_word", "similarity"])

        part = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, item_id bigint, start_word bigint, similarity double")
        found = part if found is None else found.unionByName(part)
    return found


def clean(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, radius: int = RADIUS) -> DataFrame:
    """The rows of docs that hold no benchmark item, with their columns as they are, whatever they are called.

    Null and empty texts hold none and stay; an empty benchmark or table changes nothing; repeated rows stay or go together.
    """
    small_batches(docs.sparkSession)
    names = docs.columns
    text_name = unused(docs, "_text")
    for index in _indexes(benchmark, least, radius):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole, text_name, CLEAN_BYTES):
                    words = words_of(batch.column(text_name).to_pylist(), lower=True)
                    kept = [not index.hits(words.hashes[words.first[i] : words.first[i + 1]]) for i in range(batch.num_rows)]
                    yield batch.select(names).filter(pa.array(kept, pa.bool_()))

        docs = docs.select("*", F.col("text").cast("string").alias(text_name)).mapInArrow(run, ddl(docs))
    return docs


#: The matches in DuckDB, for items and documents of five words or more with unlike ids: all windows of every pair that shares a shingle.
MATCHES_SQL = r"""
WITH doc AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL
), item AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL
), doc_shingle AS (
  SELECT doc_id, i, array_to_string(w[i + 1 : i + 5], ' ') AS s FROM (SELECT doc_id, w, unnest(range(len(w) - 4)) AS i FROM doc WHERE len(w) >= 5)
), item_shingle AS (
  SELECT item_id, s, count(*) AS n FROM (SELECT item_id, array_to_string(w[i + 1 : i + 5], ' ') AS s FROM (SELECT item_id, w, unnest(range(len(w) - 4)) AS i FROM item WHERE len(w) >= 5)) GROUP BY ALL
), pair AS (
  SELECT DISTINCT doc_id, item_id FROM doc_shingle JOIN item_shingle USING (s)
), win AS (
  SELECT doc_id, item_id, least(len(d.w), len(i.w)) AS span, len(i.w) - 4 AS whole, unnest(range(len(d.w) - least(len(d.w), len(i.w)) + 1)) AS start_word FROM pair JOIN doc d USING (doc_id) JOIN item i USING (item_id)
), held AS (
  SELECT win.doc_id, win.item_id, start_word, span, whole, s, count(*) AS n FROM win JOIN doc_shingle d ON d.doc_id = win.doc_id AND d.i BETWEEN start_word AND start_word + span - 5 GROUP BY ALL
), likeness AS (
  SELECT doc_id, item_id, start_word, sum(least(h.n, i.n))::DOUBLE / (any_value(span) - 4 + any_value(whole) - sum(least(h.n, i.n))) AS similarity FROM held h JOIN item_shingle i USING (item_id, s) GROUP BY doc_id, item_id, start_word
)
SELECT doc_id, item_id, start_word, similarity FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start_word) AS place FROM likeness) WHERE place = 1 AND similarity >= 0.8
"""
