"""Substring dedup by repeated-phrase automata.

A window of ``window`` words recurs if its word sequence starts at two places or more.

1. Anchors: each window is represented by its least eight-word shingle, so equal windows
   have the same anchor. Windows in turn with their anchor at one place are a segment, about fifteen of them. Anchors are counted;
   the windows of those that recur are worth a look (a bitmap says so, where a false member changes nothing).
2. Confirmation: these windows are hashed and counted, each twice at most of a batch of texts. Each that occurs twice or more is
   given to one of the segments that hold it, which makes its text one of the phrases, each of them kept once, without its places.
3. Location: segments with windows that may recur are reduced to distinct ones and dealt with the phrases by anchor to shards;
   an anchor of more than ``HELD`` segments is dealt to several shards, each of which gets all its phrases.
   Each shard compiles its phrases into an Aho-Corasick automaton, a symbol a word, and streams the segments of all documents
   through it. The automaton's patterns are the phrases' pieces of half a window, one of which lies in any window; where one is
   found, the phrase is laid against the text, and as far as they agree, for a window at least, the text's windows recur.
4. What is found in a segment holds at all its places; every word under a recurring window is removed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import bitmap
from tessera.llm.common import Scratch, cut, slices, small_batches
from tessera.llm.words import Words, mix, shingles, words_of

WINDOW = 35
ANCHOR = 8
#: Segments of an anchor that one shard gets; a task holds about so many with their phrases, and as many further phrases at a time.
HELD = 1024
#: Low bits of a segment's number that are left free for the offset of a window in it; a segment has 63 windows at most.
_OFFSET = 6


def _document() -> list[Column]:
    null = F.col("doc_id").isNull()
    return [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("d"), F.xxhash64(null, F.col("text").cast("string")).alias("t"), F.col("text").cast("string").alias("text")]


def anchored(words: Words, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows within one text, the places of their anchors, and the anchors' hashes by place."""
    grams = shingles(words.hashes, anchor)
    wide = window - anchor + 1
    if len(grams) < wide:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), grams
    inside = np.zeros(len(words.hashes) + 1, np.int64)  # +1 where a text's windows begin, -1 after its last
    length = np.diff(words.first)
    fits = length >= window
    np.add.at(inside, words.first[:-1][fits], 1)
    np.add.at(inside, words.first[1:][fits] - window + 1, -1)
    start = np.flatnonzero(np.cumsum(inside))
    place = start + sliding_window_view(grams, wide)[start].argmin(1) if len(start) < 1 << 14 else _least(grams, wide, start)
    return start, place, grams


def _least(grams: np.ndarray, wide: int, start: np.ndarray) -> np.ndarray:
    """Place of the least of ``wide`` hashes from each start on, the first of equals: halves are joined by doubling."""
    best, at, span = grams.copy(), np.arange(len(grams)), 1
    while 2 * span <= wide:
        left, right = best[:-span], best[span:]
        take = right < left
        best, at, span = np.where(take, right, left), np.where(take, at[span:], at[:-span]), 2 * span
    left, right = best[start], best[start + wide - span]
    return np.where(right < left, at[start + wide - span], at[start])


def _anchors(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                start, place, grams = anchored(words_of(batch.column("text").to_pylist()), window, anchor)
                own = place[np.concatenate(([True], place[1:] != place[:-1]))] if len(place) else place
                yield pa.RecordBatch.from_arrays([pa.array(grams[own].view(np.int64))], names=["key"])

    return docs.select("text").mapInArrow(run, "key bigint")


class _Segments:
    """The windows of recurring anchors in some texts: their starts and hashes, and the segments they make."""

    def __init__(self, words: Words, recurring: bitmap.Bitmap, window: int, anchor: int) -> None:
        start, place, grams = anchored(words, window, anchor)
        keys = grams[place] if len(place) else np.zeros(0, np.uint64)
        keep = recurring.member(keys)
        self.start, place, keys = start[keep], place[keep], keys[keep]
        self.hashes = mix(shingles(words.hashes, window)[self.start] + np.uint64(window)) if len(self.start) else keys
        self.head = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(place) else np.zeros(0, np.int64)
        self.size = np.diff(np.append(self.head, len(place)))
        self.anchor = keys[self.head]
        # first and last window and their number make up a segment's words
        last = self.hashes[self.head + self.size - 1]
        self.number = mix(self.hashes[self.head] + mix(last ^ self.size.astype(np.uint64))) >> np.uint64(_OFFSET) << np.uint64(_OFFSET)
        self.owner = np.repeat(np.arange(len(self.head)), self.size)
        self.offset = np.arange(len(place)) - np.repeat(self.head, self.size)


def _windows(docs: DataFrame, recurring, window: int, anchor: int) -> DataFrame:
    """Windows of recurring anchors, each twice at most of a batch: ``key``, and ``holder``, a segment's number with the offset in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                own = _Segments(words_of(batch.column("text").to_pylist()), recurring.value, window, anchor)
                _, first, count = np.unique(own.hashes, return_index=True, return_counts=True)
                rows = np.repeat(first, np.minimum(count, 2))
                holder = own.number[own.owner[rows]] | own.offset[rows].astype(np.uint64) if len(rows) else own.number
                yield pa.RecordBatch.from_arrays([pa.array(own.hashes[rows].view(np.int64)), pa.array(holder.view(np.int64))], names=["key", "holder"])

    return docs.select("text").mapInArrow(run, "key bigint, holder bigint")


def _places(docs: DataFrame, recurring, confirmed, window: int, anchor: int) -> DataFrame:
    """Segments with a window that may recur: anchor, number, document, first word, and for the first of equal ones in a task the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for batch in slices(whole):
                words = words_of(batch.column("text").to_pylist())
                own = _Segments(words, recurring.value, window, anchor)
                kept = np.unique(own.owner[confirmed.value.member(own.hashes)])
                begin = own.start[own.head[kept]]
                doc = np.searchsorted(words.first, begin, side="right") - 1
                starts, ends, texts = words.start, words.end, []
                for number, a, n in zip(own.number[kept].tolist(), begin.tolist(), own.size[kept].tolist(), strict=True):
                    if number in seen:
                        texts.append(None)
                        continue
                    seen.add(number)
                    texts.append(b" ".join(words.data[starts[a] : ends[a + n + window - 2]].split()).decode())
                rows = pa.array(doc)
                yield pa.RecordBatch.from_arrays([pa.array(own.anchor[kept].view(np.int64)), pa.array(own.number[kept].view(np.int64)), batch.column("d").take(rows), batch.column("t").take(rows), pa.array((begin - words.first[doc]).astype(np.int32)), pa.array(texts, pa.string())], names=["anchor", "segment", "d", "t", "low", "text"])

    return docs.mapInArrow(run, "anchor bigint, segment bigint, d bigint, t bigint, low int, text string")


def _symbols(count: int) -> list[str]:
    """A symbol of two characters for each of ``count`` words; first and second ones differ, so no match begins within a symbol.

    Of about as many first ones as second ones: the automaton's nodes have few branches, which it looks through in turn.
    """
    half = math.isqrt(max(count, 1) - 1) + 1
    usable = [chr(c if c < 0xD800 else c + 0x800) for c in range(1, 2 * half + 1)]  # no surrogates
    return [usable[i // half] + usable[half + i % half] for i in range(count)]


def _runs(mask: int) -> Iterator[tuple[int, int]]:
    """First and last of each run of set bits."""
    at = 0
    while mask >> at:
        at += ((mask >> at) & -(mask >> at)).bit_length() - 1
        n = (~(mask >> at) & ((mask >> at) + 1)).bit_length() - 1
        yield at, at + n - 1
        at += n


def _agree(a: str, b: str) -> int:
    """How many characters two strings of one length begin alike with."""
    if a == b:
        return len(a)
    return next(i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y)


def locate(texts: list[list[str]], phrases: list[tuple[list[str], int]], window: int = WINDOW) -> list[int]:
    """For each text, which of its windows lie in a phrase, as bits by their first word.

    A phrase is a list of words and which windows of it are confirmed, as bits; runs of these are what is looked for.
    """
    import ahocorasick

    if not phrases:
        return [0] * len(texts)
    known: dict[str, int] = {}
    lists = {id(words): words for words in [*texts, *(words for words, _ in phrases)]}  # a text that is a phrase as well is coded once
    coded = {k: [known.setdefault(w, len(known)) for w in words] for k, words in lists.items()}
    symbols = _symbols(len(known))
    width, piece = 2, (window + 1) // 2
    strings = {k: "".join([symbols[c] for c in codes]) for k, codes in coded.items()}
    wide, step = window * width, piece * width
    pieces: dict[str, list[tuple[str, int]]] = {}
    for words, mask in phrases:
        string = strings[id(words)]
        for first, last in _runs(mask):
            run = string[first * width : last * width + wide]
            for at in range(0, len(run) - step + 1, step):
                pieces.setdefault(run[at : at + step], []).append((run, at))
    automaton = ahocorasick.Automaton()
    for text, own in pieces.items():
        automaton.add_word(text, own)
    automaton.make_automaton()
    found = []
    for words in texts:
        string, bits = strings[id(words)], 0
        for last, own in automaton.iter(string) if len(string) >= wide else ():
            begin = last + 1 - step
            low, high = max(0, begin + step - wide) // width, min(begin, len(string) - wide) // width
            around = (1 << (high + 1)) - (1 << low)  # the windows that hold the piece
            for run, at in own:
                if bits & around == around:
                    break
                back = min(begin, at)
                left = _agree(string[begin - back : begin][::-1], run[at - back : at][::-1]) // width * width
                ahead = min(len(string) - begin, len(run) - at)
                right = _agree(string[begin : begin + ahead], run[at : at + ahead]) // width * width
                if (windows := (left + right - wide) // width + 1) > 0:
                    bits |= ((1 << windows) - 1) << ((begin - left) // width)
        found.append(bits)
    return found


def _located(window: int):
    """Shards, sorted, those to be searched first: a row for each segment searched in which windows recur."""

    def search(rows: list[tuple]) -> pa.RecordBatch:
        own = [(searched, number, text.split(" "), mask) for _, searched, number, text, mask in rows]
        texts = [(number, words) for searched, number, words, _ in own if searched]
        phrases = [(words, mask) for _, _, words, mask in own if mask]
        bits = locate([words for _, words in texts], phrases, window)
        out = [(number, b) for (number, _), b in zip(texts, bits, strict=True) if b]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["segment", "mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        new = 0  # of those held, rows that no automaton had yet
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in ("anchor", "salt", "searched", "segment", "text", "mask")]
            for anchor, salt, *row in zip(*columns, strict=True):
                shard = (anchor, salt)
                other = bool(held) and held[-1][0] != shard
                if other and len(held) >= HELD or not row[0] and new >= HELD:
                    yield search(held)
                    # segments of this shard stay for its further phrases
                    held, new = [(*x[:4], None) for x in held if x[1] and x[0] == shard], 0
                held.append((shard, *row))
                new += 1
        if held:
            yield search(held)

    return run


def recurring_windows(docs: DataFrame, scratch: Scratch, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """d, t and ``marks``, runs (low, mask) of recurring windows, for each document that has any."""
    if window - anchor >= 1 << _OFFSET:
        raise ValueError("a window may have 63 shingles at most")
    spark = docs.sparkSession
    own = docs.select(*_document()).where("text IS NOT NULL")
    counted = scratch.cut(_anchors(own, window, anchor).groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "anchors")
    recurring = spark.sparkContext.broadcast(bitmap.build(counted))
    scratch.drop(counted)
    confirmed = scratch.cut(_windows(own, recurring, window, anchor).groupBy("key").agg(F.count("*").alias("n"), F.min("holder").alias("holder")).where("n > 1").select("key", "holder"), "confirmed")
    known = spark.sparkContext.broadcast(bitmap.build(confirmed))
    places = scratch.cut(_places(own, recurring, known, window, anchor), "places")
    low = (1 << _OFFSET) - 1
    number, offset = F.col("holder").bitwiseAND(F.lit(~low)), F.col("holder").bitwiseAND(F.lit(low)).cast("int")
    phrases = confirmed.groupBy(number.alias("segment")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), offset)).alias("mask"))
    segments = scratch.cut(places.where("text IS NOT NULL").select("segment", "anchor", "text").dropDuplicates(["segment"]).join(phrases, "segment", "left"), "segments")
    scratch.drop(confirmed)
    # written first, so that Spark knows its size when it chooses how to join: usually it is small, and the segments stay where they are
    many = scratch.cut(segments.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > HELD).select("anchor", F.ceil(F.col("n") / HELD).cast("int").alias("shards")), "many")
    dealt = segments.join(many, "anchor", "left").withColumn("shards", F.coalesce("shards", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("segment"), "shards"))
    every = F.when(F.col("mask").isNull(), F.array("own")).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("shards").cast("bigint") - 1))
    dealt = dealt.withColumn("salt", F.explode(every)).select("anchor", "salt", (F.col("salt") == F.col("own")).alias("searched"), "segment", "text", "mask")
    shards = dealt.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", F.desc("searched"))
    found = scratch.cut(shards.mapInArrow(_located(window), "segment bigint, mask bigint").groupBy("segment").agg(F.bit_or("mask").alias("mask")), "found")
    scratch.drop(segments)
    return places.select("segment", "d", "t", "low").join(found, "segment").groupBy("d", "t").agg(F.collect_list(F.struct("low", "mask")).alias("marks"))


def _removed(words: Words, marks: pa.ListArray, window: int) -> np.ndarray:
    """Which of the words of all texts lie under the marked windows."""
    lists = marks.offsets.to_numpy().astype(np.int64)
    flat = marks.flatten()
    owner = np.repeat(np.arange(len(marks)), np.diff(lists))
    low, mask = (flat.field(k).to_numpy() for k in ("low", "mask"))
    depth = np.zeros(len(words.hashes) + 1, np.int64)
    for bit in range(1 << _OFFSET):
        at = (mask >> bit & 1).astype(bool)
        start = words.first[owner[at]] + low[at] + bit
        np.add.at(depth, start, 1)
        np.add.at(depth, start + window, -1)
    return np.cumsum(depth[:-1]) > 0


def dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, and kept_text (words joined by one space) for every document.

    All copies of a recurring window go, the first too, so ties don't matter. A null or empty text has no words.
    Very long texts are taken whole, in segments of some dozen words. Repeated rows are separate documents, so their windows recur. A null doc_id is a document.
    An empty table gives no rows; extra columns are ignored, whatever they are called.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                texts = batch.column("text").to_pylist()
                words = words_of(texts)
                gone = _removed(words, batch.column("marks"), window)
                first = words.first.tolist()
                count, left = [], []
                for text, a, b in zip(texts, first[:-1], first[1:], strict=True):
                    own = (text or "").encode().split()
                    hit = gone[a:b]
                    count.append(int(hit.sum()))
                    left.append(b" ".join([own[i] for i in np.flatnonzero(~hit).tolist()] if count[-1] else own).decode())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(words.first)), pa.array(count, pa.int64()), pa.array(left, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    with Scratch(docs.sparkSession) as scratch:
        marks = cut(recurring_windows(docs, scratch, window, anchor), "marks")
    joined = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *_document()).join(marks, ["d", "t"], "left").select("doc_id", "text", "marks")
    return joined.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


#: The same in DuckDB, for unlike ids.
DIGEST_SQL = r"""
WITH doc AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), win AS (
  SELECT doc_id, s, md5(array_to_string(words[s + 1 : s + 35], ' ')) AS h FROM (SELECT doc_id, words, unnest(range(len(words) - 34)) AS s FROM doc WHERE len(words) >= 35)
), again AS (
  SELECT h FROM win GROUP BY h HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, s + i AS i FROM (SELECT doc_id, s FROM win WHERE h IN (SELECT h FROM again)), (SELECT unnest(range(35)) AS i)
), word AS (
  SELECT doc_id, unnest(range(len(words))) AS i, unnest(words) AS word FROM doc
), kept AS (
  SELECT w.doc_id, count(g.i) AS n_removed, string_agg(w.word, ' ' ORDER BY w.i) FILTER (g.i IS NULL) AS text FROM word w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.i = g.i GROUP BY w.doc_id
)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM doc d LEFT JOIN kept k USING (doc_id)
"""
