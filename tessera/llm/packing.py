"""Best-fit packing of tokenised documents into sequences of fixed capacity.

A document is its token ids and an end id. One longer than the capacity is cut: the
first piece takes the remainder, the rest are full. The packing itself needs only how
many pieces of each length there are, so it is planned on that histogram (at most
``capacity`` rows, whatever the corpus): pieces over a third of the capacity are
matched greedily, the longest with the longest partner that fits and at most two of
them in a sequence; shorter pieces then go, longest first, into the tightest gap that
takes them. The plan is a short list of runs "so many sequences of this make-up"; a
piece finds its place from its length and its rank among the pieces of that length.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import cut, slices, small_batches

CAPACITY = 1024
END_ID = 2
VOCABULARY = "byte_bpe_50k.json"
#: A chunk ends where white space follows other text. The tokenizer's own pattern always parts there, so chunks can be encoded one by one and remembered. \x1c-\x1f are no white space to it.
_CHUNK = r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+"
#: Chunks remembered by one Python worker, some 130 MB; further ones are encoded whenever they come.
REMEMBERED = 700_000


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: a visible Latin-1 character stands for itself, the other bytes for 256 and on, in order."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Chunks(dict):
    """Chunk to its ids as bytes; a chunk not yet known is encoded and, while there is room, kept."""

    def __init__(self, path: str, room: int) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.room, self.tokenizer = room, Tokenizer.from_file(path)
        self.merge, self.letters = self.tokenizer.model.tokenize, _byte_letters()

    def __missing__(self, chunk: str) -> bytes:
        word = chunk.rstrip(".,!?;:")
        if word[word[:1] == " " :].isalpha():
            if len(word) < len(chunk):  # the tokenizer parts a word from the marks after it
                return self[word] + self[chunk[len(word) :]]
            # one space and letters are never parted, so the merges apply at once
            ids = [x.id for x in self.merge(chunk.encode().decode("latin-1").translate(self.letters))]
        else:
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        found = pack_ids(f"<{len(ids)}I", *ids)
        if len(self) < self.room:
            self[chunk] = found
        return found


class _Encoder:
    """Texts to little-endian unsigned 32-bit ids, by the tokenizer, chunk by chunk; its added tokens are taken out first, as it does itself."""

    def __init__(self, path: str, room: int) -> None:
        import re

        self.chunks, self.known = re.compile(_CHUNK).findall, _Chunks(path, room)
        added = self.known.tokenizer.get_added_tokens_decoder()
        self.added = {x.content: pack_ids("<I", i) for i, x in added.items()}
        # tokens that take white space with them, or only stand alone, leave no chunks to be encoded one by one
        self.whole = any(x.lstrip or x.rstrip or x.single_word or x.normalized for x in added.values())
        self.parts = re.compile(f"({'|'.join(map(re.escape, sorted(self.added, key=len, reverse=True)))})").split if added else None

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.chunks(text)))

    def _ids(self, text: str) -> bytes:
        if self.whole:
            ids = self.known.tokenizer.encode(text, add_special_tokens=False).ids
            return pack_ids(f"<{len(ids)}I", *ids)
        if self.parts is None or not any(x in text for x in self.added):
            return self._plain(text)
        return b"".join(self.added[x] if i % 2 else self._plain(x) for i, x in enumerate(self.parts(text)))

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self._ids(text) for text in texts]


_encoders: dict[tuple[str, int], _Encoder] = {}  # of a Python worker, which Spark uses again for later tasks


def encoder(path: str, room: int = REMEMBERED) -> _Encoder:
    return _encoders.get((path, room)) or _encoders.setdefault((path, room), _Encoder(path, room))


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, rank bigint"


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, remembered: int = REMEMBERED) -> DataFrame:
    """Tokenise and cut every document: one row per piece, with its rank among the task's pieces of its length.

    The ranks hold only for the run that made them, so write the result before using it.
    """
    small_batches(docs.sparkSession)
    path = vocabulary or vocabulary_path()
    end = np.asarray([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, seen = encoder(path, remembered).encode, {}
        for whole in batches:
            for batch in slices(whole):
                out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "part", "rank")}
                texts = [x or "" for x in batch.column("text").to_pylist()]
                for doc, part, ids in zip(batch.column("doc_id").to_pylist(), batch.column("part").to_pylist(), ids_of(texts), strict=True):
                    ids += end
                    n, start, k = len(ids) // 4, 0, 0
                    length = n % capacity or capacity
                    while start < n:
                        rank = seen.get(length, 0)
                        seen[length] = rank + 1
                        out["doc_id"].append(doc)
                        out["piece"].append(k)
                        out["start"].append(start)
                        out["length"].append(length)
                        out["ids_crc32"].append(zlib.crc32(ids[4 * start : 4 * (start + length)]))
                        out["part"].append(part)
                        out["rank"].append(rank)
                        start, k, length = start + length, k + 1, capacity
                yield pa.RecordBatch.from_pydict(out, pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("rank", pa.int64())]))

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.spark_partition_id().alias("part")).mapInArrow(run, _PIECES)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Plan the packing of ``histogram[length]`` pieces of each length.

    Returns runs (length, first rank, count, first sequence, offset) and the number of sequences:
    pieces of that length with ranks from first rank on go, one each, to successive sequences at that offset.
    """
    left = {n: count for n, count in histogram.items() if count > 0}
    used = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    total = 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # room left -> runs of sequences (first, count)
    rooms: list[int] = []  # the keys of gaps, sorted

    def place(length: int, count: int, sequence: int, offset: int) -> None:
        runs.append((length, used[length], count, sequence, offset))
        used[length] += count
        left[length] -= count

    def leave(room: int, first: int, count: int) -> None:
        if room:
            if room not in gaps:
                gaps[room] = []
                insort(rooms, room)
            gaps[room].append((first, count))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        if not left[n]:
            large.pop()
            continue
        at = bisect_left(large, capacity - n + 1) - 1
        while at >= 0 and (not left[large[at]] or (large[at] == n and left[n] < 2)):
            if not left[large[at]]:
                large.pop(at)
            at -= 1
        if at < 0:
            count = left[n]
            place(n, count, total, 0)
            leave(capacity - n, total, count)
        else:
            other = large[at]
            count = left[n] // 2 if other == n else min(left[n], left[other])
            place(n, count, total, 0)
            place(other, count, total, n)
            leave(capacity - n - other, total, count)
        total += count

    small = [-n for n in left if 3 * n <= capacity]
    heapq.heapify(small)
    while small:
        n = -heapq.heappop(small)
        while left[n]:
            at = bisect_left(rooms, n)
            if at == len(rooms):  # as many new sequences as these pieces fill
                count = -(-left[n] // (capacity // n))
                leave(capacity, total, count)
                total += count
                continue
            room = rooms[at]
            first, count = gaps[room].pop()
            if not gaps[room]:
                del gaps[room]
                rooms.pop(at)
            take = min(count, left[n])
            place(n, take, first, capacity - room)
            if take < count:
                leave(room, first + take, count - take)
            leave(room - n, first, take)
    return runs, total


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, remembered: int = REMEMBERED) -> DataFrame:
    """Pack all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty, and an empty document is its end id alone. A very long text is encoded whole and cut into
    pieces of the capacity, the first one shorter. Repeated rows are
    packed as often as they occur; pieces of one length are interchangeable, so ties go by partition and place in it. A null doc_id is kept. An empty table gives no rows.
    Extra columns are ignored, whatever they are called. Pieces are written to the shared folder, so the tokeniser
    runs once. Sequences are gapless from offset 0. A worker remembers the ids of ``remembered`` chunks, which a later job finds in it still;
    fewer cost time and change nothing.
    """
    made = cut(pieces(docs, capacity, vocabulary, remembered), "pieces")
    by_task = made.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_task = by_task.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # one row for each length: bounded by the capacity, not by the corpus
    counts = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, _ = plan(counts, capacity)
    by_length: dict[int, np.ndarray] = {}
    for length in counts:
        by_length[length] = np.asarray([r[1:] for r in runs if r[0] == length], np.int64)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                own, rows = by_length[int(n)], np.flatnonzero(length == n)
                at = np.searchsorted(own[:, 0], rank[rows], side="right") - 1
                sequence[rows] = own[at, 2] + rank[rows] - own[at, 0]
                offset[rows] = own[at, 3]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = made.join(by_task.select("length", "part", "before"), ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(locate, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
