"""Periodic runs of words, found by string synchronising sets.

A run is a stretch of words with smallest period q that is at least twice q long and that
no neighbouring word extends. At scale t, a power of two, a position is chosen if the least
hash of the t-word windows that start in the t + 1 places from it on is that of the first or
of the last of them; windows of a period of t / 3 or less don't count. Whether a position is
chosen depends on the 2 t words from it on alone, so equal contexts are chosen alike: in a
run of a period from 3 t - 1 to 6 t - 2, some chosen position and the one a period later
have equal contexts, and their distance proposes the period. What the scales leave out:

- periods under the first scale's are read off directly, word against word;
- a run whose every period is itself of a small period p has no chosen position. It lies over
  two runs of period p that meet, and its periods follow from their phases.

Proposals are extended by hashes of prefixes in both directions, then compared word by word.
Hashes that differ prove that words differ and equal words have equal hashes, so no run is
missed and none is wrong, whatever collides. All texts of a slice are worked on at once, the
longest first, so that a scale works on those only that are long enough for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices, small_batches
from tessera.llm.words import mix, words_of

#: A run has so many words at least.
LEAST = 12
#: Words of the first scale's windows; periods of less than 3 * 4 - 1 words are read off directly.
FIRST_SCALE = 4
WORD = r"[^\x20\x09-\x0D]+"
_PRIMES = (np.int64(2147483647), np.int64(2147483629))
_BASES = (np.int64(1213836577), np.int64(794320417))
_powers = [np.ones(1, np.int64), np.ones(1, np.int64)]


def _power(n: int) -> list[np.ndarray]:
    """Powers of both bases from 0 to n at least."""
    for k, (base, prime) in enumerate(zip(_BASES, _PRIMES, strict=True)):
        while len(_powers[k]) <= n:
            have = _powers[k]
            _powers[k] = np.concatenate((have, have * (have[-1] * base % prime) % prime))
    return _powers


class Text:
    """Numbered words with hashes of all prefixes; windows of equal words have equal hashes."""

    def __init__(self, words: np.ndarray) -> None:
        self.words, self.n = words, len(words)
        values = mix(words.astype(np.uint64) + np.uint64(1))
        self.powers = _power(self.n)
        self.sums = []
        for k, prime in enumerate(_PRIMES):
            terms = (values >> np.uint64(32 * k)).astype(np.int64) % prime * self.powers[k][: self.n] % prime
            self.sums.append(np.concatenate((np.zeros(1, np.int64), np.cumsum(terms) % prime)))

    def names(self, n: int, size: int) -> np.ndarray:
        """A name of the words in each window of one size within the first n words; unlike windows seldom have the same."""
        part = (self.sums[0][size : n + 1] - self.sums[0][: n + 1 - size] + _PRIMES[0]) * self.powers[0][self.n - n + size : self.n + 1][::-1]
        for _ in range(2):  # the remainder by a Mersenne prime
            part = (part & _PRIMES[0]) + (part >> 31)
        part[part == _PRIMES[0]] = 0
        return mix(part.astype(np.uint64))

    def windows(self, starts: np.ndarray, size: int) -> np.ndarray:
        """A 64-bit name of the words in each window of one size."""
        out = np.zeros(len(starts), np.uint64)
        for k, prime in enumerate(_PRIMES):
            part = (self.sums[k][starts + size] - self.sums[k][starts]) % prime * self.powers[k][self.n - starts] % prime
            out ^= mix(part.astype(np.uint64) + np.uint64(k << 40))
        return out

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the words from a and from b on, a before b, have equal hashes for size words."""
        same = np.ones(len(a), bool)
        for k, prime in enumerate(_PRIMES):
            left = (self.sums[k][a + size] - self.sums[k][a]) % prime * self.powers[k][b - a] % prime
            same &= left == (self.sums[k][b + size] - self.sums[k][b]) % prime
        return same

    def shared(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """Words that the texts from a and from b on share, or with back those that end before a and b; up to most."""
        low, high = np.zeros(len(a), np.int64), most.copy()
        while (open_ := low < high).any():
            middle = np.where(open_, (low + high + 1) // 2, low)
            fits = self.equal(a - middle, b - middle, middle) if back else self.equal(a, b, middle)
            low, high = np.where(fits, middle, low), np.where(fits | ~open_, high, middle - 1)
        return low


def _least_within(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each width consecutive values."""
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[: len(values) - (width - have)], values[width - have :]) if have < width else values


class Finder:
    """Runs (start, end, period) of texts that stand one after another, each with a word of its own behind it."""

    def __init__(self, text: Text, begins: np.ndarray, ends: np.ndarray) -> None:
        self.text, self.begins, self.ends = text, begins, ends
        self.runs = np.zeros((0, 3), np.int64)

    def add(self, found: np.ndarray) -> np.ndarray:
        """Take new runs in; of equal stretches the one of the smallest period stays. Returns those that are new."""
        every = np.concatenate((self.runs, found))
        every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
        first = np.ones(len(every), bool)
        first[1:] = (every[1:, :2] != every[:-1, :2]).any(1)
        before, self.runs = self.runs, every[first]
        return self.runs[~np.isin(self.runs[:, 0] * (self.text.n + 1) + self.runs[:, 1], before[:, 0] * (self.text.n + 1) + before[:, 1])]

    def small(self) -> None:
        """Runs of periods that no scale proposes, word against word."""
        words, found = self.text.words, []
        for q in range(1, 3 * FIRST_SCALE - 1):
            if len(words) <= q:
                break
            edge = np.diff(np.concatenate(([0], (words[q:] == words[:-q]).view(np.int8), [0])))
            start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + q
            long = end - start >= max(2 * q, FIRST_SCALE)
            found.append(np.stack((start[long], end[long], np.full(long.sum(), q)), 1))
        self.add(np.concatenate(found)) if found else None

    def scale(self, t: int, n: int) -> None:
        """Runs of periods from 3 t - 1 to 6 t - 2 within the first n words."""
        if n < 2 * t:
            return
        names = self.text.names(n, t)
        none = np.uint64(0xFFFFFFFFFFFFFFFF)
        names[names == none] = none - np.uint64(1)
        own = self.runs[(3 * self.runs[:, 2] <= t) & (self.runs[:, 1] - self.runs[:, 0] >= t) & (self.runs[:, 0] < n - t + 1)]
        if len(own):
            marks = np.zeros(n - t + 2, np.int64)
            np.add.at(marks, own[:, 0], 1)
            np.add.at(marks, np.minimum(own[:, 1] - t + 1, n - t + 1), -1)
            names[np.cumsum(marks[:-1]) > 0] = none
        least = _least_within(names, t + 1)
        chosen = np.flatnonzero((least != none) & ((least == names[: len(least)]) | (least == names[t : t + len(least)])))
        contexts = self.text.windows(chosen, 2 * t)
        pairs = []
        for d in range(1, len(chosen)):
            gap = chosen[d:] - chosen[:-d]
            if not (gap <= 6 * t - 2).any():
                break
            fits = (gap <= 6 * t - 2) & (gap >= 3 * t - 1) & (contexts[d:] == contexts[:-d])
            pairs.append(np.stack((chosen[:-d][fits], gap[fits]), 1))
        new = self.extend(np.concatenate(pairs)) if pairs else self.runs[:0]
        while len(new):
            new = self.extend(self.meeting(new))

    def extend(self, pairs: np.ndarray) -> np.ndarray:
        """Add the runs around pairs (place, period) of equal words a period apart; returns those that are new."""
        if not len(pairs):
            return self.runs[:0]
        at, q = pairs[np.lexsort((pairs[:, 0], pairs[:, 1]))].T
        if len(at) > 1:  # proposals within one stretch are one
            again = np.zeros(len(at), bool)
            again[1:] = (q[1:] == q[:-1]) & self.text.equal(at[:-1], at[:-1] + q[:-1], np.where(q[1:] == q[:-1], np.minimum(at[1:] - at[:-1], self.text.n - at[:-1] - q[:-1]), 0))
            at, q = at[~again], q[~again]
        own = np.searchsorted(self.begins, at, "right") - 1
        fits = at + q < self.ends[own]
        at, q, own = at[fits], q[fits], own[fits]
        left = self.text.shared(at, at + q, at - self.begins[own], back=True)
        right = self.text.shared(at, at + q, self.ends[own] - at - q)
        found = np.stack((at - left, at + q + right, q), 1)
        words, out = self.text.words, []
        for (s, e, p), place, k in zip(found.tolist(), at.tolist(), own.tolist(), strict=True):
            if e - s < 2 * p:
                continue
            if not np.array_equal(words[s : e - p], words[s + p : e]):  # hashes were equal and words are not
                a, b = int(self.begins[k]), int(self.ends[k])
                unlike = np.flatnonzero(words[a : b - p] != words[a + p : b]) + a
                cut = np.searchsorted(unlike, place)
                s = int(unlike[cut - 1]) + 1 if cut else a
                e = (int(unlike[cut]) if cut < len(unlike) else b - p) + p
                if e - s < 2 * p:
                    continue
            out.append((s, e, p))
        return self.add(np.asarray(out, np.int64).reshape(-1, 3))

    def meeting(self, new: np.ndarray) -> np.ndarray:
        """Pairs (place, period) of runs that lie over two runs of one small period that meet, at least one of them new."""
        fresh = {tuple(x) for x in new.tolist()}
        runs = self.runs[np.lexsort((self.runs[:, 0], self.runs[:, 2]))]
        meet = np.flatnonzero((runs[1:, 2] == runs[:-1, 2]) & (runs[1:, 0] <= runs[:-1, 1]))
        out = []
        for one, two in zip(runs[meet].tolist(), runs[meet + 1].tolist(), strict=True):
            p, least = one[2], max(3 * FIRST_SCALE - 1, 9 * one[2] - 1)
            most = min(one[1] - one[0], two[1] - two[0])
            if most < least or not (tuple(one) in fresh or tuple(two) in fresh):
                continue
            same = np.flatnonzero(self.text.windows(np.arange(one[0], one[0] + p), p) == self.text.windows(np.asarray([two[0]]), p))
            if len(same):
                q = np.arange(least + (two[0] - one[0] - int(same[0]) - least) % p, most + 1, p)
                out.append(np.stack((np.maximum(one[0], two[0] - q), q), 1))
        return np.concatenate(out) if out else self.runs[:0, :2]


def runs_of(words: np.ndarray, first: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(text, start, length, period) of every run of least words or more; text i has the numbered words first[i] to first[i + 1].

    Sorted by text, start and period. Words are equal if their numbers are.
    """
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] >= max(least, 2)]
    if not len(order):
        return np.zeros((0, 4), np.int64)
    own = sizes[order]
    begins = np.concatenate(([0], np.cumsum(own + 1)[:-1]))
    ends = begins + own
    source = np.arange(ends[-1] + 1) + np.repeat(first[:-1][order] - begins, own + 1)
    joined = words.astype(np.int64)[np.minimum(source, len(words) - 1)]
    joined[ends] = int(words.max()) + 1 + np.arange(len(order))
    finder = Finder(Text(joined), begins, ends)
    finder.small()
    new = finder.runs
    while len(new):
        new = finder.extend(finder.meeting(new))
    t = FIRST_SCALE
    while (enough := own >= 6 * t - 2).any():
        finder.scale(t, int(ends[enough][-1]))
        t *= 2
    runs = finder.runs[finder.runs[:, 1] - finder.runs[:, 0] >= np.maximum(least, 2 * finder.runs[:, 2])]
    text = np.searchsorted(begins, runs[:, 0], "right") - 1
    out = np.stack((order[text], runs[:, 0] - begins[text], runs[:, 1] - runs[:, 0], runs[:, 2]), 1)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def detect(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (start, length, period by start, then period) and collapsed of every document.

    collapsed is the words, joined by one space, without those that a run contains after its first period. Null texts
    and texts without words have no runs and an empty collapsed. Very long texts are taken whole, in a few hundred bytes a word;
    work grows as words times the logarithm of their number. Repeated rows each give theirs, an empty table gives no rows,
    and other columns are ignored, whatever they are called. Nothing is shuffled.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                words = words_of(batch.column("text").to_pylist())
                found = runs_of(words.coded()[0], words.first, least)
                counts = np.bincount(found[:, 0], minlength=batch.num_rows)
                stop = np.concatenate(([0], np.cumsum(counts)))
                kept = np.ones(len(words.start), bool)
                for i, start, length, period in found.tolist():
                    kept[words.first[i] + start + period : words.first[i] + start + length] = False
                collapsed = []
                for i in range(batch.num_rows):
                    own = kept[words.first[i] : words.first[i + 1]]
                    every = words.strings(i)
                    collapsed.append(b" ".join(every if own.all() else [w for w, k in zip(every, own.tolist(), strict=True) if k]).decode())
                listed = pa.ListArray.from_arrays(pa.array(stop, pa.int32()), pa.StructArray.from_arrays([pa.array(found[:, k]) for k in (1, 2, 3)], names=["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(words.first), pa.int64()), listed.cast(_RUNS), pa.array(collapsed, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def digest(found: DataFrame) -> DataFrame:
    """Counts, the longest run (ties: smallest start, then period) and digests of what detect returns."""
    best = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    length = -F.col("best.shorter")
    return found.select("*", best.alias("best")).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
        F.floor(length * 1000 / F.col("best.period")).cast("bigint").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text of all documents; of a tenth of them, chosen by the hash of their ids, the end repeats some words of theirs.

    With h = crc32(doc_id in decimal), g = h div 10 and n words: if h % 10 = 0, word i from a = g % n on is word a + (i - a) % p, p = 1 + (n - a) div (3 + g % 8).
    """
    h = F.crc32(F.col("doc_id").cast("bigint").cast("string").cast("binary"))

    def planted(words: Column) -> Column:
        n, g = F.size(words).cast("bigint"), F.floor(h / 10)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int"))), " ")

    own = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    words = F.when(F.pmod(h, F.lit(10)) == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    return own.select("doc_id", "text", words.alias("words")).select("doc_id", F.when(F.size("words") > 0, planted(F.col("words"))).otherwise(F.col("text")).alias("text"))
