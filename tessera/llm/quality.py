"""Quality rules: gradient-boosted trees over document statistics.

Statistics of every whole text are taken in Arrow batches. A few base rules reject at
once; the rest is judged by boosted trees that are fitted on labelled documents and
flattened into numpy node arrays, so that a batch is scored by a handful of array
steps a tree. Chosen features are monotonic: more symbols, repetition or duplicate
lines can never raise a document's score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ddl, slices, small_batches, unused

_WORDS = re.compile("[^\x20\x09-\x0d]+").findall
_SYMBOLS = re.compile("[#*$%&|<>]").findall
_CAPITALS = re.compile("[A-ZÀ-ÖØ-Þ]").findall
_MARKS = re.compile("[.,;:!?]").findall

#: Least words, and most words in repeated windows out of a hundred, for the base rules.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Most labelled documents that the trees are fitted on; they are those with the smallest hash of their id.
SAMPLE_ROWS = 10_000
#: Documents scored below this are rejected.
LEAST_SCORE = 0.5

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features of the trees, and the sign that each keeps: -1, a higher value never raises the score; 0, free.
FEATURES = {
    "log_words": 0, "word_length": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "capitals_per_letter": 0,
    "marks_per_word": 0, "words_per_line": 0, "distinct_share": 0, "digits_per_char": -1, "longest_word": 0, "exclaim_per_word": -1,
}


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The base counts and the features of one whole text; null counts as empty."""
    text = text or ""
    words = _WORDS(text)
    n = len(words)
    lines = text.split("\n")
    seen: set[str] = set()
    with_words = dup = 0
    for line in lines:
        if line and not line.isspace() or _WORDS(line):
            with_words += 1
            if line in seen:
                dup += 1
            seen.add(line)
    distinct = len(set(words))
    repeated = 0
    if n > 3 and distinct < n:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        count = Counter(windows)
        if len(count) < len(windows):
            end = 0
            for i, window in enumerate(windows):
                if count[window] > 1:
                    repeated += i + 3 - max(i, end)
                    end = i + 3
    chars, symbols = sum(map(len, words)), len(_SYMBOLS(text))
    per, size = max(n, 1), max(len(text), 1)
    features = [
        float(np.log1p(n)), chars / per, symbols / per, dup / max(with_words, 1), repeated / per, len(_CAPITALS(text)) / size,
        len(_MARKS(text)) / per, n / max(with_words, 1), distinct / per, sum(map(text.count, "0123456789")) / size, float(max(map(len, words), default=0)), text.count("!") / per,
    ]
    return [n, chars, symbols, dup, repeated], features


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat_words > MOST_REPEATED * n_words


@dataclass(frozen=True)
class Trees:
    """Trees of one depth as node arrays (tree by tree, node i's children at 2i+1 and 2i+2); leaves hold values."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    start: float
    depth: int

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Chance of good quality for each row of features."""
        total = np.full(len(rows), self.start)
        index = np.arange(len(rows))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (rows[index, feature[node]] > threshold[node])
            total += value[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-total))


def fit(rows: np.ndarray, labels: np.ndarray, signs: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 2.0) -> Trees:
    """Boost trees on the logistic loss over quantile bins.

    A split on a signed feature is taken only if its two values keep the sign; the midpoint
    then bounds both subtrees, which makes every tree, and so their sum, monotonic.
    """
    n, m = rows.shape
    edges = [np.unique(np.quantile(rows[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(edges[j], rows[:, j], side="left") for j in range(m)], 1)
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    total = np.full(n, start)
    inner, leaves = 2**depth - 1, 2**depth
    features, thresholds, values = (np.zeros((trees, k), t) for k, t in ((inner, np.int64), (inner, float), (leaves, float)))
    thresholds += np.inf
    for t in range(trees):
        chance = 1 / (1 + np.exp(-total))
        grad, hess = labels - chance, chance * (1 - chance)
        node = np.zeros(n, np.int64)
        bounds = {0: (-np.inf, np.inf)}
        for i in range(inner):
            own = np.flatnonzero(node == i)
            low, high = bounds[i]
            best = None
            if len(own) >= 10:
                g_all, h_all = grad[own].sum(), hess[own].sum()
                for j in range(m):
                    if not len(edges[j]):
                        continue
                    g = np.cumsum(np.bincount(binned[own, j], grad[own], len(edges[j]) + 1))[:-1]
                    h = np.cumsum(np.bincount(binned[own, j], hess[own], len(edges[j]) + 1))[:-1]
                    left, right = np.clip(g / (h + ridge), low, high), np.clip((g_all - g) / (h_all - h + ridge), low, high)
                    gain = g * left - (h + ridge) * left**2 / 2 + (g_all - g) * right - (h_all - h + ridge) * right**2 / 2
                    fine = (h > 0.5) & (h_all - h > 0.5) & (signs[j] * (right - left) >= 0)
                    gain = np.where(fine, gain, -np.inf)
                    k = int(gain.argmax())
                    if gain[k] > -np.inf and (best is None or gain[k] > best[0]):
                        best = (gain[k], j, k, left[k], right[k])
            mid_low, mid_high = (low, high), (low, high)
            if best and best[0] > 1e-9:
                _, j, k, left, right = best
                features[t, i], thresholds[t, i] = j, edges[j][k]
                go = binned[own, j] > k
                if signs[j]:
                    mid = (left + right) / 2
                    mid_low, mid_high = ((low, mid), (mid, high)) if signs[j] > 0 else ((mid, high), (low, mid))
            else:
                go = np.zeros(len(own), bool)
            node[own] = 2 * i + 1 + go
            bounds[2 * i + 1], bounds[2 * i + 2] = mid_low, mid_high
        for leaf in range(leaves):
            own = node == inner + leaf
            low, high = bounds[inner + leaf]
            values[t, leaf] = rate * np.clip(grad[own].sum() / (hess[own].sum() + ridge), low, high)
        total += values[t][node - inner]
    return Trees(features, thresholds, values, start, depth)


_STATISTICS = pa.schema([("doc_id", pa.int64()), *((k, pa.int64()) for k in BASE)])


def sample_features(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``rows`` labelled documents: those whose ids hash lowest, so the same at every run."""
    small_batches(docs.sparkSession)
    chosen = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(x)[1] for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(found, pa.list_(pa.float64()))], names=["doc_id", "quality", "features"])

    # the broadcast side has at most ``rows`` rows of two numbers
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    # at most ``rows`` documents, unless ids repeat; their features only
    got = texts.mapInArrow(run, "doc_id bigint, quality int, features array<double>").orderBy("doc_id", "features").toPandas()
    if not len(got):
        return np.zeros((0, len(FEATURES))), np.zeros(0)
    return np.stack(got.features.to_numpy()).astype(float), got.quality.to_numpy(float)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Trees | None:
    """Trees fitted on labelled documents, or None where the labels do not hold both classes."""
    features, quality = sample_features(docs, labels, rows)
    return fit(features, quality, list(FEATURES.values())) if 0 < quality.sum() < len(quality) else None


def score(docs: DataFrame, trees: Trees | None, least: float = LEAST_SCORE, keep_columns: bool = False) -> DataFrame:
    """Counts and verdict for every document.

    Returns doc_id, the five base counts, base_failed, kept and quality_score (null without
    trees, and then only the base rules decide). With keep_columns, the columns of docs come
    first instead and only ``kept`` is added. Null and empty texts have no words and fail.
    Very long texts are judged whole. Repeated rows are judged alike, and no order of rows matters, so there are no ties; a score of
    exactly ``least`` is kept. An empty table gives no rows; extra columns are ignored, whatever they are called.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_name):
                found = [statistics(x) for x in batch.column(text_name).to_pylist()]
                counts = np.asarray([x[0] for x in found], np.int64).reshape(-1, len(BASE))
                failed = np.asarray([base_failed(int(c[0]), int(c[4])) for c in counts], bool)
                chance = trees.score(np.asarray([x[1] for x in found], float)) if trees and len(found) else None
                kept = ~failed if chance is None else ~failed & (chance >= least)
                if keep_columns:
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(kept)], names=[*names, kept_name])
                else:
                    yield pa.RecordBatch.from_arrays([batch.column("_doc"), *(pa.array(c) for c in counts.T), pa.array(failed), pa.array(kept), pa.array(chance, pa.float64()) if chance is not None else pa.nulls(len(kept), pa.float64())], names=["doc_id", *BASE, "base_failed", "kept", "quality_score"])

    names, kept_name = docs.columns, unused(docs, "_kept")
    text_name = unused(docs, "_text") if keep_columns else "_text"
    text = F.col("text").cast("string").alias(text_name)
    if keep_columns:
        return docs.select("*", text).mapInArrow(run, f"{ddl(docs)}, {kept_name} boolean").where(kept_name).drop(kept_name)
    return docs.select(F.col("doc_id").cast("bigint").alias("_doc"), text).mapInArrow(run, "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, quality_score double")
