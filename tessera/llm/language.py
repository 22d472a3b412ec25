"""Language identification with word-first backoff.

A known word scores its log frequency in each language. An unseen word backs off: its
character n-grams of the greatest length are looked up, those that are unknown give way
to the two shorter ones inside them, down to single characters, and the word scores
their mean with a penalty for each step down. Documents are scored in Arrow batches: the
words met are numbered, so a frequent word is looked up once, and the scores of a batch are summed by document in numpy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import slices, small_batches

#: Most documents of a language that its frequencies are learned from: those whose ids hash lowest.
SAMPLE_ROWS = 1_000
LONGEST = 4
#: Log penalty for each step of backoff.
STEP = -1.0
UNKNOWN = "und"
#: Words remembered by a task.
_REMEMBERED = 300_000

#: Letters and, rarely, other marks that count as parts of words; ``str.isalpha`` is ``\\p{L}`` for every character and parts these off.
_LETTERS = re.compile(r"[^\W\d_]+").findall
_LETTER_RUN = r"\p{L}+"


def held_out():
    """Whether a document is kept from learning: crc32 of its id as text leaves 0 by 5; a null id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("bigint").cast("string")) % 5 == 0, F.lit(True))


def letter_runs(word: str) -> list[str]:
    """The runs of letters in a word."""
    return [word] if word.isalpha() else "".join(c if c.isalpha() else " " for c in word).split()


class Model:
    """Log frequencies by language: a row of ``scores`` for every word and every n-gram, found by their numbers."""

    def __init__(self, languages: list[str], words: dict[str, int], ngrams: dict[str, int], scores: np.ndarray) -> None:
        self.languages, self.words, self.ngrams, self.scores = languages, words, ngrams, scores

    def _gram(self, gram: str) -> list[np.ndarray]:
        found = self.ngrams.get(gram)
        if found is not None:
            return [self.scores[found] + STEP * (LONGEST - len(gram))]
        return self._gram(gram[:-1]) + self._gram(gram[1:]) if len(gram) > 1 else []

    def word(self, word: str) -> np.ndarray:
        """Log frequency of a lower-case word in each language, by backoff if it is unseen."""
        found = self.words.get(word)
        if found is not None:
            return self.scores[found]
        padded = f" {word} "
        n = min(LONGEST, len(padded))
        grams = [x for i in range(len(padded) - n + 1) for x in self._gram(padded[i : i + n])]
        return np.mean(grams, axis=0) if grams else np.zeros(len(self.languages))


class _Seen(dict):
    """Words met by a task: each has a row of scores, one for each language and the number of its letter runs."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model, self.rows = model, np.zeros((1 << 12, len(model.languages) + 1))

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        if at == len(self.rows):
            self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
        for run in letter_runs(word):
            self.rows[at, :-1] += self.model.word(run)
            self.rows[at, -1] += 1
        return at


def predict(texts: list[str | None], seen: _Seen) -> tuple[list[str], np.ndarray]:
    """Language of every whole text and its share among all."""
    languages = seen.model.languages
    found = [_LETTERS(x.lower()) if x else [] for x in texts]
    ids = np.fromiter((seen[w] for own in found for w in own), np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(own) for own in found])
    total = np.stack([np.bincount(owner, seen.rows[ids, k], len(texts)) for k in range(len(languages) + 1)], 1) if len(ids) else np.zeros((len(texts), len(languages) + 1))
    if len(seen) > _REMEMBERED:
        seen.clear()
        seen.rows[:] = 0
    if not languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    known, total = total[:, -1] > 0, total[:, :-1]
    share = np.exp(total - total.max(1, keepdims=True))
    best = share.argmax(1)  # the first of equals, in the order of the names
    score = share[np.arange(len(texts)), best] / share.sum(1)
    return [languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)], np.where(known, score, 0.0)


def _log_shares(terms: np.ndarray, langs: np.ndarray, counts: np.ndarray, languages: list[str], floor: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Distinct terms, and their smoothed log frequencies in each language."""
    names, at = np.unique(terms, return_inverse=True)
    held = np.full((len(names), len(languages)), floor)
    np.add.at(held, (at, np.searchsorted(languages, langs)), counts)
    return names.tolist(), np.log(held / held.sum(0))


def _grams(k: int):
    """The n-grams of length k of the column ``padded``; the word itself where it is shorter."""
    each = F.regexp_extract_all("padded", F.lit(f"(?s)(?=(.{{{k}}}))."), F.lit(1))  # one pass, whatever the length
    return F.when(F.char_length("padded") < k, F.array("padded")).otherwise(each)


def _lowest(ids: DataFrame, rows: int) -> DataFrame:
    """lang and doc_id of the ``rows`` rows of each language whose ids hash lowest.

    Hashes are counted by their leading bits first, so that few more than ``rows`` of a language have to be sorted.
    """
    keyed = ids.withColumn("hash", F.xxhash64("doc_id")).withColumn("lead", F.shiftright("hash", 52))
    counts = keyed.groupBy("lang", "lead").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("lang").orderBy("lead")) - F.col("n"))
    bound = before.where(F.col("before") < rows).groupBy("lang").agg(F.max("lead").alias("bound"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "doc_id"))
    return keyed.join(F.broadcast(bound), "lang").where("lead <= bound").withColumn("place", place).where(F.col("place") <= rows).select("lang", "doc_id")


def train(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Learn from text and lang of documents that are not held out, at most ``rows`` of each language, so that none is missed beside a large one.

    The model holds all words and n-grams of that sample, which bounds it, so that it can be sent to every task.
    Documents without lang or text teach nothing; without any, every prediction is ``und``.
    """
    usable = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    ids = _lowest(usable.select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("bigint").alias("doc_id")), rows)
    # the broadcast side holds at most ``rows`` ids a language
    sample = usable.select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("bigint").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text")).join(F.broadcast(ids.distinct()), ["lang", "doc_id"]).select("lang", "text")
    word = sample.select("lang", F.explode(F.regexp_extract_all("text", F.lit(_LETTER_RUN), F.lit(0))).alias("term")).groupBy("lang", "term").agg(F.count("*").alias("n")).persist()
    padded = word.withColumn("padded", F.concat(F.lit(" "), "term", F.lit(" ")))
    grams = padded.select(
        "lang", "n",
        F.explode(F.flatten(F.array(*[_grams(k) for k in range(1, LONGEST + 1)]))).alias("term"),
    ).groupBy("lang", "term").agg(F.sum("n").alias("n")).withColumn("size", F.char_length("term"))
    # the terms of the sample, each once a language
    found = word.withColumn("size", F.lit(0)).unionByName(grams.where("size > 0")).select("size", "term", "lang", "n").toArrow()
    word.unpersist()
    size, term, lang, n = (found.column(k).to_numpy() for k in ("size", "term", "lang", "n"))
    languages = sorted(set(lang.tolist()))
    numbers: list[dict[str, int]] = [{}, {}]
    scores = [np.zeros((0, len(languages)))]
    for k in range(LONGEST + 1):
        own = size == k
        names, values = _log_shares(term[own].astype(str), lang[own].astype(str), n[own], languages) if own.any() else ([], scores[0])
        begin = sum(map(len, scores))
        numbers[min(k, 1)].update(zip(names, range(begin, begin + len(names)), strict=True))
        scores.append(values)
    return Model(languages, *numbers, np.concatenate(scores))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Predict the language of every whole text: doc_id, held_out, lang_pred, score.

    ``und`` with score 0 where the text is null, empty or without letters (characters of category L). Very long texts are
    scored whole. Of languages that tie, the first by name is taken. Repeated rows are
    predicted alike; an empty table gives no rows; extra columns are ignored. lang, source and
    doc_id play no part in a prediction.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen(shared.value)
        for whole in batches:
            for batch in slices(whole):
                found, score = predict(batch.column("text").to_pylist(), seen)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(found, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")
