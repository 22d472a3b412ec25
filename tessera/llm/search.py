"""Ranked lexical search by presence masks.

Documents become postings of the terms that the items hold. A segment of some thousand
documents is worked on at a time: for an item, the bitmaps of its terms are laid over one
another, and documents of one mask of matched terms are one group. A mask's score is at most
the sum of what its terms give at most in the segment, so groups are scored in the order of
these bounds, the highest first, until no bound reaches the score that counts. That is
the score of the last wanted place among those found in the segment, or among a fraction of all
documents that is scored beforehand, whichever is higher; both only bound what can be left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import Scratch, cut, slices, small_batches
from tessera.llm.words import NOT_ALNUM, words_of

#: Results of an item.
TOP = 50
#: Documents whose bitmaps are held at a time.
SEGMENT = 8192
#: One in so many documents is scored first, for scores below which nothing needs to leave its task.
AHEAD = 64
#: Characters of items that are sent to the tasks at a time; more items take several passes over the documents.
BLOCK_CHARS = 4_000_000


def terms_of(texts: list[str | None]) -> list[dict[bytes, int]]:
    """Terms and their counts of every text."""
    words = words_of(texts, lower=True, separators=NOT_ALNUM)
    codes, names = words.coded(lower=True)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        code, count = np.unique(codes[a:b], return_counts=True)
        out.append(dict(zip([names[c] for c in code.tolist()], count.tolist(), strict=True)))
    return out


class Query:
    """Items with their terms, which are numbered."""

    def __init__(self, items: list[tuple[int | None, str]]) -> None:
        terms: dict[int | None, set[bytes]] = {}
        for (item_id, _), found in zip(items, terms_of([t for _, t in items]), strict=True):
            terms.setdefault(item_id, set()).update(found)
        self.ids = [k for k, own in terms.items() if own]
        self.names = sorted({x for own in terms.values() for x in own})
        self.number = {x: i for i, x in enumerate(self.names)}
        self.terms = [np.asarray(sorted(self.number[x] for x in terms[k]), np.int64) for k in self.ids]
        text = b" ".join(self.names).decode()
        self.hashes = np.unique(words_of([text], lower=True, separators=NOT_ALNUM).hashes)

    def postings(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms of each text, and of its terms that items hold: the text, the number and the count, sorted."""
        words = words_of(texts, lower=True, separators=NOT_ALNUM)
        near = np.searchsorted(self.hashes, words.hashes)
        maybe = np.flatnonzero(self.hashes[np.minimum(near, len(self.hashes) - 1)] == words.hashes) if len(self.hashes) else np.zeros(0, np.int64)
        codes, names = words.coded(maybe, lower=True)
        numbers = np.asarray([self.number.get(x, -1) for x in names], np.int64)[codes] if len(codes) else codes
        owner = np.searchsorted(words.first, maybe, "right") - 1
        key, count = np.unique((owner * len(self.names) + numbers)[numbers >= 0], return_counts=True)
        return np.diff(words.first), key // max(len(self.names), 1), key % max(len(self.names), 1), count


class Scorer:
    """Weights of the terms, and for each item the least score that counts."""

    def __init__(self, query: Query, n_docs: int, n_terms: int, df: np.ndarray, least: np.ndarray, top: int) -> None:
        self.terms, self.n_docs, self.n_terms, self.least, self.top = query.terms, n_docs, n_terms, least, top
        self.weight = np.asarray([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)

    def best(self, ids: np.ndarray, sizes: np.ndarray, doc: np.ndarray, term: np.ndarray, count: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(item, ids, scores) of the best documents of a segment; postings are sorted by document and term."""
        v = len(self.weight)
        m = 50 + 50 * sizes * self.n_docs // max(self.n_terms, 1)
        gain = 1_000_000_000 * count // (1000 * count + 20 * m[doc]) * self.weight[term]
        keys = doc * v + term
        by_term = np.argsort(term, kind="stable")
        begin = np.searchsorted(term[by_term], np.arange(v + 1))
        most = np.zeros(v, np.int64)
        np.maximum.at(most, term, gain)
        for item, terms in enumerate(self.terms):
            found = self._item(item, terms, ids, doc, by_term, begin, most, keys, gain)
            if found is not None:
                yield item, *found

    def _item(self, item, terms, ids, doc, by_term, begin, most, keys, gain):  # noqa: ANN001
        terms = terms[begin[terms + 1] > begin[terms]]
        if int(most[terms].sum()) < max(int(self.least[item]), 1):
            return None
        group, bound = np.zeros(len(ids), np.int64), np.zeros(1, np.int64)
        for part in range(0, len(terms), 64):  # the presence masks, 64 terms in a word
            mask = np.zeros(len(ids), np.uint64)
            for j, t in enumerate(terms[part : part + 64].tolist()):
                mask[doc[by_term[begin[t] : begin[t + 1]]]] |= np.uint64(1 << j)
            masks, own = np.unique(mask, return_inverse=True)
            value = np.zeros(len(masks), np.int64)
            for j, t in enumerate(terms[part : part + 64].tolist()):
                value += ((masks >> np.uint64(j)) & np.uint64(1)).astype(np.int64) * most[t]
            pair, group = np.unique(group * len(masks) + own, return_inverse=True)
            bound = bound[pair // len(masks)] + value[pair % len(masks)]
        order = np.argsort(-bound[group], kind="stable")
        bounds = bound[group][order]
        held_id, held = ids[:0], np.zeros(0, np.int64)
        at, step, least = 0, 2 * self.top, max(int(self.least[item]), 1)
        while at < len(order) and bounds[at] >= least:
            stop = min(at + step, int(np.searchsorted(-bounds, -least, "right")))
            own = order[at:stop]
            places = own[:, None] * len(self.weight) + terms
            found = np.minimum(np.searchsorted(keys, places), len(keys) - 1)
            scores = np.where(keys[found] == places, gain[found], 0).sum(1)
            fits = scores >= least
            held_id, held = np.concatenate((held_id, ids[own[fits]])), np.concatenate((held, scores[fits]))
            first = np.lexsort((held_id, -held))[: self.top]
            held_id, held = held_id[first], held[first]
            if len(held) == self.top:
                least = max(least, int(held[-1]))
            at, step = stop, 2 * step
        return held_id, held


def _blocks(items: DataFrame) -> Iterator[Query]:
    """The items in blocks of about BLOCK_CHARS, all rows of an item in one; usually there is one block."""
    own = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    blocks = (own.agg(F.sum(F.char_length("text"))).first()[0] or 0) // BLOCK_CHARS + 1
    for k in range(blocks):
        yield Query([tuple(r) for r in own.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()])


_NULL_ID = np.int64(np.iinfo(np.int64).min)


def _postings(docs: DataFrame, query: Query) -> DataFrame:
    """doc_id, n, terms and counts of the documents that have a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                n, doc, term, count = query.postings(batch.column("text").to_pylist())
                offsets = pa.array(np.searchsorted(doc, np.arange(batch.num_rows + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (term, count)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "counts"]).filter(pa.array(n > 0))

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, counts array<int>")


def _best(postings: DataFrame, scorer: Scorer, top: int) -> DataFrame:
    """item (its number), rank, doc_id and score of each item's best documents."""

    def scored(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        ids = table.column("doc_id").to_pandas().fillna(_NULL_ID).to_numpy(np.int64) if table.column("doc_id").null_count else table.column("doc_id").to_numpy()
        terms = table.column("terms").combine_chunks()
        sizes = terms.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(len(ids)), sizes)
        out = list(scorer.best(ids, table.column("n").to_numpy(), doc, *(table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("terms", "counts"))))
        item = np.concatenate([np.full(len(x[1]), x[0], np.int64) for x in out]) if out else ids[:0]
        doc_id, score = (np.concatenate([x[k] for x in out]) if out else ids[:0] for k in (1, 2))
        return pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc_id, pa.int64(), mask=doc_id == _NULL_ID), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= SEGMENT:
                yield scored(held)
                held, rows = [], 0
        if held:
            yield scored(held)

    found = postings.select("doc_id", "n", "terms", "counts").mapInArrow(run, "item bigint, doc_id bigint, score bigint")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc("doc_id")))
    return found.select("item", place.alias("rank"), "doc_id", "score").where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of the top documents of every item, those of equal scores by ascending doc_id.

    Terms are runs of letters, digits and characters beyond ASCII, A-Z as a-z. Null and empty texts, of documents as of items,
    have no terms: they are found by nothing, find nothing and don't count. Very long texts count whole. Rows of one item_id
    are one item, that of null included, with the terms of all; repeated documents are each ranked, a null doc_id before others. Empty tables give
    no rows; other columns are ignored, whatever they are called. Only the result, items * top rows at most, is sorted by item.
    """
    spark = docs.sparkSession
    small_batches(spark)
    result = None
    for query in _blocks(items):
        with Scratch(spark) as scratch:
            postings = scratch.cut(_postings(docs, query), "postings")
            n_docs, n_terms = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
            df = np.zeros(len(query.names), np.int64)
            for term, n in postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row for each term of the block
                df[term] = n
            least = np.zeros(len(query.ids), np.int64)
            ahead = postings.where(F.pmod(F.xxhash64("doc_id"), F.lit(AHEAD)) == 0)
            for item, score in _best(ahead, Scorer(query, n_docs, n_terms, df, least.copy(), top), top).where(F.col("rank") == top).select("item", "score").collect():
                least[item] = score
            names = spark.createDataFrame(list(enumerate(query.ids)), "item bigint, item_id bigint")
            best = _best(postings, Scorer(query, n_docs, n_terms, df, least, top), top)
            part = cut(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "found")  # names: of one block
        result = part if result is None else result.unionByName(part)
    return result


#: All scores in DuckDB, for unlike ids.
SEARCH_SQL = r"""
WITH doc AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents WHERE text IS NOT NULL
), size AS (SELECT doc_id, count(*) AS n FROM doc GROUP BY doc_id
), total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM size
), tf AS (SELECT doc_id, term, count(*) AS tf FROM doc GROUP BY ALL
), weight AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term
), item AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE text IS NOT NULL
), scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::BIGINT AS score
  FROM item JOIN tf USING (term) JOIN weight USING (term) JOIN size USING (doc_id), total GROUP BY item_id, doc_id
)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scored WHERE score > 0) WHERE rank <= 50
"""
