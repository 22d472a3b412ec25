"""Near-duplicates by HyperMinHash, with every link confirmed on full shingle sets.

1. Each document becomes its set of word shingles. Each shingle's hash picks one of the
   buckets; a bucket keeps the least of the rest of its hashes, stored as the count of
   leading zeros and a few mantissa bits. Documents with equal sets are one node from here on.
2. Registers are banded, empty ones filled from others. Nodes that share a band meet there, and each
   meets only the band's centre: the node whose bands hold the most nodes, in a group of copies one close to what
   they were copied from. No pairs are made within a band. A pair is a link if it passes the
   collision-corrected estimate of the Jaccard similarity and then the exact comparison.
3. What a centre leaves open is settled without comparing its nodes with each other. Let D(x)
   be the symmetric difference of x and the centre. If x isn't linked with the centre, then
   x and y can only be linked if D(x) and D(y) share more than about half of D(y), so by the
   prefix principle they share one of their first few elements. The rarest come first, so an edit that
   thousands of copies share is in a prefix only where nearly the whole difference is so common, and a shared element
   counts only if enough of both differences comes after it. Pairs that aren't connected yet pass the estimate and then the exact comparison.
4. Links make components.

Two documents at a similarity of 0.8 miss all 51 bands of five with a chance of 2e-9, and any
closer ones with less; at 0.3 they meet with a chance of 0.12, at 0.2 of 0.02.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import bitmap
from tessera.llm.common import Scratch, cut, row_of, slices, small_batches
from tessera.llm.components import components
from tessera.llm.words import mix, shingle_sets, words_of

SHINGLE, LEAST = 5, 80
BUCKETS, MANTISSA, BAND = 256, 10, 5
NO_ID = 2**63 - 1


def registers(shingles: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of a sorted set of 64-bit shingles; 0 marks an empty bucket."""
    out = np.zeros(BUCKETS, np.uint16)
    if len(shingles):
        bucket = (shingles >> np.uint64(56)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        fraction, exponent = np.frexp((shingles[first] & np.uint64((1 << 56) - 1)).astype(float) + 1)
        zeros = np.clip(57 - exponent, 0, 60)
        out[bucket[first]] = zeros * (1 << MANTISSA) + ((fraction * 2 - 1) * (1 << MANTISSA)).astype(np.int64) + 1
    return out


#: For each attempt, which bucket an empty one looks at; the same for all documents.
_LOOKS = (mix(np.arange(1, 64 * BUCKETS + 1, dtype=np.uint64)) % np.uint64(BUCKETS)).astype(np.int64).reshape(64, BUCKETS)


def filled(of: np.ndarray) -> np.ndarray:
    """Registers with every empty one filled from another bucket, so that two agree with the chance of the sets' similarity.

    An empty bucket looks at others in a fixed order until one has a value; after 64 looks, the first that follows it has.
    """
    own = np.flatnonzero(of)
    if not len(own) or len(own) == len(of):
        return of
    out, empty = of.copy(), np.flatnonzero(of == 0)
    for look in _LOOKS:
        found = of[look[empty]]
        out[empty] = found
        empty = empty[found == 0]
        if not len(empty):
            return out
    out[empty] = of[own[np.searchsorted(own, empty) % len(own)]]
    return out


def band_keys(of: np.ndarray) -> np.ndarray:
    """A key for each band of five registers; none for an empty set."""
    if not of.any():
        return np.zeros(0, np.uint64)
    bands = filled(of)[: len(of) // BAND * BAND].reshape(-1, BAND).astype(np.uint64)
    keys = np.arange(1, len(bands) + 1, dtype=np.uint64)
    for register in bands.T:
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + register)
    return keys


def estimate(a: np.ndarray, b: np.ndarray, n: int, m: int) -> tuple[float, int]:
    """Jaccard similarity from registers, freed of chance collisions, and how many registers it rests on."""
    used = (a != 0) | (b != 0)
    count = int(used.sum())
    if not count:
        return 0.0, 0
    chance = 0.1699 * count / (1 << MANTISSA) * 4 * n * m / (n + m) ** 2  # expected collisions of unlike minima
    return max(0.0, (int((a[used] == b[used]).sum()) - chance) / count), count


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id; o and t, the document as a node: its id (the greatest number for null) and the hash of its text; text."""
    null, text = F.col("doc_id").isNull(), F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("o"), F.xxhash64(null, text).alias("t"), text.alias("text"))


def sketch(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, o, t, n_shingles, a digest of the whole set, and the registers of every document."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                sets = shingle_sets(words_of(batch.column("text").to_pylist(), lower=True), shingle)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k) for k in ("doc_id", "o", "t")), pa.array([len(x) for x in sets], pa.int64()),
                        pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets], pa.binary()), pa.array([registers(x).tobytes() for x in sets], pa.binary()),
                    ],
                    names=["doc_id", "o", "t", "n_shingles", "digest", "registers"],
                )

    return _keyed(docs).mapInArrow(run, "doc_id bigint, o bigint, t bigint, n_shingles bigint, digest binary, registers binary")


def _node(prefix: str = "") -> Column:
    return F.struct(F.col(f"{prefix}o").alias("o"), F.col(f"{prefix}t").alias("t"))


def _band_rows(sketches: DataFrame, nodes, common=None) -> DataFrame:
    """Bands of the nodes among the sketches; with the levels of common keys, those that recur, with their nodes and the sum of the node's levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            batch = whole.filter(pa.array(nodes.value.member(whole.column("node").to_numpy().view(np.uint64))))
            keys = [band_keys(np.frombuffer(x, np.uint16)) for x in batch.column("registers").to_pylist()]
            owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            every = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            if common is None:
                yield pa.RecordBatch.from_arrays([pa.array(every.view(np.int64))], names=["key"])
                continue
            keep = common.value.member(every)
            weight = np.bincount(owner, common.value.level(every), len(keys)).astype(np.int64)
            owner = owner[keep]
            rows = pa.array(owner)
            yield pa.RecordBatch.from_arrays([pa.array(every[keep].view(np.int64)), batch.column("o").take(rows), batch.column("t").take(rows), pa.array(weight[owner])], names=["key", "o", "t", "weight"])

    own = sketches.where("n_shingles > 0").select("o", "t", "registers", F.xxhash64("o", "t").alias("node"))
    return own.mapInArrow(run, "key bigint" if common is None else "key bigint, o bigint, t bigint, weight bigint")


def _lists(batch: pa.RecordBatch, name: str) -> Iterator[np.ndarray]:
    column = batch.column(name)
    offsets, values = column.offsets.to_numpy().tolist(), column.values.to_numpy().view(np.uint64)
    return (values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True))


def _alike(x: np.ndarray, y: np.ndarray, least: int) -> bool:
    """Whether the estimate from registers allows a link: not if it is eight deviations short of ``least``."""
    like, count = estimate(registers(x), registers(y), len(x), len(y))
    return like + 8 * np.sqrt(0.25 / max(count, 1)) >= least / 100


def _compare(pairs: DataFrame, least: int) -> DataFrame:
    """Each node with its centre: whether they are linked, the sizes n of the node, m of the centre and d of the difference, and the difference.

    With s the sum of sizes, two sets are linked if (100 - least) s >= (100 + least) d.
    """
    far, near = 100 - least, 100 + least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            every = [np.zeros(0, np.uint64)]
            for x, c in zip(_lists(batch, "xs"), _lists(batch, "cs"), strict=True):
                difference = np.concatenate((x[~_inside(x, c)], c[~_inside(c, x)]))
                d, n, m = len(difference), len(x), len(c)
                for k, value in enumerate((_alike(x, c, least) and far * (n + m) >= near * d, n, m, d)):
                    out[k].append(value)
                every.append(difference)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([len(x) for x in every]).astype(np.int32)), pa.array(np.concatenate(every).view(np.int64)))
            kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("xo", "xt", "co", "ct")), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True)), lists], names=["xo", "xt", "co", "ct", "linked", "n", "m", "d", "difference"])

    return pairs.mapInArrow(run, "xo bigint, xt bigint, co bigint, ct bigint, linked boolean, n bigint, m bigint, d bigint, difference array<bigint>")


def _inside(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which elements of sorted a are in sorted b."""
    if not len(b):
        return np.zeros(len(a), bool)
    return b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a


def _elements(compared: DataFrame, least: int, common=None, of_open: bool = False) -> DataFrame:
    """A row for each element of a difference, keyed with its centre.

    With the levels of common keys, only those of the prefix that recur, the rarest first, with sizes and place. The prefix leaves out one element less than must be shared: with any node that isn't
    linked with the centre, or of_open, with any node at all for one that isn't.
    """
    far, near = 100 - least, 100 + least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("difference")
            offsets = column.offsets.to_numpy().astype(np.int64)
            values = column.values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint64)
            offsets = offsets - offsets[0]
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            centre = mix(batch.column("co").to_numpy().view(np.uint64) + mix(batch.column("ct").to_numpy().view(np.uint64)))
            keys = mix(values ^ centre[row])
            if common is None:
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], names=["key"])
                continue
            n, m, d = (batch.column(k).to_numpy() for k in ("n", "m", "d"))
            needed = np.maximum(1, -(-(near * d - far * (n + m)) // (far + near))) if of_open else -(-(near * d + far * (m - n) + 1) // (2 * near))
            needed = np.maximum(needed, d - n * far // least)  # linked sets differ by far / least of either's size at most
            length = np.clip(d - needed + 1, 0, d)
            order = np.lexsort((keys, common.value.level(keys), row))
            keys = keys[order]
            place = np.arange(len(keys)) - offsets[:-1][row]
            keep = (place < length[row]) & common.value.member(keys)
            rows = pa.array(row[keep])
            yield pa.RecordBatch.from_arrays([pa.array(keys[keep].view(np.int64)), *(batch.column(k).take(rows) for k in ("xo", "xt", "n", "d")), pa.array(place[keep])], names=["key", "o", "t", "n", "d", "place"])

    return compared.mapInArrow(run, "key bigint" if common is None else "key bigint, o bigint, t bigint, n bigint, d bigint, place bigint")


def _confirm(pairs: DataFrame, least: int) -> DataFrame:
    """Pairs that pass the estimate and then the exact comparison, as edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(_lists(batch, "xs"), _lists(batch, "cs"), strict=True):
                same = int(_inside(x, y).sum()) if _alike(x, y, least) else 0
                keep.append(100 * same >= least * (len(x) + len(y) - same))
            yield batch.select(["xo", "xt", "co", "ct"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "xo bigint, xt bigint, co bigint, ct bigint")


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (x, c) with the sets of both."""
    named = lambda p: [F.col("o").alias(f"{p}o"), F.col("t").alias(f"{p}t"), F.col("s").alias(f"{p}s")]
    return pairs.join(sets.select(named("x")), ["xo", "xt"]).join(sets.select(named("c")), ["co", "ct"])


def links(docs: DataFrame, sketches: DataFrame, nodes: DataFrame, shingle: int, least: int, scratch: Scratch) -> DataFrame:
    """Edges (u, v) between nodes, a node being (o, t), that connect what the links connect."""
    spark = docs.sparkSession
    chosen = spark.sparkContext.broadcast(bitmap.build(nodes.select(F.xxhash64("o", "t").alias("key"))))
    counted = scratch.cut(_band_rows(sketches, chosen).groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "bands")
    common = spark.sparkContext.broadcast(bitmap.levels(counted, 2))
    scratch.drop(counted)
    members = _band_rows(sketches, chosen, common)
    centres = members.groupBy("key").agg(F.min(F.struct((-F.col("weight")).alias("w"), "o", "t")).alias("c"), F.count("*").alias("n")).where("n > 1")
    met = members.join(centres, "key").where((F.col("o") != F.col("c.o")) | (F.col("t") != F.col("c.t")))
    pairs = scratch.cut(met.select(F.col("o").alias("xo"), F.col("t").alias("xt"), F.col("c.o").alias("co"), F.col("c.t").alias("ct")).distinct(), "pairs")
    needed = pairs.select(F.col("xo").alias("o"), F.col("xt").alias("t")).unionByName(pairs.select(F.col("co").alias("o"), F.col("ct").alias("t"))).distinct()
    wanted = spark.sparkContext.broadcast(bitmap.build(needed.select(F.xxhash64("o", "t").alias("key"))))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            own = whole.filter(pa.array(wanted.value.member(whole.column("key").to_numpy().view(np.uint64))))
            for batch in slices(own):
                found = shingle_sets(words_of(batch.column("text").to_pylist(), lower=True), shingle)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32)), pa.array(np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("o"), batch.column("t"), lists], names=["o", "t", "s"])

    sets = _keyed(docs).select("o", "t", "text", F.xxhash64("o", "t").alias("key")).mapInArrow(sets_of, "o bigint, t bigint, s array<bigint>")
    if not sketches.groupBy("o", "t").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        sets = sets.dropDuplicates(["o", "t"])  # rows that are repeated whole
    sets = scratch.cut(sets, "sets")
    compared = scratch.cut(_compare(_with_sets(pairs, sets), least), "compared")
    scratch.drop(pairs)
    edge = [_node("x").alias("u"), _node("c").alias("v")]
    linked = components(compared.where("linked").select(edge), scratch)

    open_ = compared.where("NOT linked")
    around = scratch.cut(compared.join(open_.select("co", "ct").distinct(), ["co", "ct"], "left_semi"), "around")
    scratch.drop(compared)
    shared = scratch.cut(_elements(around, least).groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "elements")
    common = spark.sparkContext.broadcast(bitmap.levels(shared, 2))
    scratch.drop(shared)
    x = _elements(around.where("NOT linked"), least, common, of_open=True).alias("x")
    y = _elements(around, least, common).alias("y")
    # how many elements the differences must share; all of them lie at the first shared one's places or behind
    far, near = 100 - least, 100 + least
    need = F.ceil((near * (F.col("x.d") + F.col("y.d")) - far * (F.col("x.n") + F.col("y.n"))) / (2 * near))
    behind = F.least(F.col("x.d") - F.col("x.place"), F.col("y.d") - F.col("y.place"))
    likely = x.join(y, (F.col("x.key") == F.col("y.key")) & ((F.col("x.o") != F.col("y.o")) | (F.col("x.t") != F.col("y.t"))) & (behind >= need))
    one, other = F.struct("x.o", "x.t"), F.struct("y.o", "y.t")
    pair = F.struct(F.least(one, other).alias("x"), F.greatest(one, other).alias("c"))
    again = likely.select(pair.alias("pair")).distinct().select(*(F.col(f"pair.{p}.{k}").alias(f"{p}{k}") for p in "xc" for k in "ot"))
    root = lambda p: linked.select(F.col("u.o").alias(f"{p}o"), F.col("u.t").alias(f"{p}t"), F.col("v").alias(f"{p}root"))
    apart = again.join(root("x"), ["xo", "xt"], "left").join(root("c"), ["co", "ct"], "left").where(F.coalesce("xroot", _node("x")) != F.coalesce("croot", _node("c")))
    found = _confirm(_with_sets(apart.select("xo", "xt", "co", "ct"), sets), least).select(edge)
    return linked.unionByName(found)


def classes(docs: DataFrame, shingle: int = SHINGLE, least: int = LEAST) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, (o, t), the document as a node, and (root_o, root_t), its component's root, for every row of docs.

    Documents without words are linked with nothing. A null doc_id takes part and is never the
    smallest unless all of its component are null; then component_id is null and kept true. Repeated
    rows are equal documents. Very long texts are taken whole, their sets held by one task each. Ties go to the least (id, text hash).
    An empty table gives no rows; extra columns are ignored, whatever they are called.
    """
    with Scratch(docs.sparkSession) as scratch:
        sketches = scratch.cut(sketch(docs, shingle), "sketches")
        worded = sketches.where("n_shingles > 0")
        nodes = scratch.cut(worded.groupBy("digest").agg(F.min(F.struct("o", "t")).alias("node")).select("digest", "node.o", "node.t"), "nodes")
        roots = components(links(docs, sketches, nodes, shingle, least, scratch), scratch).select(F.col("u.o").alias("no"), F.col("u.t").alias("nt"), F.col("v").alias("root"))
        named = nodes.select("digest", F.col("o").alias("no"), F.col("t").alias("nt")).join(roots, ["no", "nt"], "left").select("digest", F.coalesce("root.o", "no").alias("root"), F.coalesce("root.t", "nt").alias("root_t"))
        found = sketches.drop("registers").join(named, "digest", "left")
        component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.when(F.col("root") != NO_ID, F.col("root")))
        return cut(found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"), "o", "t", F.coalesce("root", "o").alias("root_o"), F.coalesce("root_t", "t").alias("root_t")), "classes")


def dedup(docs: DataFrame, shingle: int = SHINGLE, least: int = LEAST) -> DataFrame:
    """The rows of docs that stay: of each component its root, one with the smallest doc_id, of rows with equal id and text one.

    Documents that are not linked both stay, whether or not their ids are equal or null. Null and empty texts stay. Columns come
    back as they are, whatever they are called; an empty table stays empty.
    """
    own = docs.select(row_of(docs).alias("row"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("o"), F.xxhash64(F.col("doc_id").isNull(), F.col("text").cast("string")).alias("t"))
    one = classes(docs, shingle, least).where("o = root_o AND t = root_t").select("o", "t")
    return own.join(one, ["o", "t"], "left_semi").dropDuplicates(["o", "t"]).select("row.*")


#: The components by four-word shingles in DuckDB, for unlike ids and small tables: all links, and all that they reach.
CLASSES_SQL = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(words) >= 4 THEN words[i + 1 : i + 4] ELSE words END, ' ') AS s
  FROM (SELECT doc_id, words, unnest(range(greatest(1, len(words) - 3))) AS i FROM doc WHERE len(words) > 0)
), size AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * same >= 80 * (x.n + y.n - same)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM doc UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b
), root AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept FROM doc d JOIN root r USING (doc_id) LEFT JOIN size s USING (doc_id)
"""
