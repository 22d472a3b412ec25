"""Line dedup by a suffix array over line ids, with DataFrame operations alone.

Every document is the sequence of its lines that hold a word. Lines that occur once in
the corpus can be in no repeated run, so they only part the sequences; the rest get a
rank, and prefix doubling ranks the first 1, 2, 4, ... lines of every suffix: the rank of 2h lines comes
from the pair of ranks of the first and the second h. Pairs are reduced to distinct ones that occur twice or more
before they are range-partitioned, sorted and numbered, so a line that fills a third of the corpus is one
row there, and ranks grow with the order of the suffixes.

Two suffixes lie in one interval of the array with a longest common prefix of n lines or more if they agree in
two ranks of h lines, h <= n < 2h: the one that begins the n lines, and the one that ends them. A run counts from
``min_words`` words on, in however many lines. So for each line the least run of as many words that begins there, and
the least that ends there, is looked for in its interval: where the interval has an earlier member, the run is a later copy.
These windows joined make up the maximal repeated runs (every line of a longer one is in such a window of it),
and the lines under them are deleted. Each line has a word, so doubling ends at ``min_words`` lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, cut, row_of, unused

#: Words that a repeated run has at least.
MIN_WORDS = 5
_WORD = r"[^\x20\x09-\x0D]"
#: Place of a line: document (null ids apart from all others), hash of its text, line number among those with a word.
PLACE = ["d", "t", "p"]


def _document() -> list[Column]:
    null = F.col("doc_id").isNull()
    return [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("d"), F.xxhash64(null, F.col("text").cast("string")).alias("t")]


def _least(counts: Column, min_words: int) -> Column:
    """How many of the first counts make up ``min_words``; null if all together do not."""
    step = lambda had, n: F.when(had["words"] >= min_words, had).otherwise(F.struct((had["words"] + n).alias("words"), (had["lines"] + 1).alias("lines")))
    return F.aggregate(counts, F.struct(F.lit(0).alias("words"), F.lit(0).alias("lines")), step, lambda had: F.when(had["words"] >= min_words, had["lines"]))


def lines_of(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """d, t, p, the two halves a, b of a 128-bit hash, and the lines of the least runs that begin (``ahead``) and end (``behind``) there, for every line with a word."""
    with_words = F.filter(F.split(F.col("text").cast("string"), "\n", -1), lambda x: x.rlike(_WORD))
    own = docs.select(*_document(), with_words.alias("lines")).withColumn("counts", F.transform("lines", lambda x: F.regexp_count(x, F.lit(f"{_WORD}+"))))
    ahead = lambda i: _least(F.slice("counts", i + 1, min_words), min_words)
    behind = lambda i: _least(F.reverse(F.slice("counts", F.greatest(i + 2 - min_words, F.lit(1)), F.least(i + 1, F.lit(min_words)))), min_words)
    line = lambda x, i: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("line"), x).alias("b"), ahead(i).alias("ahead"), behind(i).alias("behind"))
    return own.select("d", "t", F.posexplode(F.transform("lines", line)).alias("p", "line")).select("d", "t", "p", "line.*")


def _numbered(keys: DataFrame, *by: str) -> DataFrame:
    """Distinct keys with numbers that grow in their order: partition in the high bits, place in it in the low ones."""
    return keys.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id())


def _first_ranks(lines: DataFrame, scratch: Scratch) -> DataFrame:
    repeated = lines.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return scratch.cut(lines.join(_numbered(repeated, "a", "b"), ["a", "b"]).select(*PLACE, "rank", "ahead", "behind").dropDuplicates(PLACE), "ranks")


def _doubled(ranks: DataFrame, h: int, scratch: Scratch) -> DataFrame:
    """Ranks of 2h lines from those of h, for places whose 2h lines occur again."""
    later = ranks.select("d", "t", (F.col("p") - h).alias("p"), F.col("rank").alias("next"))
    pairs = ranks.select(*PLACE, F.col("rank").alias("first")).join(later, PLACE)
    again = pairs.groupBy("first", "next").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return scratch.cut(pairs.join(_numbered(again, "first", "next"), ["first", "next"]).select(*PLACE, "rank"), "ranks")


def suffix_array(docs: DataFrame, depth: int = 1 << 20) -> DataFrame:
    """d, t, p, ``rank`` and ``lines``: the suffixes at lines that recur, by the order of their repeated beginnings.

    ``lines`` is the power of two of lines, ``depth`` at most, up to which the suffix shares its beginning with another; within
    equal ``lines`` suffixes sort by ``rank``, and equal ranks are equal beginnings. An interval of the array whose longest common prefix is
    2 ** k or more is a rank of round k. Rounds end when no beginning occurs again.
    """
    with Scratch(docs.sparkSession) as scratch:
        ranks, h = _first_ranks(scratch.cut(lines_of(docs), "lines"), scratch).select(*PLACE, "rank"), 1
        found = None
        while True:
            next_ = _doubled(ranks, h, scratch) if 2 * h <= depth else None
            last = next_ is None or next_.isEmpty()
            own = (ranks if last else ranks.join(next_, PLACE, "left_anti")).withColumn("lines", F.lit(h))
            found = own if found is None else found.unionByName(own)
            if last:
                return cut(found, "suffixes")
            ranks, h = next_, 2 * h


def _windows(lines: DataFrame, min_words: int, scratch: Scratch) -> DataFrame:
    """d, t, p, n and ``interval``, for each least run of n lines whose blocks of lines occur again."""
    ranks = _first_ranks(lines, scratch)
    ahead = ranks.select(*PLACE, F.col("ahead").alias("n"))
    behind = ranks.select("d", "t", (F.col("p") - F.col("behind") + 1).alias("p"), F.col("behind").alias("n"))
    runs = scratch.cut(ahead.unionByName(behind).where("n IS NOT NULL").distinct(), "runs")
    found, h = None, 1
    while True:
        own = runs.where((F.col("n") >= h) & (F.col("n") < 2 * h))
        head = own.join(ranks.select(*PLACE, F.col("rank").alias("head")), PLACE)
        if h > 1:
            end = ranks.select("d", "t", (F.col("p") + h).alias("end"), F.col("rank").alias("tail"))
            head = head.withColumn("end", F.col("p") + F.col("n")).join(end, ["d", "t", "end"])
        else:
            head = head.withColumn("tail", F.col("head"))
        one = head.select(*PLACE, "n", F.struct("n", "head", "tail").alias("interval"))
        found = one if found is None else found.unionByName(one)
        if 2 * h > min_words:
            return found
        ranks, h = _doubled(ranks.select(*PLACE, "rank"), h, scratch), 2 * h


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """d, t and ``gone``: the numbers of a document's lines that lie in later copies of repeated runs."""
    with Scratch(docs.sparkSession) as scratch:
        lines = scratch.cut(lines_of(docs, min_words), "lines")
        array = scratch.cut(_windows(lines, min_words, scratch), "windows")
        scratch.drop(lines)
        place = F.struct(*PLACE)
        first = array.groupBy("interval").agg(F.min(place).alias("first"), F.count("*").alias("members")).where("members > 1")
        copies = array.join(first, "interval").where(place > F.col("first"))
        covered = copies.select("d", "t", F.explode(F.sequence(F.col("p"), F.col("p") + F.col("n") - 1)).alias("p"))
        return cut(covered.groupBy("d", "t").agg(F.collect_set("p").alias("gone")), "copies")


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with ``text`` freed of later copies, and n_lines and n_removed added, with underscores before them where docs has such columns.

    Later copies are runs of lines, at least ``min_words`` words in all, that an earlier place has as well, be it in the same
    document. Order is by doc_id, then text hash, then line; null ids come first. Lines without a
    word are never deleted and break no run. Null texts stay null and have no lines, empty ones stay empty. Very long texts are
    taken whole: one row each, their lines one row each. Of equal runs the first stays, whatever the ties. Repeated rows
    (same id and text) are one document: all of them come back, with the same text. An
    empty table gives no rows; other columns are kept, whatever they are called.
    """
    n_lines, n_removed = unused(docs, "n_lines"), unused(docs, "n_removed")
    gone = later_copies(docs, min_words)
    text = F.col("text").cast("string")
    keyed = docs.select(row_of(docs, "text").alias("row") if len(docs.columns) > 1 else F.lit(None).alias("row"), *_document(), text.alias("_text"))
    lines = F.split("_text", "\n", -1)
    found = keyed.join(gone, ["d", "t"], "left").withColumn("lines", lines)
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    found = found.withColumn("worded", F.filter(every, lambda i: F.get("lines", i).rlike(_WORD)))
    left = F.array_except(every, F.transform("gone", lambda p: F.get("worded", p)))
    kept = F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")
    new = F.when(F.col("gone").isNull(), F.col("_text")).otherwise(kept)
    columns = [new.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    count = F.when(F.col("_text").isNull(), 0).otherwise(F.size("worded"))
    return found.select(*columns, count.cast("bigint").alias(n_lines), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("bigint").alias(n_removed))


def digest(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed and kept_md5, the MD5 of the text that is left, for every document."""
    found = dedup(docs.select("doc_id", "text"), min_words)
    return found.select(F.col("doc_id").cast("bigint").alias("doc_id"), "n_lines", "n_removed", F.md5("text").alias("kept_md5"))


#: The same for min_words of 5 and unlike (doc_id, text), in DuckDB: every run of one to five lines with five words or more, and whether it came before.
DIGEST_SQL = """
WITH line AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents
), worded AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS p, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM line WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), listed AS (
  SELECT doc_id, p, n, list(line) OVER w AS run, sum(words) OVER w AS words, count(*) OVER w AS held
  FROM (SELECT * FROM worded, (SELECT unnest(range(1, 6)) AS n)) WINDOW w AS (PARTITION BY doc_id, n ORDER BY p RANGE BETWEEN CURRENT ROW AND n - 1 FOLLOWING)
), later AS (
  SELECT doc_id, p, n FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, p) AS copy FROM listed WHERE held = n AND words >= 5) WHERE copy > 1
), gone AS (
  SELECT DISTINCT doc_id, p + i AS p FROM (SELECT doc_id, p, unnest(range(n)) AS i FROM later)
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text, count(w.p) AS n_lines, count(w.p) FILTER (g.p IS NOT NULL) AS n_removed,
    string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (g.p IS NULL) AS left_text
  FROM line l LEFT JOIN worded w ON l.doc_id = w.doc_id AND l.pos = w.pos LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.p = w.p GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed,
  CASE WHEN d.text IS NULL THEN NULL ELSE md5(coalesce(k.left_text, '')) END AS kept_md5
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
