"""The corpus pipeline: quality rules, line dedup, near-dedup, benchmark decontamination and packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; ``run``
writes every stage's result as Parquet in the shared folder and reads it again for the
next. All but the last return the columns of ``documents``, and any others there are, whatever they are called.
Each stage gives an empty result for an empty table, takes very long texts whole, and does with nulls, ties and repeated rows
what its operator's docstring says; the stages add what follows here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, lines, neardup, packing, quality
from tessera.llm.common import cut, table, unused

#: Chunks that a Python worker remembers while it packs. They stay in it when the next corpus begins, beside an executor whose heap has grown by then.
REMEMBERED = 250_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the trees are fitted on labelled documents of docs. Null and empty texts go, repeated rows stay or go together."""
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")), keep_columns=True)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs; those of which no line with a word is left go, null and empty texts too. n_chars follows the text. Repeated rows are one document and come back as often."""
    n_lines, n_removed = unused(docs, "n_lines"), unused(docs, "n_removed")
    found = lines.dedup(docs).where(F.col(n_lines) > F.col(n_removed))
    return (found.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in docs.columns else found).select(*(f"`{c}`" for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, a similarity of 0.8 or more. Of repeated rows one stays."""
    return neardup.dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null texts hold none."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, packed into sequences; a null text is one end id."""
    return packing.pack(docs, remembered=REMEMBERED)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", best_fit_packing),
]

#: The trees, the registers and the tokenizer have no SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents, each on what the one before wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
