"""Connected components by alternating large and small stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch


def _large(edges: DataFrame) -> DataFrame:
    """Each node sends its larger neighbours to the least node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("least"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node sends itself and its smaller neighbours to the least of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("least"))
    moved = down.join(least, "u").where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.unionByName(least.withColumnRenamed("least", "v")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v), v the least node of u's component, for every node that isn't that itself. u and v may be of any sortable type.

    The result is a cut point of ``scratch``, and goes with it.
    """
    edges = scratch.cut(edges.where("u <> v").select("u", "v").distinct(), "edges")
    state = _state(edges)
    while True:
        new = scratch.cut(_small(_large(edges)), "stars")
        scratch.drop(edges)
        edges, found = new, _state(new)
        if found == state:
            return edges
        state = found
