"""Rows whose order is stored: sparse keys, so that rows are put between others without renumbering the table.

``at`` is a row's order key, unique and greater than 0. Keys are ``GAP`` apart at first. Rows that come between two others share the gap
there is. Keys lie in spans of fixed width, and an insertion looks only at the spans that it goes to: where a gap is used up, its span
is spread anew, and only if a span would hold more than ``MOST`` rows the whole table. Rows that are deleted leave their gap, so
putting them back is a union.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.laminate import numbered
from tessera.sources.folders import checkpointed

GAP = 1 << 20
#: Width of a span in keys, and the rows that one may hold.
SPAN, MOST = 1 << 36, 1 << 20
_END = 2**63 - 1


def _span(key: str, width: int) -> Column:
    return F.floor(F.col(key) / F.lit(width)) if width < 1 << 20 else F.shiftright(key, width.bit_length() - 1)


def spread(rows: DataFrame, order: Sequence[str], gap: int = GAP) -> DataFrame:
    """rows with ``at``, keys a gap apart in this order."""
    return numbered(rows, list(order), "at").withColumn("at", F.col("at") * gap - gap // 2)


def places(rows: DataFrame, name: str = "place") -> DataFrame:
    """rows with their place in the order, from 0."""
    return numbered(rows, ["at"], name).withColumn(name, F.col(name) - 1)


def at_places(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (place, and other columns) with the order key ``before`` of the row at each place, null beyond the last."""
    return wanted.join(places(rows.select("at")).withColumnRenamed("at", "before"), "place", "left")


def insert(rows: DataFrame, new: DataFrame, key: str, order: Sequence[str], gap: int = GAP, span: int = SPAN, most: int = MOST) -> DataFrame:
    """rows and new ones, each put before the first row whose ``key`` is its ``before``, or at the end if that is null or there is none.

    New rows with one place come in their ``order``, columns of theirs; columns that only they have are left out, and those they lack are
    null. ``key`` may be ``at`` itself (see at_places). span is a power of two.
    """
    if span & (span - 1):
        raise ValueError("a span is a power of two wide")
    columns = rows.columns
    wanted = new.select("before").where("before IS NOT NULL").distinct()
    target = rows.select(F.col(key).alias("before"), F.col("at").alias("_to")).join(wanted, "before", "left_semi").groupBy("before").agg(F.min("_to").alias("_to"))
    placed = new.join(target, "before", "left").withColumn("_to", F.coalesce("_to", F.lit(_END)))
    placed = numbered(placed, ["_to", *order], "_k").select(*(c for c in columns if c in new.columns and c != "at"), "_to", "_k")
    # the gaps that new rows go to, each with its number of them and its span
    gaps = placed.groupBy("_to").agg(F.min("_k").alias("_first"), F.count("*").alias("_n")).withColumn("_s", _span("_to", span))
    inner = gaps.where(F.col("_to") != _END)
    own = rows.select("at", _span("at", span).alias("_s")).join(inner.select("_s").distinct(), "_s", "left_semi")
    before = own.select(F.col("at").alias("_to"), F.lag("at").over(Window.partitionBy("_s").orderBy("at")).alias("_low"))
    inner = checkpointed(inner.join(before, "_to").withColumn("_low", F.coalesce("_low", F.col("_s") * span)))
    sizes = own.groupBy("_s").agg(F.count("*").alias("_n")).unionByName(inner.select("_s", "_n")).groupBy("_s").agg(F.sum("_n").alias("_n"))
    both = lambda old, fresh: old.withColumns({"_to": F.col("at"), "_old": F.lit(1), "_k": F.lit(0).cast("bigint")}).unionByName(fresh.withColumn("_old", F.lit(0)), allowMissingColumns=True)
    if not sizes.where((F.col("_n") > most) | (F.col("_n") >= span)).isEmpty():
        whole = both(rows, placed).drop("at")
        return spread(whole, ["_to", "_old", "_k"], gap).select(columns)
    step = F.expr("(_to - _low) div (_n + 1)")
    crowded = inner.where(step < 1).select("_s").distinct()
    last = rows.agg(F.coalesce(F.max("at"), F.lit(-(gap // 2))).alias("_low"))  # one row
    end = gaps.where(F.col("_to") == _END).join(F.broadcast(last)).select("_to", "_first", "_low", F.lit(gap).cast("bigint").alias("_step"))
    fits = inner.join(crowded, "_s", "left_anti").select("_to", "_first", "_low", step.alias("_step")).unionByName(end)
    between = placed.join(fits, "_to").withColumn("at", F.col("_low") + (F.col("_k") - F.col("_first") + 1) * F.col("_step"))
    kept, moved = rows, None
    if not crowded.isEmpty():
        spanned = rows.withColumn("_s", _span("at", span))
        kept = spanned.join(crowded, "_s", "left_anti").drop("_s")
        fresh = placed.where(F.col("_to") != _END).withColumn("_s", _span("_to", span)).join(crowded, "_s", "left_semi")
        again = numbered(both(spanned.join(crowded, "_s", "left_semi"), fresh).drop("at"), ["_to", "_old", "_k"], "_i")
        size = again.groupBy("_s").agg(F.min("_i").alias("_begin"), F.count("*").alias("_m"))
        moved = again.join(size, "_s").withColumn("at", F.col("_s") * span + (F.col("_i") - F.col("_begin") + 1) * F.expr(f"{span} div (_m + 1)"))
    found = kept.select(columns).unionByName(between.select(*(c for c in columns if c in between.columns)), allowMissingColumns=True)
    return found if moved is None else found.unionByName(moved.select(columns))


def remove(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """rows without all of those whose key is in gone."""
    return rows.join(gone.select(key), key, "left_anti").select(rows.columns)


def remove_first(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """rows without the first in the order of each key in gone."""
    first = rows.select(key, "at").join(gone.select(key), key, "left_semi").groupBy(key).agg(F.min("at").alias("at"))
    return rows.join(first.select("at"), "at", "left_anti").select(rows.columns)


def change(rows: DataFrame, new: DataFrame, key: str, values: Sequence[str], seq: str) -> DataFrame:
    """rows with the values of new (key, seq, values) where their key is in it, of several the last by seq; all keep their place, and nulls are values.

    A null seq comes before all others, of equal ones the greatest values count.
    """
    last = new.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(seq, *values)).alias("_new"))
    joined = rows.join(last, key, "left")
    return joined.withColumns({c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) for c in values}).select(rows.columns)
