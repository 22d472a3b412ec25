"""What a record is shown as: labels, details, defaults, and points along an outline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.cards import KINDS, fields

# Label texts by kind: id column, title column, and the word where there is no title.
LABELS = {"node": ("nid", None, "Node"), "part": ("pid", "title", "Part"), "material": ("mid", "title", "Material"), "section_shell": ("secid", "title", "Section"), "section_solid": ("secid", "title", "Section"), "section_beam": ("secid", "title", "Section"), "element": ("eid", None, "Element")}


def label(kind: str, columns: list[str]) -> Column:
    """``id: title``, or the kind's word and the id."""
    key, title, word = LABELS[kind]
    plain = F.concat(F.lit(f"{word} "), F.col(key).cast("string"))
    if title is None or title not in columns:
        return plain
    return F.when(F.coalesce(F.col(title), F.lit("")) != "", F.concat(F.col(key).cast("string"), F.lit(": "), F.col(title))).otherwise(plain)


def details(records: DataFrame) -> DataFrame:
    """Every record as one JSON text of its columns."""
    return records.select(F.to_json(F.struct("*")).alias("details"))


def new_record(spark: SparkSession, kind: str, **values) -> DataFrame:
    """One record with the values given; other fields are 0 or blank. The first field, the id, must be over 0."""
    columns = [(n, t) for card in KINDS[kind].cards for n, t, _, _ in fields(card)]
    if unknown := set(values) - {n for n, _ in columns}:
        raise ValueError(f"{kind} has no {sorted(unknown)}")
    if columns[0][1] == "i" and not values.get(columns[0][0], 0) > 0:
        raise ValueError(f"{columns[0][0]} must be over 0")
    kinds, empty = {"i": "int", "d": "double", "s": "string"}, {"i": 0, "d": 0.0, "s": ""}
    return spark.range(1).select(*(F.lit(values.get(n, empty[t])).cast(kinds[t]).alias(n) for n, t in columns))


def along(ring: DataFrame, key: str, count: int) -> DataFrame:
    """``count`` points at even steps along each key's closed ring (an array of u, v): key, sample, u, v."""
    after = F.concat(F.slice("ring", F.lit(2), F.size("ring")), F.slice("ring", F.lit(1), F.lit(1)))
    sides = F.zip_with("ring", after, lambda p, q: F.struct(p["u"].alias("u"), p["v"].alias("v"), q["u"].alias("u2"), q["v"].alias("v2"), F.sqrt((q["u"] - p["u"]) * (q["u"] - p["u"]) + (q["v"] - p["v"]) * (q["v"] - p["v"])).alias("len")))
    total = F.aggregate("sides", F.lit(0.0), lambda a, s: a + s["len"])
    begin = F.transform("sides", lambda s, i: F.aggregate(F.slice("sides", F.lit(1), i), F.lit(0.0), lambda a, x: a + x["len"]))
    placed = ring.withColumn("sides", sides).withColumn("total", total).withColumn("begin", begin)
    each = placed.select(key, "sides", "begin", "total", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("sample")).withColumn("at", F.col("total") * F.col("sample") / count)
    side = F.size(F.filter("begin", lambda b: b <= F.col("at"))) - 1  # the last side that begins no later
    found = each.withColumn("s", F.get("sides", side)).withColumn("b", F.get("begin", side))
    part = F.when(F.col("s.len") > 0, (F.col("at") - F.col("b")) / F.col("s.len")).otherwise(0.0)
    return found.withColumn("part", F.greatest(F.lit(0.0), F.least(F.lit(1.0), part))).select(key, "sample", (F.col("s.u") + F.col("part") * (F.col("s.u2") - F.col("s.u"))).alias("u"), (F.col("s.v") + F.col("part") * (F.col("s.v2") - F.col("s.v"))).alias("v"))
