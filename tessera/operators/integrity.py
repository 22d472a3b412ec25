"""Referential integrity as a table of issues: severity, category, item_id, field, ref_category, ref_id, message."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Order of severities in a report.
SEVERITIES = ("ERROR", "WARNING", "INFO")


def _issues(rows: DataFrame, severity: str, category: str, item: str, field: Column, ref_category: str, ref: Column, message: Column) -> DataFrame:
    return rows.select(F.lit(severity).alias("severity"), F.lit(category).alias("category"), F.col(item).cast("bigint").alias("item_id"), field.alias("field"), F.lit(ref_category).alias("ref_category"), ref.cast("bigint").alias("ref_id"), message.alias("message"))


def missing_reference(rows: DataFrame, category: str, item: str, field: str, targets: DataFrame, target: str, ref_category: str, zero_is_none: bool = True) -> DataFrame:
    """Rows whose field is set and in no target row. A 0 stands for none, as in a part's section and material, or with
    zero_is_none off for the id 0, as in an element's part."""
    known = targets.select(F.col(target).alias("_known")).distinct()
    lost = rows.where(F.col(field).isNotNull() & ((F.col(field) != 0) | (not zero_is_none))).join(known, F.col(field) == F.col("_known"), "left_anti")
    return _issues(lost, "ERROR", category, item, F.lit(field), ref_category, F.col(field), F.concat(F.lit(f"{ref_category} "), F.col(field).cast("string"), F.lit(" does not exist")))


def missing_nodes(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """Element corners, 0 aside, whose node doesn't exist."""
    corner = elements.select("eid", F.posexplode("nodes").alias("pos", "nid")).where("nid <> 0")
    lost = corner.join(nodes.select("nid").distinct(), "nid", "left_anti")
    return _issues(lost, "ERROR", "element", "eid", F.concat(F.lit("node"), (F.col("pos") + 1).cast("string")), "node", F.col("nid"), F.concat(F.lit("node "), F.col("nid").cast("string"), F.lit(" does not exist")))


def duplicates(rows: DataFrame, category: str, keys: list[str], order: list[str], item: str | None = None) -> DataFrame:
    """Each repeat of a key after the first."""
    again = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n > 1")
    return _issues(again, "ERROR", category, item or keys[0], F.lit("id"), category, F.col(item or keys[0]), F.lit("id occurs again"))


def odd_coordinates(nodes: DataFrame, most: float = 1e10) -> DataFrame:
    """NaN coordinates are errors, huge ones warnings."""
    bad = F.isnan("x") | F.isnan("y") | F.isnan("z")
    huge = ~bad & (F.greatest(F.abs("x"), F.abs("y"), F.abs("z")) > most)
    return _issues(nodes.where(bad), "ERROR", "node", "nid", F.lit("x,y,z"), "node", F.col("nid"), F.lit("coordinate is not a number")).unionByName(
        _issues(nodes.where(huge), "WARNING", "node", "nid", F.lit("x,y,z"), "node", F.col("nid"), F.lit("coordinate is very large"))
    )


def check_deck(elements: DataFrame, nodes: DataFrame, parts: DataFrame, sections: DataFrame, materials: DataFrame, category: str | None = None, touched: DataFrame | None = None) -> DataFrame:
    """All issues of a deck: parts and nodes that elements of shells and solids name, sections and materials that parts name, ids that repeat, odd coordinates.

    With category (``element``, ``node`` or ``part``) only issues of its items, with touched (category, item_id) only those of these items.
    """

    def of(rows: DataFrame, name: str, key: str) -> DataFrame:
        return rows if touched is None else rows.join(touched.where(F.col("category") == name).select(F.col("item_id").alias(key)), key, "left_semi")

    own = of(elements.where(F.col("type").isin("shell", "solid")), "element", "eid")
    some_nodes, some_parts = of(nodes, "node", "nid"), of(parts, "part", "pid")
    checks = {
        "element": [missing_reference(own, "element", "eid", "pid", parts, "pid", "part", zero_is_none=False), missing_nodes(own, nodes), duplicates(own, "element", ["eid"], ["pid"])],
        "part": [missing_reference(some_parts, "part", "pid", "secid", sections, "secid", "section"), missing_reference(some_parts, "part", "pid", "mid", materials, "mid", "material"), duplicates(some_parts, "part", ["pid"], ["secid", "mid"])],
        "node": [duplicates(some_nodes, "node", ["nid"], ["x", "y", "z"]), odd_coordinates(some_nodes)],
    }
    return check_all(*(check for name, own_checks in checks.items() if category in (None, name) for check in own_checks))


def touched_by(changed: DataFrame, elements: DataFrame, parts: DataFrame) -> DataFrame:
    """category and item_id of changed items and of all that name them: elements of changed parts and nodes, parts of changed sections and materials.

    changed: category (``element``, ``node``, ``part``, ``section``, ``material``) and item_id of items added, changed or deleted;
    elements and parts are as they are afterwards.
    """
    ids = lambda name, key: changed.where(F.col("category") == name).select(F.col("item_id").alias(key)).distinct()
    named = lambda rows, name, key: rows.select(F.lit(name).alias("category"), F.col(key).cast("bigint").alias("item_id"))
    corner = elements.select("eid", F.explode("nodes").alias("nid"))
    found = [
        changed.select("category", F.col("item_id").cast("bigint").alias("item_id")), named(elements.join(ids("part", "pid"), "pid", "left_semi"), "element", "eid"), named(corner.join(ids("node", "nid"), "nid", "left_semi"), "element", "eid"),
        named(parts.join(ids("section", "secid"), "secid", "left_semi"), "part", "pid"), named(parts.join(ids("material", "mid"), "mid", "left_semi"), "part", "pid"),
    ]
    return reduce(DataFrame.unionByName, found).distinct()


def recheck(standing: DataFrame, changed: DataFrame, elements: DataFrame, nodes: DataFrame, parts: DataFrame, sections: DataFrame, materials: DataFrame) -> DataFrame:
    """The issues of a deck after some items changed: standing issues of items that no change touches, and new ones of those that one touches.

    Equal to check_deck over everything, as an issue rests on its item and on what the item names.
    """
    touched = touched_by(changed, elements, parts)
    kept = standing.join(touched, ["category", "item_id"], "left_anti").select(*standing.columns)
    return kept.unionByName(check_deck(elements, nodes, parts, sections, materials, touched=touched))


def check_all(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def report(issues: DataFrame) -> DataFrame:
    """Issues by severity and category, errors first by ``rank``."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    return issues.groupBy("severity", "category").agg(F.count("*").alias("n")).withColumn("rank", rank.cast("int"))
