"""Finding, filtering and summing up records: lookups, searches, parts with their elements, reports and previews."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.folders import checkpointed

#: Key columns of record kinds.
ID_COLUMNS = {
    "node": "nid", "part": "pid", "element": "eid", "element_shell": "eid", "element_solid": "eid", "element_beam": "eid", "set_node": "sid", "set_part": "sid", "set_shell": "sid", "set_solid": "sid", "set_segment": "sid",
    "section_shell": "secid", "section_solid": "secid", "section_beam": "secid", "material": "mid", "curve": "lcid", "contact": "ssid", "database_cross_section": "csid", "boundary_spc": "nid", "boundary_motion": "nid", "load_node": "nid",
}
#: Groups of kinds that are shown as one table.
VIEWS = {
    "controls": tuple(f"control_{x}" for x in ("termination", "timestep", "energy", "output", "shell", "contact", "hourglass", "bulk_viscosity")),
    "databases": ("database_binary", "database_ascii", "database_history", "database_cross_section"), "boundaries": ("boundary_spc", "boundary_motion"), "loads": ("load_node", "load_segment", "load_body"),
    "initials": ("initial_velocity", "initial_velocity_generation"), "constraineds": ("nodal_rigid_body", "extra_nodes", "extra_nodes_set", "joint", "spotweld"),
    "sets": ("set_node", "set_part", "set_shell", "set_solid", "set_segment"), "sections": ("section_shell", "section_solid", "section_beam"), "elements": ("element_shell", "element_solid", "element_beam"),
}


def first_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of the rows with one key the first in this order: what a search from the top finds."""
    return _one(rows, keys, F.min_by, order)


def last_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of the rows with one key the last in this order: what an index filled from the top holds."""
    return _one(rows, keys, F.max_by, order)


def _one(rows: DataFrame, keys: list[str], pick, order: list[Column]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    found = rows.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return found.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest))


def of_type(rows: DataFrame, column: str, *types: str) -> DataFrame:
    return rows.where(F.col(column).isin(*types))


def of_part(elements: DataFrame, pid: int) -> DataFrame:
    return elements.where(F.col("pid") == pid)


def of_parts(elements: DataFrame, parts: DataFrame) -> DataFrame:
    """Elements of the parts (pid) that are shown, all kinds together."""
    return elements.join(parts.select("pid").distinct(), "pid", "left_semi")


def name_or_id(rows: DataFrame, id_column: str, name_column: str, text: str) -> DataFrame:
    """Rows whose id or name holds the text, whatever its case."""
    low = text.lower()
    return rows.where(F.lower(name_column).contains(low) | F.col(id_column).cast("string").contains(low))


def visible_groups(groups: DataFrame, group_key: str, group_name: str, items: DataFrame, item_group: str, item_name: str, text: str) -> DataFrame:
    """Groups of a tree that are shown for a search: their own name or that of one of their items holds the text."""
    low = text.lower()
    below = items.where(F.lower(item_name).contains(low)).select(F.col(item_group).alias("_group")).distinct()
    found = groups.join(below, F.col(group_key) == F.col("_group"), "left")
    return found.where(F.lower(group_name).contains(low) | F.col("_group").isNotNull()).drop("_group")


def visible_tree(tree: DataFrame, text: str, step=None) -> DataFrame:
    """Rows of a tree (id, parent, label, null parents for roots) that a search shows: their label holds the text, or that of a row below them or of their parent.

    The text is trimmed, and case doesn't count; an empty one shows everything, null labels hold none. The tree may be of any
    depth: matches climb level by level, each row once, so rows whose parents go round in a ring are shown right too.
    ``step(frame)`` cuts a level's plan from those before; by default it is checkpointed.
    """
    low = text.lower().strip()
    cut = step or checkpointed
    matches = F.contains(F.lower(F.coalesce("label", F.lit(""))), F.lit(low)) if low else F.lit(True)
    own = tree.select("id", "parent", matches.alias("own"))
    hit = own.where("own")
    level = cut(hit.select("parent").where("parent IS NOT NULL").distinct())
    above = level
    while not level.isEmpty():
        level = cut(own.join(level.withColumnRenamed("parent", "id"), "id", "left_semi").where("parent IS NOT NULL").select("parent").distinct().join(above, "parent", "left_anti"))
        above = above.unionByName(level)
    shown = hit.select("id").unionByName(above.withColumnRenamed("parent", "id")).unionByName(own.join(hit.select(F.col("id").alias("parent")), "parent", "left_semi").select("id")).distinct()
    return tree.join(shown, "id", "left_semi")


def id_buckets(rows: DataFrame, id_column: str, most: int = 100) -> DataFrame:
    """bucket, width, n, low, high: ranges of ids, as wide as the number of rows asks for, split by ten while they hold over ``most`` rows.

    The widest are 100,000 for over 100,000 rows, 10,000 for over 10,000, else 1,000; the narrowest are 100. Wider ranges are
    summed up from the narrowest, so the rows are grouped once.
    """
    at = lambda column, width: F.floor(column / width) * width
    least = rows.groupBy(at(F.col(id_column), 100).alias("b100")).agg(F.count("*").alias("n"), F.min(id_column).alias("low"), F.max(id_column).alias("high"))
    widths = (100_000, 10_000, 1_000, 100)
    total = least.agg(F.sum("n").alias("_total"))  # one row
    held = least.crossJoin(F.broadcast(total)).withColumn("_top", F.when(F.col("_total") > 100_000, 100_000).when(F.col("_total") > 10_000, 10_000).otherwise(1_000))
    for w in widths:
        held = held.withColumn(f"_n{w}", F.sum("n").over(Window.partitionBy(at(F.col("b100"), w))))
    width = F.coalesce(*(F.when((F.col("_top") >= w) & (F.col(f"_n{w}") <= most), w) for w in widths), F.lit(100))
    return held.withColumn("width", width).groupBy(at(F.col("b100"), F.col("width")).alias("bucket"), "width").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def part_list(elements: DataFrame, parts: DataFrame) -> DataFrame:
    """pid, name and n, the elements of each part that has any; elements of part 0 do not count."""
    counted = elements.where("pid <> 0").groupBy("pid").agg(F.count("*").alias("n"))
    return counted.join(parts.select("pid", "name"), "pid", "left").select("pid", "name", "n")


def first_rows(rows: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows in this order, each with ``more``, how many rows come after them."""
    total = rows.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("more"))  # one row
    return rows.orderBy(*order).limit(most).crossJoin(F.broadcast(total))


def more_line(rows: DataFrame, most: int) -> DataFrame:
    """The line that ends a preview: how many rows it leaves out; none if it leaves out none."""
    return rows.agg(F.count("*").alias("n")).where(F.col("n") > most).select(F.format_string("... %d more", F.col("n") - most).alias("line"))


def category_counts(rows: DataFrame, group: Column, category: Column) -> DataFrame:
    """grp, category, n: rows of each category, of each group (category null) and in all."""
    return rows.select(group.alias("grp"), category.alias("category")).rollup("grp", "category").agg(F.count("*").alias("n"))


def union_ids(name: str, *columns: DataFrame) -> DataFrame:
    """Distinct ids of several tables of one column."""
    return reduce(DataFrame.union, columns).toDF(name).distinct()


def first_of_tied(contacts: DataFrame, order: str) -> DataFrame:
    """Of tied contacts between the same two sides the first; other contacts are kept as they are."""
    tied = F.col("type").startswith("TIED")
    kept = contacts.where(tied).withColumn("_n", F.row_number().over(Window.partitionBy("ssid", "msid").orderBy(order))).where("_n = 1").drop("_n")
    return contacts.where(~tied).unionByName(kept)


def named_elements(elements: DataFrame, parts: DataFrame) -> DataFrame:
    """Elements with ``name``, their part's, or ``Part`` and its id where it has none."""
    named = parts.where("name IS NOT NULL AND name <> ''").select("pid", "name")
    return elements.join(named, "pid", "left").withColumn("name", F.coalesce("name", F.concat(F.lit("Part "), F.col("pid").cast("string"))))


def element_corners(elements: DataFrame, parts: DataFrame, nodes: DataFrame) -> DataFrame:
    """eid, pid, name, pos, nid, x, y, z: elements with their part's name and each corner's coordinates, null for unknown nodes."""
    own = named_elements(elements, parts).select("eid", "pid", "name", F.posexplode("nodes").alias("pos", "nid"))
    return own.join(nodes.select("nid", "x", "y", "z"), "nid", "left").select("eid", "pid", "name", "pos", "nid", "x", "y", "z")


def color_index(parts: DataFrame, colors: int = 15) -> DataFrame:
    """pid and ``color``: the rank of the part's id, from 0, modulo the number of colors."""
    from tessera.operators.laminate import numbered

    ranked = numbered(parts.select("pid").distinct(), ["pid"], "_rank")
    return ranked.select("pid", ((F.col("_rank") - 1) % colors).alias("color"))


def matrix(rows: DataFrame, columns: list[str], array: str | None = None, width: int = 0) -> DataFrame:
    """``row``: columns, and ``width`` places of an array, 0 where there is none, as one array of doubles."""
    places = [F.get(array, i) for i in range(width)] if array else []
    return rows.select(F.array(*(F.coalesce(c.cast("double"), F.lit(0.0)) for c in (*(F.col(c) for c in columns), *places))).alias("row"))


def flat_nodes(elements: DataFrame, width: int = 8) -> DataFrame:
    """Elements with n1, n2, ... instead of their array of nodes, 0 beyond its end."""
    return elements.select(*(c for c in elements.columns if c != "nodes"), *(F.coalesce(F.get("nodes", i), F.lit(0)).alias(f"n{i + 1}") for i in range(width)))


def point_at(points: Column, i: Column | int) -> Column:
    """A curve's point (a, o); zeros beyond its ends."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.coalesce(F.when(i >= 0, F.get(points, i)), F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("o")))


def view(deck, group: str) -> DataFrame:
    """The records of a group of kinds in one table: ``kind``, and the columns of all of them."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (deck[kind].withColumn("kind", F.lit(kind)) for kind in VIEWS[group]))


def clipboard(rows: DataFrame, kind: str) -> DataFrame:
    """One text for each record, as it is copied: its card lines, parted by newlines."""
    from tessera.operators.export import lines

    placed = lines(rows, kind).groupBy("item").agg(F.array_sort(F.collect_list(F.struct("card", "line"))).alias("l"))
    return placed.select("item", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))
