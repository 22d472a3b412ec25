"""Laminates: material lookup by name, and layers of a set merged into one equivalent material."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.folders import checkpointed

# What stands for a material that no library entry matches.
DEFAULTS = {"density": 1.2, "modulus": 2000.0, "add1": 0.002, "add2": 0.001, "add3": 2000.0}


def _prefixes(name: Column) -> Column:
    return F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(name), F.lit(1))), lambda i: F.substring(name, F.lit(1), i)))


def resolve(queries: DataFrame, library: DataFrame, rule: str = "A") -> DataFrame:
    """Match names (query) with library entries (ord, name).

    Rule A: the same name; else an entry that begins the query; else one that the query begins; first in
    library order. Rule B: the same; else the shortest entry that the query begins; else one that begins
    the query. Prefixes are spelled out and joined by equality. Unmatched names give nulls.
    """
    q = queries.select("query").distinct()
    lib = library.select("ord", "name")
    begins = q.select("query", _prefixes(F.col("query")).alias("name")).join(lib, "name").select("query", "ord", "name")
    begun = lib.select("ord", "name", _prefixes(F.col("name")).alias("query")).join(q, "query").select("query", "ord", "name")
    both = begins.withColumn("kind", F.when(F.col("query") == F.col("name"), 0).otherwise(1)).unionByName(begun.where("query <> name").withColumn("kind", F.lit(2)))
    if rule == "A":
        rank = F.struct("kind", "ord", "name")
    else:
        order = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 2, 1).otherwise(2)
        rank = F.struct(order.alias("kind"), F.when(F.col("kind") == 2, F.char_length("name")).otherwise(0).alias("size"), "ord", "name")
    best = both.groupBy("query").agg(F.min(rank).alias("best")).select("query", "best.name")
    return queries.join(best, "query", "left")


def with_defaults(rows: DataFrame) -> DataFrame:
    """Missing material numbers filled in."""
    return rows.withColumns({k: F.coalesce(k, F.lit(v)) for k, v in DEFAULTS.items() if k in rows.columns})


def equivalents(modulus: Column, poisson: Column) -> tuple[Column, Column]:
    """Bulk and shear modulus of an elastic material; a Poisson's ratio of 0.5 or more counts as 0.3."""
    nu = F.when(poisson >= 0.5, 0.3).otherwise(poisson)
    return modulus / (3 * (1 - 2 * nu)), modulus / (2 * (1 + nu))


def merge(layers: DataFrame, keys: list[str]) -> DataFrame:
    """Layers (keys, ord, name, thickness, bulk, g0, gi, density, beta) merged by key.

    Bulk moduli, density and decay are averaged by thickness (Voigt), shear moduli, floored at
    1, in series (Reuss); names are joined in layer order.
    """
    t = F.col("thickness")
    mean = lambda c: F.sum(F.col(c) * t) / F.sum(t)
    series = lambda c: F.sum(t) / F.sum(t / F.greatest(F.col(c), F.lit(1.0)))
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]), "_")
    return layers.groupBy(*keys).agg(F.count("*").alias("n_layers"), F.sum(t).alias("thickness"), mean("bulk").alias("bulk"), series("g0").alias("g0"), series("gi").alias("gi"), mean("density").alias("density"), mean("beta").alias("beta"), names.alias("name"))


def clamp(g0: Column, gi: Column, least: Column) -> tuple[Column, Column]:
    """The long-time modulus raised to a least; the short-time one keeps its ratio if it was greater, else is no smaller."""
    new = F.greatest(gi, least)
    return F.when(g0 > gi, g0 / gi * new).otherwise(F.greatest(g0, new)), new


def numbered(groups: DataFrame, order: list[str], name: str = "mid") -> DataFrame:
    """Running numbers from 1 over all rows in this order.

    Rows are ranged over tasks and sorted there; a number is a row's place in its task plus the rows of
    the tasks before, so no task sees them all. The sorted rows are checkpointed, so numbers hold whatever is computed again.
    """
    ranged = checkpointed(groups.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row for each task
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    found = ranged.withColumn("_part", part).join(F.broadcast(before), "_part")
    return found.withColumn(name, F.col("_id").bitwiseAND((1 << 33) - 1) + F.col("_before") + 1).drop("_id", "_part", "_before")


def shares(layers: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each layer's share of its part's thickness and its offset from the top."""
    whole = Window.partitionBy(key)
    above = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return layers.withColumn("share", F.col("thickness") / F.sum("thickness").over(whole)).withColumn("offset", F.coalesce(F.sum("thickness").over(above), F.lit(0.0)))


def split_names(layers: DataFrame, sep: str = "_") -> DataFrame:
    """Merged names parted again, the thickness divided evenly; ``part_no`` counts from 0."""
    names = F.split("name", sep)
    return layers.withColumn("thickness", F.col("thickness") / F.size(names)).withColumn("_names", names).select(*[c for c in layers.columns if c not in ("name",)], F.posexplode("_names").alias("part_no", "name"))


def material_types(queries: DataFrame, library: DataFrame) -> DataFrame:
    """query and type: of the library's row of that name; for names that begin with PSA or OCA VISCOELASTIC; else of the first row, by ord, whose name the query begins with; else VISCOELASTIC."""
    known = library.select("ord", "name", "type")
    exact = queries.join(known.select(F.col("name").alias("query"), F.col("type").alias("exact")), "query", "left")
    begins = queries.distinct().select("query", F.explode(F.transform(F.sequence(F.lit(0), F.char_length("query")), lambda n: F.substring(F.col("query"), F.lit(1), n))).alias("name"))
    prefix = begins.join(known, "name").groupBy("query").agg(F.min_by("type", "ord").alias("prefix"))
    adhesive = F.when(F.upper("query").rlike("^(PSA|OCA)"), "VISCOELASTIC")
    return exact.join(prefix, "query", "left").select("query", F.coalesce("exact", adhesive, "prefix", F.lit("VISCOELASTIC")).alias("type"))


def apply_stack(config: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of a stack that belong to known parts (pid), and how many different parts of it are ``applied`` and ``skipped``."""
    known = parts.select("pid").distinct().withColumn("known", F.lit(1))
    counted = config.select("pid").distinct().join(known, "pid", "left").agg(F.count("known").alias("applied"), (F.count("*") - F.count("known")).alias("skipped"))
    return config.join(known.drop("known"), "pid", "left_semi"), counted


def renumbered(layers: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Layers with ``row``, their place in their part from 0, and ``layer_set`` one more where it is null."""
    row = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return layers.withColumn("row", row).withColumn("layer_set", F.coalesce("layer_set", F.col("row") + 1))


def add_layers(layers: DataFrame, key: str, order: str, new: DataFrame) -> DataFrame:
    """Layers with those of ``new`` (key, material, thickness) after the last of their part, each a set of its own."""
    last = layers.groupBy(key).agg(F.max(order).alias("_last"), F.max("layer_set").alias("_set"))
    n = F.row_number().over(Window.partitionBy(key).orderBy("material", "thickness"))
    placed = new.withColumn("_n", n).join(last, key, "left").withColumn(order, F.coalesce("_last", F.lit(-1)) + F.col("_n")).withColumn("layer_set", F.coalesce("_set", F.lit(0)) + F.col("_n"))
    return layers.unionByName(placed.drop("_n", "_last", "_set"), allowMissingColumns=True)


def remove_layers(layers: DataFrame, key: str, order: str, chosen: DataFrame | None = None) -> DataFrame:
    """Layers without the chosen ones (key and order columns), or without the last of each part."""
    if chosen is not None:
        return layers.join(chosen.select(key, order), [key, order], "left_anti")
    last = layers.groupBy(key).agg(F.max(order).alias("_last"))
    return layers.join(last, key).where(F.col(order) < F.col("_last")).drop("_last")


#: Layers that are sent to the tasks at a time.
_SENT = 10_000


def copy_stack(layers: DataFrame, key: str, source: int, targets: DataFrame) -> DataFrame:
    """Layers in which each target part has the source part's whole stack instead of its own.

    The stack, one part's layers, is counted and sent to the targets in blocks, of which there is seldom more than one.
    """
    stack, wanted = layers.where(F.col(key) == source).drop(key), targets.select(key).distinct()
    blocks = stack.count() // _SENT + 1
    dealt = [stack.where(F.pmod(F.xxhash64(*stack.columns), F.lit(blocks)) == k) if blocks > 1 else stack for k in range(blocks)]
    rows = reduce(DataFrame.unionByName, [wanted.join(F.broadcast(block)) for block in dealt])
    return layers.join(wanted, key, "left_anti").unionByName(rows.select(layers.columns))


def add_parts(parts: DataFrame, new: DataFrame) -> DataFrame:
    """Parts (pid, name, enabled) with the new ones (pid, name) that are not there yet, enabled; of several names of one the least."""
    fresh = new.join(parts.select("pid"), "pid", "left_anti").groupBy("pid").agg(F.min("name").alias("name")).withColumn("enabled", F.lit(True))
    return parts.unionByName(fresh.select("pid", "name", "enabled"))


def enable_all(parts: DataFrame, on: bool = True) -> DataFrame:
    return parts.withColumn("enabled", F.lit(on))
