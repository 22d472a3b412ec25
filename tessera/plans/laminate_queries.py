"""Laminates over the given tables: part as material library, lineitem as layer stacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import laminate, script
from tessera.plans.base import query, table
from tessera.sources.library import script_blocks

_LAYERS = "SELECT l_orderkey AS part_id, l_linenumber % 3 AS layer_set, l_linenumber AS ord, l_quantity AS thickness, l_extendedprice AS bulk, l_extendedprice * l_discount AS g0, l_tax * 100 AS gi, l_discount AS density, l_tax AS beta, l_partkey::VARCHAR AS name FROM lineitem"


def _layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "lineitem")
    return i.select(
        F.col("l_orderkey").alias("part_id"), (F.col("l_linenumber") % 3).alias("layer_set"), F.col("l_linenumber").alias("ord"), F.col("l_quantity").alias("thickness"), F.col("l_extendedprice").alias("bulk"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("g0"), (F.col("l_tax") * 100).alias("gi"), F.col("l_discount").alias("density"), F.col("l_tax").alias("beta"), F.col("l_partkey").cast("string").alias("name"),
    )


@query(
    f"SELECT part_id, layer_set, count(*) AS n_layers, sum(thickness) AS thickness, round(sum(bulk * thickness) / sum(thickness) + 1e-7, 2) AS bulk, round(sum(thickness) / sum(thickness / greatest(g0, 1.0)) + 1e-7, 3) AS g0, round(sum(thickness) / sum(thickness / greatest(gi, 1.0)) + 1e-7, 4) AS gi, round(sum(density * thickness) / sum(thickness) + 1e-9, 6) AS density, string_agg(name, '_' ORDER BY ord, name) AS name FROM ({_LAYERS}) GROUP BY ALL"
)
def voigt_reuss(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = laminate.merge(_layers(spark, sf_dir), ["part_id", "layer_set"])
    return m.select("part_id", "layer_set", "n_layers", "thickness", *(F.round(F.col(c) + tie, n).alias(c) for c, n, tie in (("bulk", 2, 1e-7), ("g0", 3, 1e-7), ("gi", 4, 1e-7), ("density", 6, 1e-9))), "name")


@query("WITH p AS (SELECT p_partkey, p_retailprice AS e, CASE WHEN (p_size % 6) / 10.0 >= 0.5 THEN 0.3 ELSE (p_size % 6) / 10.0 END::DOUBLE AS nu FROM part) SELECT p_partkey, round(e / (3 * (1 - 2 * nu)), 4) AS bulk, round(e / (2 * (1 + nu)), 4) AS shear FROM p")
def elastic_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    bulk, shear = laminate.equivalents(F.col("p_retailprice"), (F.col("p_size") % 6) / 10.0)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(bulk, 4).alias("bulk"), F.round(shear, 4).alias("shear"))


@query("SELECT p_partkey, round(CASE WHEN p_retailprice > p_size * 30 THEN p_retailprice / (p_size * 30.0) * greatest(p_size * 30.0, 600.0) ELSE greatest(p_retailprice, greatest(p_size * 30.0, 600.0)) END, 4) AS g0, greatest(p_size * 30.0, 600.0)::DOUBLE AS gi FROM part")
def clamp_shear(spark: SparkSession, sf_dir: str) -> DataFrame:
    g0, gi = laminate.clamp(F.col("p_retailprice"), F.col("p_size") * 30.0, F.lit(600.0))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(g0, 4).alias("g0"), gi.alias("gi"))


_LIBRARY = "lib AS (SELECT min(p_partkey) AS ord, split_part(p_name, ' ', 1) AS name FROM part GROUP BY 2 UNION ALL SELECT min(p_partkey), p_name FROM part WHERE p_size % 7 = 0 GROUP BY 2), q AS (SELECT DISTINCT p_name AS query FROM part UNION SELECT DISTINCT left(p_name, 6) FROM part)"
_MATCH = "SELECT q.query, (SELECT name FROM lib WHERE lib.name = q.query OR starts_with(q.query, lib.name) OR starts_with(lib.name, q.query) ORDER BY {order} LIMIT 1) AS name FROM q"


def _names(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf_dir, "part")
    least = F.min("p_partkey").alias("ord")
    lib = p.groupBy(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("name")).agg(least).unionByName(p.where("p_size % 7 = 0").groupBy(F.col("p_name").alias("name")).agg(least))
    return p.select(F.col("p_name").alias("query")).union(p.select(F.left("p_name", F.lit(6)))).distinct(), lib


@query(f"WITH {_LIBRARY} " + _MATCH.format(order="CASE WHEN lib.name = q.query THEN 0 WHEN starts_with(q.query, lib.name) THEN 1 ELSE 2 END, ord, name"))
def material_resolve_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return laminate.resolve(*_names(spark, sf_dir), "A").select("query", "name")


@query(f"WITH {_LIBRARY} " + _MATCH.format(order="CASE WHEN lib.name = q.query THEN 0 WHEN starts_with(lib.name, q.query) THEN 1 ELSE 2 END, CASE WHEN starts_with(lib.name, q.query) AND lib.name <> q.query THEN length(lib.name) ELSE 0 END, ord, name"))
def material_resolve_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return laminate.resolve(*_names(spark, sf_dir), "B").select("query", "name")


@query("SELECT part_id, layer_set, row_number() OVER (ORDER BY part_id, layer_set) AS mid FROM (SELECT DISTINCT l_orderkey AS part_id, l_linenumber % 3 AS layer_set FROM lineitem)")
def stack_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return laminate.numbered(_layers(spark, sf_dir).select("part_id", "layer_set").distinct(), ["part_id", "layer_set"])


_ONE = "SELECT l_orderkey AS part_id, l_linenumber AS ord, min(l_partkey) AS partkey, max(l_quantity) AS thickness FROM lineitem GROUP BY 1, 2"


@query(f"SELECT part_id, ord, round(thickness / sum(thickness) OVER (PARTITION BY part_id), 6) AS share, coalesce(sum(thickness) OVER (PARTITION BY part_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS \"offset\" FROM ({_ONE})")
def stack_share_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("part_id"), F.col("l_linenumber").alias("ord")).agg(F.max("l_quantity").alias("thickness"))
    return laminate.shares(one, "part_id", ["ord"]).select("part_id", "ord", F.round("share", 6).alias("share"), "offset")


@query("SELECT p_partkey, part_no, n[part_no + 1] AS name, p_retailprice / len(n) AS thickness FROM (SELECT p_partkey, p_retailprice, string_split(p_name, ' ') AS n, unnest(range(len(string_split(p_name, ' ')))) AS part_no FROM part)")
def stack_split_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_retailprice").alias("thickness"))
    found = laminate.split_names(p, " ")
    return found.select("p_partkey", F.col("part_no").cast("bigint").alias("part_no"), "name", "thickness")


@query("SELECT count(*) FILTER (p.p_partkey IS NOT NULL) AS applied, count(*) FILTER (p.p_partkey IS NULL) AS skipped FROM (SELECT DISTINCT l_partkey + 10 AS pid FROM lineitem) c LEFT JOIN part p ON c.pid = p.p_partkey")
def apply_stack_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") + 10).alias("pid"))
    return laminate.apply_stack(config, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pid")))[1]


def _stack(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as parts, their lines as layers; every fifth order is off."""
    o = table(spark, sf_dir, "orders")
    parts = o.select(F.col("o_orderkey").alias("part_ord"), F.col("o_orderkey").alias("part_id"), (F.col("o_orderkey") % 5 != 0).alias("enabled"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(1.0).alias("dz"), F.lit(0.0).alias("angle"))
    i = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "ELASTIC").when(F.col("l_returnflag") == "N", "ELASTOPLASTIC").otherwise("VISCOELASTIC")
    layers = i.select(F.col("l_orderkey").alias("part_id"), (F.col("l_linenumber") % 3).alias("layer_set"), F.col("l_linenumber").alias("ord"), F.col("l_partkey").cast("string").alias("name"), F.col("l_quantity").alias("thickness"), kind.alias("type"), F.lit(1.5).alias("density"), F.col("l_extendedprice").alias("modulus"), F.col("l_discount").alias("add1"), F.col("l_tax").alias("add2"), F.lit(2.0).alias("add3"))
    return parts, layers


@query("WITH s AS (SELECT l_orderkey AS part_id, l_linenumber % 3 AS layer_set, sum(l_quantity) AS thickness, string_agg(l_partkey::VARCHAR, '_' ORDER BY l_linenumber, l_partkey::VARCHAR) AS name FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) AND l_orderkey % 5 <> 0 GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (ORDER BY part_id, layer_set) AS mid FROM s) SELECT part_id, mid, name, printf('*THK%02d,%.3f', mid, thickness) AS line FROM n")
def stack_thickness_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = script.layer_sets(*_stack(spark, sf_dir))
    return sets.select("part_id", "mid", "name", F.concat(F.lit("*THK"), F.format_string("%02d", "mid"), F.lit(","), F.format_string("%.3f", "thickness")).alias("line"))


@query()
def stack_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole script of all orders' stacks as placed lines; its format is held against a written one in the tests."""
    return script.script(*_stack(spark, sf_dir), "model.k")


_SETS = "WITH s AS (SELECT l_orderkey AS part_id, l_linenumber % 3 AS layer_set, sum(l_quantity) AS thickness, list(l_partkey::VARCHAR ORDER BY l_linenumber, l_partkey::VARCHAR) AS names FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) AND l_orderkey % 5 <> 0 GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (ORDER BY part_id, layer_set) AS mid FROM s)"


@query(f"{_SETS} SELECT part_id::INT AS pid, mid::INT AS mid, round(round(thickness, 3) / len(names), 9) AS thickness, unnest(range(len(names)))::INT AS part_no, unnest(names) AS name FROM n")
def stack_script_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole stack script read back: every layer with its share of its set's thickness."""
    placed = script.script(*_stack(spark, sf_dir), "model.k")
    lines = laminate.numbered(placed, ["block", "part_ord", "step", "mid", "i"], "line_no").select(F.lit("script").alias("file"), "line_no", "line")
    return script_blocks(lines).select("pid", "mid", F.round("thickness", 9).alias("thickness"), "part_no", "name")


@query(
    f"{_SETS} SELECT part_id, mid, '*MID' || printf('%02d', mid) AS start, array_to_string(names, '_') AS name, '*NUME' || mid || ',2' AS nume FROM n"
)
def stack_script_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per set, what its lines in the script say."""
    placed = script.script(*_stack(spark, sf_dir), "model.k").where("block = 2 AND step = 1")
    at = lambda i: F.max(F.when(F.col("i") == i, F.col("line")))
    found = placed.groupBy(F.col("part_ord").alias("part_id"), "mid").agg(F.substring_index(at(0), ",", 1).alias("start"), at(1).alias("name"), at(5).alias("nume"))
    return found


@query(
    "WITH q AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN 'psa ' || p_name WHEN 2 THEN n_name || '_' || p_size ELSE n_name END AS query FROM part JOIN nation ON p_partkey % 25 = n_nationkey), "
    "lib AS (SELECT n_nationkey AS ord, n_name AS name, CASE n_nationkey % 2 WHEN 0 THEN 'ELASTIC' ELSE 'ELASTOPLASTIC' END AS type FROM nation) "
    "SELECT q.query, coalesce(any_value(e.type), CASE WHEN upper(q.query) LIKE 'PSA%' OR upper(q.query) LIKE 'OCA%' THEN 'VISCOELASTIC' END, arg_min(p.type, p.ord), 'VISCOELASTIC') AS type FROM q LEFT JOIN lib e ON e.name = q.query LEFT JOIN lib p ON starts_with(q.query, p.name) GROUP BY q.query"
)
def material_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    p = table(spark, sf_dir, "part").join(n, F.col("p_partkey") % 25 == F.col("n_nationkey"))
    name = F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("psa "), "p_name")).when(F.col("p_partkey") % 4 == 2, F.concat("n_name", F.lit("_"), F.col("p_size").cast("string"))).otherwise(F.col("n_name"))
    lib = n.select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, "ELASTIC").otherwise("ELASTOPLASTIC").alias("type"))
    return laminate.material_types(p.select(name.alias("query")).distinct(), lib)


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "lineitem")
    one = i.groupBy(F.col("l_orderkey").alias("part_id"), F.col("l_linenumber").alias("ord")).agg(F.min("l_partkey").cast("string").alias("material"), F.max("l_quantity").alias("thickness"))
    return one.withColumn("layer_set", F.when(F.col("ord") % 2 == 0, F.col("ord").cast("bigint")))


_ROWS = "SELECT l_orderkey AS part_id, l_linenumber AS ord, min(l_partkey)::VARCHAR AS material, max(l_quantity) AS thickness, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber END AS layer_set FROM lineitem GROUP BY l_orderkey, l_linenumber"


@query(f"SELECT part_id, ord, row, coalesce(layer_set, row + 1) AS layer_set FROM (SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY ord) - 1 AS row FROM ({_ROWS}) WHERE ord > 1)")
def layers_renumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers after their first ones are removed, numbered anew."""
    rows = _rows(spark, sf_dir)
    left = laminate.remove_layers(rows, "part_id", "ord", rows.where("ord = 1"))
    return laminate.renumbered(left, "part_id", ["ord"]).select("part_id", "ord", "row", "layer_set")


@query(
    f"WITH r AS ({_ROWS}), added AS (SELECT part_id, ord, material FROM r UNION ALL SELECT part_id, max(ord) + 1, 'NEW' FROM r WHERE part_id % 2 = 0 GROUP BY part_id) "
    "SELECT part_id, count(*) AS n, max(ord) AS last, bool_or(material = 'NEW') AS added FROM added WHERE part_id % 2 = 0 GROUP BY part_id UNION ALL SELECT part_id, count(*) - 1, max(ord) FILTER (ord < m), false FROM (SELECT *, max(ord) OVER (PARTITION BY part_id) AS m FROM r) WHERE part_id % 2 = 1 GROUP BY part_id HAVING count(*) > 1"
)
def layers_added_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layer more for even parts, the last one less for odd ones."""
    rows = _rows(spark, sf_dir)
    even, odd = rows.where("part_id % 2 = 0"), rows.where("part_id % 2 = 1")
    new = even.select("part_id").distinct().select("part_id", F.lit("NEW").alias("material"), F.lit(0.1).alias("thickness"))
    found = laminate.add_layers(even, "part_id", "ord", new).unionByName(laminate.remove_layers(odd, "part_id", "ord"))
    return found.groupBy("part_id").agg(F.count("*").alias("n"), F.max("ord").alias("last"), F.bool_or(F.col("material") == "NEW").alias("added"))


@query(
    f"WITH r AS ({_ROWS}), s AS (SELECT * FROM r WHERE part_id = (SELECT min(part_id) FROM r)), t AS (SELECT DISTINCT part_id FROM r WHERE part_id % 10 = 3 AND part_id <> (SELECT min(part_id) FROM r)) "
    "SELECT part_id, ord, material FROM r WHERE part_id NOT IN (SELECT part_id FROM t) UNION ALL SELECT t.part_id, s.ord, s.material FROM s, t"
)
def layers_copied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first part's stack pasted over those of every tenth part."""
    rows = _rows(spark, sf_dir)
    source = rows.agg(F.min("part_id")).first()[0]
    if source is None:
        return rows.select("part_id", "ord", "material")
    return laminate.copy_stack(rows, "part_id", source, rows.where((F.col("part_id") % 10 == 3) & (F.col("part_id") != source)).select("part_id")).select("part_id", "ord", "material")


@query("SELECT p_partkey AS pid, p_name AS name, true AS enabled FROM part WHERE p_size < 20 UNION ALL SELECT DISTINCT l_partkey, 'Part ' || l_partkey, true FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 20)")
def parts_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the model added to a list that has some of them, all enabled."""
    own = table(spark, sf_dir, "part").where("p_size < 20").select(F.col("p_partkey").alias("pid"), F.col("p_name").alias("name"), F.lit(False).alias("enabled"))
    new = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("pid"), F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("name"))
    return laminate.enable_all(laminate.add_parts(own, new))
