"""Histories of commands over the events table, searches in a tree of several tables, and checks of what edits touch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import history, integrity, ordered, select
from tessera.plans.base import mesh_elements, mesh_nodes, query, table
from tessera.sources.folders import checkpointed

_MOST = 5
_ACTION = "CASE WHEN event_id % 11 < 6 THEN 'do' WHEN event_id % 11 < 8 THEN 'undo' WHEN event_id % 11 = 8 THEN 'redo' WHEN event_id % 11 = 9 THEN 'begin' WHEN event_id % 3 = 0 THEN 'rollback' ELSE 'commit' END"


@query(
    f"""WITH RECURSIVE log AS (SELECT user_id AS s, event_id AS q, {_ACTION} AS action, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    state AS (
      SELECT DISTINCT s, 0::BIGINT AS n, []::BIGINT[][] AS undo, []::BIGINT[][] AS redo, NULL::BIGINT[] AS batch, []::BIGINT[] AS settled FROM log
      UNION ALL
      SELECT s, n, CASE WHEN pushed IS NOT NULL THEN list_append(undo, pushed)[-{_MOST}:] WHEN action = 'undo' AND len(undo) > 0 THEN undo[:-2] WHEN action = 'redo' AND len(redo) > 0 THEN list_append(undo, redo[-1]) ELSE undo END,
        CASE WHEN pushed IS NOT NULL THEN []::BIGINT[][] WHEN action = 'undo' AND len(undo) > 0 THEN list_append(redo, undo[-1]) WHEN action = 'redo' AND len(redo) > 0 THEN redo[:-2] ELSE redo END,
        CASE WHEN action = 'begin' THEN coalesce(batch, []::BIGINT[]) WHEN action = 'do' AND batch IS NOT NULL THEN list_append(batch, q) WHEN action IN ('commit', 'rollback') THEN NULL ELSE batch END,
        CASE WHEN pushed IS NOT NULL AND len(undo) >= {_MOST} THEN list_concat(settled, undo[1]) ELSE settled END
      FROM (SELECT state.s, log.n, undo, redo, batch, settled, action, q, CASE WHEN action = 'do' AND batch IS NULL THEN [q] WHEN action = 'commit' AND len(batch) > 0 THEN batch END AS pushed FROM state JOIN log ON log.s = state.s AND log.n = state.n + 1)
    ), last AS (SELECT arg_max(undo, n) AS undo, max_by(coalesce(batch, []::BIGINT[]), n) AS batch, arg_max(settled, n) AS settled, s FROM state GROUP BY s)
    SELECT s AS session, unnest(settled) AS seq, false AS undoable FROM last UNION ALL SELECT s, unnest(batch), false FROM last UNION ALL SELECT s, unnest(flatten(undo)), true FROM last"""
)
def commands_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's events as commands, undone and redone, some in batches, five of which can be undone: what is in force in the end."""
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.expr(_ACTION).alias("action"))
    return history.in_force(log, _MOST)


_TREE = """SELECT 'r' || r_regionkey AS id, NULL::VARCHAR AS parent, r_name AS label FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'order ' || o_orderkey FROM orders"""


@query(
    f"""WITH RECURSIVE tree AS ({_TREE}), hit AS (SELECT * FROM tree WHERE contains(lower(label), '77')),
    above AS (SELECT parent AS id FROM hit WHERE parent IS NOT NULL UNION SELECT parent FROM above JOIN tree USING (id) WHERE parent IS NOT NULL)
    SELECT id, label FROM tree WHERE id IN (SELECT id FROM hit) OR id IN (SELECT id FROM above) OR parent IN (SELECT id FROM hit)"""
)
def tree_search_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, customers and orders as one tree: what a search for a number shows."""
    of = lambda name, id_, parent, label: table(spark, sf_dir, name).select(id_.alias("id"), parent.alias("parent"), label.alias("label"))
    key = lambda mark, name: F.concat(F.lit(mark), F.col(name).cast("string"))
    tree = of("region", key("r", "r_regionkey"), F.lit(None).cast("string"), F.col("r_name"))
    tree = tree.unionByName(of("nation", key("n", "n_nationkey"), key("r", "n_regionkey"), F.col("n_name"))).unionByName(of("customer", key("c", "c_custkey"), key("n", "c_nationkey"), F.col("c_name")))
    tree = tree.unionByName(of("orders", key("o", "o_orderkey"), key("c", "o_custkey"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string"))))
    return select.visible_tree(tree, " 77 ").select("id", "label")


@query(
    """WITH node AS (SELECT vec_id AS nid, vec_id % 101 = 7 AS far FROM embeddings WHERE vec_id % 97 <> 5), element AS (SELECT vec_id AS eid, vec_id // 50 AS pid FROM embeddings),
    part AS (SELECT DISTINCT vec_id // 50 AS pid, (vec_id // 50) % 4 + 1 AS mid FROM embeddings WHERE vec_id // 50 <> 3)
    SELECT 'ERROR' AS severity, 'element' AS category, eid AS item_id, 'pid' AS field, pid AS ref_id FROM element WHERE pid = 3
    UNION ALL SELECT 'ERROR', 'element', eid, 'node' || (pos + 1), eid + pos FROM element, range(8) r(pos) WHERE eid + pos <> 0 AND eid + pos NOT IN (SELECT nid FROM node)
    UNION ALL SELECT 'ERROR', 'part', pid, 'mid', mid FROM part WHERE mid IN (2, 4) UNION ALL SELECT 'WARNING', 'node', nid, 'x,y,z', nid FROM node WHERE far"""
)
def integrity_rechecked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of a deck after nodes, a part and a material were deleted, nodes moved far off and a section added: only what these changes touch is checked again."""
    nodes, elements = mesh_nodes(spark, sf_dir), mesh_elements(spark, sf_dir, whole=False).withColumn("type", F.lit("solid"))
    parts = elements.select("pid").distinct().select("pid", (F.col("pid") % 3 + 1).alias("secid"), (F.col("pid") % 4 + 1).alias("mid"))
    ids = lambda n, key: spark.range(1, n + 1).select(F.col("id").alias(key))
    standing = integrity.check_deck(elements, nodes, parts, ids(2, "secid"), ids(3, "mid"))
    gone, moved = F.col("nid") % 97 == 5, F.col("nid") % 101 == 7
    now = nodes.where(~gone).withColumn("x", F.when(moved, 1e11).otherwise(F.col("x")))
    few = spark.createDataFrame([("part", 3), ("section", 3), ("material", 2)], "category string, item_id bigint")
    changed = few.unionByName(nodes.where(gone | moved).select(F.lit("node").alias("category"), F.col("nid").alias("item_id")))
    found = integrity.recheck(standing, changed, elements, now, parts.where("pid <> 3"), ids(3, "secid"), ids(3, "mid").where("mid <> 2"))
    return found.select("severity", "category", "item_id", "field", "ref_id")


@query(
    """WITH new AS (SELECT l_orderkey AS k, l_linenumber AS line, CASE l_returnflag WHEN 'R' THEN (SELECT min(o_orderkey) FROM orders) WHEN 'A' THEN NULL ELSE l_orderkey END AS before FROM lineitem),
    item AS (SELECT o_orderdate AS d, o_orderkey AS o, 1 AS old, o_orderkey AS k, 0 AS line FROM orders
      UNION ALL SELECT o_orderdate, o_orderkey, 0, new.k, new.line FROM new LEFT JOIN orders ON o_orderkey = before)
    SELECT row_number() OVER (ORDER BY d NULLS LAST, o NULLS LAST, old, k, line) - 1 AS place, k AS order_key, line FROM item"""
)
def ordered_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in the order of their dates, with every line put before its order, those returned before the order of the least key, those accepted at the end."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    rows = ordered.spread(orders.select("o_orderdate", F.col("o_orderkey").alias("order_key"), F.lit(0).alias("line")), ["o_orderdate", "order_key"])
    least = orders.agg(F.min("o_orderkey").alias("least"))  # one row
    before = F.when(F.col("l_returnflag") == "R", F.col("least")).when(F.col("l_returnflag") != "A", F.col("l_orderkey"))
    new = lines.join(F.broadcast(least)).select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").cast("int").alias("line"), before.alias("before"))
    return ordered.places(ordered.insert(rows, new, "order_key", ["order_key", "line"])).select("place", "order_key", "line")


@query(
    """WITH own AS (SELECT c_custkey AS k, c_name AS name, row_number() OVER (ORDER BY c_custkey) - 1 AS place FROM customer),
    item AS (SELECT k AS spot, 1 AS old, k AS id, name FROM own UNION ALL SELECT own.k, 0, s_suppkey, s_name FROM supplier LEFT JOIN own ON place = 7 * (s_suppkey // 2)),
    all_ AS (SELECT row_number() OVER (ORDER BY spot NULLS LAST, old, id) AS n, id, name FROM item),
    left_ AS (SELECT n, id, name FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n) AS i FROM all_) WHERE NOT (i = 1 AND id % 3 = 0))
    SELECT row_number() OVER (ORDER BY n) - 1 AS place, id, CASE WHEN id % 5 = 0 THEN 'order ' || last ELSE name END AS name
    FROM left_ LEFT JOIN (SELECT o_custkey AS id, max(o_orderkey) AS last FROM orders GROUP BY o_custkey) USING (id)"""
)
def ordered_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in order, suppliers put in at every seventh place two by two, the first row of every third id deleted, names set to the latest order of every fifth id."""
    customers, suppliers, orders = (table(spark, sf_dir, name) for name in ("customer", "supplier", "orders"))
    rows = ordered.spread(customers.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), ["id"])
    wanted = suppliers.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), (F.floor(F.col("s_suppkey") / 2) * 7).alias("place"))
    rows = checkpointed(ordered.insert(rows, ordered.at_places(rows, wanted), "at", ["id"]))
    rows = ordered.remove_first(rows, rows.where("id % 3 = 0"), "id")
    ids = rows.select("id").where("id % 5 = 0").distinct()
    new = ids.join(orders.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq")), "id", "left").withColumn("name", F.concat(F.lit("order "), F.col("seq").cast("string")))
    return ordered.places(ordered.change(rows, new, "id", ["name"], "seq")).select("place", "id", "name")
