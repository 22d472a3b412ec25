"""Registration of queries with the SQL that checks them, and the views over the given tables that they share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: Parts of the mesh view hold so many elements; each is lifted half a unit over the one before.
PART_SIZE = 50


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name, with the SQL for the same rows."""

    def add(run):
        QUERIES[run.__name__] = run
        if sql:
            ORACLE[run.__name__] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mesh_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    at = lambda i: F.get("embedding", i).cast("double")
    return e.select(F.col("vec_id").alias("nid"), at(0).alias("x"), at(1).alias("y"), (at(2) + F.floor(F.col("vec_id") / PART_SIZE) * 0.5).alias("z"))


def mesh_elements(spark: SparkSession, sf_dir: str, whole: bool = True) -> DataFrame:
    """Eight consecutive nodes each; with whole, only those whose last node exists."""
    e = table(spark, sf_dir, "embeddings").select("vec_id")
    if whole:
        e = e.join(e.select((F.col("vec_id") - 7).alias("vec_id")), "vec_id", "left_semi")
    return e.select(F.col("vec_id").alias("eid"), F.floor(F.col("vec_id") / PART_SIZE).alias("pid"), F.sequence(F.col("vec_id"), F.col("vec_id") + 7).alias("nodes"))


#: The same views in DuckDB.
MESH_SQL = """
node AS (SELECT vec_id AS nid, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE + floor(vec_id / 50) * 0.5 AS z FROM embeddings),
element AS (SELECT vec_id AS eid, CAST(floor(vec_id / 50) AS BIGINT) AS pid FROM embeddings e WHERE vec_id + 7 IN (SELECT vec_id FROM embeddings)),
corner AS (SELECT eid, pid, pos, eid + pos AS nid FROM element, range(8) AS r(pos)),
placed AS (SELECT c.*, n.x, n.y, n.z FROM corner c JOIN node n USING (nid)),
box AS (SELECT pid, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM placed GROUP BY pid)
"""


def part_deck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deck lines (file, line_no, line) written from the part table: a *PART section of three lines for each row."""
    p = table(spark, sf_dir, "part")
    card = F.concat(*[F.lpad(F.col(c).cast("string"), 10, " ") for c in ("p_partkey", "p_size")], F.lpad(F.floor("p_retailprice").cast("string"), 10, " "))
    body = F.array(F.lit("*PART"), F.col("p_name"), card)
    rows = p.select(F.col("p_partkey"), F.posexplode(body).alias("i", "line"))
    return rows.select(F.lit("part").alias("file"), (F.col("p_partkey") * 4 + F.col("i")).alias("line_no"), "line")
