"""Regions, rays in any direction and adjacent parts over the mesh view of the embeddings table."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import mesh, rays, regions
from tessera.plans.base import MESH_SQL, mesh_elements, mesh_nodes, query
from tessera.sources.folders import shared_dir


def _mesh(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mesh_elements(spark, sf_dir), mesh_nodes(spark, sf_dir)


#: Rays are cast along the normals of the three planes, and obliquely.
DIRECTIONS = {"XY": (0.0, 0.0, 1.0), "YZ": (1.0, 0.0, 0.0), "ZX": (0.0, 1.0, 0.0), "oblique": (0.48, 0.6, 0.64)}
MOST = 1.5

_QUADS = """hexface AS (SELECT unnest(range(6)) AS f, unnest([[0,1,2,3],[4,5,6,7],[0,1,5,4],[1,2,6,5],[2,3,7,6],[3,0,4,7]]) AS c),
outer_face AS (SELECT min(eid) AS eid, min(pid) AS pid, min(f) AS f, min(c) AS c FROM (SELECT *, list_sort([eid + c[1], eid + c[2], eid + c[3], eid + c[4]]) AS k FROM element, hexface) GROUP BY k HAVING count(*) = 1),
quad AS (SELECT eid, pid, f, a.x ax, a.y ay, a.z az, b.x bx, b.y by_, b.z bz, d.x cx, d.y cy, d.z cz, e.x dx, e.y dy, e.z dz FROM outer_face JOIN node a ON a.nid = eid + c[1] JOIN node b ON b.nid = eid + c[2] JOIN node d ON d.nid = eid + c[3] JOIN node e ON e.nid = eid + c[4])"""
_CAST = f"""direction AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {x}::DOUBLE, {y}::DOUBLE, {z}::DOUBLE)" for k, (x, y, z) in DIRECTIONS.items())}) t(name, ux, uy, uz)),
raw AS (SELECT *, (by_-ay)*(cz-az)-(bz-az)*(cy-ay) AS n1, (bz-az)*(cx-ax)-(bx-ax)*(cz-az) AS n2, (bx-ax)*(cy-ay)-(by_-ay)*(cx-ax) AS n3 FROM quad),
ray AS (SELECT name, pid AS source, eid, f, way, (ax+bx+cx+dx)/4 AS x, (ay+by_+cy+dy)/4 AS y, (az+bz+cz+dz)/4 AS z, way*ux AS vx, way*uy AS vy, way*uz AS vz FROM (SELECT *, sqrt(n1*n1+n2*n2+n3*n3) AS s FROM raw), direction, (VALUES (1), (-1)) w(way)
  WHERE CASE WHEN s > 1e-10 THEN abs((n1*ux+n2*uy+n3*uz)/s) ELSE abs(uz) END > 0.3),
tri AS (SELECT pid AS part, ax, ay, az, bx, by_, bz, cx, cy, cz FROM quad UNION ALL SELECT pid, ax, ay, az, cx, cy, cz, dx, dy, dz FROM quad),
m AS (SELECT name, source, eid, f, way, part, (bx-ax)*(vy*(cz-az)-vz*(cy-ay)) + (by_-ay)*(vz*(cx-ax)-vx*(cz-az)) + (bz-az)*(vx*(cy-ay)-vy*(cx-ax)) AS det,
  (x-ax)*(vy*(cz-az)-vz*(cy-ay)) + (y-ay)*(vz*(cx-ax)-vx*(cz-az)) + (z-az)*(vx*(cy-ay)-vy*(cx-ax)) AS u,
  vx*((y-ay)*(bz-az)-(z-az)*(by_-ay)) + vy*((z-az)*(bx-ax)-(x-ax)*(bz-az)) + vz*((x-ax)*(by_-ay)-(y-ay)*(bx-ax)) AS v,
  (cx-ax)*((y-ay)*(bz-az)-(z-az)*(by_-ay)) + (cy-ay)*((z-az)*(bx-ax)-(x-ax)*(bz-az)) + (cz-az)*((x-ax)*(by_-ay)-(y-ay)*(bx-ax)) AS t FROM ray JOIN tri ON source <> part),
hit AS (SELECT *, t / det AS far FROM m WHERE abs(det) > 1e-6 AND u / det >= 0 AND v / det >= 0 AND u / det + v / det <= 1 AND t / det > 1e-6 AND t / det < {MOST}),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name, source, eid, f, way ORDER BY far, part) AS n FROM hit) WHERE n = 1)"""


@query(f"WITH {MESH_SQL}, {_QUADS}, {_CAST} SELECT name AS direction, source, part, count(*) AS hits, round(min(far), 5) AS nearest FROM first GROUP BY ALL")
def rays_at_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rays from all aligned exterior faces, both ways, along the planes' normals and obliquely, at the faces of other parts; nearest hits by pair."""
    elements, nodes = _mesh(spark, sf_dir)
    placed = rays.face_corners(mesh.exterior_faces(elements), nodes)
    every = [rays.face_rays(placed, d).withColumn("ray_id", F.struct(F.lit(name).alias("direction"), "ray_id")) for name, d in DIRECTIONS.items()]
    found = rays.cast(reduce(DataFrame.unionByName, every), rays.face_triangles(placed), MOST)
    return found.groupBy("ray_id.direction", "source", "part").agg(F.count("*").alias("hits"), F.round(F.min("t"), 5).alias("nearest"))


_ADJACENT = """own AS (SELECT DISTINCT pid, eid + unnest(c) AS nid FROM outer_face),
numbered AS (SELECT own.*, row_number() OVER (PARTITION BY pid ORDER BY nid) - 1 AS place, count(*) OVER (PARTITION BY pid) AS n FROM own JOIN node USING (nid)),
sample AS (SELECT pid AS source, x, y, z FROM numbered JOIN node USING (nid) WHERE n <= 20 OR list_contains(list_transform(range(20), lambda i: floor(i * (n - 1) / 19)::BIGINT), place)),
struck AS (SELECT source, pid AS part, count(*) AS hits FROM sample JOIN box ON source <> pid AND x BETWEEN min_x AND max_x AND y BETWEEN min_y AND max_y AND ((min_z - z <= {most} AND max_z > z) OR (z - max_z <= {most} AND min_z < z)) GROUP BY ALL),
scored AS (SELECT *, max(hits) OVER (PARTITION BY source) AS best FROM struck), kept AS (SELECT *, hits / best AS coverage FROM scored WHERE hits >= greatest(1, floor(best * 0.5)))"""


@query(f"WITH {MESH_SQL}, {_QUADS}, {_ADJACENT.format(most=0.4)} SELECT source, part, hits, round(coverage, 6) AS coverage, (row_number() OVER (PARTITION BY source ORDER BY coverage DESC, part))::INT AS rank FROM kept")
def adjacent_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts next to each part, for all parts at once: candidates, sampled faces, rays and coverage, the best first."""
    kept, _ = rays.adjacent(*_mesh(spark, sf_dir), "XY", most=0.4, count=20, threshold=0.5)
    return kept.select("source", "part", "hits", F.round("coverage", 6).alias("coverage"), "rank")


_STOOD_SQL = MESH_SQL.replace("embedding[1]::DOUBLE AS x", "embedding[1]::DOUBLE + (vec_id // 50) % 3 AS x").replace("embedding[3]::DOUBLE + floor", "embedding[3]::DOUBLE * 0.1 + floor")


@query(
    f"WITH {_STOOD_SQL}, {_QUADS}, {_ADJACENT.format(most=0.9)},"
    " near AS (SELECT a.pid AS source, count(*) AS candidates FROM box a JOIN box b ON a.pid <> b.pid AND greatest(0.0, b.min_z - a.max_z, a.min_z - b.max_z) <= 0.9 GROUP BY 1)"
    " SELECT pid AS source, CASE WHEN s.n IS NULL THEN coalesce(candidates, 0) ELSE -1 END AS candidates, coalesce(s.n, 0) AS struck, coalesce(k.n, 0) AS kept, CASE WHEN k.n IS NULL THEN CASE WHEN candidates IS NULL THEN 'no candidates' ELSE 'no hits' END END AS reason"
    " FROM box LEFT JOIN near ON near.source = pid LEFT JOIN (SELECT source, count(*) AS n FROM struck GROUP BY 1) s ON s.source = pid LEFT JOIN (SELECT source, count(*) AS n FROM kept GROUP BY 1) k ON k.source = pid"
)
def adjacent_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why parts of a mesh, in which every third stands over another, have none next to them; candidates are -1 where they aren't counted."""
    elements, nodes = _mesh(spark, sf_dir)
    part = F.floor(F.col("nid") / 50)
    stood = nodes.select("nid", (F.col("x") + part % 3).alias("x"), "y", ((F.col("z") - part * 0.5) * 0.1 + part * 0.5).alias("z"))
    return rays.adjacent(elements, stood, "XY", most=0.9, count=20, threshold=0.5)[1].fillna(-1, ["candidates"])


@query(f"WITH {MESH_SQL} SELECT a.pid AS region, b.pid, round(greatest(0.0, b.min_z - a.max_z, a.min_z - b.max_z), 6) AS gap FROM box a JOIN box b ON a.pid <> b.pid AND a.min_x <= b.max_x AND b.min_x <= a.max_x AND a.min_y <= b.max_y AND b.min_y <= a.max_y AND a.min_z - 0.25 <= b.max_z AND b.min_z <= a.max_z + 0.25")
def boxes_meeting_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's box, grown along z, as a region: the other boxes that it meets."""
    boxes = mesh.boxes(*_mesh(spark, sf_dir))
    grid = regions.Grid.of(boxes)
    met = regions.meeting(regions.keyed(boxes, grid), regions.grown(boxes, "pid", {"z": 0.25}), grid).where("region <> pid")
    own = boxes.select(F.col("pid").alias("region"), F.col("min_z").alias("low"), F.col("max_z").alias("high"))
    return met.join(own, "region").select("region", "pid", F.round(F.greatest(F.lit(0.0), F.col("min_z") - F.col("high"), F.col("low") - F.col("max_z")), 6).alias("gap"))


@query(f"WITH {MESH_SQL} SELECT nid, pid FROM node JOIN box ON x BETWEEN min_x AND max_x AND y BETWEEN min_y AND max_y AND z BETWEEN min_z AND max_z")
def points_in_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every node the parts whose boxes contain it."""
    elements, nodes = _mesh(spark, sf_dir)
    boxes = mesh.boxes(elements, nodes)
    grid = regions.Grid.of(boxes)
    return regions.meeting(regions.keyed(boxes, grid), regions.points(nodes, "nid"), grid).select(F.col("region").alias("nid"), "pid")


@query(f"WITH {MESH_SQL}, each AS (SELECT eid, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM placed GROUP BY eid) SELECT eid FROM each WHERE min_x <= 0.1 AND max_x >= -0.1 AND min_y <= 0.1 AND max_y >= -0.1 AND min_z <= 2.5 AND max_z >= 2.0")
def stored_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements' boxes written in the order of their keys; those that meet one region, by ranges of keys."""
    elements, nodes = _mesh(spark, sf_dir)
    boxes = mesh.boxes(elements.withColumn("pid", F.col("eid")), nodes).withColumnRenamed("pid", "eid")
    grid = regions.Grid.of(boxes)
    path = f"{shared_dir(spark)}/boxes-{uuid.uuid4().hex}"
    regions.keyed(boxes, grid).repartitionByRange("level", "cell").sortWithinPartitions("level", "cell").write.parquet(path)
    return regions.within(spark.read.parquet(path), grid, (-0.1, -0.1, 2.0), (0.1, 0.1, 2.5)).select("eid")
