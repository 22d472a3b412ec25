"""Mesh geometry and adjacency over the mesh view of the embeddings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import adjacency, mesh, select, views
from tessera.plans.base import MESH_SQL, mesh_elements, mesh_nodes, query


def _mesh(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mesh_elements(spark, sf_dir), mesh_nodes(spark, sf_dir)


def _rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = mesh_nodes(spark, sf_dir)
    return nodes.select(F.floor(F.col("nid") / 50).alias("source"), F.col("nid").alias("ray_id"), "x", "y", "z")


_HITS = "ray AS (SELECT CAST(floor(nid / 50) AS BIGINT) AS source, nid AS ray_id, x, y, z FROM node), hit AS (SELECT source, ray_id, pid AS part, greatest(0.0, min_z - z, z - max_z) AS t FROM ray JOIN box ON source <> pid AND x BETWEEN min_x AND max_x AND y BETWEEN min_y AND max_y)"


@query(f"WITH {MESH_SQL} SELECT * FROM box")
def part_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.boxes(*_mesh(spark, sf_dir))


@query(f"WITH {MESH_SQL} SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z, round((min(x) + max(x)) / 2, 6) AS centre_x, round(sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2 + (max(z) - min(z)) ** 2), 6) AS diagonal FROM node")
def global_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = mesh.bounds(mesh_nodes(spark, sf_dir))
    return b.select(*(f"{n}_{c}" for c in "xyz" for n in ("min", "max")), F.round("centre_x", 6).alias("centre_x"), F.round("diagonal", 6).alias("diagonal"))


@query("SELECT e.vec_id AS eid, pos, coalesce(n.vec_id, (SELECT min(vec_id) FROM embeddings)) AS nid FROM embeddings e CROSS JOIN range(8) r(pos) LEFT JOIN embeddings n ON n.vec_id = e.vec_id + pos")
def node_index_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown nodes take the place of the first."""
    nodes = mesh_nodes(spark, sf_dir).select("nid", F.col("nid").alias("x"), F.col("nid").alias("y"), F.col("nid").alias("z"))
    found = mesh.corners(mesh_elements(spark, sf_dir, whole=False), nodes, fallback=True)
    return found.select("eid", F.col("pos").cast("bigint").alias("pos"), F.col("x").alias("nid"))


_FACES = "face AS (SELECT eid, pid, f, list_sort([eid + c[1], eid + c[2], eid + c[3], eid + c[4]]) AS k FROM element, (SELECT unnest(range(6)) AS f, unnest([[0,1,2,3],[4,5,6,7],[0,1,5,4],[1,2,6,5],[2,3,7,6],[3,0,4,7]]) AS c)), once AS (SELECT k, min(pid) AS pid FROM face GROUP BY k HAVING count(*) = 1)"


@query(f"WITH {MESH_SQL}, {_FACES} SELECT pid, count(*) AS faces FROM once GROUP BY pid")
def exterior_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.exterior_faces(mesh_elements(spark, sf_dir)).groupBy("pid").agg(F.count("*").alias("faces"))


@query(f"WITH {MESH_SQL}, {_FACES} SELECT count(*) AS faces, (SELECT count(*) FROM element) AS solids, round(100.0 * (1 - count(*) / (6.0 * (SELECT count(*) FROM element))), 4) AS reduction FROM once")
def face_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = mesh_elements(spark, sf_dir)
    n, f = e.agg(F.count("*").alias("solids")), mesh.exterior_faces(e).agg(F.count("*").alias("faces"))
    return f.join(F.broadcast(n)).select("faces", "solids", F.round(100.0 * (1 - F.col("faces") / (6.0 * F.col("solids"))), 4).alias("reduction"))


@query(f"WITH {MESH_SQL}, {_FACES} SELECT pid, 2 * count(*) AS triangles, 4 * count(*) AS edges FROM once GROUP BY pid")
def face_triangles_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    quads = mesh.exterior_faces(mesh_elements(spark, sf_dir))
    t = mesh.triangles(quads).groupBy("pid").agg(F.count("*").alias("triangles"))
    return t.join(mesh.edges(quads).groupBy("pid").agg(F.count("*").alias("edges")), "pid")


_NORMALS = """wide AS (SELECT eid, pid, max(x) FILTER (pos = 0) x0, max(y) FILTER (pos = 0) y0, max(z) FILTER (pos = 0) z0, max(x) FILTER (pos = 1) x1, max(y) FILTER (pos = 1) y1, max(z) FILTER (pos = 1) z1, max(x) FILTER (pos = 2) x2, max(y) FILTER (pos = 2) y2, max(z) FILTER (pos = 2) z2 FROM placed GROUP BY eid, pid),
raw AS (SELECT pid, (y1-y0)*(z2-z0)-(z1-z0)*(y2-y0) AS a, (z1-z0)*(x2-x0)-(x1-x0)*(z2-z0) AS b, (x1-x0)*(y2-y0)-(y1-y0)*(x2-x0) AS c FROM wide),
unit AS (SELECT pid, a/l AS a, b/l AS b, c/l AS c FROM (SELECT *, sqrt(a*a+b*b+c*c) AS l FROM raw) WHERE l > 1e-10),
mean AS (SELECT pid, avg(a) AS a, avg(b) AS b, avg(c) AS c, 1 / (1 + var_pop(a) + var_pop(b) + var_pop(c)) AS confidence FROM unit GROUP BY pid),
normal AS (SELECT pid, a/l AS nx, b/l AS ny, c/l AS nz, confidence FROM (SELECT *, sqrt(a*a+b*b+c*c) AS l FROM mean) WHERE l > 1e-10)"""


@query(f"WITH {MESH_SQL}, {_NORMALS} SELECT pid, round(nx, 4) AS nx, round(ny, 4) AS ny, round(nz, 4) AS nz, round(confidence, 4) AS confidence, CASE WHEN abs(nx) >= abs(ny) AND abs(nx) >= abs(nz) THEN 'YZ' WHEN abs(ny) >= abs(nz) THEN 'ZX' ELSE 'XY' END AS plane FROM normal")
def part_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = mesh.part_normals(*_mesh(spark, sf_dir))
    return n.select("pid", *(F.round(c, 4).alias(c) for c in ("nx", "ny", "nz", "confidence")), "plane")


@query(
    f"WITH {MESH_SQL}, {_NORMALS} SELECT p.pid AS source, q.pid AS part, round(degrees(acos(greatest(-1.0, least(1.0, a.nx*b.nx+a.ny*b.ny+a.nz*b.nz)))), 3) AS degrees FROM box p JOIN box q ON p.pid <> q.pid AND greatest(0.0, q.min_z - p.max_z, p.min_z - q.max_z) <= 2.0 "
    "LEFT JOIN normal a ON a.pid = p.pid LEFT JOIN normal b ON b.pid = q.pid WHERE coalesce(a.nx*b.nx+a.ny*b.ny+a.nz*b.nz < -0.5, true)"
)
def facing_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of parts within a gap, those whose normals point at each other."""
    elements, nodes = _mesh(spark, sf_dir)
    near = adjacency.within_gap(mesh.boxes(elements, nodes), "z", 2.0)
    found = adjacency.facing(mesh.angles(near, mesh.part_normals(elements, nodes)))
    return found.select("source", "part", F.round("degrees", 3).alias("degrees"))


@query(f"WITH {MESH_SQL} SELECT a.pid AS source, b.pid AS part, round(greatest(0.0, b.min_z - a.max_z, a.min_z - b.max_z), 6) AS gap FROM box a JOIN box b ON a.pid <> b.pid WHERE greatest(0.0, b.min_z - a.max_z, a.min_z - b.max_z) <= 0.3")
def distance_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjacency.within_gap(mesh.boxes(*_mesh(spark, sf_dir)), "z", 0.3).select("source", "part", F.round("gap", 6).alias("gap"))


@query(f"WITH {MESH_SQL} SELECT pid, round(greatest(0.1, (max_z - min_z) * 0.1), 6) AS least, round((max_z - min_z) * 5, 6) AS most FROM box")
def auto_thickness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjacency.search_range(mesh.boxes(*_mesh(spark, sf_dir)), "z").select("pid", F.round("least", 6).alias("least"), F.round("most", 6).alias("most"))


@query("WITH p AS (SELECT vec_id AS nid, CAST(floor(vec_id / 50) AS BIGINT) AS pid FROM embeddings), n AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY nid) - 1 AS place, count(*) OVER (PARTITION BY pid) AS n FROM p) SELECT pid, nid, place FROM n WHERE n <= 7 OR place IN (SELECT CAST(floor(i * (n.n - 1) / 6) AS BIGINT) FROM range(7) r(i))")
def sample_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven evenly spaced nodes of each part."""
    rows = mesh_nodes(spark, sf_dir).select("nid", F.floor(F.col("nid") / 50).alias("pid"))
    return mesh.evenly(rows, "pid", "nid", 7).select("pid", "nid", F.col("place").cast("bigint").alias("place"))


@query(f"WITH {MESH_SQL}, {_HITS} SELECT source, part, count(*) AS hits, round(min(t), 6) AS nearest FROM hit GROUP BY ALL")
def ray_box_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = adjacency.ray_box_hits(_rays(spark, sf_dir), mesh.boxes(*_mesh(spark, sf_dir)))
    return hits.groupBy("source", "part").agg(F.count("*").alias("hits"), F.round(F.min("t"), 6).alias("nearest"))


@query(f"WITH {MESH_SQL}, {_HITS} SELECT source, ray_id, part, round(t, 6) AS t FROM (SELECT *, row_number() OVER (PARTITION BY ray_id ORDER BY t, part) AS n FROM hit) WHERE n = 1")
def ray_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = adjacency.nearest_boxes(_rays(spark, sf_dir), mesh.boxes(*_mesh(spark, sf_dir)))
    return found.select("source", "ray_id", "part", F.round("t", 6).alias("t"))


@query(f"WITH {MESH_SQL}, {_HITS}, n AS (SELECT source, part, count(*) AS hits FROM hit GROUP BY ALL), m AS (SELECT *, max(hits) OVER (PARTITION BY source) AS best FROM n) SELECT source, part, hits, round(hits / best, 6) AS coverage FROM m WHERE hits >= greatest(1, floor(best * 0.5))")
def coverage_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = adjacency.ray_box_hits(_rays(spark, sf_dir), mesh.boxes(*_mesh(spark, sf_dir)))
    return adjacency.coverage(hits, 0.5).select("source", "part", "hits", F.round("coverage", 6).alias("coverage"))


_VISIBLE = "seen AS (SELECT b.pid, (b.min_z + b.max_z) / 2 AS depth FROM box b, box s WHERE s.pid = 4 AND b.pid <> 4 AND b.min_x <= s.max_x AND b.max_x >= s.min_x AND b.min_y <= s.max_y AND b.max_y >= s.min_y AND (b.min_z + b.max_z) / 2 > (s.min_z + s.max_z) / 2)"


@query(f"WITH {MESH_SQL}, {_VISIBLE} SELECT pid, round(depth, 6) AS depth FROM seen")
def occlusion_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjacency.visible(mesh.boxes(*_mesh(spark, sf_dir)), 4).select("pid", F.round("depth", 6).alias("depth"))


@query(f"WITH {MESH_SQL} SELECT pid, round(0.7 + 0.3 * (depth - min(depth) OVER ()) / (max(depth) OVER () - min(depth) OVER ()), 4) AS shade FROM (SELECT pid, avg(z) AS depth FROM placed GROUP BY pid)")
def depth_shading(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = mesh.centroids(*_mesh(spark, sf_dir)).select("pid", F.col("cz").alias("depth"))
    return adjacency.shades(c).select("pid", F.round("shade", 4).alias("shade"))


# An edge of the hull has no point to its right.
_HULL = "pts AS (SELECT DISTINCT pid, x AS u, y AS v FROM placed), edge AS (SELECT a.pid, a.u AS au, a.v AS av, b.u AS bu, b.v AS bv FROM pts a JOIN pts b ON a.pid = b.pid AND (a.u <> b.u OR a.v <> b.v) WHERE NOT EXISTS (SELECT 1 FROM pts c WHERE c.pid = a.pid AND (b.u - a.u) * (c.v - a.v) - (b.v - a.v) * (c.u - a.u) < 0))"


@query(f"WITH {MESH_SQL}, {_HULL} SELECT pid, round(sum(au * bv - av * bu) / 2, 6) AS area, round(sum(sqrt((bu - au) ** 2 + (bv - av) ** 2)), 6) AS perimeter FROM edge GROUP BY pid")
def hull_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area and perimeter of every part's hull in the XY plane."""
    return mesh.projections(*_mesh(spark, sf_dir)).select("pid", F.round("area", 6).alias("area"), F.round("perimeter", 6).alias("perimeter"))


@query(
    f"WITH {MESH_SQL}, tri AS (SELECT a.pid AS part, a.x ax, a.y ay, a.z az, b.x bx, b.y qy, b.z bz, c.x cx, c.y cy, c.z cz FROM placed a JOIN placed b ON a.eid = b.eid AND a.pos = 0 AND b.pos = 1 JOIN placed c ON a.eid = c.eid AND c.pos = 2), "
    "ray AS (SELECT CAST(floor(nid / 50) AS BIGINT) AS source, nid AS ray_id, x, y, z FROM node), m AS (SELECT source, ray_id, part, (bx-ax)*(-(cy-ay)) + (qy-ay)*(cx-ax) AS det, (x-ax)*(-(cy-ay)) + (y-ay)*(cx-ax) AS u, (x-ax)*(qy-ay) - (y-ay)*(bx-ax) AS v, "
    "(cx-ax)*((y-ay)*(bz-az)-(z-az)*(qy-ay)) + (cy-ay)*((z-az)*(bx-ax)-(x-ax)*(bz-az)) + (cz-az)*((x-ax)*(qy-ay)-(y-ay)*(bx-ax)) AS t FROM ray JOIN tri ON source <> part) "
    "SELECT source, part, count(*) AS hits FROM (SELECT *, row_number() OVER (PARTITION BY ray_id ORDER BY t / det, part) AS n FROM m WHERE abs(det) > 1e-8 AND u / det >= 0 AND v / det >= 0 AND u / det + v / det <= 1 AND t / det > 1e-6) WHERE n = 1 GROUP BY ALL"
)
def ray_triangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rays upwards from all nodes on the elements' first triangles: nearest hits by pair."""
    elements, nodes = _mesh(spark, sf_dir)
    c = mesh.corners(elements.select("eid", "pid", F.slice("nodes", 1, 3).alias("nodes")), nodes)
    wide = c.groupBy("eid", F.col("pid").alias("part")).agg(*(F.max(F.when(F.col("pos") == i, F.col(k))).alias(f"{p}{k}") for i, p in enumerate("abc") for k in "xyz"))
    rays = _rays(spark, sf_dir).withColumns({"dx": F.lit(0.0), "dy": F.lit(0.0), "dz": F.lit(1.0)})
    return adjacency.ray_triangles(rays, wide).groupBy("source", "part").agg(F.count("*").alias("hits"))


@query()
def perimeter_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve points at even steps along every part's hull; the walk is tested on a rectangle."""
    ring = mesh.projections(*_mesh(spark, sf_dir)).select("pid", "ring")
    return views.along(ring, "pid", 12).select("pid", "sample", F.round("u", 6).alias("u"), F.round("v", 6).alias("v"))


@query(f"WITH {MESH_SQL} SELECT DISTINCT pid, nid FROM corner WHERE nid <> 0")
def part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of every part once."""
    return mesh.distinct_nodes(mesh_elements(spark, sf_dir))


@query(f"WITH {MESH_SQL} SELECT c.eid, c.pid, pos, nid, x, y, z, 'Part ' || c.pid AS name FROM placed c")
def element_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every element with its part's name and its corners' coordinates."""
    none = spark.createDataFrame([], "pid bigint, name string")
    found = select.element_corners(mesh_elements(spark, sf_dir), none, mesh_nodes(spark, sf_dir))
    return found.withColumn("pos", F.col("pos").cast("bigint"))


@query("SELECT vec_id AS eid, vec_id + 0 AS n1, vec_id + 7 AS n8, 0 AS n9 FROM embeddings WHERE vec_id + 7 IN (SELECT vec_id FROM embeddings)")
def element_flat_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.flat_nodes(mesh_elements(spark, sf_dir), 9).select("eid", "n1", "n8", F.col("n9").cast("bigint").alias("n9"))


@query(f"WITH {MESH_SQL} SELECT eid, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(avg(z), 6) AS cz FROM placed WHERE pos < 4 GROUP BY eid")
def face_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mesh.face_centres(*_mesh(spark, sf_dir))
    return found.select("eid", *(F.round(c, 6).alias(c) for c in ("cx", "cy", "cz")))


@query(f"WITH {MESH_SQL} SELECT pid AS source, i * 5 + j AS ray_id, round(min_x + (max_x - min_x) * i / 4, 6) AS x, round(min_y + (max_y - min_y) * j / 4, 6) AS y, max_z AS z FROM box, range(5) a(i), range(5) b(j)")
def ray_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five by five rays from the upper side of every part's box."""
    found = mesh.ray_grid(mesh.boxes(*_mesh(spark, sf_dir)), "z", 5)
    return found.select("source", F.col("ray_id").cast("bigint").alias("ray_id"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "z")


@query(f"WITH {MESH_SQL}, {_HITS}, total AS (SELECT source, count(*) AS total FROM ray GROUP BY source) SELECT source, part, count(*) AS hits, round(count(*) / any_value(total), 6) AS coverage FROM hit JOIN total USING (source) GROUP BY source, part")
def total_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of all of a part's rays that hit another one."""
    rays = _rays(spark, sf_dir)
    hits = adjacency.ray_box_hits(rays, mesh.boxes(*_mesh(spark, sf_dir)))
    return adjacency.total_coverage(hits, rays).select("source", "part", "hits", F.round("coverage", 6).alias("coverage"))
