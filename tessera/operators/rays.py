"""Rays in any direction, up to a distance: against triangles, and against the boxes of adjacent parts.

Rays walk through cells in three dimensions: the distances at which a ray crosses the cells' sides,
axis by axis, part it into steps, and each step's middle says its cell. Triangles lie in the cells
of their boxes, larger ones in wider cells, a level for each; both meet by key, in levels that are in use.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import adjacency, mesh, regions

AXES = "xyz"
#: Direction of the rays of each plane.
NORMALS = {"XY": (0.0, 0.0, 1.0), "YZ": (1.0, 0.0, 0.0), "ZX": (0.0, 1.0, 0.0)}
#: A ray takes about so many cells of the finest level, at most.
_STEPS = 16
#: Cells of its level that a triangle may be long.
_LONG = 2
#: Share of a cell by which triangles are grown, beyond what rounding can shift a step.
_SLACK = 1e-6


def face_corners(faces: DataFrame, nodes: DataFrame) -> DataFrame:
    """faces (eid, pid, face, corners) with the places of the four corners, ax .. dz; faces of unknown nodes go."""
    placed = faces.select("eid", "pid", "face", F.posexplode("corners").alias("pos", "nid")).join(nodes.select("nid", *AXES), "nid")
    at = [F.max(F.when(F.col("pos") == i, F.col(c))).alias(f"{p}{c}") for i, p in enumerate("abcd") for c in AXES]
    return placed.groupBy("eid", "pid", "face").agg(*at, F.count("*").alias("n")).where("n = 4").drop("n")


def face_rays(placed: DataFrame, direction: tuple[float, float, float], least: float = 0.3) -> DataFrame:
    """Rays (source, ray_id, x .. dz) from the centres of faces, both ways, where the face's normal and the direction are aligned by more than least.

    A face without a normal counts as facing along z. ray_id is a struct of element, face and way.
    """
    length = math.sqrt(sum(v * v for v in direction))
    unit = [v / length for v in direction]
    side = lambda p, c: F.col(f"{p}{c}") - F.col(f"a{c}")
    n = mesh.cross(*(side("b", c) for c in AXES), *(side("c", c) for c in AXES))
    size = F.sqrt(sum(v * v for v in n))
    normal = [F.when(size > 1e-10, v / size).otherwise(F.lit(1.0 if c == "z" else 0.0)) for v, c in zip(n, AXES, strict=True)]
    aligned = placed.where(F.abs(sum(v * u for v, u in zip(normal, unit, strict=True))) > least)
    centre = [((F.col(f"a{c}") + F.col(f"b{c}") + F.col(f"c{c}") + F.col(f"d{c}")) / 4).alias(c) for c in AXES]
    both = aligned.select("pid", "eid", "face", *centre, F.explode(F.array(F.lit(1), F.lit(-1))).alias("way"))
    return both.select(F.col("pid").alias("source"), F.struct("eid", "face", "way").alias("ray_id"), *AXES, *((F.col("way") * F.lit(u)).alias(f"d{c}") for u, c in zip(unit, AXES, strict=True)))


def face_triangles(placed: DataFrame) -> DataFrame:
    """Triangles (part, ax .. cz) of faces, two for each."""
    one = [F.col(f"{p}{c}") for p in "abc" for c in AXES]
    two = [F.col(f"{q}{c}").alias(f"{p}{c}") for p, q in zip("abc", "acd", strict=True) for c in AXES]
    return placed.select(F.col("pid").alias("part"), F.explode(F.array(F.struct(*one), F.struct(*two))).alias("t")).select("part", "t.*")


def _reached(o: Column, d: Column, w: Column):
    """How far a cell's side is along a ray."""
    return lambda side: (side * w - o) / d


def _walked(rays: DataFrame, width: float, levels: list[int], most: float) -> DataFrame:
    """Rays with level and the cells cx, cy, cz that they cross within most."""
    own = rays.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).withColumn("w", F.lit(width) * F.pow(F.lit(2.0), "level"))
    marks = [F.array(F.lit(0.0), F.lit(float(most)))]
    for c in AXES:
        o, d, w = F.col(c), F.col(f"d{c}"), F.col("w")
        ends = F.floor(o / w), F.floor((o + d * most) / w)
        sides = F.sequence(F.least(*ends) + 1, F.greatest(*ends))
        marks.append(F.when((F.abs(d) > 1e-12) & (ends[0] != ends[1]), F.transform(sides, _reached(o, d, w))).otherwise(F.array().cast("array<double>")))
    stops = F.filter(F.concat(*marks), lambda t: (t >= 0) & (t <= most))
    own = own.withColumn("stops", F.array_sort(stops))
    middles = F.zip_with(F.slice("stops", F.lit(1), F.size("stops") - 1), F.slice("stops", F.lit(2), F.size("stops") - 1), lambda a, b: (a + b) / 2)
    cells = F.array_distinct(F.transform(middles, lambda t: F.struct(*(F.floor((F.col(c) + F.col(f"d{c}") * t) / F.col("w")).alias(f"c{c}") for c in AXES))))
    return own.withColumn("cell", F.explode(cells)).select(*rays.columns, "level", "cell.*")


def cast(rays: DataFrame, triangles: DataFrame, most: float, candidates: DataFrame | None = None, parallel: float = 1e-6) -> DataFrame:
    """Nearest hit (source, ray_id, part, t) of each ray on triangles of other parts, nearer than most.

    rays: source, ray_id, x, y, z and a direction dx, dy, dz of any length but 0; t is a distance. triangles: part, ax .. cz.
    With candidates (source, part) only these pairs count. Of equally near parts the one with the smallest id is hit;
    what is nearer than 1e-6 isn't. Null or unknown coordinates hit nothing.
    """
    length = F.sqrt(sum(F.col(f"d{c}") * F.col(f"d{c}") for c in AXES))
    rays = rays.withColumn("length", length).where("length > 0").select("source", "ray_id", *AXES, *((F.col(f"d{c}") / F.col("length")).alias(f"d{c}") for c in AXES))
    if candidates is not None:
        rays = rays.join(candidates.select("source").distinct(), "source", "left_semi")
        triangles = triangles.join(candidates.select("part").distinct(), "part", "left_semi")
    low = {c: F.least(*(F.col(f"{p}{c}") for p in "abc")) for c in AXES}
    high = {c: F.greatest(*(F.col(f"{p}{c}") for p in "abc")) for c in AXES}
    sized = triangles.withColumn("size", F.greatest(*(high[c] - low[c] for c in AXES)))
    width = max(sized.agg(F.avg("size")).first()[0] or 0.0, most / _STEPS, 1e-9)
    sized = sized.withColumn("level", F.when(F.col("size") > _LONG * width, F.ceil(F.log2(F.col("size") / (_LONG * width)))).otherwise(0).cast("int"))
    levels = sorted(r[0] for r in sized.select("level").distinct().collect() if r[0] is not None)  # a few dozen at most
    if not levels:
        return rays.select("source", "ray_id", F.lit(None).cast("bigint").alias("part"), F.lit(None).cast("double").alias("t")).where("false")
    w = F.lit(width) * F.pow(F.lit(2.0), "level")
    celled = sized
    for c in AXES:
        celled = celled.withColumn(f"c{c}_", F.explode(F.sequence(F.floor((low[c] - _SLACK * w) / w), F.floor((high[c] + _SLACK * w) / w))))
    # a triangle's corners are called ax .. cz, and so would its cell be
    celled = celled.drop("size").withColumnsRenamed({f"c{c}": f"k{c}" for c in AXES}).withColumnsRenamed({f"c{c}_": f"c{c}" for c in AXES})
    met = _walked(rays, width, levels, most).join(celled, ["level", "cx", "cy", "cz"]).where("source <> part")
    if candidates is not None:
        met = met.join(candidates.select("source", "part"), ["source", "part"], "left_semi")
    e1, e2 = [[F.col(f"{p}{k}") - F.col(f"a{k}") for k in AXES] for p in "bk"]
    d, o = [F.col(f"d{k}") for k in AXES], [F.col(k) - F.col(f"a{k}") for k in AXES]
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    h, q = mesh.cross(*d, *e2), mesh.cross(*o, *e1)
    found = met.select("source", "ray_id", "part", dot(e1, h).alias("det"), dot(o, h).alias("u"), dot(d, q).alias("v"), dot(e2, q).alias("t")).where(F.abs("det") > parallel)
    found = found.select("source", "ray_id", "part", *((F.col(k) / F.col("det")).alias(k) for k in "uvt")).where("u >= 0 AND v >= 0 AND u + v <= 1 AND t > 1e-6").where(F.col("t") < most)
    return adjacency.nearest(found)


def samples(elements: DataFrame, nodes: DataFrame, count: int) -> DataFrame:
    """source and ``points``, an array of at most count places: evenly spaced ones of the nodes, in the order of their ids, that a part's exterior faces have."""
    own = mesh.exterior_faces(elements).select("pid", F.explode("corners").alias("nid")).distinct()
    chosen = mesh.evenly(own.join(nodes.select("nid"), "nid", "left_semi"), "pid", "nid", count)
    return chosen.join(nodes.select("nid", *AXES), "nid").groupBy(F.col("pid").alias("source")).agg(F.collect_list(F.struct(*AXES)).alias("points"))


def _struck(point: Column, axis: str, most: float) -> Column:
    """Whether a ray along the axis, one way or the other, meets the box min_x .. max_z within most."""
    inside = F.lit(True)
    for c in AXES:
        if c != axis:
            inside = inside & point[c].between(F.col(f"min_{c}"), F.col(f"max_{c}"))
    low, high = F.col(f"min_{axis}") - point[axis], F.col(f"max_{axis}") - point[axis]
    return inside & (((low <= most) & (high > 0)) | ((-high <= most) & (low < 0)))


def adjacent(elements: DataFrame, nodes: DataFrame, plane: str = "XY", most: float = 1.0, count: int = 100, threshold: float = 0.1, layer_mode: bool = False) -> tuple[DataFrame, DataFrame]:
    """For all parts at once: the parts that lie next to each, and a diagnosis of every part.

    First: source, part, hits, coverage and rank, the place by coverage and then by id. Second: source, candidates, struck, kept and ``reason``,
    why none was kept, null where one was; candidates are counted, parts within the gap, where none was struck, and null elsewhere.

    Candidates are parts no further apart than most along the plane's normal. Rays are cast, along it and both ways, from evenly
    spaced nodes of the source's exterior faces; what has fewer hits than the threshold's share of the best is dropped. Only candidates whose
    boxes meet the source's, grown by most along the normal, can be hit, so pairs are made of these alone, and a pair's rays are
    counted in its row. With layer_mode every candidate counts as hit once.
    """
    axis = PLANE_AXIS[plane]
    boxes = mesh.boxes(elements, nodes)
    points = samples(elements, nodes, count)
    if layer_mode:
        hits = adjacency.within_gap(boxes, axis, most).select("source", "part", F.lit(1).cast("bigint").alias("hits"))
    else:
        grid = regions.Grid.of(boxes)
        pairs = regions.meeting(regions.keyed(boxes, grid), regions.grown(boxes, "pid", {axis: most}), grid).where("pid <> region")
        rayed = pairs.withColumnRenamed("region", "source").join(points, "source")
        hits = rayed.select("source", F.col("pid").alias("part"), F.size(F.filter("points", lambda p: _struck(p, axis, most))).cast("bigint").alias("hits")).where("hits > 0")
    best = F.max("hits").over(Window.partitionBy("source"))
    scored = hits.withColumn("best", best).withColumn("coverage", F.col("hits") / F.col("best")).where(F.col("hits") >= F.greatest(F.lit(1), F.floor(F.col("best") * threshold)))
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("coverage"), "part"))
    kept = scored.select("source", "part", "hits", "coverage", rank.alias("rank"))
    counted = lambda rows, name: rows.groupBy("source").agg(F.count("*").alias(name))
    whole = boxes.select(F.col("pid").alias("source")).join(points.select("source", F.lit(True).alias("shown")), "source", "left")
    for rows, name in ((hits, "struck"), (kept, "kept")):
        whole = whole.join(counted(rows, name), "source", "left").fillna(0, [name])
    quiet = boxes.join(hits.select(F.col("source").alias("pid")).distinct(), "pid", "left_anti")
    near = counted(adjacency.within_gap(boxes, axis, most, quiet), "candidates")
    whole = whole.join(near, "source", "left").withColumn("candidates", F.when(F.col("struck") == 0, F.coalesce("candidates", F.lit(0))))
    reason = F.when(F.col("kept") > 0, None).when(F.col("shown").isNull(), "no exterior faces").when(F.col("candidates") == 0, "no candidates").when(F.col("struck") == 0, "no hits").otherwise("below threshold")
    return kept, whole.select("source", "candidates", "struck", "kept", reason.alias("reason"))


PLANE_AXIS = {plane: axis for plane, (axis, _) in mesh.PLANES.items()}
