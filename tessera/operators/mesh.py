"""Mesh geometry on nodes (nid, x, y, z) and elements (eid, pid, nodes)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Corners of the six faces of a hexahedron. Faces are found by their sorted corners, so the order of faces and of
# corners round a face is free; here the two ends come first and then the sides in turn.
HEX_FACES = ((0, 1, 2, 3), (4, 5, 6, 7), (0, 1, 5, 4), (1, 2, 6, 5), (2, 3, 7, 6), (3, 0, 4, 7))
PLANES = {"YZ": ("x", ("y", "z")), "ZX": ("y", ("z", "x")), "XY": ("z", ("x", "y"))}


def element_nodes(elements: DataFrame) -> DataFrame:
    """eid, pid, pos, nid for every corner of every element."""
    return elements.select("eid", "pid", F.posexplode("nodes").alias("pos", "nid"))


def corners(elements: DataFrame, nodes: DataFrame, fallback: bool = False) -> DataFrame:
    """Corners with coordinates. Unknown nodes are left out, or with fallback take the place of the first node."""
    own = element_nodes(elements)
    if not fallback:
        return own.join(nodes.select("nid", "x", "y", "z"), "nid")
    first = nodes.agg(*(F.min_by(c, "nid").alias(f"first_{c}") for c in "xyz"))  # one row
    found = own.join(nodes.select("nid", "x", "y", "z"), "nid", "left").join(F.broadcast(first))
    return found.select("eid", "pid", "pos", "nid", *(F.coalesce(c, f"first_{c}").alias(c) for c in "xyz"))


def boxes(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """pid and the least and greatest coordinates of its corners."""
    return corners(elements, nodes).groupBy("pid").agg(*(f(c).alias(f"{n}{c}") for c in "xyz" for f, n in ((F.min, "min_"), (F.max, "max_"))))


def bounds(nodes: DataFrame) -> DataFrame:
    """One row: least and greatest coordinates, centre and diagonal of the whole model."""
    box = nodes.agg(*(f(c).alias(f"{n}{c}") for c in "xyz" for f, n in ((F.min, "min_"), (F.max, "max_"))))
    side = lambda c: F.col(f"max_{c}") - F.col(f"min_{c}")
    centres = [((F.col(f"max_{c}") + F.col(f"min_{c}")) / 2).alias(f"centre_{c}") for c in "xyz"]
    return box.select("*", *centres, F.sqrt(sum(side(c) * side(c) for c in "xyz")).alias("diagonal"))


def faces(elements: DataFrame) -> DataFrame:
    """eid, pid, face and its four corner ids, six for each element of eight nodes."""
    quads = F.array(*[F.array(*[F.get("nodes", i) for i in face]) for face in HEX_FACES])
    return elements.where(F.size("nodes") == 8).select("eid", "pid", F.posexplode(quads).alias("face", "corners"))


def exterior_faces(elements: DataFrame) -> DataFrame:
    """Faces whose set of corners occurs once over all parts."""
    keyed = faces(elements).withColumn("key", F.array_sort("corners"))
    once = keyed.groupBy("key").agg(F.count("*").alias("n"), F.first(F.struct("eid", "pid", "face", "corners")).alias("one")).where("n = 1")
    return once.select("one.*")


def triangles(quads: DataFrame) -> DataFrame:
    """Two triangles, (0, 1, 2) and (0, 2, 3), for each face."""
    c = lambda i: F.get("corners", i)
    two = F.array(F.struct(c(0).alias("a"), c(1).alias("b"), c(2).alias("c")), F.struct(c(0).alias("a"), c(2).alias("b"), c(3).alias("c")))
    return quads.select("eid", "pid", "face", F.posexplode(two).alias("half", "t")).select("eid", "pid", "face", "half", "t.*")


def edges(quads: DataFrame) -> DataFrame:
    """Four edges for each face."""
    c = lambda i: F.get("corners", i)
    four = F.array(*[F.struct(c(i).alias("a"), c((i + 1) % 4).alias("b")) for i in range(4)])
    return quads.select("eid", "pid", "face", F.explode(four).alias("e")).select("eid", "pid", "face", "e.*")


def cross(ax, ay, az, bx, by, bz) -> tuple[Column, Column, Column]:
    return ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx


def element_normals(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """eid, pid and the unit normal over an element's first three corners; degenerate ones are left out."""
    three = corners(elements.select("eid", "pid", F.slice("nodes", 1, 3).alias("nodes")), nodes)
    at = lambda c, i: F.max(F.when(F.col("pos") == i, F.col(c))).alias(f"{c}{i}")
    wide = three.groupBy("eid", "pid").agg(*(at(c, i) for c in "xyz" for i in range(3)))
    side = lambda c, i: F.col(f"{c}{i}") - F.col(f"{c}0")
    n = cross(*(side(c, 1) for c in "xyz"), *(side(c, 2) for c in "xyz"))
    found = wide.select("eid", "pid", *(v.alias(k) for k, v in zip(("nx", "ny", "nz"), n, strict=True))).withColumn("length", F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz")))
    return found.where("length > 1e-10").select("eid", "pid", *((F.col(c) / F.col("length")).alias(c) for c in ("nx", "ny", "nz")))


def part_normals(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """pid, mean unit normal, confidence 1 / (1 + summed variance), and the plane of its greatest axis."""
    means = element_normals(elements, nodes).groupBy("pid").agg(*(F.avg(c).alias(f"m{c}") for c in ("nx", "ny", "nz")), (F.var_pop("nx") + F.var_pop("ny") + F.var_pop("nz")).alias("spread"))
    length = F.sqrt(sum(F.col(f"m{c}") * F.col(f"m{c}") for c in ("nx", "ny", "nz")))
    unit = means.withColumn("length", length).where("length > 1e-10").select("pid", *((F.col(f"m{c}") / F.col("length")).alias(c) for c in ("nx", "ny", "nz")), (1 / (1 + F.col("spread"))).alias("confidence"))
    x, y, z = (F.abs(c) for c in ("nx", "ny", "nz"))
    return unit.withColumn("plane", F.when((x >= y) & (x >= z), "YZ").when(y >= z, "ZX").otherwise("XY"))


def angles(pairs: DataFrame, normals: DataFrame) -> DataFrame:
    """Pairs (source, part) with the dot product and the angle of their normals in degrees; null where a part has none."""
    side = lambda p, key: normals.select(F.col("pid").alias(key), *(F.col(c).alias(f"{p}{c}") for c in ("nx", "ny", "nz")))
    both = pairs.join(side("a", "source"), "source", "left").join(side("b", "part"), "part", "left")
    dot = F.col("anx") * F.col("bnx") + F.col("any") * F.col("bny") + F.col("anz") * F.col("bnz")
    return both.select("source", "part", dot.alias("dot")).withColumn("degrees", F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("dot"))))))


def centroids(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """pid and the mean of its corners, a node counting once for each element it is in."""
    return corners(elements, nodes).groupBy("pid").agg(*(F.avg(c).alias(f"c{c}") for c in "xyz"))


def _turn(o, a, b) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Convex hull of points, counter-clockwise from the least; points on an edge are left out."""
    points = sorted(set(points))
    if len(points) < 3:
        return points
    halves = []
    for order in (points, points[::-1]):
        half: list = []
        for p in order:
            while len(half) > 1 and _turn(half[-2], half[-1], p) <= 0:
                half.pop()
            half.append(p)
        halves.append(half[:-1])
    return halves[0] + halves[1]


def projections(elements: DataFrame, nodes: DataFrame, plane: str = "XY") -> DataFrame:
    """pid, the hull of its corners in a plane as an ordered array of (u, v), its area and perimeter.

    Hulls are first taken within each task and then of these hulls' points, so no task gets all
    the points of a part. Parts without three points off a line give no row.
    """
    u, v = PLANES[plane][1]
    flat = corners(elements, nodes).select("pid", F.col(u).alias("u"), F.col(v).alias("v"))

    def within(frames):
        for frame in frames:
            parts = [(pid, *p) for pid, own in frame.groupby("pid") for p in hull(list(zip(own.u, own.v, strict=True)))]
            yield pd.DataFrame(parts, columns=["pid", "u", "v"])

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        points = hull(list(zip(frame.u, frame.v, strict=True)))
        return pd.DataFrame([(frame.pid.iloc[0], i, *p) for i, p in enumerate(points)], columns=["pid", "i", "u", "v"])

    schema = f"pid {elements.schema['pid'].dataType.simpleString()}, u double, v double"
    ring = flat.mapInPandas(within, schema).groupBy("pid").applyInPandas(whole, schema.replace("u double", "i int, u double"))
    points = ring.groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("i", "u", "v"))).alias("ring"))
    return points.select("pid", "ring", area(F.col("ring")).alias("area"), perimeter(F.col("ring")).alias("perimeter")).where("area > 1e-12")


def _around(ring: Column, value) -> Column:
    """Sum of value(point, next point) around a closed ring."""
    after = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, F.lit(1), F.lit(1)))
    return F.aggregate(F.zip_with(ring, after, value), F.lit(0.0), lambda a, x: a + x)


def area(ring: Column) -> Column:
    return F.abs(_around(ring, lambda p, q: p["u"] * q["v"] - q["u"] * p["v"])) / 2


def perimeter(ring: Column) -> Column:
    return _around(ring, lambda p, q: F.sqrt((q["u"] - p["u"]) * (q["u"] - p["u"]) + (q["v"] - p["v"]) * (q["v"] - p["v"])))


#: Values of the order that one task sorts at a time.
_SPAN = 65_536


def evenly(rows: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """k evenly spaced rows of each key: those at int(i * (n - 1) / (k - 1)) in order; all where there are no more than k.

    order is a number. Rows are sorted in spans of it, and a row's place is that in its span and the rows of the spans before.
    """
    spanned = rows.withColumn("_span", F.floor(F.col(order) / _SPAN))
    every = Window.partitionBy(key)
    sizes = spanned.groupBy(key, "_span").agg(F.count("*").alias("_n")).select(key, "_span", (F.sum("_n").over(every.orderBy("_span")) - F.col("_n")).alias("_before"), F.sum("_n").over(every).alias("n"))
    numbered = spanned.withColumn("place", F.row_number().over(Window.partitionBy(key, "_span").orderBy(order)) - 1).join(sizes, [key, "_span"])
    numbered = numbered.withColumn("place", F.col("place") + F.col("_before"))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (F.col("n") - 1) / max(k - 1, 1)))
    return numbered.where((F.col("n") <= k) | F.array_contains(wanted, F.col("place").cast("bigint"))).drop("n", "_span", "_before")


def distinct_nodes(elements: DataFrame) -> DataFrame:
    """pid and nid: every node of a part once."""
    return element_nodes(elements).where("nid <> 0").select("pid", "nid").distinct()


def face_centres(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """eid, pid, the mean cx, cy, cz of an element's first four corners, and its unit normal, along z where it is degenerate."""
    four = corners(elements.select("eid", "pid", F.slice("nodes", 1, 4).alias("nodes")), nodes)
    centre = four.groupBy("eid", "pid").agg(*(F.avg(c).alias(f"c{c}") for c in "xyz"))
    found = centre.join(element_normals(elements, nodes).drop("pid"), "eid", "left")
    return found.select("eid", "pid", "cx", "cy", "cz", F.coalesce("nx", F.lit(0.0)).alias("nx"), F.coalesce("ny", F.lit(0.0)).alias("ny"), F.coalesce("nz", F.lit(1.0)).alias("nz"))


def ray_grid(boxes: DataFrame, axis: str, count: int, positive: bool = True) -> DataFrame:
    """source, ray_id, x, y, z: ``count`` by ``count`` evenly spaced points on the far or near side of each part's box along the axis."""
    u, v = [c for c in "xyz" if c != axis]
    at = lambda c, i: F.col(f"min_{c}") + (F.col(f"max_{c}") - F.col(f"min_{c}")) * (F.col(i) / (count - 1) if count > 1 else F.lit(0.5))
    steps = F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    grid = boxes.withColumn("i", steps).withColumn("j", steps)
    place = {u: at(u, "i"), v: at(v, "j"), axis: F.col(f"{'max' if positive else 'min'}_{axis}")}
    return grid.select(F.col("pid").alias("source"), (F.col("i") * count + F.col("j")).alias("ray_id"), *(place[c].alias(c) for c in "xyz"))
