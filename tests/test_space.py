"""Regions and rays against plain versions on made meshes."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import mesh, rays, regions

BOX = "pid bigint, min_x double, max_x double, min_y double, max_y double, min_z double, max_z double"


def boxes(seed, n):
    r = random.Random(seed)
    out = []
    for i in range(n):
        size = 100 if i % 31 == 0 else 10 ** r.uniform(-2, 0.5)
        at = [r.uniform(-20, 20) for _ in range(3)]
        ends = [(v, v + size * r.choice([0, 0.5, 1])) for v in at]
        out.append((i, *(v for e in ends for v in e)))
    return [*out, (n, None, 1.0, 0.0, 1.0, 0.0, 1.0)]


def meets(a, b):
    return None not in a and None not in b and all(a[1 + 2 * k] <= b[2 + 2 * k] and b[1 + 2 * k] <= a[2 + 2 * k] for k in range(3))


@pytest.mark.parametrize("seed", [1, 2])
def test_meeting(spark, seed, tmp_path):
    ours, theirs = boxes(seed, 150), [*boxes(seed + 10, 60), (99, -1000.0, 1000.0, -1000.0, 1000.0, -1000.0, 1000.0), (98, 5.0, 5.0, 5.0, 5.0, 5.0, 5.0)]
    b = spark.createDataFrame(ours, BOX)
    grid = regions.Grid.of(b)
    keyed = regions.keyed(b, grid)
    got = regions.meeting(keyed, spark.createDataFrame(theirs, BOX).withColumnRenamed("pid", "region"), grid).select("pid", "region").collect()
    assert sorted(map(tuple, got)) == sorted((x[0], y[0]) for x in ours for y in theirs if meets(x, y))
    keyed.write.parquet(str(tmp_path / "keyed"))
    keyed = spark.read.parquet(str(tmp_path / "keyed"))
    for low, high in (((-5, -5, -5), (5, 5, 5)), ((0, 0, 0), (0, 0, 0)), ((-1e3,) * 3, (1e3,) * 3), ((19, 19, 19), (30, 30, 30))):
        region = (0, *(float(v) for e in zip(low, high, strict=True) for v in e))
        found = [r.pid for r in regions.within(keyed, grid, low, high).collect()]
        assert sorted(found) == sorted(x[0] for x in ours if meets(x, region))
    assert regions.meeting(keyed.limit(0), spark.createDataFrame(theirs, BOX).withColumnRenamed("pid", "region"), regions.Grid.of(b.limit(0))).count() == 0


def test_keys_prune(spark, tmp_path):
    b = spark.createDataFrame([x for x in boxes(3, 2000) if None not in x], BOX)
    grid = regions.Grid.of(b)
    regions.keyed(b, grid).orderBy("level", "cell").write.parquet(str(tmp_path / "b"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000000")
    try:
        plan = regions.within(spark.read.parquet(str(tmp_path / "b")), grid, (0, 0, 0), (1, 1, 1))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(cell" in plan.partition("PushedFilters")[2]


def hit(ray, tri):
    o, d = ray[2:5], ray[5:8]
    a, b, c = tri[1:4], tri[4:7], tri[7:10]
    sub = lambda p, q: [x - y for x, y in zip(p, q, strict=True)]
    cross = lambda p, q: [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]
    dot = lambda p, q: sum(x * y for x, y in zip(p, q, strict=True))
    size = dot(d, d) ** 0.5
    d = [x / size for x in d]
    e1, e2, s = sub(b, a), sub(c, a), sub(o, a)
    h = cross(d, e2)
    det = dot(e1, h)
    if abs(det) <= 1e-6:
        return None
    q = cross(s, e1)
    u, v, t = dot(s, h) / det, dot(d, q) / det, dot(e2, q) / det
    return t if u >= 0 and v >= 0 and u + v <= 1 and t > 1e-6 else None


@pytest.mark.parametrize("most", [0.7, 6.0, 80.0])
def test_cast(spark, most):
    r = random.Random(5)
    tris = []
    for i in range(200):
        at, size = [r.uniform(-5, 5) for _ in range(3)], 30 if i % 40 == 0 else r.choice([0.3, 2])
        tris.append((i % 20, *(v + r.uniform(-size, size) for _ in range(3) for v in at)))
    own = [(i % 20, i, *(r.uniform(-5, 5) for _ in range(3)), *(r.choice([(0.0, 0.0, 1.0), (0.0, -2.0, 0.0), tuple(r.uniform(-1, 1) for _ in range(3))]))) for i in range(150)]
    want = {}
    for ray in own:
        found = [(t, tri[0]) for tri in tris if tri[0] != ray[0] and (t := hit(ray, tri)) is not None and t < most]
        if found:
            want[ray[1]] = min(found)
    own += [(1, 900, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (1, 901, None, 0.0, 0.0, 1.0, 0.0, 0.0)]
    t = spark.createDataFrame(tris, "part bigint, " + ", ".join(f"{p}{c} double" for p in "abc" for c in "xyz"))
    rayed = spark.createDataFrame(own, "source bigint, ray_id bigint, x double, y double, z double, dx double, dy double, dz double")
    got = {x.ray_id: (x.t, x.part) for x in rays.cast(rayed, t, most).collect()}
    assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and abs(got[k][0] - want[k][0]) < 1e-9 for k in want)
    pairs = spark.createDataFrame([(s, p) for s in range(20) for p in range(0, 20, 3)], "source bigint, part bigint")
    some = {x.ray_id: x.part for x in rays.cast(rayed, t, most, pairs).collect()}
    assert some and all(p % 3 == 0 for p in some.values())
    assert rays.cast(rayed, t.limit(0), most).count() == 0


def plates(spark):
    """Cubes of side 1: 1 under 2 with a gap of 0.5, 3 far off, 4 beside 1 at the same height."""
    nodes, elements = [], []
    for pid, (x, y, z) in {1: (0, 0, 0), 2: (0.2, 0.2, 1.5), 3: (0, 0, 50), 4: (5, 0, 0)}.items():
        first = len(nodes) + 1
        nodes += [(first + i, x + a, y + b, z + c) for i, (a, b, c) in enumerate([(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)])]
        elements.append((pid, pid, list(range(first, first + 8))))
    return spark.createDataFrame(elements, "eid bigint, pid bigint, nodes array<bigint>"), spark.createDataFrame([(n, float(x), float(y), float(z)) for n, x, y, z in nodes], "nid bigint, x double, y double, z double")


def test_adjacent(spark):
    elements, nodes = plates(spark)
    kept, why = rays.adjacent(elements, nodes, "XY", most=1.0)
    assert {(r.source, r.part, r.hits, r.rank) for r in kept.collect()} == {(1, 2, 1, 1), (2, 1, 1, 1)}  # the corner (1, 1) alone lies under the other, and its upper end alone within 1
    assert {r.source: (r.candidates, r.reason) for r in why.collect()} == {1: (None, None), 2: (None, None), 3: (0, "no candidates"), 4: (2, "no hits")}
    layer = rays.adjacent(elements, nodes, "XY", most=1.0, layer_mode=True)[0]
    assert {(r.source, r.part) for r in layer.collect()} == {(1, 2), (1, 4), (2, 1), (2, 4), (4, 1), (4, 2)}
    faces = rays.face_corners(mesh.exterior_faces(elements), nodes)
    up = rays.cast(rays.face_rays(faces, (0, 0, 1)), rays.face_triangles(faces), 1.0)
    assert {(r.source, r.part, round(r.t, 9)) for r in up.collect()} == {(1, 2, 0.5), (2, 1, 0.5)}


def test_evenly_over_spans(spark, monkeypatch):
    monkeypatch.setattr(mesh, "_SPAN", 7)
    rows = spark.range(101).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"))
    got = {}
    for r in mesh.evenly(rows, "k", "v", 5).collect():
        got.setdefault(r.k, set()).add(r.v)
    assert got == {k: {[v for v in range(101) if v % 2 == k][int(i * (n - 1) / 4)] for i in range(5)} for k, n in ((0, 51), (1, 50))}
    assert mesh.evenly(rows, "k", "v", 1).count() == 2
