"""Nearest hits of rays, found in growing windows, against all pairs."""

import random

import pytest

from tessera.operators import adjacency


def frame(spark, rows, columns, types=None):
    return spark.createDataFrame(rows, ", ".join(f"{c} {(types or {}).get(c, 'double')}" for c in columns.split())).repartition(3)


LONG = {"source": "long", "ray_id": "long", "part": "long", "pid": "long"}


def triangles_hit(rays, triangles):
    best = {}
    for source, ray, x, y, z, _, _, dz in rays:
        for part, ax, ay, az, bx, by, bz, cx, cy, cz in triangles:
            det = ((bx - ax) * (-(cy - ay)) + (by - ay) * (cx - ax)) * dz
            if source == part or not abs(det) > 1e-8:
                continue
            u, v = ((x - ax) * (-(cy - ay)) + (y - ay) * (cx - ax)) * dz / det, ((x - ax) * (by - ay) - (y - ay) * (bx - ax)) * dz / det
            t = ((cx - ax) * ((y - ay) * (bz - az) - (z - az) * (by - ay)) + (cy - ay) * ((z - az) * (bx - ax) - (x - ax) * (bz - az)) + (cz - az) * ((x - ax) * (by - ay) - (y - ay) * (bx - ax))) / det
            if u >= 0 and v >= 0 and u + v <= 1 and t > 1e-6:
                best[source, ray] = min(best.get((source, ray), (t, part)), (t, part))
    return best


def boxes_hit(rays, boxes):
    best = {}
    for source, ray, x, y, z in rays:
        for part, x0, x1, y0, y1, z0, z1 in boxes:
            if source != part and x0 <= x <= x1 and y0 <= y <= y1:
                t = max(0.0, z0 - z, z - z1)
                best[source, ray] = min(best.get((source, ray), (t, part)), (t, part))
    return best


def near(got, want):
    found = {(x.source, x.ray_id): (x.t, x.part) for x in got.collect()}
    assert got.count() == len(found) and {k: p for k, (_, p) in found.items()} == {k: p for k, (_, p) in want.items()}
    assert all(t == pytest.approx(want[k][0], rel=1e-9, abs=1e-12) for k, (t, _) in found.items())


@pytest.mark.parametrize("high,big", [(200, 0), (0, 0), (50, 40)])
def test_triangles(spark, high, big):
    """Stacked ones, ones in one plane with ties, and some as large as everything; rays of both directions and several speeds, some that miss all."""
    r = random.Random(high)
    at = lambda wide: [r.uniform(0, 10) + r.gauss(0, wide) for _ in range(2)]
    triangles = []
    for i in range(150):
        wide, z = (big if big and i % 50 == 0 else 2), r.uniform(0, high)
        triangles.append((i % 40, *(c for _ in range(3) for c in (*at(wide), z + (r.gauss(0, 1 + big * (i % 50 == 0)) if high else 0.0)))))
    rays = [(i % 40, i, *at(1), r.uniform(-20, high + 20), 0.0, 0.0, r.choice([1.0, -1.0, 0.25, -8.0, 0.0])) for i in range(200)] + [(1, 999, 500.0, 500.0, 0.0, 0.0, 0.0, 1.0)]
    want = triangles_hit(rays, triangles)
    assert len(want) > 30
    columns = "part ax ay az bx by bz cx cy cz"
    near(adjacency.ray_triangles(frame(spark, rays, "source ray_id x y z dx dy dz", LONG), frame(spark, triangles, columns, LONG)), want)


@pytest.mark.parametrize("axis", ["z", "x"])
def test_boxes(spark, axis):
    r = random.Random(7)
    boxes = []
    for i in range(120):
        x, y, z, s = r.uniform(0, 6), r.uniform(0, 6), r.choice([0.0, 3.0, r.uniform(0, 300)]), r.choice([1, 3, 3, 40])
        boxes.append((i, x, x + s * r.random(), y, y + s * r.random(), z, z + s * r.random()))
    rays = [(r.randrange(120), i, r.uniform(0, 8), r.uniform(0, 8), r.choice([0.0, 3.0, r.uniform(-50, 350)])) for i in range(200)]
    columns = "pid min_x max_x min_y max_y min_z max_z"
    if axis == "x":  # the same, turned
        columns = "pid min_y max_y min_z max_z min_x max_x"
    want = boxes_hit(rays, boxes)
    assert 100 < len(want)
    own = frame(spark, rays, "source ray_id x y z" if axis == "z" else "source ray_id y z x", LONG)
    near(adjacency.nearest_boxes(own, frame(spark, boxes, columns, LONG), axis), want)


def test_none(spark):
    rays = frame(spark, [(1, 1, 0.5, 0.5, 0.0)], "source ray_id x y z", LONG)
    boxes = frame(spark, [(1, 0.0, 1.0, 0.0, 1.0, 0.0, 1.0)], "pid min_x max_x min_y max_y min_z max_z", LONG)
    assert adjacency.nearest_boxes(rays, boxes).isEmpty() and adjacency.nearest_boxes(rays, boxes.limit(0)).isEmpty() and adjacency.nearest_boxes(rays.limit(0), boxes).isEmpty()
    endless = frame(spark, [(2, 0.0, 1.0, 0.0, 1.0, float("nan"), float("nan")), (3, 0.0, 1.0, 0.0, 1.0, 5.0, float("inf"))], "pid min_x max_x min_y max_y min_z max_z", LONG)
    assert [x.part for x in adjacency.nearest_boxes(rays, endless).collect()] == [3]


@pytest.mark.parametrize("kind", ["boxes", "triangles"])
def test_few_pairs(spark, monkeypatch, kind):
    """In a stack of 1,500 parts, of which a ray's line meets nearly all, it is compared with a few."""
    r, n, met, first = random.Random(3), 1500, [], adjacency._first

    def counting(rays, things, axes, back, forth, hits):
        def counted(pairs):
            met.append(pairs.count())
            return hits(pairs)

        return first(rays, things, axes, back, forth, counted)

    monkeypatch.setattr(adjacency, "_first", counting)
    rays = [(i, i, r.uniform(0.4, 0.6), r.uniform(0.4, 0.6), float(i)) for i in range(n)]
    if kind == "boxes":
        found = adjacency.nearest_boxes(frame(spark, rays, "source ray_id x y z", LONG), frame(spark, [(i, 0.0, 1.0, 0.0, 1.0, i - 0.2, i + 0.3) for i in range(n)], "pid min_x max_x min_y max_y min_z max_z", LONG))
        assert found.where("part = source - 1 AND abs(t - 0.7) < 1e-9 OR source = 0 AND part = 1").count() == n
    else:
        found = adjacency.ray_triangles(frame(spark, [(*x, 0.0, 0.0, 1.0) for x in rays], "source ray_id x y z dx dy dz", LONG), frame(spark, [(i, -1.0, -1.0, i + 0.1, 3.0, 0.0, i + 0.1, 0.0, 3.0, i + 0.3) for i in range(n)], "part ax ay az bx by bz cx cy cz", LONG))
        assert found.count() == n - 1 and found.where("part = source + 1").count() == n - 1
    assert 0 < sum(met) < 40 * n
