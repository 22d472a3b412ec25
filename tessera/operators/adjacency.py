"""Which parts lie next to which: gaps between boxes, rays against boxes, coverage, view order.

Range conditions are turned into equal cells, so that the joins are by key. Cells are as wide as things are on average;
what is larger is put into cells of two, four, ... times that width, a level for each, so that nothing takes more than a few cells.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.folders import checkpointed

#: Cells of its level that a thing may be long.
_LONG = 4


def _scale(rows: DataFrame, *sizes: Column) -> tuple[float, int]:
    """Width of the finest cells, the mean of all sizes, and the level of the largest; two numbers of one row."""
    found = rows.agg(F.avg(F.greatest(*sizes, F.lit(0.0))), F.max(F.greatest(*sizes, F.lit(0.0)))).first()
    width = max(found[0] or 0.0, 1e-9)
    return width, max(math.ceil(math.log2(max((found[1] or 0.0) / (_LONG * width), 1))), 0)


def _level(size: Column, width: float) -> Column:
    return F.when(size > _LONG * width, F.ceil(F.log2(size / (_LONG * width)))).otherwise(0).cast("int")


def _cell(at: Column, width: float, level: Column) -> Column:
    return F.floor(at / (width * F.pow(F.lit(2.0), level)))


def _along(low: Column, high: Column, width: float, level: Column) -> Column:
    return F.explode(F.sequence(_cell(low, width, level), _cell(high, width, level)))


def within_gap(boxes: DataFrame, axis: str, most: float, sources: DataFrame | None = None) -> DataFrame:
    """Ordered pairs (source, part, gap) of parts whose boxes are no further apart along the axis than ``most``.

    A pair meets in the cells of the larger one's level, and counts in the first that both have. With sources, only their boxes look for others.
    """
    low, high = F.col(f"min_{axis}"), F.col(f"max_{axis}")
    width, top = _scale(boxes, high - low + 2 * most)

    def placed(boxes: DataFrame, key: str, p: str, wider: float) -> DataFrame:
        own = boxes.select(F.col("pid").alias(key), low.alias(f"{p}0"), high.alias(f"{p}1"), (low - wider).alias(f"{p}l"), (high + wider).alias(f"{p}h"))
        own = own.withColumn(f"{p}v", F.least(_level(F.col(f"{p}h") - F.col(f"{p}l"), width), F.lit(top))).withColumn("level", F.explode(F.sequence(F.col(f"{p}v"), F.lit(top))))
        return own.withColumn("cell", _along(F.col(f"{p}l"), F.col(f"{p}h"), width, F.col("level")))

    met = placed(boxes if sources is None else sources, "source", "a", most).join(placed(boxes, "part", "b", 0.0), ["level", "cell"]).where((F.col("source") != F.col("part")) & (F.col("level") == F.greatest("av", "bv")))
    once = met.where(F.col("cell") == _cell(F.greatest("al", "bl"), width, F.col("level")))
    gap = F.greatest(F.lit(0.0), F.col("b0") - F.col("a1"), F.col("a0") - F.col("b1"))
    return once.select("source", "part", gap.alias("gap")).where(F.col("gap") <= most)


def _in_cells(things: DataFrame, low_u: Column, high_u: Column, low_v: Column, high_v: Column) -> tuple[DataFrame, float, int]:
    """Things with level, cu and cv, the cells of two axes that they reach into; the width and the last level."""
    size = F.greatest(high_u - low_u, high_v - low_v)
    width, top = _scale(things, high_u - low_u, high_v - low_v)
    own = things.withColumn("level", _level(size, width))
    return own.withColumn("cu", _along(low_u, high_u, width, F.col("level"))).withColumn("cv", _along(low_v, high_v, width, F.col("level"))), width, top


def _points(points: DataFrame, u: str, v: str, width: float, top: int) -> DataFrame:
    """Points in their cell of every level."""
    own = points.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(top))))
    return own.withColumn("cu", _cell(F.col(u), width, F.col("level"))).withColumn("cv", _cell(F.col(v), width, F.col("level")))


def search_range(boxes: DataFrame, axis: str) -> DataFrame:
    """pid and the gaps to search, from a tenth of the size along the axis (0.1 at least) to five times it."""
    size = F.col(f"max_{axis}") - F.col(f"min_{axis}")
    return boxes.select("pid", F.when(size > 0, F.greatest(F.lit(0.1), size * 0.1)).otherwise(0.1).alias("least"), F.when(size > 0, size * 5).otherwise(100.0).alias("most"))


def ray_box_hits(rays: DataFrame, boxes: DataFrame, axis: str = "z") -> DataFrame:
    """Hits (source, ray_id, part, t) of rays along the axis, both ways, on the boxes of other parts.

    rays: source, ray_id, x, y, z. t is how far the near side is, 0 from within a box.
    """
    u, v = [c for c in "xyz" if c != axis]
    b, width, top = _in_cells(boxes.withColumnRenamed("pid", "part"), F.col(f"min_{u}"), F.col(f"max_{u}"), F.col(f"min_{v}"), F.col(f"max_{v}"))
    r = _points(rays, u, v, width, top)
    met = r.join(b, ["level", "cu", "cv"]).where((F.col("source") != F.col("part")) & F.col(u).between(F.col(f"min_{u}"), F.col(f"max_{u}")) & F.col(v).between(F.col(f"min_{v}"), F.col(f"max_{v}")))
    t = F.greatest(F.lit(0.0), F.col(f"min_{axis}") - F.col(axis), F.col(axis) - F.col(f"max_{axis}"))
    return met.select("source", "ray_id", "part", t.alias("t"))


def nearest(hits: DataFrame) -> DataFrame:
    """The first part that each ray meets; of equally near ones the one with the smallest id."""
    return hits.groupBy("source", "ray_id").agg(F.min(F.struct("t", "part")).alias("first")).select("source", "ray_id", "first.part", "first.t")


def coverage(hits: DataFrame, threshold: float = 0.1) -> DataFrame:
    """source, part, hits and coverage, the share of the source's best part; parts under the threshold (one hit at least) go."""
    counted = hits.groupBy("source", "part").agg(F.count("*").alias("hits"))
    best = F.max("hits").over(Window.partitionBy("source"))
    found = counted.withColumn("best", best).where(F.col("hits") >= F.greatest(F.lit(1), F.floor(F.col("best") * threshold)))
    return found.select("source", "part", "hits", (F.col("hits") / F.col("best")).alias("coverage"))


def facing(angles: DataFrame, most: float = -0.5) -> DataFrame:
    """Pairs of parts whose normals point at each other; a part without a normal passes."""
    return angles.where(F.coalesce(F.col("dot") < most, F.lit(True)))


def visible(boxes: DataFrame, source: int, grow: float = 0.0, view: str = "top") -> DataFrame:
    """Parts over (or under) a source whose boxes overlap its own, grown in plane, seen along z."""
    s = boxes.where(F.col("pid") == source).select(*(F.col(c).alias(f"s_{c}") for c in boxes.columns if c != "pid"))  # one row
    overlap = (F.col("min_x") <= F.col("s_max_x") + grow) & (F.col("max_x") >= F.col("s_min_x") - grow) & (F.col("min_y") <= F.col("s_max_y") + grow) & (F.col("max_y") >= F.col("s_min_y") - grow)
    middle, own = (F.col("min_z") + F.col("max_z")) / 2, (F.col("s_min_z") + F.col("s_max_z")) / 2
    side = middle > own if view == "top" else middle < own
    return boxes.where(F.col("pid") != source).join(F.broadcast(s)).where(overlap & side).select("pid", middle.alias("depth"))


def shades(depths: DataFrame, depth: str = "depth") -> DataFrame:
    """A shade from 0.7 to 1.0 by depth; 1.0 where all are alike."""
    ends = depths.agg(F.min(depth).alias("low"), F.max(depth).alias("high"))  # one row
    span = F.col("high") - F.col("low")
    return depths.join(F.broadcast(ends)).withColumn("shade", F.when(span < 1e-6, 1.0).otherwise(0.7 + 0.3 * (F.col(depth) - F.col("low")) / span)).drop("low", "high")


#: A window's share that rounding may take: a hit this close to its end waits for the next window.
_CLOSE = 1e-3


def _first(rays: DataFrame, things: DataFrame, axes: tuple[str, str, str], back: Column, forth: Column, hits: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``nearest`` of hits, without all the pairs that the rays' lines go through.

    Rays look along the third axis, as far as ``back`` and ``forth`` times t, in windows of t that grow eightfold: a hit within the window is final, as
    everything that near was looked at; the other rays go on, the last time with everything. things: part and the ranges l0, h0 .. l2, h2
    by axis. Both meet by key, in cells of the first two axes and of the third one, which is as wide as the window.
    """
    things, left = checkpointed(things), checkpointed(rays.withColumns({"_back": back, "_forth": forth}))
    u, v, w = axes
    flat, long = F.greatest(F.col("h0") - F.col("l0"), F.col("h1") - F.col("l1")), F.col("h2") - F.col("l2")
    size = things.agg(F.avg(flat), F.avg(long), F.min("l2"), F.max("h2"), F.count("*")).first()
    ends = left.agg(F.min(w), F.max(w), F.max(F.greatest("_back", "_forth"))).first()
    width, speed = max(size[0] or 0.0, 1e-9), ends[2] or 1.0
    span = max((x for x in (size[3], ends[1]) if x is not None), default=0.0) - min((x for x in (size[2], ends[0]) if x is not None), default=0.0)
    things = things.withColumn("level", _level(flat, width))
    reach, found = max(2 * (size[1] or 0.0), span / max(size[4], 1), 1e-9), None
    while found is None or not left.isEmpty():
        last, t = not reach <= span < math.inf, reach / speed
        deep = F.lit(0) if last else _level(long, reach)
        t_ = things.withColumn("deep", deep)
        used = [(x.level, x.deep) for x in t_.select("level", "deep").distinct().collect()]  # a few
        at = lambda low, high, level: F.lit(0).cast("bigint") if last else _along(low, high, reach, level)
        t_ = t_.withColumn("c0", _along(F.col("l0"), F.col("h0"), width, F.col("level"))).withColumn("c1", _along(F.col("l1"), F.col("h1"), width, F.col("level"))).withColumn("c2", at(F.col("l2"), F.col("h2"), F.col("deep")))
        r = left.withColumn("_in", F.explode(F.array(*(F.struct(F.lit(a).alias("level"), F.lit(b).alias("deep")) for a, b in used)))) if used else left.where("false").withColumn("_in", F.struct(F.lit(0).alias("level"), F.lit(0).alias("deep")))
        r = r.select("*", "_in.level", "_in.deep").drop("_in").withColumn("c0", _cell(F.col(u), width, F.col("level"))).withColumn("c1", _cell(F.col(v), width, F.col("level")))
        r = r.withColumn("c2", at(F.col(w) - F.col("_back") * t - _CLOSE * reach, F.col(w) + F.col("_forth") * t + _CLOSE * reach, F.col("deep")))
        met = r.join(t_, ["level", "deep", "c0", "c1", "c2"]).where((F.col("source") != F.col("part")) & F.col(u).between(F.col("l0"), F.col("h0")) & F.col(v).between(F.col("l1"), F.col("h1")))
        now = nearest(hits(met))
        now = checkpointed(now if last else now.where(F.col("t") <= t * (1 - _CLOSE)))
        found = now if found is None else found.unionByName(now)
        if last:
            break
        left, reach = checkpointed(left.join(now, ["source", "ray_id"], "left_anti")), reach * 8
    return found


def nearest_boxes(rays: DataFrame, boxes: DataFrame, axis: str = "z") -> DataFrame:
    """``nearest`` of ``ray_box_hits``, in time and memory as the rays' number; those only grow with it times the boxes'."""
    u, v = [c for c in "xyz" if c != axis]
    ranges = {f"{p}{i}": F.col(f"{end}_{k}") for i, k in enumerate((u, v, axis)) for p, end in (("l", "min"), ("h", "max"))}
    t = F.greatest(F.lit(0.0), F.col("l2") - F.col(axis), F.col(axis) - F.col("h2"))
    return _first(rays, boxes.select(F.col("pid").alias("part"), *(c.alias(k) for k, c in ranges.items())), (u, v, axis), F.lit(1.0), F.lit(1.0), lambda met: met.select("source", "ray_id", "part", t.alias("t")))


def ray_triangles(rays: DataFrame, triangles: DataFrame) -> DataFrame:
    """Nearest hit (source, ray_id, part, t) of rays (source, ray_id, x, y, z, dx, dy, dz) on triangles of other parts.

    triangles: part, and corners ax..cz. Rays run along z (dx = dy = 0), so both sides meet in cells of x and y, and in windows of z. Ranges
    are wider than the triangles by a millionth, for rounding.
    """
    end = lambda pick, k: pick(*(f"{p}{k}" for p in "abc"))
    more = F.greatest(*(end(F.greatest, k) - end(F.least, k) for k in "xyz")) * 1e-6
    ranges = (side.alias(f"{p}{i}") for i, k in enumerate("xyz") for p, side in (("l", end(F.least, k) - more), ("h", end(F.greatest, k) + more)))
    edges = ((F.col(f"{p}{k}") - F.col(f"a{k}")).alias(f"{n}{k}") for p, n in (("b", "e"), ("c", "f")) for k in "xyz")
    things = triangles.select("part", "ax", "ay", "az", *ranges, *edges).withColumn("area", F.expr("ex * -fy + ey * fx")).where("area <> 0")

    def hits(met: DataFrame) -> DataFrame:  # short terms of few columns: a method of the compiled code that is too long is interpreted
        o = met.select("source", "ray_id", "part", "dz", "area", *(f"{p}{k}" for p in "ef" for k in "xyz"), *((F.col(k) - F.col(f"a{k}")).alias(f"o{k}") for k in "xyz"))
        q = o.where("abs(dz * area) > 1e-8 AND (ox * -fy + oy * fx) / area >= 0 AND (ox * ey - oy * ex) / area >= 0 AND (ox * -fy + oy * fx) / area + (ox * ey - oy * ex) / area <= 1")
        t = F.expr("(fx * (oy * ez - oz * ey) + fy * (oz * ex - ox * ez) + fz * (ox * ey - oy * ex)) / (dz * area)")
        return q.select("source", "ray_id", "part", t.alias("t")).where("t > 1e-6")

    zero, ahead = F.lit(0.0), rays.where("abs(dz) > 0 AND abs(dz) < double('Infinity')").select("source", "ray_id", "x", "y", "z", "dz")
    return _first(ahead, things, ("x", "y", "z"), F.greatest(zero, -F.col("dz")), F.greatest(zero, F.col("dz")), hits)


def explain_none(candidates: DataFrame, hits: DataFrame, kept: DataFrame) -> DataFrame:
    """One row of counts and why nothing was found: no candidates, no hits, or none over the threshold."""
    n = [x.agg(F.count("*").alias(k)) for x, k in ((candidates, "candidates"), (hits, "hits"), (kept, "kept"))]
    one = F.broadcast(n[0]).join(F.broadcast(n[1])).join(F.broadcast(n[2]))  # three single rows
    reason = F.when(F.col("candidates") == 0, "no candidates").when(F.col("hits") == 0, "no hits").when(F.col("kept") == 0, "below threshold")
    return one.withColumn("reason", reason)


def total_coverage(hits: DataFrame, rays: DataFrame) -> DataFrame:
    """source, part, hits and ``coverage``: the share of all the source's rays that hit the part."""
    total = rays.groupBy("source").agg(F.count("*").alias("total"))
    found = hits.groupBy("source", "part").agg(F.count("*").alias("hits")).join(total, "source")
    return found.select("source", "part", "hits", (F.col("hits") / F.greatest("total", F.lit(1))).alias("coverage"))
