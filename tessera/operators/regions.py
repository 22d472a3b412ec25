"""Region queries on boxes by hierarchical keys in three dimensions.

A box gets one key: the Morton code of its centre's cell, and the level whose cells are at least
as wide as the box. Shifting three bits off gives the cell of the next level, so a key holds its
ancestors. A box reaches at most half a cell beyond its centre's cell, so what meets a region is in the
cells of the region grown by half a cell: for a table of regions these cells are joined by
key, for one region they are ranges of keys, which prune the row groups of a table sorted by key.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.fields import let

AXES = "xyz"
#: Bits of a cell's number along one axis.
BITS = 20
#: Ranges of keys that a region is cut into for each level, at most.
RANGES = 16
#: Share of a cell by which regions are grown, beyond what rounding can shift a box.
_SLACK = 1e-6


@dataclass(frozen=True)
class Grid:
    """Cells of width * 2 ** level from the origin on; levels are those from 0 to top."""

    origin: tuple[float, float, float]
    width: float
    top: int

    @staticmethod
    def of(boxes: DataFrame) -> Grid:
        """Cells about as wide as boxes are on average; one row of figures is read."""
        side = F.greatest(*(F.col(f"max_{c}") - F.col(f"min_{c}") for c in AXES))
        ends = [f(f"{n}{c}") for c in AXES for f, n in ((F.min, "min_"), (F.max, "max_"))]
        *at, mean, most = boxes.agg(*ends, F.avg(side), F.max(side)).first()
        if mean is None:
            return Grid((0.0, 0.0, 0.0), 1.0, 0)
        extent = max(b - a for a, b in zip(at[::2], at[1::2], strict=True))
        width = max(mean, extent / (1 << BITS), 1e-12)
        return Grid(tuple(at[::2]), width, max(math.ceil(math.log2(max(most / width, 1))), 0))

    def cell(self, at: Column, axis: str, level: Column | None = None) -> Column:
        """Number of the level's cell (without level: the finest) along an axis; what lies outside counts as at the edge."""
        fine = F.floor((at - F.lit(self.origin[AXES.index(axis)])) / self.width).cast("bigint")
        held = F.greatest(F.lit(0).cast("bigint"), F.least(F.lit((1 << BITS) - 1).cast("bigint"), fine))
        return held if level is None else F.call_function("shiftright", held, level)

    def level(self, size: Column) -> Column:
        """The first level whose cells are as wide."""
        return F.when(size > self.width, F.least(F.lit(BITS), F.ceil(F.log2(size / self.width)))).otherwise(0).cast("int")


def _spread(v: Column) -> Column:
    """The bits of a number, two free bits after each; each step is computed once."""
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        v = let(v, _parted(shift, mask))
    return v


def _parted(shift: int, mask: int):
    return lambda v: v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("bigint"))


def morton(x: Column, y: Column, z: Column) -> Column:
    """Bits of three numbers in turn."""
    return _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1)).bitwiseOR(F.shiftleft(_spread(z), 2))


def keyed(boxes: DataFrame, grid: Grid) -> DataFrame:
    """boxes with ``level`` and ``cell``, the Morton code of the centre's finest cell; boxes without coordinates go."""
    whole = boxes.dropna(subset=[f"{n}_{c}" for c in AXES for n in ("min", "max")])
    side = F.greatest(*(F.col(f"max_{c}") - F.col(f"min_{c}") for c in AXES))
    centre = [grid.cell((F.col(f"min_{c}") + F.col(f"max_{c}")) / 2, c) for c in AXES]
    return whole.select("*", grid.level(side).alias("level"), morton(*centre).alias("cell"))


def _overlap(p: str, q: str) -> Column:
    out = F.lit(True)
    for c in AXES:
        out = out & (F.col(f"{p}min_{c}") <= F.col(f"{q}max_{c}")) & (F.col(f"{q}min_{c}") <= F.col(f"{p}max_{c}"))
    return out


def meeting(boxes: DataFrame, regions: DataFrame, grid: Grid) -> DataFrame:
    """Every box (keyed; all its columns) with every region (``region`` and min_x .. max_z) that it meets or touches, once.

    Both are met at the level of the larger one: a box is in one cell of each level from its own up, a region in 27 at most.
    Regions without coordinates meet nothing.
    """
    side = F.greatest(*(F.col(f"r_max_{c}") - F.col(f"r_min_{c}") for c in AXES))
    theirs = regions.select("region", *(F.col(f"{n}_{c}").alias(f"r_{n}_{c}") for c in AXES for n in ("min", "max"))).dropna(subset=[f"r_{n}_{c}" for c in AXES for n in ("min", "max")])
    theirs = theirs.withColumn("region_level", grid.level(side))
    last = F.lit(max(grid.top, theirs.agg(F.max("region_level")).first()[0] or 0))  # one number
    ours = boxes.withColumnRenamed("level", "own_level").withColumn("level", F.explode(F.sequence(F.col("own_level"), last)))
    ours = ours.withColumn("key", F.call_function("shiftright", F.col("cell"), F.col("level") * 3))
    theirs = theirs.withColumn("level", F.explode(F.sequence(F.col("region_level"), last)))
    half = F.lit(grid.width) * F.pow(F.lit(2.0), F.col("level")) * (0.5 + _SLACK)
    for c in AXES:
        low, high = grid.cell(F.col(f"r_min_{c}") - half, c, F.col("level")), grid.cell(F.col(f"r_max_{c}") + half, c, F.col("level"))
        theirs = theirs.withColumn(f"cell_{c}", F.explode(F.sequence(low, high)))
    theirs = theirs.withColumn("key", morton(*(F.col(f"cell_{c}") for c in AXES)))
    met = ours.join(theirs, ["level", "key"]).where((F.col("level") == F.greatest("own_level", "region_level")) & _overlap("", "r_"))
    return met.select(*boxes.columns, "region")


def points(rows: DataFrame, key: str) -> DataFrame:
    """Points (key, x, y, z) as regions."""
    return rows.select(F.col(key).alias("region"), *(F.col(c).alias(f"{n}_{c}") for c in AXES for n in ("min", "max")))


def grown(boxes: DataFrame, key: str, by: dict[str, float]) -> DataFrame:
    """Boxes as regions, grown by so much along each axis that is named."""
    return boxes.select(F.col(key).alias("region"), *((F.col(f"{n}_{c}") + by.get(c, 0.0) * sign).alias(f"{n}_{c}") for c in AXES for n, sign in (("min", -1), ("max", 1))))


def _code(x: int, y: int, z: int) -> int:
    return sum((((v >> b) & 1) << (3 * b + k)) for k, v in enumerate((x, y, z)) for b in range(BITS))


def _ranges(low: tuple[int, ...], high: tuple[int, ...]) -> list[tuple[int, int]]:
    """Ranges of Morton codes that cover the cells from low to high: octants are cut where they are partly outside, the widest first."""
    open_, done = [(BITS, 0, 0, 0)], []
    while open_:
        bits, *at = open_.pop(0)
        size = 1 << bits
        if any(a + size - 1 < lo or a > hi for a, lo, hi in zip(at, low, high, strict=True)):
            continue
        inside = all(lo <= a and a + size - 1 <= hi for a, lo, hi in zip(at, low, high, strict=True))
        if inside or not bits or len(open_) + len(done) >= RANGES:
            first = _code(*at)
            done.append((first, first + (1 << 3 * bits) - 1))
        else:
            open_ += [(bits - 1, *(a + ((k >> i) & 1) * size // 2 for i, a in enumerate(at))) for k in range(8)]
    merged: list[tuple[int, int]] = []
    for a, b in sorted(done):
        if merged and merged[-1][1] + 1 == a:
            merged[-1] = (merged[-1][0], b)
        else:
            merged.append((a, b))
    return merged


def within(boxes: DataFrame, grid: Grid, low: tuple[float, float, float], high: tuple[float, float, float]) -> DataFrame:
    """Keyed boxes that meet or touch one region. The keys' ranges are plain filters, so a written table sorted by level and cell is read in parts."""
    near = F.lit(False)
    for level in range(grid.top + 1):
        half = grid.width * 2**level * (0.5 + _SLACK)
        ends = [[min(max(math.floor((v + sign * half - o) / grid.width), 0), (1 << BITS) - 1) for v, o in zip(at, grid.origin, strict=True)] for at, sign in ((low, -1), (high, 1))]
        held = F.lit(False)
        for a, b in _ranges(*map(tuple, ends)):
            held = held | F.col("cell").between(a, b)
        near = near | ((F.col("level") == level) & held)
    exact = F.lit(True)
    for c, lo, hi in zip(AXES, low, high, strict=True):
        exact = exact & (F.col(f"min_{c}") <= hi) & (F.col(f"max_{c}") >= lo)
    return boxes.where(near & exact)
