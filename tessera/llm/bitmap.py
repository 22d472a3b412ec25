"""Bitmaps over 64-bit keys, sized from how many keys there are, up to a fixed size.

Membership has false positives, more of them the fuller the bitmap is; callers use it only
to leave out rows that cannot matter, or to order rows, never to decide a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the smallest and of the largest bitmap, as powers of two: 128 kB and 32 MB are sent to a task at most.
SMALLEST, LARGEST = 20, 28


class Bitmap:
    """Bits set at the top ``bits`` of each key."""

    def __init__(self, data: np.ndarray, bits: int) -> None:
        self.data, self.bits = data, bits

    def member(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> np.uint64(64 - self.bits)
        return (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1 > 0


def _bits(count: int) -> int:
    """32 bits a key, as a power of two within the bounds."""
    return min(max((32 * max(count, 1) - 1).bit_length(), SMALLEST), LARGEST)


def _build(keys: DataFrame, sizes: list[int]) -> list[Bitmap]:
    """A bitmap of the keys with a ``level`` over k, for each k. Tasks make a thousand blocks of each, so the driver gets no more than their size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            own, level = batch.column("key").to_numpy().view(np.uint64), batch.column("level").to_numpy()
            for k, bits in enumerate(sizes):
                low = bits - 10
                at = np.sort((own[level > k] >> np.uint64(64 - bits)).astype(np.int64))
                edges = np.flatnonzero(np.diff(at >> low)) + 1
                for part in np.split(at, edges) if len(at) else []:
                    blocks.setdefault((k, int(part[0] >> low)), np.zeros(1 << low, bool))[part & ((1 << low) - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in blocks], pa.int32()), pa.array([b for _, b in blocks], pa.int32()), pa.array([np.packbits(x).tobytes() for x in blocks.values()], pa.binary())], names=["k", "block", "bits"])

    out = [np.zeros((1 << 10, 1 << (bits - 13)), np.uint8) for bits in sizes]
    block = F.shiftrightunsigned("key", 54).cast("int")
    for row in keys.select("key", "level", block.alias("block")).repartition("block").mapInArrow(run, "k int, block int, bits binary").collect():
        out[row["k"]][row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return [Bitmap(x.reshape(-1), bits) for x, bits in zip(out, sizes, strict=True)]


def build(keys: DataFrame, count: int | None = None) -> Bitmap:
    """Bitmap of the column ``key``; ``count`` says how many rows there are, if that is known."""
    return _build(keys.select("key", F.lit(1).alias("level")), [_bits(keys.count() if count is None else count)])[0]


class Levels:
    """How often keys occur, as a level from 0 (once, or hardly more) on; each level has a bitmap of the keys that reach it."""

    def __init__(self, maps: list[Bitmap]) -> None:
        self.maps = maps

    def member(self, keys: np.ndarray) -> np.ndarray:
        """Which keys recur."""
        return self.maps[0].member(keys) if self.maps else np.zeros(len(keys), bool)

    def level(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        for one in self.maps:
            out += one.member(keys)
        return out


def levels(counted: DataFrame, factor: int, steps: int = 16) -> Levels:
    """Levels of (key, n): level k + 1 is reached by keys with an n of 2 * factor ** k or more."""
    bounds = [2 * factor**k for k in range(steps)]
    sizes = [x for x in counted.agg(*(F.count_if(F.col("n") >= b).alias(f"k{k}") for k, b in enumerate(bounds))).first() if x]
    reached = sum((F.when(F.col("n") >= b, 1).otherwise(0) for b in bounds), F.lit(0))
    return Levels(_build(counted.select("key", reached.alias("level")), [_bits(x) for x in sizes]) if sizes else [])
