"""The boundary curve of `sf` for one long sequence, over many tasks and without a matrix of all pairs of frames.

The frames go in slices to every block of rows (at most `BLOCKS` of them, so what is shuffled grows with the frames). A first pass finds each frame's
k-th least distance, a second one makes the recurrence rows of a block and its neighbours from distances and those limits, turns them into lags
and filters them. All pairs are compared in both passes; a task holds the frames, and strips of rows of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import numeric as N
from .api import matrix

#: Frames of a slice; the most blocks, and the fewest rows of one; cells of a strip.
SLICE, BLOCKS, ROWS, CELLS = 64, 24, 512, 16_000_000


class Distances:
    """Squared distances of embedded frames: of m frames in a row each, by a product of the frames themselves."""

    def __init__(self, x: np.ndarray, m: int):
        self.x, self.m, self.n = x, m, len(x) - m
        self.squares = (x**2).sum(axis=1)
        #: Distances are told apart from this on: equal vectors stay equal however products are cut.
        self.near = 1e-12 * m * float(self.squares.max(initial=0)) * 4

    def tile(self, a: int, b: int, c: int, d: int) -> np.ndarray:
        """Of rows a to b and columns c to d, both excluded at the end."""
        more = self.m - 1
        one = self.squares[a : b + more, None] + self.squares[None, c : d + more] - 2 * self.x[a : b + more] @ self.x[c : d + more].T
        out = one[: b - a, : d - c].copy()
        for k in range(1, self.m):
            out += one[k : k + b - a, k : k + d - c]
        return out


def limits(dist: Distances, k: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows a to b the k-th least squared distance to another, and the last place that counts of those at that distance."""
    top, last = np.full(b - a, -np.inf), np.full(b - a, -1, np.int64)
    if k < 1:
        return top, last
    strip = max(1, CELLS // max(1, dist.n))
    for at in range(a, b, strip):
        to = min(b, at + strip)
        d = dist.tile(at, to, 0, dist.n)
        d[np.arange(to - at), np.arange(at, to)] = np.inf
        top[at - a : to - a] = np.partition(d, k - 1, axis=1)[:, k - 1] if k < dist.n else d.max(axis=1, initial=-np.inf, where=np.isfinite(d))
        for r in range(to - at):
            t = top[at - a + r]
            equal = np.flatnonzero(np.abs(d[r] - t) <= dist.near)
            left = k - np.count_nonzero(d[r] < t - dist.near)
            last[at - a + r] = equal[min(left, len(equal)) - 1] if left > 0 and len(equal) else -1
    return top, last


def mirrored(k: np.ndarray, n: int) -> np.ndarray:
    return N.places(n, k, "reflect")


def weights(sigma: float) -> np.ndarray:
    radius = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return w / w.sum()


def linked(dist: Distances, top: np.ndarray, last: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Rows of the mutual recurrence matrix, at some places in order."""
    low, high = int(places.min()), int(places.max()) + 1
    out = np.zeros((high - low, dist.n), bool)
    strip = max(64, CELLS // (high - low))
    for c in range(0, dist.n, strip):
        to = min(dist.n, c + strip)
        d = dist.tile(low, high, c, to)
        j, own = np.arange(c, to), np.arange(low, high)[:, None]
        out[:, c:to] = (d < top[low:high, None] - dist.near) | (d <= top[low:high, None] + dist.near) & (j <= last[low:high, None])
        out[:, c:to] &= (d < top[c:to] - dist.near) | (d <= top[c:to] + dist.near) & (own <= last[c:to])
    out[np.arange(high - low), np.arange(low, high)] = False
    return out[places - low]


def curve(dist: Distances, top: np.ndarray, last: np.ndarray, a: int, b: int, m_gaussian: float) -> np.ndarray:
    """Distances of successive structural features of times a to b; 0 for the last time of all."""
    n, w, v = dist.n, weights(m_gaussian / 2), weights(0.5)
    radius, side = len(w) // 2, len(v) // 2
    out = np.zeros(b - a)
    strip = int(max(64, min(512, 4 * CELLS // n - 2 * radius)))
    for at in range(a, min(b, n - 1), strip):
        to = min(b, n - 1, at + strip)
        # times at to `to` and the one after it, with the filter's reach
        reach = mirrored(np.arange(at - radius, to + 1 + radius), n)
        places, of = np.unique(reach, return_inverse=True)
        rec = linked(dist, top, last, places)
        for r, p in enumerate(places):
            rec[r] = np.roll(rec[r], -int(p))
        # the filter along time and the difference of successive times in one product
        mix = np.zeros((to - at, len(places)))
        for k in range(len(w)):
            np.add.at(mix, (np.arange(to - at), of[np.arange(to - at) + k + 1]), w[k])
            np.add.at(mix, (np.arange(to - at), of[np.arange(to - at) + k]), -w[k])
        total, step = np.zeros(to - at), max(256, CELLS // (4 * len(places)))
        for c in range(0, n, step):
            d = min(n, c + step)
            lags = mix @ rec[:, mirrored(np.arange(c - side, d + side), n)].astype(float)
            total += (sum(v[k] * lags[:, k : k + d - c] for k in range(len(v))) ** 2).sum(axis=1)
        out[at - a : to - a] = np.sqrt(total)
    return out


def slices(frames: DataFrame) -> DataFrame:
    """(part, x): slices of frames (i, vec) in order."""
    part = F.floor(F.col("i") / SLICE).cast("int")
    return frames.groupBy(part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("i", "vec")))["vec"].alias("x"))


def over_blocks(slices_: DataFrame, n: int, m: int, f, schema: pa.Schema, sql: str) -> DataFrame:
    """f(x, the other columns, first row, last row) of every block of rows, each with all slices; a row a block and what f returns."""
    rows = max(ROWS, -(-(n - m) // BLOCKS))
    blocks = max(1, -(-(n - m) // rows))
    names = slices_.columns
    dealt = slices_.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(blocks, "block").sortWithinPartitions("block", "part")

    def run(batches):
        held, now = [], None

        def done():
            x = np.concatenate([matrix(c[names.index("x")]) for c in held])
            more = [np.concatenate([c[k].values.to_numpy(zero_copy_only=False) for c in held]) for k, name in enumerate(names) if name not in ("part", "x")]
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), *[pa.array([v], t.type) for v, t in zip(f(x, more, now * rows, min(n - m, (now + 1) * rows)), list(schema)[1:])]], schema=schema)

        for batch in batches:
            block = batch.column(batch.schema.names.index("block")).to_pylist()
            for k, b in enumerate(block):
                if b != now and held:
                    yield done()
                    held = []
                now = b
                held.append([batch.column(batch.schema.names.index(c))[k] for c in names])
        if held:
            yield done()

    return dealt.mapInArrow(run, sql)


def structural_curve(frames: DataFrame, n: int, config: dict) -> DataFrame:
    """One row (nc): the curve of n frames (i, vec) before it is brought to 0..1."""
    m, k, norm, m_gaussian = int(config["m_embedded"]), int(config["k_nearest"] * n), config["bound_norm_feats"], config["M_gaussian"]
    assert m == config["m_embedded"] and norm not in ("min_max", "log")

    def distances(x):
        return Distances(N.normalise(x, norm), m)

    def first(x, more, a, b):
        return limits(distances(x), k, a, b)

    def second(x, more, a, b):
        return [curve(distances(x), *more, a, b, m_gaussian)]

    cut = slices(frames)
    found = over_blocks(cut, n, m, first, pa.schema([("block", pa.int32()), ("top", pa.list_(pa.float64())), ("last", pa.list_(pa.int64()))]), "block int, top array<double>, last array<bigint>")
    rows = max(ROWS, -(-(n - m) // BLOCKS))
    # limits of the frames of a slice, beside it; the last frames have none
    each = found.select("block", F.posexplode(F.arrays_zip("top", "last")).alias("k", "l")).select((F.col("block") * F.lit(rows) + F.col("k")).alias("i"), "l.top", "l.last")
    own = each.groupBy(F.floor(F.col("i") / SLICE).cast("int").alias("part")).agg(F.array_sort(F.collect_list(F.struct("i", "top", "last"))).alias("o")).select("part", F.col("o.top").alias("top"), F.col("o.last").alias("last"))
    both = cut.join(own, "part", "left").select("part", "x", F.coalesce("top", F.array().cast("array<double>")).alias("top"), F.coalesce("last", F.array().cast("array<bigint>")).alias("last"))
    curves = over_blocks(both, n, m, second, pa.schema([("block", pa.int32()), ("nc", pa.list_(pa.float64()))]), "block int, nc array<double>")
    return curves.groupBy().agg(F.flatten(F.array_sort(F.collect_list(F.struct("block", "nc")))["nc"]).alias("nc"))
