"""Operators on packed tracks (track_id, ts, x): one row in, one row out, no shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import vectors as V


def columns_of(x) -> Column:
    """x transposed: one array per dimension."""
    return V.let(x, lambda m: F.transform(F.sequence(F.lit(0), F.size(F.get(m, 0)) - 1), lambda d: F.transform(m, lambda v: F.get(v, d))))


def rows_of(c) -> Column:
    """The inverse of columns_of."""
    return V.let(c, lambda m: F.transform(F.sequence(F.lit(0), F.size(F.get(m, 0)) - 1), lambda i: F.transform(m, lambda a: F.get(a, i))))


def per_dimension(x, f) -> Column:
    """f on the array of every dimension."""
    return rows_of(F.transform(columns_of(x), f))


def min_max(packed: DataFrame, floor: float = 0.001) -> DataFrame:
    """x + floor - smallest value of the track, divided by each dimension's largest."""
    low = F.array_min(F.transform("x", lambda v: F.array_min(v)))
    shifted = V.let(low, lambda m: F.transform("x", lambda v: F.transform(v, lambda y: y + (F.lit(floor) - m))))
    top = lambda x: F.transform(columns_of(x), lambda a: F.array_max(a))
    return packed.withColumn("x", V.let(shifted, lambda x: V.let(top(x), lambda t: F.transform(x, lambda v: F.zip_with(v, t, lambda y, m: y / m)))))


def log_normalise(packed: DataFrame, floor: float = 0.1, min_db: float = -80.0) -> DataFrame:
    return min_max(packed, floor).withColumn("x", F.transform("x", lambda v: F.transform(v, lambda y: abs(min_db) * F.log10(y))))


def normalise(packed: DataFrame, kind: str | float | None = "min_max", floor: float | None = None, min_db: float = -80.0) -> DataFrame:
    """`min_max`, `log`, a norm of the rows (`inf`, `-inf`, 0 or p), or None; rows whose norm is 0 stay."""
    if kind is None:
        return packed
    if kind == "min_max":
        return min_max(packed, 0.001 if floor is None else floor)
    if kind == "log":
        return log_normalise(packed, 0.1 if floor is None else floor, min_db)
    return packed.withColumn("x", F.transform("x", lambda v: V.scale(v, V.row_norm(v, kind))))


def l2_rows(packed: DataFrame) -> DataFrame:
    return packed.withColumn("x", F.transform("x", V.l2_or_small))


def whiten(packed: DataFrame) -> DataFrame:
    """Every dimension divided by its population standard deviation; constant ones stay."""

    def scaled(a):
        return V.scale(a, V.let(A.mean(a), lambda m: F.sqrt(V.total(F.transform(a, lambda y: (y - m) * (y - m))) / F.size(a))))

    return packed.withColumn("x", per_dimension(F.col("x"), scaled))


def logarithm(packed: DataFrame) -> DataFrame:
    return packed.withColumn("x", F.transform("x", lambda v: F.transform(v, lambda y: F.log1p(y))))


def to_decibel(x: Column, reference: Column, amplitude: bool = False, least: float | None = None, top_db: float = 80.0) -> Column:
    """10 log10 of power (20 log10 of amplitude) over the reference, over an array, no more than top_db under its largest."""
    factor, floor = (20.0, 1e-5) if amplitude else (10.0, 1e-10)
    floor = least or floor
    db = F.transform(x, lambda v: factor * (F.log10(F.greatest(F.abs(v), F.lit(floor))) - F.log10(F.greatest(F.abs(reference), F.lit(floor)))))
    return V.let(db, lambda a: V.let(F.array_max(a), lambda m: F.transform(a, lambda v: F.greatest(v, m - top_db))))


def median_smooth(packed: DataFrame, size: int) -> DataFrame:
    return packed.withColumn("x", per_dimension(F.col("x"), lambda a: A.median_filter(a, size)))


def gaussian_smooth(packed: DataFrame, sigma: float) -> DataFrame:
    return packed.withColumn("x", per_dimension(F.col("x"), lambda a: A.gaussian_filter(a, sigma)))


def stack_memory(packed: DataFrame) -> DataFrame:
    return packed.withColumn("x", A.stack_memory("x"))


def delay_embedding(packed: DataFrame, m: float = 3.0) -> DataFrame:
    return packed.withColumn("x", A.delay_embedding(F.col("x"), m)).where(F.size("x") > 0).withColumn("ts", F.slice("ts", 1, F.size("x")))


def beat_sync(packed: DataFrame, beats: Column | str = "beats") -> DataFrame:
    """Mean vectors of the frames between beats; beats is an array of frame numbers.

    The frames before the first beat and from the last one on are groups too; empty groups are left out. The time
    of a group is that of the beat that ends it, the last frame's for the last.
    """
    cuts = F.array_distinct(F.array_sort(F.concat(F.array(F.lit(0)), F.transform(beats, lambda b: b.cast("int")), F.array(F.size("x")))))
    cuts = F.filter(cuts, lambda c: (c >= 0) & (c <= F.size("x")))
    spans = lambda c: F.filter(A.positions(c), lambda k: k < F.size(c) - 1)
    means = V.let(cuts, lambda c: F.transform(spans(c), lambda k: F.transform(columns_of(F.slice("x", A.at(c, k) + 1, A.at(c, k + 1) - A.at(c, k))), A.mean)))
    times = V.let(cuts, lambda c: F.transform(spans(c), lambda k: A.at("ts", F.least(A.at(c, k + 1), F.size("ts") - 1))))
    return packed.withColumn("__x", means).withColumn("ts", times).withColumn("x", F.col("__x")).drop("__x")


def successive_novelty(packed: DataFrame) -> DataFrame:
    """Adds nc: distance of every vector to the next, brought to 0..1."""
    return packed.withColumn("nc", A.successive_distances(F.col("x"))).withColumn("nc", A.to_unit("nc", "abs"))


def adaptive_threshold(packed: DataFrame, size: int, share: float, nc: str = "nc", base: str | None = None) -> DataFrame:
    """Adds th: running median of the curve plus a share of the mean of base (the curve itself by default)."""
    level = A.mean(F.col(base or nc)) * share
    return packed.withColumn("th", V.let(level, lambda m: F.transform(A.median_filter(F.col(nc), size), lambda v: v + m)))


def pick_peaks(packed: DataFrame, nc: str = "nc", th: str = "th") -> DataFrame:
    """Adds peaks: frame numbers."""
    return packed.withColumn("peaks", A.peaks(F.col(nc), F.col(th)))


def with_ends(peaks: Column, n: Column) -> Column:
    """Boundaries: 0, the peaks, n - 1; sorted and distinct."""
    return F.array_distinct(F.array_sort(F.concat(F.array(F.lit(0)), peaks, F.array(n - 1))))


def ordinal_chroma(packed: DataFrame) -> DataFrame:
    """x + smallest value + 0.1, each row divided by its largest, in 80 log10."""
    low = F.array_min(F.transform("x", lambda v: F.array_min(v)))
    shifted = V.let(low, lambda m: F.transform("x", lambda v: F.transform(v, lambda y: y + (m + 0.1))))
    return packed.withColumn("x", F.transform(shifted, lambda v: V.let(F.array_max(v), lambda m: F.transform(v, lambda y: 80 * F.log10(y / m)))))


def frame_times(duration: Column, rate: float = 22050, hop: int = 1024) -> Column:
    """int(duration * rate / hop) equally spaced times from 0 to duration."""
    n = F.floor(duration * rate / hop).cast("int")
    return F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda k: F.when(n == 1, F.lit(0.0)).otherwise(duration * k / (n - 1)))


def tonnetz(packed: DataFrame) -> DataFrame:
    """Tonal centroids of 12-bin chroma, rows scaled to sum 1."""
    angles = [(7 / 6, 1.0, 0.0), (7 / 6, 1.0, 0.5), (3 / 2, 1.0, 0.0), (3 / 2, 1.0, 0.5), (2 / 3, 0.5, 0.0), (2 / 3, 0.5, 0.5)]
    phi = F.array(*[F.array(*[F.lit(r * math.cos(math.pi * (a * c - (0.5 - s)))) for c in range(12)]) for a, r, s in angles])
    scaled = F.transform("x", lambda v: V.scale(v, V.row_norm(v, 1)))
    return packed.withColumn("x", F.transform(scaled, lambda v: F.transform(phi, lambda p: V.dot(p, v))))
