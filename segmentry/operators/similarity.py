"""Self-similarity of packed tracks: matrices are arrays of rows, made and read within a track's row."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import vectors as V
from .sequences import columns_of, per_dimension


def standardised(packed: DataFrame) -> DataFrame:
    """Dimensions divided by their sample standard deviation; constant ones become 0."""

    def scaled(a):
        spread = V.let(A.mean(a), lambda m: F.sqrt(V.total(F.transform(a, lambda y: (y - m) * (y - m))) / (F.size(a) - 1)))
        return V.let(spread, lambda s: F.transform(a, lambda y: F.when(s > 0, y / s).otherwise(F.lit(0.0))))

    return packed.where(F.size("x") > 1).withColumn("x", per_dimension(F.col("x"), scaled))


def all_pairs(x, f) -> Column:
    """The matrix f(vector, vector)."""
    return V.let(x, lambda m: F.transform(m, lambda a: F.transform(m, lambda b: f(a, b))))


def distances(packed: DataFrame, name: str = "dist") -> DataFrame:
    """Adds the matrix of Euclidean distances."""
    return packed.withColumn(name, all_pairs(F.col("x"), V.euclidean))


def largest(m) -> Column:
    return F.array_max(F.transform(m, lambda r: F.array_max(r)))


def ssm(packed: DataFrame, kind: str = "seuclidean") -> DataFrame:
    """Adds ssm: `seuclidean` (1 - standardised distance / largest), `cosine`, `covariance` (of centred L2 rows) or `rbf`."""
    if kind == "seuclidean":
        d = distances(standardised(packed.withColumn("__x", F.col("x"))))
        similar = V.let("dist", lambda m: V.let(largest(m), lambda top: F.transform(m, lambda r: F.transform(r, lambda v: F.when(top > 0, 1 - v / top).otherwise(F.lit(1.0))))))
        return d.withColumn("ssm", similar).withColumn("x", F.col("__x")).drop("dist", "__x")
    rows = F.transform("x", V.l2_or_small)
    if kind == "cosine":
        return packed.withColumn("ssm", all_pairs(rows, V.dot))
    if kind in ("covariance", "autocorrelation"):
        centred = V.let(F.transform(columns_of(F.col("x")), A.mean), lambda m: F.transform("x", lambda v: V.l2_or_small(F.zip_with(v, m, lambda y, c: y - c))))
        return packed.withColumn("ssm", all_pairs(centred, V.dot))
    if kind == "rbf":
        off = lambda d: F.flatten(F.transform(A.positions(d), lambda i: F.transform(F.filter(A.positions(d), lambda j: j != i), lambda j: A.cell(d, i, j))))
        spread = lambda o: V.let(A.mean(o), lambda m: F.sqrt(V.total(F.transform(o, lambda v: (v - m) * (v - m))) / F.size(o)))
        similar = V.let(all_pairs(rows, V.euclidean), lambda d: V.let(1 / (2 * V.let(off(d), spread)), lambda g: F.transform(d, lambda r: F.transform(r, lambda v: F.exp(-g * v * v)))))
        return packed.where(F.size("x") > 1).withColumn("ssm", similar)
    raise ValueError(f"unknown similarity {kind}")


def nearest(packed: DataFrame, k: Column | int, width: int = 1) -> DataFrame:
    """Adds nn: for every position its k nearest ones, at least width away; ties go to the lower position."""
    k = k if isinstance(k, Column) else F.lit(k)
    # sort_array compares without a lambda; structs that are too near are sorted last and cut off
    far = lambda r, i: F.filter(F.transform(r, lambda v, j: F.struct(v.alias("d"), j.alias("j"))), lambda s: F.abs(i - s["j"]) >= width)
    ranked = V.let(all_pairs(F.col("x"), V.euclidean), lambda d: F.transform(d, lambda r, i: F.slice(F.sort_array(far(r, i)), 1, F.greatest(k, F.lit(0)))["j"]))
    return packed.withColumn("nn", ranked)


def recurrence(packed: DataFrame, k: Column | int, width: int = 1, mutual: bool = True) -> DataFrame:
    """Adds rec: 1.0 where j is among i's nearest (and, mutual, i among j's)."""

    def linked(nn, i, j):
        near = F.array_contains(A.at(nn, i), j)
        return F.when(near & F.array_contains(A.at(nn, j), i) if mutual else near, 1.0).otherwise(0.0)

    return nearest(packed, k, width).withColumn("rec", V.let("nn", lambda nn: A.matrix_rows(nn, lambda i, j: linked(nn, i, j))))


def lag_matrix(m) -> Column:
    """L[i][j] = m[(i + j) mod n][j]."""
    return V.let(m, lambda r: A.matrix_rows(r, lambda i, j: A.cell(r, F.pmod(i + j, F.size(r)), j)))


def unlag_matrix(lagged) -> Column:
    """The inverse of lag_matrix."""
    return V.let(lagged, lambda r: A.matrix_rows(r, lambda i, j: A.cell(r, F.pmod(i - j, F.size(r)), j)))


def time_lag_median(m, size: int) -> Column:
    """Median filter along the diagonals: the lag matrix is filtered along time, wrapped, and turned back."""
    return unlag_matrix(F.transform(lag_matrix(m), lambda r: A.median_filter(r, size, "wrap")))


def checkerboard(size: int) -> list[list[float]]:
    """Gaussian checkerboard of an even size, sigma a whole third of it; the off-diagonal quadrants are negative."""
    sigma = float(size // 3)
    g = [math.exp(-0.5 * ((k - (size - 1) / 2) / sigma) ** 2) for k in range(size)]
    half = size // 2
    return [[g[i] * g[j] * (-1 if (i < half) != (j < half) else 1) for j in range(size)] for i in range(size)]


def checkerboard_novelty(packed: DataFrame, size: int, ssm: str = "ssm") -> DataFrame:
    """Adds nc: the kernel laid over the diagonal at size/2 .. n - size/2, 0 elsewhere; only the band of half the size is read."""
    half = size // 2
    kernel = F.array(*[F.array(*[F.lit(v) for v in row]) for row in checkerboard(size)])

    def value(m, g, i):
        part = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda r: V.dot(F.slice(A.at(m, i - half + r), i - half + 1, F.lit(size)), A.at(g, r)))
        return F.when((i >= half) & (i <= F.size(m) - half), V.total(part)).otherwise(F.lit(0.0))

    curve = V.let(ssm, lambda m: V.let(kernel, lambda g: F.transform(A.positions(m), lambda i: value(m, g, i))))
    return packed.withColumn("nc", A.to_unit(curve, "min"))


def path_similarity(packed: DataFrame) -> DataFrame:
    """Adds path: exp(-squared distance of successive vectors / their median), n - 1 values."""
    steps = V.let("x", lambda x: F.transform(F.filter(A.positions(x), lambda i: i < F.size(x) - 1), lambda i: V.squared_distance(A.at(x, i), A.at(x, i + 1))))
    middle = lambda p: V.let(F.sort_array(p), lambda s: (A.at(s, F.floor((F.size(s) - 1) / 2)) + A.at(s, F.floor(F.size(s) / 2))) / 2)
    return packed.withColumn("path", V.let(steps, lambda p: V.let(middle(p), lambda m: F.transform(p, lambda v: F.exp(-v / m)))))


def balanced_affinity(packed: DataFrame, rec: str = "rec") -> DataFrame:
    """Adds degrees, mu and aff: mu * recurrence + (1 - mu) * path graph, mu balancing both degrees."""
    p = path_similarity(packed)
    degree = lambda w: F.transform(A.positions("x"), lambda i: F.coalesce(F.when(i > 0, A.at(w, i - 1)), F.lit(0.0)) + F.coalesce(A.at(w, i), F.lit(0.0)))
    p = p.withColumn("deg_path", V.let("path", degree)).withColumn("deg_rec", F.transform(rec, V.total))
    both = F.zip_with("deg_path", "deg_rec", lambda a, b: a + b)
    p = p.withColumn("mu", V.let(both, lambda b: V.dot("deg_path", b) / V.dot(b, b)))

    def cells(r, w, mu):
        edge = lambda i, j: F.when(F.abs(i - j) == 1, A.at(w, F.least(i, j))).otherwise(F.lit(0.0))
        return A.matrix_rows(r, lambda i, j: mu * A.cell(r, i, j) + (1 - mu) * edge(i, j))

    return p.withColumn("aff", V.let(rec, lambda r: V.let("path", lambda w: V.let("mu", lambda mu: cells(r, w, mu)))))


def normalised_laplacian(aff) -> Column:
    """Identity less D^-1/2 A D^-1/2; rows of degree 0 are 0."""

    def cells(m, d):
        whole = lambda i, j: F.when(i == j, 1.0).otherwise(0.0) - A.cell(m, i, j) / F.sqrt(A.at(d, i) * A.at(d, j))
        return A.matrix_rows(m, lambda i, j: F.when((A.at(d, i) == 0) | (A.at(d, j) == 0), F.lit(0.0)).otherwise(whole(i, j)))

    return V.let(aff, lambda m: V.let(F.transform(m, V.total), lambda d: cells(m, d)))
