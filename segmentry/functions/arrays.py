"""Column functions on sequences: arrays whose positions are frames.

Filters read a neighbourhood of every position; positions beyond the ends are reflected
(d c b a | a b c d | d c b a), wrapped, or zero.
"""

from __future__ import annotations

import math
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import euclidean, let, total


def held(f):
    """Binds the first argument once, so that lambdas of f never compute it again."""

    @wraps(f)
    def with_first(a, *args, **named):
        return let(a, lambda v: f(v, *args, **named))

    return with_first


def positions(a) -> Column:
    """0 to size - 1; empty for an empty array."""
    return F.when(F.size(a) > 0, F.sequence(F.lit(0), F.size(a) - 1)).otherwise(F.array().cast("array<int>"))


def at(a, i) -> Column:
    return F.get(a, i.cast("int") if isinstance(i, Column) else F.lit(i))


def placed(k: Column, n: Column, mode: str) -> Column:
    if mode == "wrap":
        return F.pmod(k, n)
    r = F.pmod(k, 2 * n)
    return F.when(r < n, r).otherwise(2 * n - 1 - r)


def neighbour(a, k: Column, mode: str) -> Column:
    n = F.size(a)
    if mode == "zero":
        return F.when((k < 0) | (k >= n), F.lit(0.0)).otherwise(at(a, k))
    return at(a, placed(k, n, mode))


@held
def neighbourhoods(a, low: int, high: int, mode: str, f) -> Column:
    """f(values at i + low .. i + high) for every position i; the ends are padded once, and windows are slices."""
    padded = F.when(F.size(a) > 0, F.transform(F.sequence(F.lit(low), F.size(a) - 1 + high), lambda k: neighbour(a, k, mode))).otherwise(a)
    return let(padded, lambda p: F.transform(positions(a), lambda i: f(F.slice(p, i + 1, F.lit(high - low + 1)))))


@held
def median_filter(a, size: int, mode: str = "reflect") -> Column:
    """Median of size values; an even size reaches one further back and takes the upper median."""
    return neighbourhoods(a, -(size // 2), size - size // 2 - 1, mode, lambda v: F.get(F.sort_array(v), F.lit(size // 2)))


def gaussian_weights(sigma: float, reach: float = 4.0) -> list[float]:
    radius = int(reach * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [x / math.fsum(w) for x in w]


@held
def gaussian_filter(a, sigma: float, mode: str = "reflect") -> Column:
    w = gaussian_weights(sigma)
    radius, weights = len(w) // 2, F.array(*[F.lit(x) for x in w])
    return neighbourhoods(a, -radius, radius, mode, lambda v: total(F.zip_with(v, weights, lambda x, y: x * y)))


@held
def mean(a) -> Column:
    return total(a) / F.size(a)


@held
def to_unit(a, add: str = "min") -> Column:
    """(a + min) / max of that; add `abs` adds the minimum's size, `subtract` takes the minimum away."""
    low = F.array_min(a)
    shift = {"min": low, "abs": F.abs(low), "subtract": -low}[add]
    return let(shift, lambda s: let(F.array_max(a) + s, lambda top: F.transform(a, lambda v: F.when(top == 0, F.lit(0.0)).otherwise((v + s) / top))))


@held
def successive_distances(x) -> Column:
    """Euclidean distance of every vector to the next; 0 for the last."""
    return F.transform(positions(x), lambda i: F.when(i < F.size(x) - 1, euclidean(at(x, i), at(x, i + 1))).otherwise(F.lit(0.0)))


@held
def peaks(a, threshold) -> Column:
    """Positions, ends excluded, above both neighbours and above the threshold's value there."""
    return let(threshold, lambda th: F.filter(positions(a), lambda i: (i > 0) & (i < F.size(a) - 1) & (at(a, i - 1) < at(a, i)) & (at(a, i) > at(a, i + 1)) & (at(a, i) > at(th, i))))


@held
def change_points(a) -> Column:
    """Positions whose value differs from the one before."""
    return F.filter(positions(a), lambda i: (i > 0) & (at(a, i) != at(a, i - 1)))


@held
def stack_memory(x) -> Column:
    """Every vector followed by the one before it; zeros before the first."""
    return F.transform(positions(x), lambda i: F.concat(at(x, i), F.when(i > 0, at(x, i - 1)).otherwise(F.transform(at(x, i), lambda v: F.lit(0.0)))))


@held
def delay_embedding(x, m: float) -> Column:
    """Vectors i to i + int(m) - 1 in one, with the leading share m - int(m) of the next; size - ceil(m) positions."""
    whole, rest = int(m), m % 1
    last = F.size(x) - math.ceil(m)
    rows = F.when(last > 0, F.sequence(F.lit(0), last - 1)).otherwise(F.array().cast("array<int>"))

    def row(i):
        body = F.flatten(F.slice(x, i + 1, whole))
        return body if not rest else F.concat(body, F.slice(at(x, i + whole), 1, F.floor(F.size(at(x, i)) * rest).cast("int")))

    return F.transform(rows, row)


def matrix_rows(x, f) -> Column:
    """The matrix f(i, j) of all pairs of positions."""
    return F.transform(positions(x), lambda i: F.transform(positions(x), lambda j: f(i, j)))


def cell(m, i, j) -> Column:
    return at(at(m, i), j)
