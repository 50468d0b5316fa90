"""Column functions on vectors (ARRAY<DOUBLE>)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value, f) -> Column:
    """f(value), with value computed once however often f reads it, also in lambdas."""
    return F.get(F.transform(F.array(F.col(value) if isinstance(value, str) else value), f), 0)


def total(a) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def pairs(a, b, f) -> Column:
    return total(F.zip_with(a, b, f))


def dot(a, b) -> Column:
    return pairs(a, b, lambda x, y: x * y)


def squared_distance(a, b) -> Column:
    return pairs(a, b, lambda x, y: (x - y) * (x - y))


def euclidean(a, b) -> Column:
    return F.sqrt(squared_distance(a, b))


def l1(a, b) -> Column:
    return pairs(a, b, lambda x, y: F.abs(x - y))


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a, b) -> Column:
    """dot / norms; 0 if a norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def cosine_distance(a, b) -> Column:
    return 1 - cosine_similarity(a, b)


def absolute_cosine_distance(a, b) -> Column:
    return 1 - F.abs(cosine_similarity(a, b))


def kullback_leibler(a, b, floor: float = 1e-12) -> Column:
    """Sum of x ln(x / y) - x + y over positive parts."""
    return pairs(a, b, lambda x, y: F.greatest(x, F.lit(floor)) * F.ln(F.greatest(x, F.lit(floor)) / F.greatest(y, F.lit(floor))) - F.greatest(x, F.lit(floor)) + F.greatest(y, F.lit(floor)))


def weighted_squared_distance(a, b, w) -> Column:
    return total(F.zip_with(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), w, lambda d, v: d * v))


def scale(a, by: Column) -> Column:
    """a / by; a itself where by is 0."""
    return let(by, lambda n: F.when(n == 0, a).otherwise(F.transform(a, lambda x: x / n)))


def row_norm(a, kind: str | float) -> Column:
    """The norm of one row: `inf`, `-inf`, 0, or p > 0."""
    absolute = F.transform(a, lambda x: F.abs(x))
    if kind == "inf":
        return F.array_max(absolute)
    if kind == "-inf":
        return F.array_min(absolute)
    if kind == 0:
        return F.size(F.filter(a, lambda x: x != 0)).cast("double")
    return F.pow(F.aggregate(absolute, F.lit(0.0), lambda s, x: s + F.pow(x, F.lit(float(kind)))), F.lit(1.0 / float(kind)))


def l2_or_small(a) -> Column:
    """a divided by its Euclidean norm; rows of zeros become 1e-10."""
    return let(norm(a), lambda n: F.transform(a, lambda x: F.when(n == 0, F.lit(1e-10)).otherwise(x / n)))


def soft_threshold(x: Column, by: float) -> Column:
    return F.signum(x) * F.greatest(F.abs(x) - by, F.lit(0.0))


def positive_part(x: Column) -> Column:
    return (F.abs(x) + x) / 2


def negative_part(x: Column) -> Column:
    return (F.abs(x) - x) / 2


def magnitude(re: Column, im: Column) -> Column:
    return F.sqrt(re * re + im * im)
