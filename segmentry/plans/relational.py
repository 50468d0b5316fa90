"""Boundary algorithms as column expressions over packed tracks; none needs a shuffle beyond the packing.

The curves of foote and sf, which take all pairs of frames, are those of matrices.py; `operators/similarity.py` has the same steps as expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import vectors as V
from ..operators import sequences as S
from ..operators import similarity as M
from . import matrices as T


def foote(packed: DataFrame, m_gaussian: int = 66, m_median: int = 12, l_peaks: int = 64, norm: str | float | None = "min_max") -> DataFrame:
    """Adds nc (smoothed novelty), th and bounds: peaks of a checkerboard kernel along the diagonal of the similarity."""
    size = m_gaussian + m_gaussian % 2
    p = S.median_smooth(S.normalise(packed, norm), m_median).where(F.size("x") > 1)
    p = T.with_curve(p, lambda x: T.checkerboard_curve(x, size)).withColumn("nc", A.to_unit("nc", "min"))
    p = p.withColumn("__raw", F.col("nc")).withColumn("nc", A.gaussian_filter("__raw", 4.0))
    p = S.pick_peaks(S.adaptive_threshold(p, l_peaks, 1 / 20, base="__raw"))
    return p.withColumn("bounds", S.with_ends(F.col("peaks"), F.size("x"))).drop("__raw", "peaks")


def sf(packed: DataFrame, m_gaussian: int = 27, m_embedded: float = 3, k_nearest: float = 0.04, mp_adaptive: int = 28, offset: float = 0.05, norm: str | float | None = "inf") -> DataFrame:
    """Adds nc, th and bounds: peaks of the change of structural features. Tracks of 20 or fewer frames get their ends only."""
    p = S.normalise(packed, norm).withColumn("__n", F.size("x"))
    short = p.where("__n <= 20").select("track_id", F.array().cast("array<double>").alias("nc"), F.array().cast("array<double>").alias("th"), F.array_distinct(F.array(F.lit(0), F.col("__n") - 1)).alias("bounds"))
    # the embedding has ceil(m_embedded) frames fewer than the track
    fewer = math.ceil(m_embedded)
    q = T.with_curve(S.delay_embedding(p.where("__n > 20"), m_embedded), lambda x: T.structural_curve(x, int(k_nearest * (len(x) + fewer)), m_gaussian))
    q = q.withColumn("nc", A.to_unit("nc", "abs"))
    q = S.pick_peaks(S.adaptive_threshold(q, mp_adaptive, offset))
    shift = math.ceil(m_embedded / 2)
    moved = F.transform("peaks", lambda i: i + shift)
    return q.select("track_id", "nc", "th", S.with_ends(moved, F.col("__n")).alias("bounds")).unionByName(short)


def penalty(n: Column, kind: str = "modulo8") -> Column:
    """Cost of a segment of n frames."""
    if kind == "modulo8":
        return F.when(n == 8, 0.0).when(n % 4 == 0, 0.25).when(n % 2 == 0, 0.5).otherwise(1.0)
    if kind == "modulo4":
        return F.when(n % 4 == 0, 0.0).when(n % 2 == 0, 0.5).otherwise(1.0)
    if kind == "modulo8modulo4":
        return F.when(n == 8, 0.0).when(n == 4, 0.25).when(n % 2 == 0, 0.5).otherwise(1.0)
    powers = {"target_deviation_8_alpha_half": 0.5, "target_deviation_8_alpha_one": 1.0, "target_deviation_8_alpha_two": 2.0}
    if kind not in powers:
        raise ValueError(f"unknown penalty {kind}")
    return F.pow(F.abs(n - 8).cast("double"), F.lit(powers[kind]))


def band_scores(ssm, max_size: int, bands: int | None) -> Column:
    """scores[end][p - 1]: sum of the off-diagonal similarities within bands of the p frames before end, over p squared.

    Every sum follows from that of one frame fewer, by the cells of the new first frame.
    """
    reach = max_size if bands is None else bands

    def row(m, end):
        longest = F.least(end, F.lit(max_size))

        def grow(acc, p):
            first = end - p
            near = F.least(p - 1, F.lit(reach)) if bands is not None else p - 1
            new = V.total(F.when(near > 0, F.slice(A.at(m, first), first + 2, F.greatest(near, F.lit(0)))).otherwise(F.array().cast("array<double>"))) * 2
            return F.struct((acc["sum"] + new).alias("sum"), F.concat(acc["out"], F.array((acc["sum"] + new) / (p * p))).alias("out"))

        start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("out"))
        return F.when(end == 0, F.array().cast("array<double>")).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(longest, F.lit(1))), start, grow, lambda a: a["out"]))

    return V.let(ssm, lambda m: F.transform(A.positions(m), lambda end: row(m, end)))


def cbm(packed: DataFrame, ssm: str = "rbf", penalty_weight: float = 1.0, penalty_func: str = "modulo8", bands: int | None = 7, min_size: int = 1, max_size: int = 32) -> DataFrame:
    """Adds bounds: the segmentation of greatest total score, by dynamic programming as a fold over the frames."""
    p = M.ssm(packed, ssm).withColumn("scores", band_scores(F.col("ssm"), max_size, bands))
    costs = F.array(*[penalty(F.lit(n), penalty_func).cast("double") for n in range(1, max_size + 1)])

    def run(s, c):
        eight = F.greatest(F.lit(0.0), F.coalesce(F.array_max(F.transform(F.slice(s, 9, F.greatest(F.size(s) - 8, F.lit(1))), lambda r: F.coalesce(A.at(r, 7), F.lit(0.0)))), F.lit(0.0)))

        def step(top):
            def one(acc, end):
                choices = F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.least(end, F.lit(max_size)), F.lit(1))), lambda n: (n >= min_size) | (n == end)), lambda n: F.struct((A.at(acc["best"], end - n) + A.at(A.at(s, end), n - 1) * n - A.at(c, n - 1) * penalty_weight * top).alias("v"), n.alias("n")))
                # the greatest value; of equal ones the earliest start, which is the longest segment
                return V.let(F.array_max(choices), lambda b: F.struct(F.concat(acc["best"], F.array(b["v"])).alias("best"), F.concat(acc["from"], F.array(end - b["n"])).alias("from")))

            return one

        start = F.struct(F.array(F.lit(0.0)).alias("best"), F.array(F.lit(0)).alias("from"))
        return V.let(eight, lambda top: F.aggregate(F.filter(A.positions(s), lambda i: i > 0), start, step(top), lambda a: a["from"]))

    def back(origin):
        return F.aggregate(A.positions(origin), F.array(F.size(origin) - 1), lambda acc, _: F.when(A.at(acc, 0) > 0, F.concat(F.array(A.at(origin, A.at(acc, 0))), acc)).otherwise(acc))

    origin = V.let("scores", lambda s: V.let(costs, lambda c: run(s, c)))
    return p.withColumn("bounds", F.array_distinct(V.let(origin, back))).drop("ssm")


def ground_truth(times: DataFrame, frames: DataFrame) -> DataFrame:
    """bounds from annotated times: the first frame at or after each (the last if there is none), with both ends."""
    near = lambda t: F.least(F.size(F.filter("ts", lambda f: f < t)), F.size("ts") - 1)
    joined = frames.select("track_id", "ts").join(times, "track_id")
    return joined.select("track_id", S.with_ends(F.transform("times", near), F.size("ts")).alias("bounds"))
