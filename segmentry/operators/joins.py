"""Joins of time-ordered tables: feature zip, best-overlap intervals, nearest points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.vectors import let


def zip_features(a: DataFrame, b: DataFrame) -> DataFrame:
    """Packed tracks with a second matrix x2; tracks whose time axes differ are left out (see unequal_axes)."""
    other = b.select("track_id", F.col("ts").alias("__ts"), F.col("x").alias("x2"))
    return a.join(other, "track_id").where(F.col("ts") == F.col("__ts")).drop("__ts")


def unequal_axes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Tracks of both tables whose time axes differ."""
    other = b.select("track_id", F.col("ts").alias("__ts"))
    return a.select("track_id", "ts").join(other, "track_id").where(F.col("ts") != F.col("__ts")).select("track_id")


def match_intervals(a: DataFrame, b: DataFrame) -> DataFrame:
    """(track_id, seg, match): for every interval of a the interval of b that it shares most time with, the earliest of equal ones.

    Both sides (track_id, seg, start, end) are gathered by track; intervals without shared time go to the nearest by centre.
    """
    pack = lambda t, name: t.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "seg"))).alias(name))
    both = pack(a, "p").join(pack(b, "q"), "track_id")
    shared = lambda x, y: F.least(x["end"], y["end"]) - F.greatest(x["start"], y["start"])
    best = lambda x: F.array_max(F.transform("q", lambda y: F.struct(F.greatest(shared(x, y), F.lit(0.0)).alias("o"), (-F.abs(x["start"] + x["end"] - y["start"] - y["end"])).alias("c"), (-y["seg"]).alias("seg"))))
    return both.select("track_id", F.inline_outer(F.transform("p", lambda x: F.struct(x["seg"].alias("seg"), (-best(x)["seg"]).alias("match"))))).where("seg is not null")


def nearest_points(a: DataFrame, b: DataFrame) -> DataFrame:
    """(track_id, t, gap): for every time of a the distance to the nearest time of b."""
    pack = lambda t, name: t.groupBy("track_id").agg(F.array_sort(F.collect_list("t")).alias(name))
    both = pack(a, "p").join(pack(b, "q"), "track_id")
    gap = let("q", lambda q: F.transform("p", lambda t: F.struct(t.alias("t"), F.array_min(F.transform(q, lambda u: F.abs(t - u))).alias("gap"))))
    return both.select("track_id", F.inline_outer(gap)).where("t is not null")


def covariance(rows: DataFrame, vec: str = "vec") -> DataFrame:
    """(i, j, v): sample covariances of all dimensions, from sums that are added in the map tasks."""
    n = rows.select(F.posexplode(vec).alias("i", "x"), F.col(vec).alias("w")).select("i", "x", F.posexplode("w").alias("j", "y"))
    return n.groupBy("i", "j").agg(F.covar_samp("x", "y").alias("v"))


def positions_of_zero_rows(x) -> A.Column:
    """Frames whose vector is zero throughout."""
    return F.filter(A.positions(x), lambda i: ~F.exists(A.at(x, i), lambda v: v != 0))


def drop_zero_rows(packed, x: str = "x"):
    """packed without the frames whose vector is zero throughout, and without their times."""
    keep = F.filter(A.positions(F.col(x)), lambda i: F.exists(A.at(F.col(x), i), lambda v: v != 0))

    def kept(c):
        return F.transform("__keep", lambda i: A.at(F.col(c), i)).alias(c)

    numbered = packed.withColumn("__keep", keep)
    return numbered.select(*[kept(c) if c in (x, "ts") else F.col(c) for c in packed.columns])
