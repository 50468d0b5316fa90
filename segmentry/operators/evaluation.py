"""Metrics of estimated against reference segmentations.

Both sides are (track_id, times ARRAY<DOUBLE>, labels ARRAY<STRING>): sorted boundary times, and one label
fewer. One equi-join on the track, then every metric is an expression on the row; no pair of frames
or boundaries of different tracks is ever made.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.vectors import let, total

WEIGHT = 0.58
BINS = 251


def middle(v) -> Column:
    return let(F.sort_array(v), lambda s: (A.at(s, F.floor((F.size(s) - 1) / 2)) + A.at(s, F.floor(F.size(s) / 2))) / 2)


def points(times) -> Column:
    return F.array_distinct(F.array_sort(F.transform(times, lambda t: F.round(t, 5))))


def trimmed(times) -> Column:
    return let(times, lambda t: F.slice(t, 2, F.greatest(F.size(t) - 2, F.lit(0))))


def matched(ref, est, window: float) -> Column:
    """Size of the largest one-to-one matching of points at most window apart: for each reference in order the earliest point left."""

    def one(e):
        def step(acc, r):
            k = F.greatest(acc["k"], F.size(F.filter(e, lambda x: x < r - window)))
            return let(k, lambda p: F.when((p < F.size(e)) & (A.at(e, p) <= r + window), F.struct((p + 1).alias("k"), (acc["m"] + 1).alias("m"))).otherwise(F.struct(p.alias("k"), acc["m"].alias("m"))))

        return F.aggregate(ref, F.struct(F.lit(0).alias("k"), F.lit(0).alias("m")), step, lambda a: a["m"])

    return let(est, one)


def f_measure(p: Column, r: Column, beta: float = 1.0) -> Column:
    b = beta * beta
    return F.when((p <= 0) & (r <= 0), 0.0).otherwise((1 + b) * p * r / (b * p + r))


def hit_rates(df: DataFrame, window: float, trim: bool, name: str, weighted: str) -> DataFrame:
    cut = trimmed if trim else (lambda t: t)
    df = df.withColumn("__r", cut(points("ref_times"))).withColumn("__e", cut(points("est_times")))
    df = df.withColumn("__m", matched("__r", "__e", window).cast("double"))
    none = (F.size("__r") == 0) | (F.size("__e") == 0)
    p = F.when(none, 0.0).otherwise(F.col("__m") / F.size("__e"))
    r = F.when(none, 0.0).otherwise(F.col("__m") / F.size("__r"))
    df = df.withColumn(f"{name}P", p).withColumn(f"{name}R", r)
    p, r = F.col(f"`{name}P`"), F.col(f"`{name}R`")
    return df.withColumn(f"{name}F", f_measure(p, r)).withColumn(weighted, f_measure(p, r, WEIGHT)).drop("__r", "__e", "__m")


def nearest_median(a, b) -> Column:
    """Median over a of the distance to the nearest of b; NaN-free: null if either is empty."""
    gaps = let(b, lambda y: F.transform(a, lambda t: F.array_min(F.transform(y, lambda u: F.abs(t - u)))))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), middle(gaps))


def deviations(df: DataFrame) -> DataFrame:
    for trim, t in ((False, ""), (True, "t")):
        cut = trimmed if trim else (lambda x: x)
        r, e = cut(points("ref_times")), cut(points("est_times"))
        df = df.withColumn("__r", r).withColumn("__e", e)
        df = df.withColumn(f"Dev{t}R2E", nearest_median(F.col("__r"), F.col("__e"))).withColumn(f"Dev{t}E2R", nearest_median(F.col("__e"), F.col("__r"))).drop("__r", "__e")
    return df


def error_entropy(ref, est, bins: int) -> Column:
    """Entropy in bits of the histogram of each estimate's error in units of the local interval of the reference."""

    def errors(r):
        def one(t):
            near = F.array_min(F.transform(A.positions(r), lambda k: F.struct(F.abs(t - A.at(r, k)).alias("d"), k.alias("k"))))

            def scaled(k):
                err = t - A.at(r, k)
                before, after = A.at(r, k) - A.at(r, k - 1), A.at(r, k + 1) - A.at(r, k)
                gap = F.when(k == F.size(r) - 1, before).when((k > 0) & (err < 0), before).otherwise(after)
                e = err / gap
                # wrapped to (-1/2, 1/2]
                return -(F.pmod(F.lit(0.5) - e, F.lit(1.0)) - 0.5)

            return let(near["k"], scaled)

        return F.transform(est, one)

    def entropy(e):
        n = F.size(e)
        low, high = F.array_min(e), F.array_max(e)
        cells = let(F.struct(low.alias("l"), high.alias("h")), lambda s: F.transform(e, lambda v: F.when(s["h"] == s["l"], F.lit(bins // 2)).otherwise(F.least(F.floor((v - s["l"]) / (s["h"] - s["l"]) * bins).cast("int"), F.lit(bins - 1)))))
        return let(cells, lambda c: total(F.transform(F.array_distinct(c), lambda x: let(F.size(F.filter(c, lambda y: y == x)) / n, lambda p: -p * F.log2(p)))))

    return let(ref, lambda r: let(errors(r), entropy))


def information_gain(ref, est, bins: int = BINS) -> Column:
    """(log2 bins - larger entropy of both directions) / log2 bins; null with fewer than 2 points on a side."""
    worst = F.greatest(error_entropy(ref, est, bins), error_entropy(est, ref, bins))
    return F.when((F.size(ref) > 1) & (F.size(est) > 1), (math.log2(bins) - worst) / math.log2(bins))


def aligned(df: DataFrame) -> DataFrame:
    """Both sides as arrays of (s, e, label) over [0, end of the reference]; gaps get labels of their own."""
    rows = lambda t, l: F.transform(F.filter(A.positions(t), lambda k: k < F.size(t) - 1), lambda k: F.struct(A.at(t, k).alias("s"), A.at(t, k + 1).alias("e"), A.at(l, k).alias("label")))  # noqa: E731, E741
    pad = lambda s, e, label: F.struct(s.alias("s"), e.alias("e"), F.lit(label).alias("label"))
    zero = F.lit(0.0)
    ref = F.concat(F.when(A.at("ref_times", 0) > 0, F.array(pad(zero, A.at("ref_times", 0), "__T_MIN"))).otherwise(F.array().cast("array<struct<s:double,e:double,label:string>>")), rows("ref_times", "ref_labels"))
    top = F.array_max("ref_times")
    clip = F.filter(F.transform(rows("est_times", "est_labels"), lambda x: F.struct(F.greatest(x["s"], zero).alias("s"), F.least(x["e"], top).alias("e"), x["label"].alias("label"))), lambda x: x["s"] < x["e"])
    none = F.array().cast("array<struct<s:double,e:double,label:string>>")
    first, last = F.least(A.at("est_times", 0), top), F.array_max("est_times")
    est = F.concat(F.when(first > 0, F.array(pad(zero, first, "__T_MIN"))).otherwise(none), clip, F.when(last < top, F.array(pad(F.greatest(last, zero), top, "__T_MAX"))).otherwise(none))
    return df.withColumn("ref_seg", F.filter(ref, lambda x: x["s"] < x["e"])).withColumn("est_seg", est)


def contingency(df: DataFrame, step: float = 0.1) -> DataFrame:
    """Adds cells: (r, e, n), the numbers of sample times k * step in both a reference and an estimated label."""
    ticks = lambda a, b: F.greatest(F.ceil(b / step - 1e-9) - F.ceil(a / step - 1e-9), F.lit(0)).cast("double")
    parts = F.flatten(F.transform("ref_seg", lambda r: F.transform(F.filter("est_seg", lambda e: (e["s"] < r["e"]) & (r["s"] < e["e"])), lambda e: F.struct(r["label"].alias("r"), e["label"].alias("e"), ticks(F.greatest(r["s"], e["s"]), F.least(r["e"], e["e"])).alias("n")))))
    keys = lambda p: F.array_distinct(F.transform(p, lambda x: F.struct(x["r"].alias("r"), x["e"].alias("e"))))
    cells = let(parts, lambda p: F.transform(keys(p), lambda k: F.struct(k["r"].alias("r"), k["e"].alias("e"), total(F.transform(F.filter(p, lambda x: (x["r"] == k["r"]) & (x["e"] == k["e"])), lambda x: x["n"])).alias("n"))))
    return df.withColumn("cells", F.filter(cells, lambda c: c["n"] > 0))


def margin(cells, side: str) -> Column:
    """The counts by label of one side."""
    return let(cells, lambda c: F.transform(F.array_distinct(F.transform(c, lambda x: x[side])), lambda k: total(F.transform(F.filter(c, lambda x: x[side] == k), lambda x: x["n"]))))


def label_scores(df: DataFrame) -> DataFrame:
    """Adds PWP, PWR, PWF, So, Su, Sf; null where a label list has -1 or @."""
    df = contingency(aligned(df))
    counts = F.transform("cells", lambda c: c["n"])
    two = lambda a: total(F.transform(a, lambda n: n * (n - 1) / 2))
    df = df.withColumn("__e", margin("cells", "e")).withColumn("__r", margin("cells", "r")).withColumn("__n", total(counts))
    entropy = lambda a, n: total(F.transform(a, lambda x: F.when(x > 0, -x / n * F.log2(x / n)).otherwise(0.0)))
    df = df.withColumn("__both", two(counts)).withColumn("__he", entropy("__e", F.col("__n"))).withColumn("__hr", entropy("__r", F.col("__n"))).withColumn("__h", entropy(counts, F.col("__n")))
    df = df.withColumn("PWP", F.try_divide("__both", two("__e"))).withColumn("PWR", F.try_divide("__both", two("__r")))
    # a side with one label has no entropy to explain
    df = df.withColumn("So", F.when(F.size("__e") <= 1, 1.0).otherwise(1 - (F.col("__h") - F.col("__hr")) / F.log2(F.size("__e")))).withColumn("Su", F.when(F.size("__r") <= 1, 1.0).otherwise(1 - (F.col("__h") - F.col("__he")) / F.log2(F.size("__r"))))
    df = df.withColumn("PWF", f_measure(F.col("PWP"), F.col("PWR"))).withColumn("Sf", f_measure(F.col("So"), F.col("Su")))
    none = F.exists("est_labels", lambda x: x.isin("-1", "@")) | F.exists("ref_labels", lambda x: x.isin("-1", "@"))
    for c in ("PWP", "PWR", "PWF", "So", "Su", "Sf"):
        df = df.withColumn(c, F.when(none, F.lit(None).cast("double")).otherwise(F.col(c)))
    return df.drop("__e", "__r", "__n", "__both", "__he", "__hr", "__h", "cells", "ref_seg", "est_seg")


def joined(est: DataFrame, ref: DataFrame) -> DataFrame:
    e = est.select("track_id", F.col("times").alias("est_times"), F.col("labels").alias("est_labels"), *[c for c in est.columns if c == "params"])
    r = ref.select("track_id", F.col("times").alias("ref_times"), F.col("labels").alias("ref_labels"))
    return e.join(r, "track_id")


def evaluate(est: DataFrame, ref: DataFrame, bins: int = BINS) -> DataFrame:
    """One row of all metrics per track that has both sides."""
    df = joined(est, ref)
    for window in ("3", "0.5"):
        df = hit_rates(df, float(window), False, f"HitRate_{window}", f"HitRate_w{window}F")
        df = hit_rates(df, float(window), True, f"HitRate_t{window}", f"HitRate_wt{window}F")
    df = deviations(df).withColumn("D", information_gain(points("ref_times"), points("est_times"), bins))
    return label_scores(df).withColumn("ds_name", F.split("track_id", "_")[0]).drop("est_times", "est_labels", "ref_times", "ref_labels")


def summary(results: DataFrame, *by: str) -> DataFrame:
    """Mean of every numeric column, by the columns given."""
    return results.groupBy(*by).agg(*[F.avg(F.col(f"`{c}`")).alias(c) for c, kind in results.dtypes if kind == "double"])


def missing_references(est: DataFrame, ref: DataFrame) -> DataFrame:
    """Tracks with an estimation and no reference."""
    return est.join(ref, "track_id", "left_anti").select("track_id")


def align_ends(df: DataFrame, threshold: float = 1.0, a: str = "est_levels", b: str = "ref_levels") -> DataFrame:
    """Sets the last time of every level of a to that of b if the durations differ by no more than threshold."""
    end = lambda h: F.element_at(A.at(h, 0), -1)
    moved = let(F.array(end(b)), lambda t: F.transform(a, lambda level: F.concat(F.slice(level, 1, F.size(level) - 1), t)))
    return df.withColumn(a, F.when(F.abs(end(a) - end(b)) <= threshold, moved).otherwise(F.col(a)))
