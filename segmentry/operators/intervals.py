"""Boundaries, intervals and labels: long tables (track_id, ...) and arrays on packed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays as A


def times_to_intervals(times: DataFrame) -> DataFrame:
    """(track_id, t) to (track_id, seg, start, end)."""
    w = W.partitionBy("track_id").orderBy("t")
    return times.select("track_id", (F.row_number().over(w) - 1).alias("seg"), F.col("t").alias("start"), F.lead("t").over(w).alias("end")).where("end is not null")


def intervals_to_times(intervals: DataFrame) -> DataFrame:
    """All starts, and the last end."""
    last = intervals.groupBy("track_id").agg(F.max_by("end", "seg").alias("t"))
    return intervals.select("track_id", F.col("start").alias("t")).unionByName(last)


def drop_empty(intervals: DataFrame) -> DataFrame:
    """Segments with start < end, numbered anew."""
    w = W.partitionBy("track_id").orderBy("start", "end", "seg")
    kept = intervals.where("start < end")
    return kept.withColumn("seg", F.row_number().over(w) - 1)


def edge_silence(segments: DataFrame, tracks: DataFrame) -> DataFrame:
    """Segments (track_id, seg, start, end, label INT) with a first one from 0 and a last one to the duration, labelled largest + 1; empty ones go."""
    ends = segments.groupBy("track_id").agg(F.min("start").alias("first"), F.max("end").alias("last"), (F.max("label") + 1).alias("label")).join(tracks.select("track_id", "dur"), "track_id")
    head = ends.select("track_id", F.lit(-1).alias("seg"), F.lit(0.0).alias("start"), F.col("first").alias("end"), "label")
    tail = ends.select("track_id", F.lit(2**31 - 1).alias("seg"), F.col("last").alias("start"), F.col("dur").alias("end"), "label")
    return drop_empty(segments.select("track_id", "seg", "start", "end", "label").unionByName(head).unionByName(tail))


def align_to_next_frame(times: DataFrame, frames: DataFrame) -> DataFrame:
    """As-of join forward: (track_id, t, frame), the first frame at or after each time, the last frame if there is none.

    Both sides are merged and read backwards once per track, so no pair of a time and a frame is ever made.
    """
    both = frames.select("track_id", "t", F.col("i").alias("frame"), F.lit(1).alias("kind")).unionByName(times.select("track_id", "t", F.lit(None).cast("int").alias("frame"), F.lit(0).alias("kind")))
    after = W.partitionBy("track_id").orderBy("t", "kind").rowsBetween(0, W.unboundedFollowing)
    whole = W.partitionBy("track_id")
    found = F.coalesce(F.first("frame", ignorenulls=True).over(after), F.max("frame").over(whole))
    return both.withColumn("found", found).where("kind = 0 and found is not null").select("track_id", "t", F.col("found").alias("frame"))


def frame_labels(bounds, labels, n: Column) -> Column:
    """The label of every frame; 0 where no segment is."""
    seg = lambda i: F.size(F.filter(bounds, lambda b: b <= i)) - 1
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(A.at(labels, seg(i)), F.lit(0)))


def synchronize_labels(new_bounds, old_bounds, old_labels, n: Column) -> Column:
    """For every new segment the median label of its frames, the mean of both middle ones if their number is even."""
    from ..functions.vectors import let

    def median(v):
        return let(F.sort_array(v), lambda s: (A.at(s, F.floor((F.size(s) - 1) / 2)) + A.at(s, F.floor(F.size(s) / 2))) / 2)

    def run(frames, b):
        return F.transform(F.filter(A.positions(b), lambda k: k < F.size(b) - 1), lambda k: median(F.slice(frames, A.at(b, k) + 1, A.at(b, k + 1) - A.at(b, k))))

    return let(frame_labels(old_bounds, old_labels, n), lambda f: let(new_bounds, lambda b: run(f, b)))


def segment_mode(frame_values: DataFrame, segments: DataFrame) -> DataFrame:
    """(track_id, seg, label): the most frequent value of the frames of each segment, the smallest of equally frequent ones."""
    inside = frame_values.join(segments, "track_id").where((F.col("i") >= F.col("first")) & (F.col("i") < F.col("last"))).select("track_id", "seg", "value")
    counts = inside.groupBy("track_id", "seg", "value").agg(F.count("*").alias("n"))
    return counts.groupBy("track_id", "seg").agg(F.max_by("value", F.struct("n", -F.col("value"))).alias("label"))


def overlap_matrix(est: DataFrame, ref: DataFrame) -> DataFrame:
    """(track_id, est_label, ref_label, overlap): shared time by pair of labels; pairs without any are absent."""
    e = est.select("track_id", F.col("start").alias("es"), F.col("end").alias("ee"), F.col("label").alias("est_label"))
    r = ref.select("track_id", F.col("start").alias("rs"), F.col("end").alias("re"), F.col("label").alias("ref_label"))
    shared = F.least("ee", "re") - F.greatest("es", "rs")
    joined = e.join(r, "track_id").where((F.col("es") < F.col("re")) & (F.col("rs") < F.col("ee")))
    return joined.groupBy("track_id", "est_label", "ref_label").agg(F.sum(shared).alias("overlap"))


def relabel(overlaps: DataFrame, est_labels: DataFrame, ref_labels: DataFrame) -> DataFrame:
    """(track_id, est_label, new_label): a greedy one-to-one matching by overlap; labels left over get estimated ids that no reference has.

    Equal overlaps go to the larger pair of labels. Both label lists of a track are read in one row.
    """
    pairs = overlaps.groupBy("track_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("overlap", "est_label", "ref_label")))).alias("pairs"))
    e = est_labels.groupBy("track_id").agg(F.array_sort(F.collect_set("label")).alias("est"))
    r = ref_labels.groupBy("track_id").agg(F.array_sort(F.collect_set("label")).alias("ref"))
    both = e.join(r, "track_id", "left").join(pairs, "track_id", "left")
    start = F.array().cast("array<struct<e:int,r:int>>")
    hit = lambda acc, p: F.exists(acc, lambda q: (q["e"] == p["est_label"]) | (q["r"] == p["ref_label"]))
    match = F.aggregate(F.coalesce("pairs", F.array().cast("array<struct<overlap:double,est_label:int,ref_label:int>>")), start, lambda acc, p: F.when(hit(acc, p), acc).otherwise(F.concat(acc, F.array(F.struct(p["est_label"].cast("int").alias("e"), p["ref_label"].cast("int").alias("r"))))))
    both = both.withColumn("match", match)
    left = F.filter("est", lambda x: ~F.exists("match", lambda q: q["e"] == x))
    unused = F.array_except("est", F.coalesce("ref", F.array().cast("array<int>")))
    rest = F.filter(F.arrays_zip(left.alias("e"), unused.alias("r")), lambda q: q["e"].isNotNull() & q["r"].isNotNull())
    both = both.withColumn("rest", F.transform(rest, lambda q: F.struct(q["e"].cast("int").alias("e"), q["r"].cast("int").alias("r"))))
    return both.select("track_id", F.inline(F.concat("match", "rest"))).select("track_id", F.col("e").alias("est_label"), F.col("r").alias("new_label"))
