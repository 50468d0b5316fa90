"""Queries of the library by name, each over whole tables, and their DuckDB twins (twins.py)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import arrays as A
from .functions import vectors as V
from .operators import evaluation as E
from .operators import factor
from .operators import intervals as I  # noqa: E741
from .operators import sequences as S
from .operators import similarity as M
from .plans import api
from .plans import long_track
from .plans import matrices as T
from .plans import registry as G
from .plans import relational as R
from .sources import annotations as ann
from .sources import frames as src

#: Small kernels: event tracks have 45 to 99 frames.
FOOTE = {"m_gaussian": 16, "m_median": 4, "l_peaks": 8}
SF = {"m_gaussian": 7, "m_embedded": 3, "k_nearest": 0.1, "mp_adaptive": 8}
PLACES = 6
#: Tracks of more frames are not compared within one task.
LONG = 1_000


def r6(c) -> Column:
    return F.round(c, PLACES)


def cells(packed: DataFrame, x: str = "x") -> DataFrame:
    """(track_id, i, d, v): the values of a matrix column."""
    rows = src.spread(packed, x, "i", "row").select("track_id", F.col("i").cast("long").alias("i"), "row")
    return src.spread(rows, "row", "d", "v", "i").select("track_id", "i", F.col("d").cast("long").alias("d"), r6("v").alias("v"))


def curve(packed: DataFrame, x: str) -> DataFrame:
    return src.spread(packed, x, "i", "v").select("track_id", F.col("i").cast("long").alias("i"), r6(F.col("v").cast("double")).alias("v"))


def bounds(packed: DataFrame) -> DataFrame:
    return src.spread(packed, "bounds", "k", "frame").select("track_id", F.col("k").cast("long").alias("k"), F.col("frame").cast("long").alias("frame"))


def on_events(f):
    return lambda spark, d: f(src.events_packed(spark, d))


def upper(packed: DataFrame, m: str) -> DataFrame:
    """(track_id, i, j, v) of the cells over the diagonal."""
    return cells(packed, m).where("i < d").withColumnRenamed("d", "j")


def days(packed: DataFrame) -> Column:
    """Frame numbers, after 0, where a new day begins."""
    day = F.transform("ts", lambda t: F.floor(t / 86400))
    return A.change_points(day)


def plain_novelty(packed: DataFrame) -> DataFrame:
    return S.successive_novelty(S.normalise(packed, "inf"))


def plain_peaks(packed: DataFrame) -> DataFrame:
    return S.pick_peaks(S.adaptive_threshold(plain_novelty(packed), 8, 0.05))


def main_type(x) -> Column:
    """Number of the event type of every frame."""
    return F.transform(x, lambda v: (F.array_position(F.slice(v, 2, 5), 1.0) - 1).cast("int"))


def estimated(packed: DataFrame) -> DataFrame:
    """Segments between novelty peaks as (track_id, times, labels); a label is the event type at the start. Times are frame numbers."""
    p = plain_peaks(packed.withColumn("types", main_type(F.col("x")))).withColumn("b", S.with_ends(F.col("peaks"), F.size("x")))
    labels = F.transform(F.filter(A.positions("b"), lambda k: k < F.size("b") - 1), lambda k: A.at("types", A.at("b", k)).cast("string"))
    return p.select("track_id", F.transform("b", lambda t: t.cast("double")).alias("times"), labels.alias("labels")).where("size(times) > 1")


def annotated(packed: DataFrame) -> DataFrame:
    """Segments of a day; the label is the day's number modulo 3."""
    p = packed.withColumn("b", S.with_ends(days(packed), F.size("x")))
    labels = F.transform(F.filter(A.positions("b"), lambda k: k < F.size("b") - 1), lambda k: F.pmod(F.floor(A.at("ts", A.at("b", k)) / 86400), F.lit(3)).cast("string"))
    return p.select("track_id", F.transform("b", lambda t: t.cast("double")).alias("times"), labels.alias("labels")).where("size(times) > 1")


def sides(spark, d) -> DataFrame:
    """Both segmentations from one packing; no join is needed here."""
    p = src.events_packed(spark, d)
    return E.joined(estimated(p), annotated(p))


def metric(df: DataFrame, *names: str) -> DataFrame:
    return df.select("track_id", *[r6(F.col(f"`{n}`").cast("double")).alias(n.replace(".", "_")) for n in names])


def label_runs(spark, d) -> DataFrame:
    """Runs of equal labels of the embeddings: (track_id, seg, start, end, label). Places are numbered by ranges, and neighbours meet by joins on places."""
    rows = src.numbered(src.table(spark, d, "embeddings").select("vec_id", "label"), "vec_id")
    before = rows.select((F.col("i") + 1).alias("i"), F.col("label").alias("before"))
    starts = rows.join(before, "i", "left").where("before is null or before <> label").select("i", "label")
    runs = src.numbered(starts, "i", "seg")
    after = runs.select((F.col("seg") - 1).alias("seg"), F.col("i").alias("next"))
    whole = rows.agg(F.count("*").alias("n"))
    got = runs.join(after, "seg", "left").join(F.broadcast(whole))
    return got.select(F.lit("embeddings").alias("track_id"), F.col("seg").cast("int").alias("seg"), F.col("i").cast("double").alias("start"), F.coalesce("next", "n").cast("double").alias("end"), "label")


def run_times(spark, d) -> DataFrame:
    runs = label_runs(spark, d)
    return I.intervals_to_times(runs)


def as_segments(seg: DataFrame) -> DataFrame:
    return seg.select("track_id", F.col("seg").cast("long").alias("seg"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), F.col("label").cast("long").alias("label"))


def frames_from_events(spark, d):
    return src.unpack(src.events_packed(spark, d)).select("track_id", F.col("i").cast("long").alias("i"), r6("t").alias("t"), r6(F.get("vec", 0)).alias("value"), F.array_join(F.transform(F.slice("vec", 2, 5), lambda v: v.cast("int").cast("string")), "").alias("types"), F.get("vec", 6).alias("k"))


def frames_from_embeddings(spark, d):
    f = src.embedding_frames(spark, d)
    return f.select("track_id", "i", F.posexplode("vec").alias("d", "v")).select("track_id", "i", F.col("d").cast("long").alias("d"), r6("v").alias("v"))


def beat_sync_mean(spark, d):
    p = src.events_packed(spark, d)
    p = p.withColumn("beats", days(p))
    return cells(S.beat_sync(p))


def mu_and_total(x):
    _, mu, aff = T.affinity(x)
    return [mu], [aff.sum()]


def cbm_segment_scores(spark, d):
    p = M.ssm(src.events_packed(spark, d), "cosine")
    p = p.withColumn("s", R.band_scores(F.col("ssm"), 16, 7))
    rows = src.spread(p, "s", "end", "row").select("track_id", F.col("end").cast("long").alias("end"), "row")
    return src.spread(rows, "row", "k", "v", "end").select("track_id", "end", (F.col("k") + 1).cast("long").alias("n"), r6("v").alias("v"))


def cbm_penalty(spark, d):
    n = spark.range(1, 65).select("id")
    kinds = ("modulo8", "modulo4", "modulo8modulo4", "target_deviation_8_alpha_half", "target_deviation_8_alpha_one", "target_deviation_8_alpha_two")
    return n.select(F.col("id").alias("n"), *[r6(R.penalty(F.col("id"), k).cast("double")).alias(k) for k in kinds])


def kernel_bounds(algorithm: str, **params):
    """Boundaries by the numeric form, which holds one track's matrix at a time; relational.py has the same plan as expressions."""
    return on_events(lambda p: bounds(api.boundary_frames(p, algorithm, **params)))


def evaluate_sides(spark, d):
    """All metrics of novelty segments against days."""
    p = src.events_packed(spark, d)
    got = api.evaluate(estimated(p), annotated(p))
    return got.select("track_id", "ds_name", *[r6(F.col(f"`{c}`")).alias(c.replace(".", "_")) for c, kind in got.dtypes if kind == "double"])


def align_times_asof(spark, d):
    f = src.unpack(src.events_packed(spark, d)).select("track_id", "i", "t")
    noon = f.select("track_id", (F.floor(F.col("t") / 86400) * 86400 + 43200).cast("double").alias("t")).distinct()
    got = I.align_to_next_frame(noon, f)
    return got.select("track_id", r6("t").alias("t"), F.col("frame").cast("long").alias("frame"))


def ground_truth_bounds(spark, d):
    p = src.events_packed(spark, d)
    noon = p.select("track_id", F.array_distinct(F.transform("ts", lambda t: F.floor(t / 86400) * 86400 + 43200.0)).alias("times"))
    return bounds(R.ground_truth(noon, p))


def synchronize_labels(spark, d):
    p = src.events_packed(spark, d)
    old = S.with_ends(days(p), F.size("x"))
    p = plain_peaks(p).withColumn("old", old).withColumn("b", S.with_ends(F.col("peaks"), F.size("x")))
    p = p.withColumn("old_labels", F.transform(F.sequence(F.lit(0), F.size("old") - 2), lambda k: k % 5))
    return curve(p.withColumn("s", I.synchronize_labels(F.col("b"), F.col("old"), F.col("old_labels"), F.size("x"))), "s")


def segment_mode(spark, d):
    p = src.events_packed(spark, d)
    p = plain_peaks(p.withColumn("types", main_type(F.col("x")))).withColumn("b", S.with_ends(F.col("peaks"), F.size("x")))
    values = src.spread(p, "types", "i", "value")
    seg = p.select("track_id", F.inline(F.transform(F.filter(A.positions("b"), lambda k: k < F.size("b") - 1), lambda k: F.struct(k.alias("seg"), A.at("b", k).alias("first"), A.at("b", k + 1).alias("last")))))
    return I.segment_mode(values, seg).select("track_id", F.col("seg").cast("long").alias("seg"), F.col("label").cast("long").alias("label"))


def segments_of(side: DataFrame) -> DataFrame:
    rows = F.transform(F.sequence(F.lit(0), F.size("labels") - 1), lambda k: F.struct(k.alias("seg"), A.at("times", k).alias("start"), A.at("times", k + 1).alias("end"), A.at("labels", k).cast("int").alias("label")))
    return side.select("track_id", F.inline(rows))


def relabel_overlap_matrix(spark, d):
    p = src.events_packed(spark, d)
    m = I.overlap_matrix(segments_of(estimated(p)), segments_of(annotated(p)))
    return m.select("track_id", F.col("est_label").cast("long").alias("est_label"), F.col("ref_label").cast("long").alias("ref_label"), r6("overlap").alias("overlap"))


def relabel_hierarchy(spark, d):
    p = src.events_packed(spark, d)
    e, r = segments_of(estimated(p)), segments_of(annotated(p))
    got = I.relabel(I.overlap_matrix(e, r), e.select("track_id", "label"), r.select("track_id", "label"))
    return got.select("track_id", F.col("est_label").cast("long").alias("est_label"), F.col("new_label").cast("long").alias("new_label"))


def results_mean(spark, d):
    got = E.label_scores(E.hit_rates(sides(spark, d), 3.0, False, "HitRate_3", "HitRate_w3F"))
    return E.summary(got.select("HitRate_3P", "HitRate_3R", "HitRate_3F", "PWF", "Sf")).select(*[r6(c).alias(c) for c in ("HitRate_3P", "HitRate_3R", "HitRate_3F", "PWF", "Sf")])


def param_sweep(spark, d):
    """The mean hit rate of every pair of threshold size and share: all pairs are made from each track's one row."""
    p = plain_novelty(src.events_packed(spark, d))
    ref = annotated(src.events_packed(spark, d)).select("track_id", F.col("times").alias("ref_times"))
    medians = p.withColumn("n", F.size("x")).select("track_id", "n", "nc", F.inline(F.array(*[F.struct(F.lit(size).cast("long").alias("size"), A.median_filter(F.col("nc"), size).alias("md")) for size in (4, 8)])))
    tried = medians.withColumn("share", F.explode(F.array(F.lit(0.0), F.lit(0.1)))).withColumn("th", V.let(A.mean(F.col("nc")) * F.col("share"), lambda m: F.transform("md", lambda v: v + m)))
    out = S.pick_peaks(tried).select("track_id", "size", "share", F.transform(S.with_ends(F.col("peaks"), F.col("n")), lambda t: t.cast("double")).alias("est_times"))
    scored = E.hit_rates(out.join(ref, "track_id"), 3.0, False, "HitRate_3", "HitRate_w3F")
    return scored.groupBy("size", "share").agg(r6(F.avg("HitRate_3F")).alias("f"))


def results_cube(spark, d):
    """Counts and mean hit rate by every grouping of data set and of more or fewer than 70 frames."""
    got = E.hit_rates(sides(spark, d), 3.0, False, "HitRate_3", "HitRate_w3F")
    got = got.select(F.concat(F.lit("d"), F.pmod(F.col("track_id").cast("long"), F.lit(3)).cast("string")).alias("ds_name"), F.when(F.element_at("ref_times", -1) >= 70, "long").otherwise("short").alias("kind"), "HitRate_3F")
    return got.cube("ds_name", "kind").agg(F.count("*").alias("n"), r6(F.avg("HitRate_3F")).alias("f"))


def factor_distances(spark, d):
    e = src.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    o = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")).where("vec_id >= 0")
    j = e.join(o, "vec_id")
    a, b = F.col("v"), F.col("w")
    return j.select("vec_id", r6(V.euclidean(a, b)).alias("l2"), r6(V.l1(a, b)).alias("l1"), r6(V.cosine_distance(a, b)).alias("cosine"), r6(V.absolute_cosine_distance(a, b)).alias("abs_cosine"), r6(V.kullback_leibler(F.transform(a, lambda x: F.abs(x)), F.transform(b, lambda x: F.abs(x)))).alias("kl"))


def vq_assign(spark, d):
    """The nearest of the means of the labels; the centres are one small row."""
    e = src.table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    parts = e.select("label", F.posexplode("v").alias("k", "x")).groupBy("label", "k").agg(F.avg("x").alias("m"))
    centres = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias("c"))
    return nearest_centre(e, centres).select("vec_id", F.col("centre").cast("long").alias("centre"), r6("dist").alias("dist"))


def with_centres(rows: DataFrame, centres: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """rows with an array of centres (label, c), and the number of blocks: one broadcast block if they are within the limit, else a row for each block of at most about limit centres."""
    blocks = max(1, -(-centres.count() // limit))
    block = F.pmod(F.xxhash64("label"), F.lit(blocks)).cast("int")
    packed = centres.groupBy(block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("label", "c"))).alias("centres"))
    dealt = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return dealt.join(F.broadcast(packed) if blocks == 1 else packed, "block").drop("block"), blocks


def nearest_centre(rows: DataFrame, centres: DataFrame, limit: int = 10_000) -> DataFrame:
    """Adds centre and dist to every row; of equally near centres the least label. Centres: (label, c)."""
    best = F.array_min(F.transform("centres", lambda c: F.struct(V.euclidean("v", c["c"]).alias("dist"), c["label"].alias("centre"))))
    got, blocks = with_centres(rows.select(F.struct("*").alias("row"), "v", F.monotonically_increasing_id().alias("id")), centres, limit)
    got = got.select("id", "row", best.alias("b"))
    if blocks > 1:
        got = got.groupBy("id").agg(F.first("row").alias("row"), F.min("b").alias("b"))
    return got.select("row.*", F.col("b.centre").alias("centre"), F.col("b.dist").alias("dist"))


def norm_sampling_probabilities(spark, d):
    e = src.table(spark, d, "embeddings").select("vec_id", V.dot(F.col("embedding").cast("array<double>"), F.col("embedding").cast("array<double>")).alias("s"))
    whole = e.agg(F.sum("s").alias("whole"))
    return e.join(F.broadcast(whole)).select("vec_id", r6(F.col("s") / F.col("whole")).alias("p"))


def cmeans_membership(spark, d):
    """Fuzzy membership (m 1.75) of every vector in the mean of every label."""
    e = src.table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    parts = e.select("label", F.posexplode("v").alias("k", "x")).groupBy("label", "k").agg(F.avg("x").alias("m"))
    centres = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias("c"))
    return memberships(e, centres).select("vec_id", F.col("label").cast("long").alias("label"), r6("membership").alias("membership"))


def memberships(rows: DataFrame, centres: DataFrame, m: float = 1.75, limit: int = 10_000) -> DataFrame:
    """(vec_id, label, membership) of every vector v and centre (label, c)."""
    got, blocks = with_centres(rows.select("vec_id", "v", F.monotonically_increasing_id().alias("id")), centres, limit)
    w = F.transform("centres", lambda c: F.struct(c["label"].alias("label"), F.pow(F.greatest(V.euclidean("v", c["c"]), F.lit(1e-12)), F.lit(-2 / (m - 1))).alias("w")))
    got = got.select("id", "vec_id", w.alias("w")).withColumn("all", V.total(F.transform("w", lambda x: x["w"])))
    if blocks > 1:
        got = got.withColumn("all", F.sum("all").over(W.partitionBy("id")))
    return got.select("vec_id", "all", F.inline("w")).select("vec_id", "label", (F.col("w") / F.col("all")).alias("membership"))


def session_segments(spark, d):
    """Sessions of every user: runs of events with gaps of at most 12 hours."""
    e = src.table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    g = e.groupBy("user_id", F.session_window("ts", "12 hours").alias("s")).agg(F.count("*").alias("n"), r6(F.sum("value")).alias("value"))
    return g.select("user_id", r6(F.unix_micros("s.start") / 1e6).alias("start"), "n", "value")


def resample_mean(spark, d):
    """Day means of value weighted by overlap: every event lasts until the next of its track."""
    p = src.unpack(src.events_packed(spark, d))
    w = W.partitionBy("track_id").orderBy("i")
    spans = p.select("track_id", F.col("t").alias("s"), F.lead("t").over(w).alias("e"), F.get("vec", 0).alias("v")).where("e is not null")
    cut = spans.select("track_id", "s", "e", "v", F.explode(F.sequence(F.floor(F.col("s") / 86400), F.floor(F.col("e") / 86400))).alias("day"))
    part = F.least("e", (F.col("day") + 1) * 86400) - F.greatest("s", F.col("day") * 86400)
    return cut.withColumn("w", part).where("w > 0").groupBy("track_id", "day").agg(r6(F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"))


def estimation_records(spark, d) -> DataFrame:
    """Annotations as files hold them: per track one without labels, one with, and one of days."""
    both = sides(spark, d)
    row = lambda t, l: F.transform(F.sequence(F.lit(0), F.size(t) - 2), lambda k: F.struct(A.at(t, k).alias("time"), (A.at(t, k + 1) - A.at(t, k)).alias("duration"), A.at(l, k).alias("value"), F.lit(None).cast("double").alias("confidence")))  # noqa: E731, E741
    box = lambda b, l: F.create_map(F.lit("boundaries_id"), F.lit(b), F.lit("labels_id"), F.lit(l).cast("string"), F.lit("k_nearest"), F.lit("0.04"))  # noqa: E731, E741
    one = lambda t, l, b, i: F.struct(row(t, l).alias("data"), box(b, i).alias("sandbox"))  # noqa: E731, E741
    all_ = F.array(one("est_times", "est_labels", "novelty", None), one("est_times", "est_labels", "novelty", "types"), one("ref_times", "ref_labels", "days", None))
    return both.select("track_id", F.posexplode(all_).alias("ann", "a")).select(F.col("track_id").alias("path"), "track_id", "ann", F.lit("segment_open").alias("namespace"), "a.data", "a.sandbox")


def find_estimation(spark, d):
    got = ann.find_estimations(estimation_records(spark, d), "novelty", "types", compat=True, k_nearest=0.04)
    return got.select("track_id", F.col("ann").cast("long").alias("ann"), F.col("matches").cast("long").alias("matches"), F.size("data").cast("long").alias("n_segments"))


def estimation_upsert(spark, d):
    """Estimations of every customer, those of each third nation estimated anew, under keys that may be null."""
    c = src.table(spark, d, "customer")
    old = c.select("c_custkey", F.col("c_mktsegment").alias("boundaries_id"), F.when(F.col("c_nationkey") % 2 == 0, F.lit("fmc2d")).alias("labels_id"), F.lit(0).cast("long").alias("version"))
    new = c.where("c_nationkey % 3 = 0").select("c_custkey", F.col("c_mktsegment").alias("boundaries_id"), F.when(F.col("c_nationkey") % 4 == 0, F.lit("fmc2d")).alias("labels_id"), F.lit(1).cast("long").alias("version"))
    return ann.upsert(old, new, ["c_custkey", "boundaries_id", "labels_id"])


def mirex_lines(spark, d):
    seg = segments_of(estimated(src.events_packed(spark, d)))
    return ann.mirex_lines(seg.withColumn("label", ann.label_letter(F.col("label"))))


def first_seen_labels(spark, d):
    seg = segments_of(annotated(src.events_packed(spark, d)))
    got = ann.first_seen_index(seg)
    return got.select("track_id", F.col("seg").cast("long").alias("seg"), F.col("index").cast("long").alias("label"))


def element_functions(spark, d):
    e = src.table(spark, d, "events").select("event_id", "value")
    v = F.col("value") - 50
    return e.select("event_id", r6(V.soft_threshold(v, 10.0)).alias("soft"), r6(V.positive_part(v)).alias("positive"), r6(V.negative_part(v)).alias("negative"), r6(V.magnitude(v, F.lit(3.0))).alias("magnitude"))


def value_decibel(packed: DataFrame) -> DataFrame:
    p = packed.withColumn("a", F.transform("x", lambda v: F.get(v, 0)))
    return p.withColumn("db", S.to_decibel(F.col("a"), F.array_max("a"), amplitude=True, top_db=30.0))


def seconds(packed: DataFrame) -> DataFrame:
    """A frame a second: for algorithms whose sizes are in seconds."""
    return packed.withColumn("ts", F.transform(A.positions("x"), lambda i: i.cast("double")))


def segmented(boundaries: str, labels: str | None = None, hier: bool = False, **params):
    def query(spark, d):
        return api.segment(seconds(src.events_packed(spark, d)), boundaries, labels, hier, **params)

    return query


def embeddings_segmented(spark, d):
    """The default algorithm over the whole of embeddings as one track; the pairs of frames of a long one are dealt out."""
    packed, n = src.embeddings_packed(spark, d), src.table(spark, d, "embeddings").count()
    if n > LONG:
        # as they are stored, since slices are dealt out many times
        frames = src.numbered(src.table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec")), "vec_id")
        curve = long_track.structural_curve(frames, n, G.configuration("sf", None))
        packed = packed.crossJoin(curve.withColumnRenamed("nc", "curve"))
    return api.segment(packed, "sf", "fmc2d")


def evaluate_api(spark, d):
    p = seconds(src.events_packed(spark, d))
    est = api.as_sides(api.segment(p, "foote", "fmc2d", M_gaussian=16, m_median=4, L_peaks=8))
    return api.evaluate(est, annotated(src.events_packed(spark, d)))


def t_measure(spark, d):
    p = seconds(src.events_packed(spark, d))
    seg = api.segment(p, "olda", hier=True)
    o = seg.groupBy("track_id", "level").agg(F.concat(F.array_sort(F.collect_list("start")), F.array(F.max("end"))).alias("t"))
    est = o.groupBy("track_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "t"))), lambda x: x["t"]).alias("levels"))
    ref = annotated(src.events_packed(spark, d)).select("track_id", F.array(F.array(F.lit(0.0), F.element_at("times", -1)), F.col("times")).alias("levels"))
    return api.t_measure(est, ref)


def factorised(method: str):
    return lambda spark, d: factor.factorize_tracks(S.min_max(src.events_packed(spark, d)), method, factors=("error",)).select("track_id", r6("v").alias("error"))


def olda_transform(spark, d):
    """Norms of the rows of the ordinal transform that is trained on the days of every track."""
    p = src.events_packed(spark, d)
    b = p.select("track_id", S.with_ends(days(p), F.size("x")).alias("bounds"))
    w = api.train_olda(seconds(p), b)[1e-4]
    return spark.createDataFrame([(k, float((r**2).sum() ** 0.5)) for k, r in enumerate(w)], "component long, norm double")


def queries():
    out = {
        "frames_from_events": frames_from_events,
        "frames_from_embeddings": frames_from_embeddings,
        "norm_inf": on_events(lambda p: cells(S.normalise(p, "inf"))),
        "norm_l2": on_events(lambda p: cells(S.l2_rows(p))),
        "norm_p1": on_events(lambda p: cells(S.normalise(p, 1))),
        "norm_minmax": on_events(lambda p: cells(S.normalise(p, "min_max"))),
        "norm_log": on_events(lambda p: cells(S.normalise(p, "log"))),
        "log1p": on_events(lambda p: cells(S.logarithm(p))),
        "whiten_cols": on_events(lambda p: cells(S.whiten(p))),
        "beat_sync_mean": beat_sync_mean,
        "delay_embedding": on_events(lambda p: cells(S.delay_embedding(p, 2.5))),
        "stack_memory": on_events(lambda p: cells(S.stack_memory(p))),
        "median_filter": on_events(lambda p: cells(S.median_smooth(p, 12))),
        "gaussian_smooth": on_events(lambda p: cells(S.gaussian_smooth(p, 2.0))),
        "novelty_successive": on_events(lambda p: curve(plain_novelty(p), "nc")),
        "adaptive_threshold": on_events(lambda p: curve(S.adaptive_threshold(plain_novelty(p), 8, 0.05), "th")),
        "peak_pick": on_events(lambda p: curve(plain_peaks(p), "peaks")),
        "change_points": on_events(lambda p: curve(p.withColumn("c", days(p)), "c")),
        "ssm_seuclidean": on_events(lambda p: upper(M.ssm(p, "seuclidean"), "ssm")),
        "ssm_cosine": on_events(lambda p: upper(M.ssm(p, "cosine"), "ssm")),
        "ssm_covariance": on_events(lambda p: upper(M.ssm(p, "covariance"), "ssm")),
        "ssm_rbf": on_events(lambda p: upper(M.ssm(p, "rbf"), "ssm")),
        "recurrence_knn": on_events(lambda p: T.cells(p, lambda x: T.recurrence(x, 3, False))),
        "recurrence_mutual": on_events(lambda p: T.cells(p, T.recurrence)),
        "lag_matrix": on_events(lambda p: T.cells(p, lambda x: T.N.to_lag(T.recurrence(x)))),
        "path_similarity": on_events(lambda p: curve(M.path_similarity(S.normalise(p, "min_max")), "path")),
        "graph_degree": on_events(lambda p: T.rows(p, lambda x: (T.np.arange(len(x)), T.affinity(x)[0]), "i long, v double")),
        "balanced_affinity": on_events(lambda p: T.rows(p, mu_and_total, "mu double, total double").select("track_id", r6("mu").alias("mu"), r6("total").alias("total"))),
        "checkerboard_novelty": on_events(lambda p: curve(M.checkerboard_novelty(M.ssm(S.normalise(p, "min_max")), 16), "nc")),
        "foote_boundaries": kernel_bounds("foote", M_gaussian=16, m_median=4, L_peaks=8),
        "foote_boundaries_relational": on_events(lambda p: bounds(R.foote(p, **FOOTE))),
        "sf_boundaries": kernel_bounds("sf", M_gaussian=7, k_nearest=0.1, Mp_adaptive=8),
        "sf_boundaries_relational": on_events(lambda p: bounds(R.sf(p, **SF))),
        "cbm_segment_scores": cbm_segment_scores,
        "cbm_penalty": cbm_penalty,
        "cbm_boundaries": kernel_bounds("cbm", ssm="cosine"),
        "cbm_boundaries_relational": on_events(lambda p: bounds(R.cbm(p, "cosine"))),
        "ground_truth_bounds": ground_truth_bounds,
        "times_to_intervals": lambda s, d: I.times_to_intervals(run_times(s, d)).select("track_id", F.col("seg").cast("long").alias("seg"), "start", "end"),
        "intervals_to_times": run_times,
        "drop_empty_segments": lambda s, d: as_segments(I.drop_empty(label_runs(s, d).withColumn("end", F.when(F.col("seg") % 7 == 3, F.col("start")).otherwise(F.col("end"))))),
        "edge_silence": lambda s, d: as_segments(I.edge_silence(label_runs(s, d).withColumn("start", F.col("start") + 0.5).withColumn("end", F.col("end") + 0.5), s.range(1).select(F.lit("embeddings").alias("track_id"), F.lit(1e6).alias("dur")))),
        "align_times_asof": align_times_asof,
        "synchronize_labels": synchronize_labels,
        "segment_mode": segment_mode,
        "relabel_overlap_matrix": relabel_overlap_matrix,
        "relabel_hierarchy": relabel_hierarchy,
        "hit_rate_3s": lambda s, d: metric(E.hit_rates(sides(s, d), 3.0, False, "HitRate_3", "HitRate_w3F"), "HitRate_3P", "HitRate_3R", "HitRate_3F"),
        "hit_rate_half": lambda s, d: metric(E.hit_rates(sides(s, d), 0.5, False, "HitRate_0.5", "HitRate_w0.5F"), "HitRate_0.5P", "HitRate_0.5R", "HitRate_0.5F"),
        "hit_rate_trimmed": lambda s, d: metric(E.hit_rates(sides(s, d), 3.0, True, "HitRate_t3", "HitRate_wt3F"), "HitRate_t3P", "HitRate_t3R", "HitRate_t3F"),
        "hit_rate_weighted": lambda s, d: metric(E.hit_rates(sides(s, d), 3.0, False, "HitRate_3", "HitRate_w3F"), "HitRate_w3F"),
        "median_deviation": lambda s, d: metric(E.deviations(sides(s, d)), "DevR2E", "DevE2R", "DevtR2E", "DevtE2R"),
        "information_gain": lambda s, d: metric(sides(s, d).withColumn("D", E.information_gain(E.points("ref_times"), E.points("est_times"))), "D"),
        "pairwise_scores": lambda s, d: metric(E.label_scores(sides(s, d)), "PWP", "PWR", "PWF"),
        "nce_scores": lambda s, d: metric(E.label_scores(sides(s, d)), "So", "Su", "Sf"),
        "results_mean": results_mean,
        "results_cube": results_cube,
        "param_sweep": param_sweep,
        "factor_distances": factor_distances,
        "vq_assign": vq_assign,
        "norm_sampling_probabilities": norm_sampling_probabilities,
        "cmeans_membership": cmeans_membership,
        "session_segments": session_segments,
        "time_lag_median": on_events(lambda p: T.upper(p, lambda x: T.N.diagonal_median(T.cosine(x), 5)).withColumn("v", r6("v"))),
        "normalised_laplacian": on_events(lambda p: T.cells(p, lambda x: T.laplacian(T.affinity(x)[2])).withColumn("v", r6("v")).where("v <> 0")),
        "ordinal_chroma": on_events(lambda p: cells(S.ordinal_chroma(p))),
        "value_decibel": on_events(lambda p: curve(value_decibel(p), "db")),
        "element_functions": element_functions,
        "find_estimation": find_estimation,
        "estimation_upsert": estimation_upsert,
        "mirex_lines": mirex_lines,
        "first_seen_labels": first_seen_labels,
        "segment_sf_fmc2d": segmented("sf", "fmc2d"),
        "segment_sf": segmented("sf", M_gaussian=7, k_nearest=0.1, Mp_adaptive=8),
        "segment_cbm_cosine": segmented("cbm", ssm="cosine"),
        "segment_foote": segmented("foote", M_gaussian=16, m_median=4, L_peaks=8),
        "segment_cbm": segmented("cbm"),
        "segment_cnmf": segmented("cnmf", "cnmf"),
        "segment_olda": segmented("olda"),
        "segment_scluster": segmented("scluster"),
        "segment_scluster_hierarchy": segmented("scluster", hier=True),
        "segment_vmo": segmented("vmo"),
        "embeddings_segmented": embeddings_segmented,
        "evaluate": evaluate_api,
        "evaluate_sides": evaluate_sides,
        "t_measure": t_measure,
        "olda_transform": olda_transform,
        **{f"factor_{m.lower()}": factorised(m) for m in factor.METHODS},
        "resample_mean": resample_mean,
    }
    return out


def oracle_sql():
    from .twins import TWINS

    return dict(TWINS)
