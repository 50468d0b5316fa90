"""Annotation and estimation files (JSON with a list of annotations), segment TSV files, and their sinks.

Files are read by Spark alone, so any store works. A `value` may be a label, a number or an object with
label and level: it is kept as its JSON text and taken apart in columns.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

JAMS = """annotations array<struct<namespace string, data array<struct<time double, duration double, value string, confidence double>>,
  annotation_metadata struct<annotator struct<name string, email string>, version string, corpus string>, sandbox map<string, string>>>,
  file_metadata struct<title string, artist string, duration double>, sandbox map<string, string>"""
#: Namespaces of hierarchical references, coarse first.
LEVELS = ("segment_salami_upper", "segment_salami_function", "segment_open", "segment_tut", "segment_salami_lower")


def track_of(path: Column) -> Column:
    """File name without folders and extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(path, track_id, duration, ann, namespace, data, sandbox): a row per annotation, ann its place in the file; none for files without a list."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    # NaN and Infinity are not JSON but some writers use them
    clean = F.regexp_replace("value", r"([:\[,]\s*)(-?Infinity|NaN)(?=\s*[,}\]])", '$1"$2"')
    files = text.select("path", F.from_json(clean, JAMS).alias("j"))
    return files.select("path", track_of(F.col("path")).alias("track_id"), F.col("j.file_metadata.duration").alias("duration"), F.posexplode("j.annotations").alias("ann", "a")).select("path", "track_id", "duration", "ann", "a.namespace", "a.data", "a.sandbox")


def nth(annotations: DataFrame, pattern: str, n: int) -> DataFrame:
    """The n-th annotation, from 0, of each file whose namespace begins with the pattern."""
    w = W.partitionBy("path").orderBy("ann")
    return annotations.where(F.col("namespace").rlike(f"^(?:{pattern})")).withColumn("__k", F.row_number().over(w) - 1).where(F.col("__k") == n).drop("__k")


def sides_of(annotations: DataFrame) -> DataFrame:
    """(track_id, times, labels) of flat annotations: interval starts and the last end."""
    rows = annotations.withColumn("d", F.array_sort(F.transform("data", lambda x: F.struct(x["time"].alias("time"), x["duration"].alias("duration"), x["value"].alias("value"))))).where(F.size("d") > 0)
    end = F.element_at("d", -1)
    return rows.select("track_id", F.concat(F.col("d.time"), F.array(end["time"] + end["duration"])).alias("times"), F.col("d.value").alias("labels"))


def references(annotations: DataFrame, annotator_id: int = 0) -> DataFrame:
    return sides_of(nth(annotations, "segment_.*", annotator_id))


def hierarchical_references(annotations: DataFrame, annotation_id: int = 0, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(track_id, level, namespace, times, labels): levels in order, absent and excluded ones skipped."""
    out = None
    for rank, namespace in enumerate(LEVELS):
        if namespace in exclude:
            continue
        found = nth(annotations, namespace + "$", annotation_id)
        one = sides_of(found).select("track_id", F.lit(rank).alias("rank"), F.lit(namespace).alias("namespace"), "times", "labels")
        out = one if out is None else out.unionByName(one)
    return out.select("track_id", (F.dense_rank().over(W.partitionBy("track_id").orderBy("rank")) - 1).alias("level"), "namespace", "times", "labels")


def find_estimations(annotations: DataFrame, boundaries_id: str, labels_id: str | None = None, hier: bool = False, compat: bool = False, **params) -> DataFrame:
    """The first matching annotation of each file, with matches, the number of those that match.

    compat: labels_id matches as the beginning of the stored id, and a stored null matches any.
    """
    stored = F.when(F.col("sandbox.labels_id") == "null", None).otherwise(F.col("sandbox.labels_id"))
    same = stored.isNull() if labels_id is None else (stored.startswith(labels_id) | stored.isNull() if compat else stored == labels_id)
    rows = annotations.where((F.col("namespace") == ("multi_segment" if hier else "segment_open")) & (F.col("sandbox.boundaries_id") == boundaries_id) & F.coalesce(same, F.lit(False)))
    for k, v in params.items():
        rows = rows.where(F.col("sandbox")[k] == (str(v).lower() if isinstance(v, bool) else str(v)))
    w = W.partitionBy("path")
    return rows.withColumn("matches", F.count("*").over(w)).withColumn("__k", F.row_number().over(w.orderBy("ann"))).where("__k = 1").drop("__k")


def estimation_levels(found: DataFrame) -> DataFrame:
    """(track_id, level, times, labels) of hierarchical estimations, by the level of every value."""
    value = F.from_json("x.value", "label string, level int")
    rows = found.select("track_id", F.explode("data").alias("x")).select("track_id", value["level"].alias("level"), F.struct(F.col("x.time").alias("time"), F.col("x.duration").alias("duration"), value["label"].alias("value")).alias("d"))
    o = rows.groupBy("track_id", "level").agg(F.array_sort(F.collect_list("d")).alias("d"))
    end = F.element_at("d", -1)
    return o.select("track_id", "level", F.concat(F.col("d.time"), F.array(end["time"] + end["duration"])).alias("times"), F.col("d.value").alias("labels"))


def annotated_beats(annotations: DataFrame, rate: int = 22050, hop: int = 1024) -> DataFrame:
    """(track_id, beat_idx, t, frame_idx) of the first beat annotation of each file."""
    rows = nth(annotations, "beat.*", 0).select("track_id", F.posexplode("data").alias("beat_idx", "x"))
    return rows.select("track_id", "beat_idx", F.col("x.time").alias("t"), F.floor(F.col("x.time") * rate / hop).cast("int").alias("frame_idx"))


def read_lab(spark: SparkSession, path: str) -> DataFrame:
    """(track_id, seg, start, end, label) of tab-separated files."""
    rows = spark.read.csv(path, sep="\t", schema="start double, end double, label string").select(track_of(F.input_file_name()).alias("track_id"), "start", "end", "label")
    return rows.withColumn("seg", F.row_number().over(W.partitionBy("track_id").orderBy("start", "end")) - 1)


def label_letter(label: Column) -> Column:
    """A for 0, B for 1, ... and @ for -1."""
    return F.char(label + 65)


def first_seen_index(rows: DataFrame, label: str = "label", position: str = "seg") -> DataFrame:
    """Adds index: labels numbered by first appearance in their track."""
    first = rows.groupBy("track_id", label).agg(F.min(position).alias("__p"))
    index = first.withColumn("index", F.row_number().over(W.partitionBy("track_id").orderBy("__p")) - 1).drop("__p")
    return rows.join(index, ["track_id", label])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of old whose key new lacks, and all rows of new; keys may be null."""
    marked = new.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    same = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"__{k}"))
        same = one if same is None else same & one
    return old.join(marked, same, "left_anti").unionByName(new)


def params_key(params: Column) -> Column:
    """A text that equal parameter maps share."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def mirex_lines(segments: DataFrame) -> DataFrame:
    """(track_id, text): start, end and label of every segment, tabs between them, no newline at the end."""
    line = F.format_string("%.3f\t%.3f\t%s", F.col("start"), F.col("end"), F.col("label").cast("string"))
    o = segments.select("track_id", F.struct("start", line.alias("line")).alias("l")).groupBy("track_id").agg(F.array_sort(F.collect_list("l")).alias("l"))
    return o.select("track_id", F.array_join("l.line", "\n").alias("text"))


def results_name(boundaries_id: str, labels_id: str | None, annotator_id: int, config: dict, extension: str = ".csv") -> str:
    """A file name of at most 255 characters; long ones end in a hash of all parameters."""
    parts = [f"boundsE{boundaries_id}", f"labelsE{labels_id}", f"annotatorE{annotator_id}", *[f"{k}E{config[k]}" for k in sorted(config)]]
    name = "_".join(parts).replace("/", "_")
    if len(name) + len(extension) > 255:
        name = name[: 255 - len(extension) - 17] + "_" + hashlib.sha256(name.encode()).hexdigest()[:16]
    return name + extension


def save_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").csv(path, header=True)


def cached_results(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored results, None if there are none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.csv(path, header=True, inferSchema=True)


def file_struct(audio: DataFrame, path: str = "path") -> DataFrame:
    """(track_id, ds_path, audio_path, est_path, feat_path, ref_path) by replacing folder and extension."""
    ds = F.regexp_replace(path, r"/[^/]*/[^/]*$", "")
    track = track_of(F.col(path))
    at = lambda folder, ext: F.concat(ds, F.lit(f"/{folder}/"), track, F.lit(ext))
    return audio.select(track.alias("track_id"), ds.alias("ds_path"), F.col(path).alias("audio_path"), at("estimations", ".jams").alias("est_path"), at("features", ".json").alias("feat_path"), at("references", ".jams").alias("ref_path"))


def dataset(spark: SparkSession, root: str, extensions: tuple[str, ...] = ("wav", "mp3", "aif")) -> DataFrame:
    """The audio files of a collection in order of path; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(f"{root}/audio").drop("content")
    return file_struct(files.orderBy("path"))
