"""segment() and evaluate(): whole collections as DataFrames, a row per track inside."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import segmentry

from ..operators import evaluation as E
from . import kernels as K
from . import registry as G

cloudpickle.register_pickle_by_value(segmentry)

SEGMENTS = "track_id string, level int, seg int, start_idx int, end_idx int, start double, end double, label int"
#: Tracks of this many frames or fewer are one segment.
MINIMUM_FRAMES = 10


def seed_of(track_id: str) -> int:
    return int.from_bytes(hashlib.sha256(str(track_id).encode()).digest()[:4], "big")


def level_rows(bounds, labels, ts, duration) -> list[tuple]:
    """(start_idx, end_idx, start, end, label): with stretches of silence before the first and after the last frame, without empty segments."""
    ts = np.asarray(ts, float)
    silence = int(max(labels)) + 1 if len(labels) else 0
    times = [0.0, *ts[np.asarray(bounds, int)], duration]
    frames = [0, *map(int, bounds), len(ts) - 1]
    own = [silence, *map(int, labels), silence]
    return [(a, b, float(s), float(e), k) for a, b, s, e, k in zip(frames[:-1], frames[1:], times[:-1], times[1:], own) if s < e]


def levels_of(x, second, ts, boundaries, labels, hier, config, given, seed):
    def call(name, bounds):
        a = G.ALGORITHMS[name]
        more = {"second": second} if name in ("scluster", "olda") else {}
        if name == "olda":
            more["ts"] = ts
        return a.run(x, bounds, config | {"hier": hier and a.hierarchical}, seed, **more)

    if boundaries == "gt":
        found = np.unique([0, *[min(int(np.searchsorted(ts, t, "left")), len(ts) - 1) for t in given or []], len(ts) - 1])
        levels = [(found, K.no_labels(found))]
    else:
        got = call(boundaries, None)
        levels = got if isinstance(got, list) else [got]
    out = []
    for b, own in levels:
        b, first = np.unique(np.asarray(b, int), return_index=True)
        if labels is None:
            own = K.no_labels(b) if len(own) == 0 or max(own) < 0 else np.asarray(own)[first[:-1]] if len(own) > max(first[:-1], default=0) else K.no_labels(b)
        elif labels != boundaries:
            got = G.ALGORITHMS[labels].run(x, b, config | {"hier": False}, seed) if len(b) > 2 else (b, [0])
            own = got[1]
        out.append((b, np.asarray(own)[: len(b) - 1]))
    return out


def matrix(cell: pa.ListScalar) -> np.ndarray:
    """Rows of equal length as a matrix, read from the list's buffers."""
    rows = cell.values
    return rows.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), -1)


def vector(cell: pa.ListScalar) -> np.ndarray:
    return cell.values.to_numpy(zero_copy_only=False).astype(float)


def segment(packed: DataFrame, boundaries: str = "sf", labels: str | None = None, hier: bool = False, times: DataFrame | None = None, grid: list[dict] | None = None, **params) -> DataFrame:
    """Segments of every track of (track_id, ts, x[, x2, dur]).

    One row is one track, so tracks are spread over the tasks and no shuffle follows the packing. `gt` takes the boundary
    times of `times` (track_id, times). Labels are -1 without a label algorithm. With a grid of parameter values, every
    track is segmented with each of them, and a last column `params` has the number of the values in the grid.
    A column `curve` has what `sf` would make of all pairs of frames (long_track.py).
    """
    if boundaries != "gt":
        G.lookup(boundaries, "boundaries")
        if hier:
            G.lookup(boundaries, "hierarchical")
    if labels is not None:
        G.lookup(labels, "labels")
    configs = [G.configuration(boundaries, labels, **params | own) for own in grid or [{}]]
    if times is not None:
        packed = packed.join(times, "track_id", "left")
    names = packed.columns
    columns = ["track_id", "level", "seg", "start_idx", "end_idx", "start", "end", "label", "params"]
    schema = pa.schema(list(zip(columns, [pa.string(), *[pa.int32()] * 4, pa.float64(), pa.float64(), pa.int32(), pa.int32()])))

    def rows_of(cells, config, number):
        config = config | {"curve": vector(cells["curve"])} if "curve" in names else config
        track, x, ts = cells["track_id"].as_py(), matrix(cells["x"]), vector(cells["ts"])
        second = matrix(cells["x2"]) if "x2" in names else None
        shift = 0.0 if "dur" in names else ts[0]
        duration = cells["dur"].as_py() if "dur" in names else float(ts[-1] - ts[0])
        if len(x) <= MINIMUM_FRAMES:
            return [(track, 0, 0, 0, len(x) - 1, 0.0, duration, 0, number)]
        given = [t - shift for t in cells["times"].as_py()] if times is not None and cells["times"].is_valid else None
        levels = levels_of(x, second, ts - shift, boundaries, labels, hier, config, given, seed_of(track))
        return [(track, level, k, *s, number) for level, (b, own) in enumerate(levels) for k, s in enumerate(level_rows(b, own, ts - shift, duration))]

    def run(batches):
        for batch in batches:
            rows = []
            for at in range(batch.num_rows):
                cells = {c: batch.column(k)[at] for k, c in enumerate(names)}
                for number, config in enumerate(configs):
                    rows += rows_of(cells, config, number)
                # a batch for each track takes longer than its rows
                if rows and (len(rows) > 10_000 or at == batch.num_rows - 1):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows = []

    found = packed.mapInArrow(run, SEGMENTS + ", params int")
    return found if grid else found.drop("params")


def boundary_frames(packed: DataFrame, algorithm: str, **params) -> DataFrame:
    """(track_id, bounds): the boundary frames of every track, in order."""
    config, names = G.configuration(algorithm, None, **params), packed.columns
    G.lookup(algorithm, "boundaries")
    schema = pa.schema([("track_id", pa.string()), ("bounds", pa.list_(pa.int32()))])

    def run(batches):
        for batch in batches:
            tracks = batch.column(names.index("track_id"))
            x = batch.column(names.index("x"))
            found = [G.ALGORITHMS[algorithm].run(matrix(x[k]), None, config, seed_of(t.as_py()))[0] for k, t in enumerate(tracks)]
            yield pa.RecordBatch.from_arrays([tracks, pa.array([np.asarray(b, np.int32) for b in found], pa.list_(pa.int32()))], schema=schema)

    return packed.mapInArrow(run, "track_id string, bounds array<int>")


def as_sides(segments: DataFrame, level: int = 0) -> DataFrame:
    """(track_id, times, labels[, params]) of one level of segments; a label of -1 is written @."""
    keys = ["track_id", *[c for c in segments.columns if c == "params"]]
    o = F.array_sort(F.collect_list(F.struct("start", "end", "label")))
    p = segments.where(F.col("level") == level).groupBy(*keys).agg(o.alias("o"))
    label = lambda v: F.when(v["label"].cast("string") == "-1", "@").otherwise(v["label"].cast("string"))
    return p.select("track_id", F.concat(F.col("o.start"), F.array(F.element_at("o.end", -1))).alias("times"), F.transform("o", label).alias("labels"), *keys[1:])


def evaluate(estimations: DataFrame, references: DataFrame, strict: bool = False, bins: int = E.BINS) -> DataFrame:
    """Metrics of every track with both sides, from (track_id, times, labels); strict: a track without a reference is an error."""
    if strict and (r := E.missing_references(estimations, references).first()):
        raise G.NoReferencesError(f"track {r['track_id']} has no reference")
    return E.evaluate(estimations, references, bins)


def t_measure(est: DataFrame, ref: DataFrame, windows: tuple[int, ...] = (10, 15), step: float = 0.1, threshold: float = 1.0) -> DataFrame:
    """Hierarchical measures of (track_id, levels ARRAY<ARRAY<DOUBLE>>), coarse levels first; ends within threshold are aligned."""
    both = est.select("track_id", F.col("levels").alias("est_levels")).join(ref.select("track_id", F.col("levels").alias("ref_levels")), "track_id")
    columns = [f"t_{m}{w}" for w in windows for m in ("precision", "recall", "measure")]

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                e = sorted((np.asarray(v, float) for v in r.est_levels), key=len)
                f = [np.asarray(v, float) for v in r.ref_levels]
                rows.append((r.track_id, *[v for w in windows for v in K.t_measures(f, e, w, step)]))
            yield pd.DataFrame(rows, columns=["track_id", *columns])

    return E.align_ends(both, threshold).mapInPandas(run, "track_id string, " + ", ".join(f"{c} double" for c in columns))


def train_olda(packed: DataFrame, bounds: DataFrame, sigmas: tuple[float, ...] = (1e-4,)) -> dict[float, np.ndarray]:
    """Transforms by regularisation: scatter sums are added per task, then over tasks; the driver sees two small matrices."""
    joined = packed.join(bounds, "track_id")

    def run(batches):
        total = None
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                x = np.stack([np.asarray(v, float) for v in r.x])
                f = K.olda_features(x, x, np.asarray(r.ts, float) - r.ts[0])
                got = np.stack(K.scatter(f, list(r.bounds)))
                total = got if total is None else total + got
        if total is not None:
            d = total.shape[1]
            k = np.indices(total.shape).reshape(3, -1)
            yield pd.DataFrame({"m": k[0], "c": k[1] * d + k[2], "v": total.ravel()})

    sums = joined.mapInPandas(run, "m int, c int, v double").groupBy("m", "c").agg(F.sum("v").alias("v")).toPandas()
    d = int(round((len(sums) / 2) ** 0.5))
    m = np.zeros((2, d * d))
    m[sums["m"], sums["c"]] = sums["v"]
    return {s: K.fit_olda(*m.reshape(2, d, d), s) for s in sigmas}


def load_transform(spark, path: str | None, size: int) -> np.ndarray:
    """The matrix of an .npy file, read through Spark; the identity without a path."""
    import io

    if path is None:
        return np.eye(size)
    content = spark.read.format("binaryFile").load(path).select("content").first()["content"]
    return np.load(io.BytesIO(bytes(content)), allow_pickle=False)


def sweep(packed: DataFrame, references: DataFrame, boundaries: str, grid: dict[str, list]) -> DataFrame:
    """Mean metrics for every combination of parameter values; one pass over the tracks and one join with the references serve all of them."""
    from itertools import product

    values = [dict(zip(grid, v)) for v in product(*grid.values())]
    got = evaluate(as_sides(segment(packed, boundaries, grid=values)), references)
    written = F.array(*[F.lit(json.dumps(v, sort_keys=True)) for v in values])
    return E.summary(got, "params").withColumn("params", F.get(written, F.col("params")))
