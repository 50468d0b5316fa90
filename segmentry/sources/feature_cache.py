"""Feature files as a cache: a feature is read from its track's JSON file, or computed from the audio and written there.

A task opens the audio of a track only if the file doesn't serve. Files are read and written through Arrow's file systems, so the
paths may be remote ones; a file takes the old one's place whole, so a task that runs twice does no harm. Tracks are apart: nothing is shuffled.
"""

from __future__ import annotations

import inspect
import json
import math
import re
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import FEATURES, FeatureParamsError, FeaturesNotFound, FeatureTypeNotFound, NoAudioFileError, NoFeaturesFileError, WrongFeaturesFormatError
from .features import FEATURE_FILE, HOP, RATE, beats, decode_wav, sync

#: Synchronisations, and the relative difference of durations that counts as none.
KINDS, TOLERANCE = ("framesync", "est_beatsync", "ann_beatsync"), 1e-3


def place(path: str):
    """(file system, path in it) of a path or address."""
    from pyarrow import fs

    if "://" not in path and not re.match(r"^file:/", path):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def load(path: str) -> bytes:
    system, at = place(path)
    with system.open_input_stream(at) as f:
        return f.read()


def store(path: str, content: bytes) -> None:
    system, at = place(path)
    system.create_dir(at.rpartition("/")[0] or ".", recursive=True)
    new = f"{at}.{uuid.uuid4().hex}"
    with system.open_output_stream(new) as f:
        f.write(content)
    system.move(new, at)


def parameters(feature_id: str, params: dict | None = None) -> dict:
    """The parameters of a feature: those given over its defaults."""
    own = list(inspect.signature(FEATURES[feature_id]).parameters.values())[2:]
    out = {p.name: p.default for p in own} | (params or {})
    if unknown := set(out) - {p.name for p in own}:
        raise FeatureParamsError(f"{feature_id} has no parameters {sorted(unknown)}")
    return out


def written(params: dict) -> dict[str, str]:
    """Parameters as a file has them: functions by name, the rest as text."""
    return {k: v.__name__ if callable(v) else str(v) for k, v in params.items()}


def check(file: dict, wanted: dict, feature_id: str, params: dict) -> None:
    """An error unless a feature file has the feature for the wanted globals and parameters; wanted globals of None match all."""
    try:
        own = file["globals"]
        dur, rate, hop, audio = float(own["dur"]), int(own["sample_rate"]), int(own["hop_length"]), own["audio_file"].rpartition("/")[2]
        if wanted.get("dur") is not None and not math.isclose(dur, wanted["dur"], rel_tol=TOLERANCE) or (rate, hop, audio) != (wanted["sample_rate"], wanted["hop_length"], wanted["audio_file"].rpartition("/")[2]):
            raise FeaturesNotFound(f"the file is of {own}, not of {wanted}")
        if feature_id not in file:
            raise FeatureParamsError(f"the file has no {feature_id}")
        if any(file[feature_id]["params"][k] != v for k, v in written(params).items()):
            raise FeatureParamsError(f"{feature_id} has parameters {file[feature_id]['params']}")
        matrices = [file[feature_id]["framesync"], file[feature_id]["est_beatsync"], file["est_beats"], file["est_beatsync_times"]]
    except (KeyError, TypeError, AttributeError, ValueError) as e:
        raise WrongFeaturesFormatError(f"the file lacks {e}") from e
    if any(m is None for m in matrices):
        raise WrongFeaturesFormatError("the file lacks a matrix")


def other_beats(file: dict, marks) -> bool:
    """Whether a file has annotated beats, and others than these."""
    return marks is not None and "ann_beats" in file and not (len(marks) == len(file["ann_beats"]) and np.allclose(marks, file["ann_beats"]))


def merged(old: dict | None, new: dict, feature_id: str) -> dict:
    """The file to write: new takes the place of a file that is absent, broken, or of other globals or annotated beats; else its feature is put in."""
    try:
        if old is None or other_beats(old, new.get("ann_beats")):
            return new
        check(old, new["globals"], feature_id, {})
    except FeatureParamsError:
        pass
    except (FeaturesNotFound, WrongFeaturesFormatError):
        return new
    return old | {k: new[k] for k in ("ann_beats", "ann_beatsync_times", feature_id) if k in new}


def computed(audio: str, content: bytes, feature_id: str, params: dict, ann_beats, rate: int, hop: int) -> dict:
    """The feature file of one track with one feature."""
    y = decode_wav(content, rate)
    m = FEATURES[feature_id](y, rate, **params)
    t = np.arange(len(m)) * hop / rate

    def at_beats(at):
        s = sync(m, at)
        return s.tolist(), np.append(t[np.minimum(at[at < len(m)], len(m) - 1)], t[-1])[: len(s)].tolist()

    at = beats(y, rate, hop)
    own, times = at_beats(at)
    out = {"globals": {"dur": len(y) / rate, "sample_rate": rate, "hop_length": hop, "audio_file": audio}, "est_beats": (at * hop / rate).tolist(), "est_beatsync_times": times}
    out[feature_id] = {"params": written(params), "framesync": m.tolist(), "est_beatsync": own}
    if ann_beats is not None and len(ann_beats):
        own, times = at_beats((np.asarray(ann_beats, float) * rate / hop).astype(int))
        out |= {"ann_beats": [float(b) for b in ann_beats], "ann_beatsync_times": times}
        out[feature_id]["ann_beatsync"] = own
    return out


def cached_features(files: DataFrame, feature_id: str, kind: str = "framesync", params: dict | None = None, rate: int = RATE, hop: int = HOP) -> DataFrame:
    """(track_id, i, t, vec) of one feature from rows (track_id, audio_path, feat_path[, dur][, ann_beats]), see annotations.file_struct.

    A track whose file agrees needs no audio. Else the feature is computed and put in the file; NoAudioFileError if there is no
    audio, FeatureTypeNotFound if annotated beats are asked for and the track has none.
    """
    if kind not in KINDS:
        raise FeatureTypeNotFound(f"no synchronisation {kind}")
    if feature_id not in FEATURES:
        raise FeatureTypeNotFound(f"no feature {feature_id}")
    own, has = parameters(feature_id, params), files.columns

    def file_of(r) -> dict:
        dur = float(r.dur) if "dur" in has and r.dur is not None and not math.isnan(r.dur) else None
        marks = r.ann_beats if "ann_beats" in has else None
        old = None
        try:
            try:
                old = json.loads(load(r.feat_path))
            except FileNotFoundError as e:
                raise NoFeaturesFileError(r.feat_path) from e
            except ValueError as e:
                raise WrongFeaturesFormatError(r.feat_path) from e
            check(old, {"dur": dur, "sample_rate": rate, "hop_length": hop, "audio_file": r.audio_path}, feature_id, own)
            if other_beats(old, marks):
                raise FeaturesNotFound("the file has other annotated beats")
            if kind == "ann_beatsync" and marks is not None and kind not in old[feature_id]:
                raise FeatureParamsError(f"{feature_id} is not synchronous with annotated beats")
            return old
        except (NoFeaturesFileError, WrongFeaturesFormatError, FeaturesNotFound, FeatureParamsError) as e:
            try:
                content = load(r.audio_path)
            except OSError:
                raise NoAudioFileError(f"{r.audio_path} is absent, and its feature file does not serve: {e}") from e
            out = merged(old, computed(r.audio_path, content, feature_id, own, marks, rate, hop), feature_id)
            store(r.feat_path, json.dumps(out).encode())
            return out

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                file = file_of(r)
                if (m := file[feature_id].get(kind)) is None:
                    raise FeatureTypeNotFound(f"track {r.track_id} has no annotated beats")
                t = [k * hop / rate for k in range(len(m))] if kind == "framesync" else (file[f"{kind}_times"] + [None] * len(m))[: len(m)]
                yield pd.DataFrame({"track_id": r.track_id, "i": np.arange(len(m)), "t": t, "vec": [np.asarray(v, float) for v in m]})

    passed = [c for c in ("track_id", "audio_path", "feat_path", "dur", "ann_beats") if c in has]
    return files.select(*passed).mapInPandas(run, "track_id string, i int, t double, vec array<double>")


def read_durations(spark: SparkSession, path: str) -> DataFrame:
    """(track_id, dur) of feature files."""
    files = spark.read.schema(FEATURE_FILE).json(path, multiLine=True)
    return files.select(F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.[^.]*$", "").alias("track_id"), F.col("globals.dur").alias("dur"))
