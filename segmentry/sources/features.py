"""Feature extraction from PCM audio, and feature files.

Audio files are read as binary rows and decoded with the standard library (WAV only); each row gives a
matrix of frames. Features are registered by name; own ones join with @feature.
"""

from __future__ import annotations

import io
import math
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import numeric as N
from ..plans.registry import FEATURES, FeatureParamsError, FeatureTypeNotFound, WrongFeaturesFormatError, feature

#: Analysis defaults.
RATE, N_FFT, HOP = 22050, 4096, 1024


def decode_wav(content: bytes, rate: int = RATE) -> np.ndarray:
    """Mono samples in -1..1 at the rate, by linear interpolation."""
    with wave.open(io.BytesIO(content)) as f:
        width, channels, own = f.getsampwidth(), f.getnchannels(), f.getframerate()
        raw = f.readframes(f.getnframes())
    if width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        y = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8) / 2.0**23
    else:
        y = np.frombuffer(raw, {1: np.uint8, 2: "<i2", 4: "<i4"}[width]).astype(float)
        y = (y - 128) / 128 if width == 1 else y / 2.0 ** (8 * width - 1)
    y = y.reshape(-1, channels).mean(axis=1)
    if own != rate and len(y):
        n = int(len(y) * rate / own)
        y = np.interp(np.arange(n) * own / rate, np.arange(len(y)), y)
    return y


def stft(y: np.ndarray, n_fft: int = N_FFT, hop: int = HOP) -> np.ndarray:
    """Bins x frames, Hann window, frames centred, zeros beyond the ends."""
    p = np.pad(y, n_fft // 2)
    n = 1 + max(0, len(p) - n_fft) // hop
    k = np.arange(n)[:, None] * hop + np.arange(n_fft)[None]
    return np.fft.rfft(p[np.minimum(k, len(p) - 1)] * np.hanning(n_fft + 1)[:-1], axis=1).T


def decibel(power: np.ndarray, reference=np.max, top: float = 80.0) -> np.ndarray:
    db = 10 * np.log10(np.maximum(power, 1e-10)) - 10 * np.log10(max(1e-10, float(reference(power))))
    return np.maximum(db, db.max() - top)


def mel_scale(f):
    """Linear under 1 kHz, logarithmic over it."""
    f = np.asarray(f, float)
    return np.where(f < 1000, f * 3 / 200, 15 + np.log(np.maximum(f, 1e-9) / 1000) / (math.log(6.4) / 27))


def mel_inverse(m):
    m = np.asarray(m, float)
    return np.where(m < 15, m * 200 / 3, 1000 * np.exp((m - 15) * math.log(6.4) / 27))


def mel_filters(rate: int, n_fft: int, n: int, low: float = 0.0, high: float | None = None) -> np.ndarray:
    """Triangles of equal area over the bins."""
    edges = mel_inverse(np.linspace(mel_scale(low), mel_scale(min(high or rate / 2, rate / 2)), n + 2))
    bins = np.arange(1 + n_fft // 2) * rate / n_fft
    up = (bins[None] - edges[:-2, None]) / np.diff(edges)[:-1, None]
    down = (edges[2:, None] - bins[None]) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def constant_q(y: np.ndarray, rate: int = RATE, hop: int = HOP, bins: int = 84, f_min: float = 32.70319566257483, per_octave: int = 12, scale: float = 1.0) -> np.ndarray:
    """Magnitudes bins x frames: every bin's windowed tone against the frames of the signal, in the frequency domain."""
    q = scale / (2 ** (1 / per_octave) - 1)
    f = f_min * 2 ** (np.arange(bins) / per_octave)
    f = f[f < rate / 2]
    n_fft = 1 << math.ceil(math.log2(min(q * rate / f[0], 1 << 15)))
    spec = stft_plain(y, n_fft, hop)
    out = np.zeros((bins, spec.shape[1]))
    for k, x in enumerate(f):
        n = min(int(q * rate / x), n_fft)
        tone = np.zeros(n_fft, complex)
        start = (n_fft - n) // 2
        w = np.hanning(n)
        tone[start : start + n] = w / max(w.sum(), 1e-9) * np.exp(2j * np.pi * x / rate * (np.arange(n) - n / 2))
        kernel = np.fft.fft(tone).conj()
        at = np.flatnonzero(np.abs(kernel) > 0.01 * np.abs(kernel).max())
        out[k] = np.abs(kernel[at] @ spec[at]) / n_fft * math.sqrt(n)
    return out


def stft_plain(y: np.ndarray, n_fft: int, hop: int) -> np.ndarray:
    p = np.pad(y, n_fft // 2)
    n = 1 + max(0, len(p) - n_fft) // hop
    k = np.arange(n)[:, None] * hop + np.arange(n_fft)[None]
    return np.fft.fft(p[np.minimum(k, len(p) - 1)], axis=1).T


def hpss(y: np.ndarray, size: int = 31) -> tuple[np.ndarray, np.ndarray]:
    """Harmonic and percussive magnitudes, bins x frames, by median filters in time and in frequency and soft masks."""
    m = np.abs(stft(y))
    h, p = N.median_filter(m.T, size).T, N.median_filter(m, size)
    whole = np.maximum(h**2 + p**2, 1e-12)
    return m * h**2 / whole, m * p**2 / whole


def onset_strength(y: np.ndarray) -> np.ndarray:
    m = decibel(mel_filters(RATE, N_FFT, 128) @ np.abs(stft(y)) ** 2)
    return np.concatenate([[0], np.maximum(0, np.diff(m, axis=1)).mean(axis=0)])


def beats(y: np.ndarray, rate: int = RATE, hop: int = HOP, tightness: float = 100.0) -> np.ndarray:
    """Beat frames by dynamic programming over onset strength (Ellis); a beat at time 0 is dropped."""
    _, percussive = hpss(y)
    m = decibel(mel_filters(rate, N_FFT, 128) @ percussive**2)
    o = np.concatenate([[0], np.maximum(0, np.diff(m, axis=1)).mean(axis=0)])
    if len(o) < 4 or o.max() <= 0:
        return np.zeros(0, int)
    lags = np.arange(1, min(len(o), int(rate / hop * 4)))
    acf = np.array([(o[k:] * o[:-k]).sum() for k in lags])
    tempo = 60 * rate / hop / lags
    period = lags[int((acf * np.exp(-0.5 * np.log2(tempo / 120) ** 2)).argmax())]
    score = o / (o.std() + 1e-9)
    total, link = score.copy(), np.full(len(o), -1)
    for i in range(len(o)):
        before = np.arange(max(0, i - 2 * period), i - period // 2)
        if len(before):
            v = total[before] - tightness * np.log((i - before) / period) ** 2
            k = int(v.argmax())
            if v[k] > 0:
                total[i], link[i] = score[i] + v[k], before[k]
    k, out = int(total[-2 * period :].argmax() + max(0, len(o) - 2 * period)), []
    while k >= 0:
        out.append(k)
        k = link[k]
    out = np.array(out[::-1])
    return out[out > 0]


@feature("cqt")
def cqt(y, rate=RATE, ref_power=np.max):
    return decibel(constant_q(y, rate) ** 2, ref_power).T


@feature("mel")
def mel(y, rate=RATE):
    return np.abs(mel_filters(rate, N_FFT, 80, 80, 16000) @ np.abs(stft(y)) ** 2).T


@feature("log_mel")
def log_mel(y, rate=RATE, ref_power=np.max):
    return decibel(mel(y, rate).T, ref_power).T


@feature("mfcc")
def mfcc(y, rate=RATE, ref_power=np.max):
    m = decibel((mel_filters(rate, N_FFT, 128) @ np.abs(stft(y)) ** 2) ** 2, ref_power)
    n = len(m)
    dct = np.sqrt(2 / n) * np.cos(np.pi / n * (np.arange(n)[None] + 0.5) * np.arange(14)[:, None])
    dct[0] /= math.sqrt(2)
    return (dct @ m).T


@feature("pcp")
def pcp(y, rate=RATE):
    """Chroma of the constant-Q energy of the harmonic part: 7 octaves from 27.5 Hz, folded, each frame's largest 1."""
    m = np.abs(stft(y))
    h, _ = hpss(y)
    gain = h.sum(axis=0) / np.maximum(m.sum(axis=0), 1e-9)
    q = constant_q(y, rate, f_min=27.5) ** 2
    q = q[:, : len(gain)] * gain[: q.shape[1]] ** 2
    chroma = np.roll(q.reshape(-1, 12, q.shape[1]).sum(axis=0), -3, axis=0)
    return (chroma / np.maximum(chroma.max(axis=0), 1e-9)).T


@feature("tonnetz")
def tonnetz(y, rate=RATE):
    c = pcp(y, rate)
    c = c / np.maximum(np.abs(c).sum(axis=1), 1e-9)[:, None]
    step = np.arange(12)
    angles = [(7 / 6, 1.0), (3 / 2, 1.0), (2 / 3, 0.5)]
    basis = np.array([r * trig(np.pi * a * step) for a, r in angles for trig in (np.sin, np.cos)])
    return c @ basis.T


@feature("tempogram")
def tempogram(y, rate=RATE, win: int = 192):
    """Local autocorrelation of onset strength, each frame's largest 1."""
    o = np.pad(onset_strength(y), win // 2)
    w = np.hanning(win + 1)[:-1]
    out = []
    for k in range(len(o) - win):
        f = np.fft.rfft(o[k : k + win] * w, 2 * win)
        a = np.fft.irfft(np.abs(f) ** 2)[:win]
        out.append(a / max(np.abs(a).max(), 1e-9))
    return np.array(out)


def sync(frames: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Mean of the frames between beats, with those before the first and from the last on."""
    cuts = np.unique(np.concatenate([[0], at[at < len(frames)], [len(frames)]]))
    return np.array([frames[a:b].mean(axis=0) for a, b in zip(cuts[:-1], cuts[1:])])


def extract(audio: DataFrame, features: tuple[str, ...] | None = None, rate: int = RATE, hop: int = HOP) -> DataFrame:
    """(track_id, feature_id, sync, i, t, vec) from binary rows (path, content): frame and beat synchronous matrices."""
    names = features or tuple(FEATURES)
    if missing := [n for n in names if n not in FEATURES]:
        raise FeatureTypeNotFound(f"no feature {missing}")
    makers = {n: FEATURES[n] for n in names}

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                y = decode_wav(r.content, rate)
                track = r.path.rpartition("/")[2].rpartition(".")[0]
                at = beats(y, rate, hop)
                for name, f in makers.items():
                    m = f(y, rate)
                    t = np.arange(len(m)) * hop / rate
                    s = sync(m, at)
                    ends = np.append(t[np.minimum(at[at < len(m)], len(m) - 1)], t[-1])[: len(s)]
                    for kind, x, when in (("framesync", m, t), ("est_beatsync", s, ends)):
                        yield pd.DataFrame({"track_id": track, "feature_id": name, "sync": kind, "i": np.arange(len(x)), "t": when, "vec": list(x)})

    return audio.select("path", "content").mapInPandas(run, "track_id string, feature_id string, sync string, i int, t double, vec array<double>")


def audio_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select("path", "content")


def select(frames: DataFrame, feature_id: str, annotated_beats: bool = False, framesync: bool = False) -> DataFrame:
    """The frames of one feature and synchronisation."""
    if annotated_beats and framesync:
        raise FeatureParamsError("frames are synchronous with annotated beats or with the analysis, not both")
    if feature_id not in FEATURES:
        raise FeatureTypeNotFound(f"no feature {feature_id}")
    kind = "framesync" if framesync else "ann_beatsync" if annotated_beats else "est_beatsync"
    return frames.where((F.col("feature_id") == feature_id) & (F.col("sync") == kind)).select("track_id", "i", "t", "vec")


def write_features(frames: DataFrame, path: str) -> None:
    """Parquet by feature and synchronisation; only the partitions that frames holds are written anew."""
    frames.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("feature_id", "sync").parquet(path)


FEATURE_FILE = "globals struct<dur double, sample_rate int, hop_length int, audio_file string>, est_beats array<double>, est_beatsync_times array<double>, ann_beats array<double>, ann_beatsync_times array<double>"
ONE_FEATURE = "struct<params map<string, string>, framesync array<array<double>>, est_beatsync array<array<double>>, ann_beatsync array<array<double>>>"


def read_feature_file(spark: SparkSession, path: str, feature_id: str, kind: str = "framesync", params: dict | None = None, rate: int = RATE, hop: int = HOP) -> DataFrame:
    """Frames of a JSON feature file whose globals and parameters agree; files that disagree give no rows."""
    if kind not in ("framesync", "est_beatsync", "ann_beatsync"):
        raise WrongFeaturesFormatError(f"no synchronisation {kind}")
    files = spark.read.schema(f"{FEATURE_FILE}, {feature_id} {ONE_FEATURE}").json(path, multiLine=True).withColumn("path", F.input_file_name())
    good = files.where((F.col("globals.sample_rate") == rate) & (F.col("globals.hop_length") == hop))
    for k, v in (params or {}).items():
        good = good.where(F.col(f"{feature_id}.params")[k] == str(v))
    t = {"framesync": F.col("i") * float(hop) / float(rate), "est_beatsync": F.get("est_beatsync_times", F.col("i")), "ann_beatsync": F.get("ann_beatsync_times", F.col("i"))}[kind]
    rows = good.select("path", "est_beatsync_times", "ann_beatsync_times", F.posexplode(f"{feature_id}.{kind}").alias("i", "vec"))
    return rows.select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "").alias("track_id"), "i", t.alias("t"), "vec")


def clicks(times: np.ndarray, length: int, rate: int = RATE) -> np.ndarray:
    """A decaying 1 kHz tone of 100 ms at every time."""
    k = np.arange(int(rate * 0.1))
    tone = np.exp(-k / (rate * 0.01)) * np.sin(2 * np.pi * 1000 * k / rate)
    out = np.zeros(length)
    for t in times:
        a = int(t * rate)
        n = min(len(tone), length - a)
        if n > 0:
            out[a : a + n] += tone[:n]
    return out


def sonify(audio: DataFrame, times: DataFrame, rate: int = RATE) -> DataFrame:
    """(track_id, content): 16-bit WAV files of the audio with clicks at the boundary times; peaks are scaled to 1."""
    rows = audio.withColumn("track_id", F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")).join(times, "track_id")

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                y = decode_wav(r.content, rate)
                y = y + clicks(np.asarray(r.times, float), len(y), rate)
                y = y / max(np.abs(y).max(), 1e-9) if len(y) else y
                f = io.BytesIO()
                with wave.open(f, "wb") as w:
                    w.setnchannels(1)
                    w.setsampwidth(2)
                    w.setframerate(rate)
                    w.writeframes((y * 32767).astype("<i2").tobytes())
                out.append((r.track_id, f.getvalue()))
            yield pd.DataFrame(out, columns=["track_id", "content"])

    return rows.select("track_id", "content", "times").mapInPandas(run, "track_id string, content binary")
