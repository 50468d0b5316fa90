"""Quality classifier by hierarchical empirical Bayes.

A logistic model over shape features of the text (letters, symbols, capitals, repeated words and lines)
gives each document's evidence. Its expected positives are summed per host and per path; a host's
share is shrunk toward the global share, and a path's toward its host's, by Beta priors whose
strengths are moment estimates over all hosts and paths, so that sparse sites stay near their prior. The score
is the document's odds, moved from the global prior to its path's, where the document itself is left out of both posteriors.

The model is fitted on at most TRAIN_ROWS labelled rows of the training folds, chosen by a hash of the id. Host and
path sums cover all documents. The site tables have a row per host or path; a hot host is summed
in the map tasks and joined as the small side if its rows are within the broadcast limit.

Results for odd rows: null texts count as empty; a null host or path is a site of its own; repeated rows
give equal values; without labelled training rows, or with one class only, the evidence is the smoothed share of positives.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, keep, per_slice, small_or_not, table

TRAIN_ROWS = 20_000
FEATURES = 10
#: Bounds of a prior's strength, in documents.
STRENGTH = (1.0, 10_000.0)

UPPER = bytes(range(0x41, 0x5B))
LOWER = bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
DIGITS, SPACES = b"0123456789", b" \t\n\r\x0b\x0c"
STOPS = b".,;:?'\"()"


def features(text: str | None) -> list[float]:
    raw = (text or "").encode()
    n = len(raw)
    if not n:
        return [0.0] * (FEATURES - 1) + [1.0]
    count = lambda chars: n - len(raw.translate(None, chars))
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    upper, lower, digits, spaces, stops = map(count, (UPPER, LOWER, DIGITS, SPACES, STOPS))
    distinct = len(set(words))
    return [
        math.log1p(len(words)) / 5,
        upper / n,
        digits / n,
        (n - upper - lower - digits - spaces - stops) / n,
        stops / max(1, len(words)),
        distinct / max(1, len(words)),
        distinct / max(1, len(words)) ** 0.7,
        len(set(lines)) / max(1, len(lines)),
        (n - spaces) / max(1, len(words)) / 10,
        0.0,
    ]


def fit(docs: DataFrame, labels: DataFrame, train, label: str = "quality") -> np.ndarray:
    """Weights of the evidence model, standardised features first."""
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & train).groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    schema = pa.schema([("y", pa.int32()), ("x", pa.list_(pa.float64()))])
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "y")
    got = rows.mapInArrow(per_slice(lambda: lambda texts, ys: [ys, list(map(features, texts))], schema), "y int, x array<double>").toPandas()
    y = got["y"].to_numpy(float)
    if len(set(y)) < 2:
        share = (y.sum() + 0.5) / (len(y) + 1)
        return np.array([0.0] * FEATURES + [math.log(share / (1 - share))])
    x = np.array(got["x"].tolist())
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    w, ridge = np.zeros(FEATURES + 1), np.diag([1.0] * FEATURES + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        move = np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + ridge, z.T @ (y - p) - ridge @ w)
        w += move * min(1.0, 5 / max(1e-9, np.abs(move).max()))
        if np.abs(move).max() < 1e-8:
            break
    return np.append(w[:-1] / spread, w[-1] - (w[:-1] * mean / spread).sum())


def evidence(docs: DataFrame, w: np.ndarray, host: str, path: str) -> DataFrame:
    """(doc_id, host, path, p_text) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("p_text", pa.float64())])

    def f(ids, hosts, paths, texts):
        z = np.array([features(t) for t in texts]) @ w[:-1] + w[-1]
        return [ids, hosts, paths, np.clip(1 / (1 + np.exp(-np.clip(z, -30, 30))), 1e-6, 1 - 1e-6).tolist()]

    return docs.select("doc_id", F.expr(host).cast("string").alias("host"), F.expr(path).cast("string").alias("path"), "text").mapInArrow(per_slice(lambda: f, schema), "doc_id long, host string, path string, p_text double")


def strength(groups: DataFrame, prior) -> float:
    """Moment estimate of a Beta prior's strength: groups (n, s), prior their prior mean."""
    within, between, total = F.sum(prior * (1 - prior)), F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - prior, 2.0)), F.sum("n")
    r = groups.agg(within.alias("w"), between.alias("b"), total.alias("t"), F.count("*").alias("g"), F.sum(F.col("n") * prior * (1 - prior)).alias("v")).first()
    if not r["g"] or not r["t"] or not r["v"]:
        return STRENGTH[1]
    variance = r["v"] / r["t"]
    # beyond the chance spread of g shares, in documents
    excess = (r["b"] - r["w"]) / r["t"]
    return min(max(variance / excess - 1, STRENGTH[0]), STRENGTH[1]) if excess > 0 else STRENGTH[1]


def classify(docs: DataFrame, labels: DataFrame, train, host: str, path: str) -> DataFrame:
    """doc_id, p_text, host_share, path_share, score and keep of every row; host and path are SQL expressions."""
    rows = keep(evidence(docs, fit(docs, labels, train), host, path))
    paths = keep(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p_text").alias("s")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    totals = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    share = (totals["s"] + 0.5) / (totals["n"] + 1) if totals["n"] else 0.5
    a = strength(hosts, F.lit(share))
    hosts = hosts.select(F.col("host").alias("h"), F.col("n").alias("host_n"), F.col("s").alias("host_s"), ((F.col("s") + a * share) / (F.col("n") + a)).alias("host_share"))
    nested = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).select("host", "path", "n", "s", "host_n", "host_s", "host_share")
    b = strength(nested, F.col("host_share"))
    sites = keep(nested.select(F.col("host").alias("h"), F.col("path").alias("q"), "n", "s", "host_n", "host_s"))
    logit = lambda p: F.log(p) - F.log(1 - p)
    joined = rows.join(small_or_not(sites, sites.count()), F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
    # a document's own evidence counts once: its sites' posteriors are those of their other documents
    joined = joined.withColumn("host_share", (F.col("host_s") - F.col("p_text") + a * share) / (F.col("host_n") - 1 + a))
    joined = joined.withColumn("path_share", (F.col("s") - F.col("p_text") + b * F.col("host_share")) / (F.col("n") - 1 + b))
    z = logit(F.col("p_text")) + logit(F.least(F.greatest("path_share", F.lit(1e-6)), F.lit(1 - 1e-6))) - math.log(share / (1 - share))
    return joined.select("doc_id", "p_text", "host_share", "path_share", (1 / (1 + F.exp(-z))).alias("score")).withColumn("keep", F.col("score") >= 0.5)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of `documents` are their sources, paths the languages of a source."""
    docs = table(spark, sf_dir, "documents")
    return classify(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0, "source", "concat(source, '/', coalesce(lang, ''))")
