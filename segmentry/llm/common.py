"""Pieces shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Functions of this subpackage travel to the executors by value, so a cluster needs no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__.rpartition(".")[0]])

#: Rows, and bytes of their texts, that are Python objects at one time in a worker; a longer text is alone.
SLICE, SLICE_BYTES = 256, 4 << 20
#: Largest table, in rows of a few numbers each, that is ever broadcast (64 MB at 32 bytes a row).
BROADCAST_ROWS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, k: int) -> Column:
    """crc32 of the id as text, modulo k; rows without an id are in fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % k, F.lit(0))


def give_back() -> None:
    """Returns freed memory of Python, Arrow and, where it can, the C library to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def once(key, build):
    """build() of this Python worker, kept for the worker's later tasks until something else is built."""
    kept = sys.__dict__.setdefault("_segmentry_worker", {})
    if key not in kept:
        kept.clear()
        give_back()
        kept[key] = build()
    return kept[key]


def slices(batch: pa.RecordBatch, rows: int):
    """The parts of a batch, of at most so many rows and SLICE_BYTES bytes of texts; a row of more is a part of its own."""
    size = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
            size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    at = held = 0
    for k, n in enumerate(size.tolist()):
        if k - at == rows or k > at and held + n > SLICE_BYTES:
            yield batch.slice(at, k - at)
            at, held = k, 0
        held += n
    if at < batch.num_rows:
        yield batch.slice(at)


def per_slice(make, schema: pa.Schema, size: int = SLICE):
    """A function for mapInArrow: make() gives a task's f(columns as lists) -> columns as lists."""

    def run(batches):
        f = make()
        for batch in batches:
            for part in slices(batch, size):
                out = f(*(c.to_pylist() for c in part.columns))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types)], schema=schema)
            del batch
            # workers stay for later tasks, beside those of other functions
            pa.default_memory_pool().release_unused()
        give_back()

    return run


def checkpoint_dir(spark: SparkSession) -> None:
    """Uses the folder of spark.checkpoint.dir; only where that is unset (tests) a temporary one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="segmentry-"))


def keep(df: DataFrame) -> DataFrame:
    """Cuts the lineage: the rows are written once to the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def small_or_not(df: DataFrame, rows: int) -> DataFrame:
    """df as a broadcast side if its counted rows are within BROADCAST_ROWS; beyond it Spark shuffles."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


#: Rows of one key from which a join may take the key apart.
HOT = 1000


def joined(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left joined with right, which has a row for each key and the number n of left's rows with it (not returned).

    Keys of HOT rows or more, and of so many that there can't be more than BROADCAST_ROWS of them, are joined by broadcast and
    never meet in one task.
    """
    right = keep(right)
    least = max(HOT, (right.agg(F.sum("n")).first()[0] or 0) // max(1, BROADCAST_ROWS))
    hot = right.where(F.col("n") >= least).drop("n")
    few = hot.count()
    if not few:
        return left.join(right.drop("n"), key)
    rest = left.join(small_or_not(hot.select(key), few), key, "left_anti").join(right.where(F.col("n") < least).drop("n"), key)
    return left.join(small_or_not(hot, few), key).unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b) as rows (node, root), root the smallest node; nodes without an edge are absent.

    Large-star and small-star steps alternate until no edge changes; every step is a grouped
    minimum and an equi-join, so neither a component nor a hub's neighbours ever meet in one task's memory.
    """

    def seen(e):
        r = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    def two(a, b, c, d):
        """Rows (a, b) and (c, d) of each row."""
        return F.inline(F.array(F.struct(F.col(a).alias("a"), F.col(b).alias("b")), F.struct(F.col(c).alias("a"), F.col(d).alias("b"))))

    def step(e, large):
        if large:
            both = e.select(two("a", "b", "b", "a"))
            least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            out = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            least = down.groupBy("a").agg(F.min("b").alias("m"))
            out = down.join(least, "a").select(two("b", "m", "a", "m"))
        return out.where("a <> b").distinct()

    now = keep(edges.select("a", "b").where("a <> b").distinct())
    before = seen(now)
    while before[0]:
        now = keep(step(step(now, True), False))
        after = seen(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
