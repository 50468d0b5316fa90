"""Frame sources: ordered feature vectors per track.

frames: track_id STRING, i INT, t DOUBLE (seconds), vec ARRAY<DOUBLE>.
packed: track_id, ts ARRAY<DOUBLE>, x ARRAY<ARRAY<DOUBLE>>; one row per track, made by one shuffle on
the track, from which every sequence operator works without another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Event types in the order of their columns in a vector.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_vectors(events: DataFrame) -> DataFrame:
    """(track_id, ts, event_id, t, vec): vec is value, one column per event type, and the k of props."""
    k = F.coalesce(F.get_json_object("props", "$.k").cast("double"), F.lit(0.0))
    vec = F.array(F.col("value").cast("double"), *[F.when(F.col("event_type") == e, 1.0).otherwise(0.0) for e in EVENT_TYPES], k)
    return events.select(F.col("user_id").cast("string").alias("track_id"), "ts", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), vec.alias("vec"))


def events_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_vectors(table(spark, sf_dir, "events"))
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", "t", "vec")))
    return rows.groupBy("track_id").agg(ordered.alias("o")).select("track_id", F.col("o.t").alias("ts"), F.col("o.vec").alias("x"))


def numbered(df: DataFrame, order: str, place: str = "i") -> DataFrame:
    """df with the place of each row in the order of a numeric column, from 0 on, nulls last; ties are ordered by the other columns.

    Rows are dealt by ranges, and only the counts of the ranges are added up. The ranges' bounds are found once and then are constants
    of the plan, so every reading of it deals rows alike, however Spark samples or joins partitions.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.agg(F.percentile_approx(order, [k / n for k in range(1, n)] or [0.5])).first()[0]
    cuts = sorted(set(cuts or []))

    def part(low: int, high: int):
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col(order) < cuts[middle], part(low, middle)).otherwise(part(middle + 1, high))

    dealt = df.withColumn("__part", F.when(F.col(order).isNull(), F.lit(len(cuts) + 1)).otherwise(part(0, len(cuts))))
    within = F.row_number().over(W.partitionBy("__part").orderBy(F.col(order).asc_nulls_last(), *[c for c in df.columns if c != order])) - 1
    counts = dealt.groupBy("__part").agg(F.count("*").alias("n"))
    first = counts.groupBy().agg(F.array_sort(F.collect_list(F.struct("__part", "n"))).alias("c")).select(F.inline(F.transform("c", lambda x, k: F.struct(x["__part"].alias("__part"), F.aggregate(F.slice("c", 1, k), F.lit(0).cast("long"), lambda a, y: a + y["n"]).alias("__first")))))
    return dealt.withColumn("__within", within).join(F.broadcast(first), "__part").withColumn(place, F.col("__first") + F.col("__within")).drop("__part", "__first", "__within")


def embedding_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frames of the track `embeddings`, in order of vec_id."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    return numbered(rows, "vec_id").select(F.lit("embeddings").alias("track_id"), "i", F.col("vec_id").cast("double").alias("t"), "vec")


def embeddings_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One track, `embeddings`, in order of vec_id; t is vec_id."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    o = F.array_sort(F.collect_list(F.struct("vec_id", "vec")))
    return rows.agg(o.alias("o")).select(F.lit("embeddings").alias("track_id"), F.transform("o", lambda r: r["vec_id"].cast("double")).alias("ts"), F.col("o.vec").alias("x")).where(F.size("x") > 0)


def spread(packed: DataFrame, x, place: str, value: str, *more: str) -> DataFrame:
    """(track_id, more, place, value): the elements of an array.

    The outer form keeps Spark from putting a filter on the array's size below, which would compute the array twice.
    """
    return packed.select("track_id", *more, F.posexplode_outer(x).alias(place, value)).where(F.col(place).isNotNull())


def unpack(packed: DataFrame, x: str = "x") -> DataFrame:
    """frames of a packed table."""
    return spread(packed, F.arrays_zip("ts", x), "i", "f").select("track_id", "i", F.col("f.ts").alias("t"), F.col(f"f.{x}").alias("vec"))


def pack(frames: DataFrame) -> DataFrame:
    o = F.array_sort(F.collect_list(F.struct("i", "t", "vec")))
    return frames.groupBy("track_id").agg(o.alias("o")).select("track_id", F.col("o.t").alias("ts"), F.col("o.vec").alias("x"))


def series(packed: DataFrame, x: str = "x") -> DataFrame:
    """(track_id, d, a): one array of values per dimension."""
    dims = F.transform(F.sequence(F.lit(0), F.size(F.get(F.col(x), 0)) - 1), lambda d: F.transform(x, lambda v: F.get(v, d)))
    return spread(packed, dims, "d", "a")
