"""Streams: session segments with a watermark, and an online basis per key."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.factor import simplex_volume


def session_segments(events: DataFrame, gap: str = "12 hours", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n, value): runs of events with gaps of at most gap; sessions close when the watermark passes them."""
    g = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s"))
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n", "value")


def beat_bins(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Means of value in tumbling windows, the beats of a stream."""
    return events.withWatermark("ts", late).groupBy("user_id", F.window("ts", width).alias("w")).agg(F.avg("value").alias("value"), F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "value", "n")


def online_basis(vectors: DataFrame, rank: int = 3) -> DataFrame:
    """(key, vec_id, changed, volume) of streams (key, vec_id, vec): k corners per key are kept as state.

    A new vector takes the place of the corner whose exchange widens the simplex most. The state is rank vectors,
    whatever the length of the stream. Vectors of a batch are taken in order of vec_id.
    """

    def step(key, batches, state: GroupState):
        ids, corners = (list(state.get[0]), [np.asarray(v) for v in np.array(state.get[1], float).reshape(len(state.get[0]), -1)]) if state.exists else ([], [])
        rows = []
        for r in pd.concat(list(batches)).sort_values("vec_id").itertuples(index=False):
            v, changed = np.asarray(r.vec, float), False
            if len(corners) < rank:
                ids.append(r.vec_id)
                corners.append(v)
                changed = True
            else:
                best, at = simplex_volume(np.array(corners).T) * (1 + 1e-9), -1
                for k in range(rank):
                    volume = simplex_volume(np.array([*corners[:k], v, *corners[k + 1 :]]).T)
                    if volume > best:
                        best, at = volume, k
                if at >= 0:
                    ids[at], corners[at], changed = r.vec_id, v, True
            rows.append((key[0], r.vec_id, changed, simplex_volume(np.array(corners).T)))
        state.update((ids, np.concatenate(corners).tolist()))
        yield pd.DataFrame(rows, columns=["key", "vec_id", "changed", "volume"])

    return vectors.groupBy("key").applyInPandasWithState(step, "key long, vec_id long, changed boolean, volume double", "ids array<long>, corners array<double>", "append", GroupStateTimeout.NoTimeout)
