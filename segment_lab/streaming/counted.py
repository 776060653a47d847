"""Segments of a fixed number of samples of a stream (G7), with a state per key.

A sample's place in its file decides its segment, so samples must be counted
in time order, whatever files they arrive in.  The table is therefore landed
in batches of times that do not overlap; each batch is one micro-batch of
the same query, and the state of a key holds the segment it has begun.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ordered import cut_points, sample_values
from ..session import scratch_path
from .segments import open_stream

MEASURES = ("n", "mean", "min", "max", "rms")
#: Segments begun, then of the open one: samples, values, their sum, least, greatest and sum of squares.
STATE = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("n", T.LongType()), T.StructField("m", T.LongType()),
                      *[T.StructField(c, T.DoubleType()) for c in ("total", "low", "high", "squares")]])


def _summary(values: np.ndarray) -> np.ndarray:
    """Per row of samples: values that are there, their sum, least, greatest, and sum of squares."""
    there = ~np.isnan(values)
    v = np.where(there, values, 0.0)
    return np.stack([there.sum(axis=1), v.sum(axis=1), np.where(there, values, np.inf).min(axis=1, initial=np.inf),
                     np.where(there, values, -np.inf).max(axis=1, initial=-np.inf), (v * v).sum(axis=1)], axis=1)


def count_segments(stream_df: DataFrame, keys: list[str], order: list[str], size: int, value: str = "value") -> DataFrame:
    """``(<keys>, chunk, n, mean, min, max, rms)`` of every full segment of ``size`` samples of a key, in append mode.

    Samples of a key are taken in the order of ``order`` inside a
    micro-batch; a missing value takes its place in a segment but no part in
    its measures.  The incomplete segment waits in the state.
    """
    kinds = [stream_df.schema[k] for k in keys]
    out = T.StructType([*kinds, T.StructField("chunk", T.LongType()), T.StructField("n", T.LongType()),
                        *[T.StructField(c, T.DoubleType()) for c in MEASURES[1:]]])

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        chunk, n, *held = state.get if state.exists else (0, 0, 0, 0.0, float("inf"), float("-inf"), 0.0)
        batch = pd.concat(list(parts), ignore_index=True).sort_values(order, kind="stable")
        values = batch[value].to_numpy(float)
        first = values[:size - n]
        m, total, low, high, squares = _summary(first[None, :])[0]
        held = [held[0] + m, held[1] + total, min(held[2], low), max(held[3], high), held[4] + squares]
        n += len(first)
        done = []
        if n == size:
            rest = values[len(first):]
            whole = len(rest) // size
            done = [held, *_summary(rest[:whole * size].reshape(whole, size)).tolist()]
            tail = rest[whole * size:]
            n, held = len(tail), _summary(tail[None, :])[0].tolist()
        if done:
            rows = np.array(done, float)
            count = np.where(rows[:, 0] > 0, rows[:, 0], np.nan)
            none = rows[:, 0] == 0
            frame = {k: [key[i]] * len(rows) for i, k in enumerate(keys)} | {
                "chunk": chunk + np.arange(len(rows)), "n": size, "mean": rows[:, 1] / count, "min": np.where(none, np.nan, rows[:, 2]),
                "max": np.where(none, np.nan, rows[:, 3]), "rms": np.sqrt(rows[:, 4] / count)}
            yield pd.DataFrame(frame)
        state.update((int(chunk + len(done)), int(n), int(held[0]), *map(float, held[1:])))

    return stream_df.groupBy(*keys).applyInPandasWithState(step, out, STATE, "append", GroupStateTimeout.NoTimeout)


def run_count_segments(spark: SparkSession, path: str, schema: T.StructType, ts: str, order: list[str], keys: list[str], size: int,
                       name: str, batches: int = 4, value: str = "value") -> DataFrame:
    """All full segments of the table at ``path``, one micro-batch for each of ``batches`` time ranges.

    Rows without a time come first.  Landed files, state and results lie in
    the shared checkpoint folder; a run that failed goes on from its state.
    """
    source = spark.read.schema(schema).parquet(path)
    when = F.col(ts).cast("timestamp")
    cuts = [v for v in cut_points([r[0] for r in sample_values(source, [when], batches)], batches)]
    out = scratch_path(spark, f"stream_{name}")
    for k in range(len(cuts) + 1):
        mine = F.lit(True)
        if k:
            mine = mine & (when >= F.lit(cuts[k - 1]))
        if k < len(cuts):
            mine = mine & (when < F.lit(cuts[k]))
        if k == 0:
            mine = mine | when.isNull()
        source.where(mine).write.mode("append").parquet(out + "/landing")
        query = count_segments(open_stream(spark, out + "/landing", schema), keys, order, size, value) \
            .writeStream.outputMode("append").format("parquet").option("checkpointLocation", out + "/_checkpoint").option("path", out + "/data") \
            .trigger(availableNow=True).start()
        query.awaitTermination()
    fields = [*[schema[k] for k in keys], T.StructField("chunk", T.LongType()), T.StructField("n", T.LongType()),
              *[T.StructField(c, T.DoubleType()) for c in MEASURES[1:]]]
    found = spark.read.schema(T.StructType(fields)).parquet(out + "/data")
    return found.select(*keys, "chunk", "n", *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in MEASURES[1:]])
