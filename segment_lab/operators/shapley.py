"""Shapley values of a fitted forest for rows of a table, by sampled walks (M7).

A walk starts at a background row and takes over the explained row's
features one by one in a random order; what the class probability changes
at a feature's step is its contribution.  Contributions of all walks are
averaged.  Walks are rows, scored by the model's own ``transform``.
"""

from __future__ import annotations

from itertools import permutations as all_orders
from math import factorial, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.randomness import seeded_hash

#: Rows that are explained, background rows, and orders (each is walked forward and back).
SAMPLE_ROWS, BACKGROUND_ROWS, ORDERS = 200, 16, 16


def orders_of(n_features: int, orders: int, seed: int) -> np.ndarray:
    """Feature orders (rows): all of them if they are not more than asked for, else seeded ones and their reverses."""
    if n_features <= 8 and factorial(n_features) <= 2 * orders:
        return np.array(list(all_orders(range(n_features))))
    rng = np.random.default_rng(seed)
    drawn = np.array([rng.permutation(n_features) for _ in range(orders)])
    return np.concatenate([drawn, drawn[:, ::-1]])


def error_bound(walks: int, confidence: float = 0.95) -> float:
    """No value is further off than this with the given confidence (Hoeffding; a contribution lies in -1 .. 1)."""
    return sqrt(2.0 * log(2.0 / (1.0 - confidence)) / walks)


def forest_shapley(df: DataFrame, model, vec: str, id_col: str, names: list[str], labels: list[str], sample_rows: int = SAMPLE_ROWS,
                   background_rows: int = BACKGROUND_ROWS, orders: int = ORDERS, seed: int = 1987) -> DataFrame:
    """``(id, cls, feature, phi, stderr, base, probability)`` of a sample of rows.

    ``sample_rows`` rows are explained and ``background_rows`` others stand
    for features not taken over yet: both are the first in the order of a
    seeded md5 of their id, a bound on the work that is part of the result.
    Every order is walked from a background row in turn (from each of them,
    if all orders are walked: then the values are exact for that
    background).  For every row and class, ``phi`` over all features plus
    ``base`` is the predicted ``probability``.  ``stderr`` is the standard
    error of ``phi`` over its walks, ``error_bound`` one that holds for any
    forest.  ``transform`` is the model's; rows without a vector are left out.
    """
    rows = df.select(F.col(id_col).alias("id"), vector_to_array(vec).alias("x")).where("x IS NOT NULL")
    explained = rows.orderBy(seeded_hash(seed, "id"), "id").limit(sample_rows)
    ground = rows.orderBy(seeded_hash(seed + 1, "id"), "id").limit(background_rows).collect()  # few whole vectors
    z = np.array([r["x"] for r in ground], float)
    turns = orders_of(len(names), orders, seed)
    exact = len(names) <= 8 and len(turns) == factorial(len(names))
    walks = [(t, b) for t in range(len(turns)) for b in (range(len(z)) if exact else [t % max(len(z), 1)])] if len(z) else []

    def walk(batches):
        for b in batches:
            for row_id, x in zip(b.column("id"), b.column("x").to_pylist()):
                x, d = np.array(x, float), len(names)
                for lo in range(0, len(walks), 64):  # some walks at a time
                    part = walks[lo:lo + 64]
                    order = turns[[t for t, _ in part]]
                    # after s steps a feature is taken over if its place in the order is below s
                    place = np.argsort(order, axis=1)
                    taken = place[:, None, :] < np.arange(d + 1)[None, :, None]
                    points = np.where(taken, x, z[[g for _, g in part]][:, None, :])
                    n = len(part) * (d + 1)
                    feature = np.concatenate([np.full((len(part), 1), -1), order], axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row_id.as_py()] * n, b.schema.field("id").type), pa.array(np.repeat(np.arange(lo, lo + len(part)), d + 1), pa.int32()),
                         pa.array(np.tile(np.arange(d + 1), len(part)), pa.int32()), pa.array(feature.ravel(), pa.int32()),
                         pa.FixedSizeListArray.from_arrays(pa.array(points.ravel()), d).cast(pa.list_(pa.float64()))],
                        ["id", "walk", "step", "feature", "point"])

    kind = rows.schema["id"].dataType.simpleString()
    steps = explained.repartition(4 * explained.sparkSession.sparkContext.defaultParallelism, "id") \
        .mapInArrow(walk, f"id {kind}, walk int, step int, feature int, point array<double>")
    scored = model.transform(steps.withColumn(model.getFeaturesCol(), array_to_vector("point"))) \
        .select("id", "walk", "step", "feature", vector_to_array(model.getProbabilityCol()).alias("p"))
    along = Window.partitionBy("id", "walk").orderBy("step")  # one walk: a row a feature
    change = scored.withColumn("before", F.lag("p").over(along))
    long = change.select("id", "walk", "feature", F.posexplode("p").alias("k", "p"), "before") \
        .select("id", "walk", "feature", "k", "p", (F.col("p") - F.get("before", F.col("k"))).alias("gain"))
    last = len(names)
    ends = scored.where((F.col("step") == 0) | (F.col("step") == last)).select("id", "step", F.posexplode("p").alias("k", "p")) \
        .groupBy("id", "k").agg(F.avg(F.when(F.col("step") == 0, F.col("p"))).alias("base"), F.max(F.when(F.col("step") == last, F.col("p"))).alias("probability"))
    values = long.where("feature >= 0").groupBy("id", "k", "feature").agg(F.avg("gain").alias("phi"), (F.stddev_pop("gain") / F.sqrt(F.count("gain"))).alias("stderr"))
    name = lambda v, at: F.get(F.lit(v), F.col(at))
    return values.join(ends, ["id", "k"]).select("id", name(labels, "k").alias("cls"), name(names, "feature").alias("feature"), "phi", "stderr", "base", "probability")
