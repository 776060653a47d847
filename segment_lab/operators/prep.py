"""Feature preparation.

Global statistics are scalar subqueries (no cross join); per-class ranking
uses the skew-safe ordinal scan, so a dominant class is still split over
many tasks.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.randomness import seeded_hash
from .describe import scalars
from .joins import salted_join
from .ordered import ordinal


def zscore(df: DataFrame, cols: list[str], ddof: int = 0, suffix: str = "") -> DataFrame:
    """(x - mean) / std with population std by default (ddof=0) (F1).

    A constant column maps to 0 (its scale is taken as 1).
    """
    std = F.stddev_pop if ddof == 0 else F.stddev_samp
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__m"), std(c).alias(f"{c}__s")]
    s = scalars(df.agg(*aggs))
    out = df
    for c in cols:
        sd = s[f"{c}__s"]
        scale = F.when(sd > 0, sd).otherwise(F.lit(1.0))
        out = out.withColumn(c + suffix, (F.col(c) - s[f"{c}__m"]) / scale)
    return out


def mixed_pipeline(numeric: list[str], categorical: list[str], out: str = "features") -> Pipeline:
    """Numeric scaling + one-hot of categoricals, unknown -> all zeros.

    Categories are indexed alphabetically (booleans by their text).  Indexer
    and encoder keep a last slot for values not seen in the fit; it is sliced
    off, so an unseen or missing category is all zeros.
    """
    stages = []
    parts = []
    if numeric:
        stages.append(VectorAssembler(inputCols=numeric, outputCol="__num", handleInvalid="keep"))
        stages.append(StandardScaler(inputCol="__num", outputCol="__num_s", withMean=True, withStd=True))
        parts.append("__num_s")
    for c in categorical:
        stages.append(SQLTransformer(statement=f"SELECT *, CAST(`{c}` AS STRING) AS `{c}__str` FROM __THIS__"))
        stages.append(StringIndexer(inputCol=f"{c}__str", outputCol=f"{c}__idx", handleInvalid="keep",
                                    stringOrderType="alphabetAsc"))
        # the indexer's own extra index is the encoder's last category, which dropLast leaves without a slot
        stages.append(OneHotEncoder(inputCol=f"{c}__idx", outputCol=f"{c}__oh", dropLast=True, handleInvalid="error"))
        parts.append(f"{c}__oh")
    stages.append(VectorAssembler(inputCols=parts, outputCol=out))
    return Pipeline(stages=stages)


def one_hot_long(train: DataFrame, apply: DataFrame, id_col: str, cols: list[str]) -> DataFrame:
    """One-hot in long form: (id, feature, slot) with slot = alphabetical
    category index learned on ``train``; NULL for a value unseen in training
    (all-zero encoding) (F2)."""
    out = None
    for c in cols:
        cats = train.select(F.col(c).alias("v")).distinct().filter(F.col("v").isNotNull())
        # slot = number of training categories sorted before v (a small table)
        ranked = ordinal(cats.withColumn("__g", F.lit(0)), "__g", ["v"], "slot").drop("__g")
        # a category may hold most rows: they meet its slot in many tasks
        part = (salted_join(apply.select(F.col(id_col).alias("id"), F.col(c).alias("v")), ranked, "v", "left")
                .select("id", F.lit(c).alias("feature"), F.col("slot").cast("int").alias("slot")))
        out = part if out is None else out.unionByName(part)
    return out


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (k * n_c) per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    s = scalars(counts.agg(F.sum("n_c").alias("n"), F.count(F.lit(1)).alias("k")))
    return counts.select(label, "n_c", (s["n"] / (s["k"] * F.col("n_c"))).alias("weight"))


def with_class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Attach the balanced weight of each row's class.

    A class may hold most rows: they meet their weight in many tasks.
    """
    w = class_weights(df, label).select(F.col(label).alias("__class"), F.col("weight").alias(out))
    return salted_join(df.withColumn("__class", F.col(label)), w, "__class").drop("__class")


def undersample(df: DataFrame, label: str, id_col: str, seed: int = 1987) -> DataFrame:
    """Random under-sampling of every class to the smallest class size.

    Rows are ranked inside their class by md5(seed:id) (skew-safe scan); the
    first n_min of each class are kept.  Deterministic on retries.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    n_min = counts.agg(F.min("n_c").alias("m")).select("m").scalar()
    h = df.withColumn("__h", seeded_hash(seed, id_col))
    r = ordinal(h, label, ["__h", id_col], "__rk", start=0)
    return r.filter(F.col("__rk") < n_min).drop("__h", "__rk")


def relabel_noise(df: DataFrame, pred: str, noise=-1) -> DataFrame:
    """Noise points (pred == -1) join the largest cluster; ties to the lowest id."""
    counts = df.filter(F.col(pred) != noise).groupBy(pred).agg(F.count(F.lit(1)).alias("n"))
    best = counts.orderBy(F.col("n").desc(), F.col(pred).asc()).limit(1).select(pred).scalar()
    return df.withColumn(pred, F.when(F.col(pred) == noise, best).otherwise(F.col(pred)))
