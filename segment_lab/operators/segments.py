"""Segmentation of long-form signals and texts.

The signal is a long table ``(file, idx, [channel,] value)``; a segment is
``idx div size``.  Every grouping key includes the segment number, so a long
file is spread over many tasks, and the windows used for deltas are bounded
by the segment length.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def downmix(samples: DataFrame, file: str = "file", idx: str = "idx",
            value: str = "value") -> DataFrame:
    """Average all channels of a sample (G1)."""
    return samples.groupBy(file, idx).agg(F.avg(value).alias(value))


def downsample(samples: DataFrame, rate: int, target: int, file: str = "file",
               idx: str = "idx", value: str = "value") -> DataFrame:
    """Reduce the rate by averaging bins of rate/target samples."""
    b = F.floor(F.col(idx) * F.lit(target) / F.lit(rate)).cast("long")
    return samples.groupBy(file, b.alias(idx)).agg(F.avg(value).alias(value))


def segments(samples: DataFrame, size: int, file: str = "file", idx: str = "idx") -> DataFrame:
    """Cut into non-overlapping segments of ``size`` samples; drop the tail.

    Adds ``chunk`` and keeps only chunks with exactly ``size`` samples.
    """
    s = samples.withColumn("chunk", F.floor(F.col(idx) / F.lit(size)).cast("int"))
    w = Window.partitionBy(file, "chunk")
    return (s.withColumn("__n", F.count(F.lit(1)).over(w))
             .filter(F.col("__n") == size).drop("__n"))


def segment_features(segs: DataFrame, file: str = "file", idx: str = "idx",
                     value: str = "value") -> DataFrame:
    """Per-segment descriptors (G4, G5, A18), one wide row per (file, chunk).

    mean, sample std, RMS energy, peak |x|, zero-crossing rate (share of
    adjacent pairs changing sign) and mean |delta|.
    """
    w = Window.partitionBy(file, "chunk").orderBy(idx)
    v = F.col(value)
    d = segs.withColumn("__prev", F.lag(value).over(w))
    cross = F.when(F.col("__prev").isNotNull(),
                   F.when(F.signum(v) * F.signum(F.col("__prev")) < 0, 1.0).otherwise(0.0))
    return d.groupBy(file, "chunk").agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.sqrt(F.avg(v * v)).alias("rms"),
        F.max(F.abs(v)).alias("peak"),
        F.avg(cross).alias("zcr"),
        F.avg(F.abs(v - F.col("__prev"))).alias("mean_abs_delta"))


def text_segments(docs: DataFrame, key: str, text: str, size: int = 30,
                  sep: str = " ", keep: list[str] | None = None) -> DataFrame:
    """Cut whole texts into segments of ``size`` words; drop the short tail.

    One row per (key, chunk) with word-level descriptors.  A document is one
    row, so the cut and the descriptors are array expressions evaluated in
    the task that reads it: no shuffle, whatever the corpus size.
    """
    keep = keep or []
    words = F.split(F.col(text), re.escape(sep))
    base = docs.select(key, *keep, words.alias("__w"))
    n_full = F.floor(F.size("__w") / F.lit(size)).cast("int")
    # Slice each text once into an array of segments (linear in its length),
    # then explode that array: a row carries only its own segment.  The outer
    # form keeps the optimizer from copying the slicing into an inferred
    # ``size(...) > 0`` filter; texts shorter than one segment give a NULL
    # chunk, dropped right after.
    cut = F.when(n_full > 0, F.transform(F.sequence(F.lit(0), n_full - 1),
                                         lambda i: F.slice("__w", i * size + 1, size)))
    seg = (base.select(key, *keep, F.posexplode_outer(cut).alias("chunk", "w"))
               .filter(F.col("chunk").isNotNull()))
    lens = F.transform("w", lambda x: F.length(x).cast("double"))
    seg = seg.select(key, *keep, "chunk", F.size("w").cast("long").alias("n_words"), lens.alias("__l"),
                     F.length(F.array_join("w", "")).cast("double").alias("n_chars"),
                     (F.length(F.array_join("w", "")) - F.length(F.translate(F.array_join("w", ""), "0123456789", "")))
                     .cast("double").alias("__d"),
                     F.size(F.array_distinct("w")).alias("__u"))
    mean = F.col("n_chars") / F.col("n_words")
    var = F.try_divide(F.aggregate("__l", F.lit(0.0), lambda a, x: a + (x - F.col("__m")) * (x - F.col("__m"))),
                       (F.col("n_words") - 1).cast("double"))
    return seg.withColumn("__m", mean).select(
        key, *keep, "chunk", "n_words", F.col("__m").alias("mean_word_len"),
        F.sqrt(var).alias("std_word_len"), "n_chars",
        F.try_divide(F.col("__d"), F.col("n_chars")).alias("digit_share"),
        (F.col("__u") / F.col("n_words")).alias("unique_ratio"))


def song_means(segs: DataFrame, features: list[str], key: str = "file",
               labels: list[str] | None = None) -> DataFrame:
    """Segment table to one row per item: mean of every feature.

    Label columns take the first non-null value in chunk order.
    """
    aggs = [F.avg(c).alias(c) for c in features]
    for lab in labels or []:
        aggs.append(F.min_by(lab, F.when(F.col(lab).isNotNull(), F.col("chunk"))).alias(lab))
    aggs.append(F.count(F.lit(1)).alias("n_segments"))
    return segs.groupBy(key).agg(*aggs)
