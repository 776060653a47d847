"""Timelines over ordered groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import ordinal, running_sums


def timeline(df: DataFrame, group, order, duration: str, scale: float = 3600.0,
             n_blocks: int | None = None) -> DataFrame:
    """Start/end of each item on its group's clock.

    start = running sum of ``duration`` before the item, end = start +
    duration, both divided by ``scale`` (seconds to hours by default).
    """
    out = running_sums(df, group, order, {"__cum": F.coalesce(F.col(duration), F.lit(0.0))},
                       n_blocks)
    d = F.coalesce(F.col(duration), F.lit(0.0))
    return (out.withColumn("start_time", (F.col("__cum") - d) / F.lit(scale))
               .withColumn("end_time", F.col("__cum") / F.lit(scale))
               .drop("__cum"))


def segment_clock(df: DataFrame, group, order, seconds: float = 30.0, scale: float = 3600.0,
                  n_blocks: int | None = None) -> DataFrame:
    """Fixed-length slots: the n-th row of a group starts at n * seconds.

    Rows with a NULL segment (a track without segments after a left join)
    still take one slot, as in the reference.
    """
    out = ordinal(df, group, order, "__slot", start=0, n_blocks=n_blocks)
    return (out.withColumn("start_time", F.col("__slot") * F.lit(seconds) / F.lit(scale))
               .withColumn("end_time", F.col("start_time") + F.lit(seconds / scale))
               .drop("__slot"))


def phase_spans(df: DataFrame, group, phase: str, start: str = "start_time",
                end: str = "end_time") -> DataFrame:
    """First start and last end of each (group, phase)."""
    g = [group] if isinstance(group, str) else list(group)
    return df.groupBy(*g, phase).agg(F.min(start).alias("span_start"),
                                     F.max(end).alias("span_end"))


def trend(df: DataFrame, group, x: str, y: str) -> DataFrame:
    """Least-squares line of ``y`` on ``x`` per group, plus Pearson r."""
    g = [group] if isinstance(group, str) else list(group)
    return df.groupBy(*g).agg(F.regr_slope(y, x).alias("slope"),
                              F.regr_intercept(y, x).alias("intercept"),
                              F.corr(x, y).alias("r"),
                              F.regr_count(y, x).alias("n"))
