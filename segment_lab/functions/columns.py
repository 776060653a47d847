"""Projections, filters and scalar column helpers.

All of these are plain Catalyst expressions: they stay inside whole-stage
codegen and filters reach the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType)


def flag_filter(df: DataFrame, flag: str, value: bool = True) -> DataFrame:
    """Keep rows whose boolean ``flag`` equals ``value`` (P1); NULL is dropped."""
    return df.filter(F.col(flag) == F.lit(value))


def select_group(df: DataFrame, col: str, which: str, exclude: str | None = None) -> DataFrame:
    """Group selector (P2): ``all``, ``most`` (all but ``exclude``) or one name."""
    if which == "all":
        return df
    if which == "most":
        if exclude is None:
            raise ValueError("which='most' needs the excluded group name")
        return df.filter(F.col(col) != F.lit(exclude))
    return df.filter(F.col(col) == F.lit(which))


def feature_columns(df: DataFrame, exclude=(), suffix: str | None = None) -> list[str]:
    """Feature names from the schema (P3): numeric, not excluded, optional suffix."""
    ex = set(exclude)
    out = [f.name for f in df.schema.fields
           if f.name not in ex and isinstance(f.dataType, NUMERIC)]
    if suffix:
        out = [c for c in out if c.endswith(suffix)]
    return out


def split_types(df: DataFrame, cols: list[str]) -> tuple[list[str], list[str]]:
    """Split columns into numeric and categorical by type.

    Integers and floating point are numeric; strings and booleans are
    categorical; other types are dropped.
    """
    num, cat = [], []
    for c in cols:
        t = df.schema[c].dataType
        if isinstance(t, (T.IntegerType, T.LongType, T.ShortType, T.ByteType,
                          T.FloatType, T.DoubleType)):
            num.append(c)
        elif isinstance(t, (T.StringType, T.BooleanType)):
            cat.append(c)
    return num, cat


def path_keys(df: DataFrame, path_col: str, group_part: int = 6, name_sep: str = "-",
              prefix: str = "") -> DataFrame:
    """Parse keys embedded in a path (P5), no UDF.

    ``group`` is the ``group_part``-th ``/`` piece (0-based), ``order`` the
    integer before the first ``name_sep`` (a regex) of the file name,
    ``item_id`` the second piece of the file name.  Malformed pieces give NULL.
    """
    parts = F.split(F.col(path_col), "/")
    fname = F.element_at(parts, -1)
    pieces = F.split(fname, name_sep)
    return df.select(
        "*",
        F.try_element_at(parts, F.lit(group_part + 1)).alias(prefix + "group"),
        F.try_element_at(pieces, F.lit(1)).try_cast("int").alias(prefix + "order"),
        F.try_element_at(pieces, F.lit(2)).alias(prefix + "item_id"),
    )


def path_rewrite(df: DataFrame, col: str, old: str, new: str, out: str | None = None) -> DataFrame:
    """Replace every occurrence of ``old`` by ``new`` in a path column."""
    return df.withColumn(out or col, F.replace(F.col(col), F.lit(old), F.lit(new)))


def hour_label(col: str | Column, compat: bool = False) -> Column:
    """Decimal hours to ``h:mm`` text.

    Minutes are rounded half-even.  ``compat=True`` keeps the reference's
    behaviour of printing ``h:60`` when the minutes round up to 60; the
    default carries the hour instead.
    """
    x = F.col(col) if isinstance(col, str) else col
    h = F.floor(x)
    m = F.bround((x - h) * 60, 0).cast("long")
    if compat:
        return F.format_string("%d:%02d", h.cast("long"), m)
    total = h.cast("long") * 60 + m
    return F.format_string("%d:%02d", F.floor(total / 60).cast("long"), F.pmod(total, F.lit(60)))


def drop_nulls(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Drop rows with a NULL in any column, or in ``cols`` only."""
    return df.na.drop(how="any", subset=cols)


def rescale(df: DataFrame, cols: list[str], divisor: float) -> DataFrame:
    """Divide a set of columns by a constant (P6), e.g. percent to fraction."""
    s = set(cols)
    return df.select([(F.col(c) / F.lit(float(divisor))).alias(c) if c in s else F.col(c)
                      for c in df.columns])
