"""Joins between tracks, ratings, segments and catalogs.

Strategy is left to Catalyst/AQE: broadcast when the runtime size of a side
is under the threshold, sort-merge otherwise; AQE splits skewed partitions
of sort-merge joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _g(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def semi_join(df: DataFrame, members: DataFrame, key, member_key=None) -> DataFrame:
    """Rows of ``df`` whose key is in ``members`` (J1, ``isin`` on a table)."""
    keys = _g(key)
    mk = keys if member_key is None else _g(member_key)
    m = members.select([F.col(a).alias(b) for a, b in zip(mk, keys)])
    return df.join(m, on=keys, how="left_semi")


def rating_join(left: DataFrame, right: DataFrame, keys, values: list[str],
                suffixes=("_df", "_emo"), offset: int = 0, offset_key: str | None = None,
                right_values: list[str] | None = None) -> DataFrame:
    """Inner equi join of two rating sources, both sides suffixed.

    ``offset`` is added to ``offset_key`` (default: the last key) on the
    right side before matching, the reference's ``# += 1``.
    """
    keys = _g(keys)
    ok = offset_key or keys[-1]
    rv = right_values or values
    r = right.select(*[(F.col(k) + F.lit(offset)).alias(k) if (k == ok and offset) else F.col(k)
                       for k in keys],
                     *[F.col(v).alias(v + suffixes[1]) for v in rv])
    l = left.select(*keys, *[c for c in left.columns if c not in keys and c not in values],
                    *[F.col(v).alias(v + suffixes[0]) for v in values])
    return l.join(r, on=keys, how="inner")


def phase_lookup(ratings: DataFrame, tracks: DataFrame, keys, fetch: list[str],
                 offset: int = 0, offset_key: str | None = None) -> DataFrame:
    """Left join that fetches columns (e.g. ``phase``) from tracks.

    No offset by default: the reference matches without the +1 of J2.
    """
    keys = _g(keys)
    ok = offset_key or keys[0]
    t = tracks.select(*[(F.col(k) + F.lit(offset)).alias(k) if (k == ok and offset) else F.col(k)
                        for k in keys], *fetch)
    return ratings.join(t, on=keys, how="left")


def track_segment_join(tracks: DataFrame, segments: DataFrame, track_key: str,
                       segment_key: str) -> DataFrame:
    """Left join, one track to many segments.

    A track without segments keeps one row with NULL segment columns.
    """
    s = segments.withColumnRenamed(segment_key, "__seg_key")
    j = tracks.join(s, tracks[track_key] == s["__seg_key"], "left")
    return j.drop("__seg_key")


def salted_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner", salts: int | None = None) -> DataFrame:
    """Equi-join whose ``big`` side may hold most of its rows under one key.

    Every row of ``small`` (unique keys, a row per class, group or category)
    is repeated once per salt, and a big row picks its salt by a hash of its
    own values, so one key's rows meet their partner in ``salts`` places.
    """
    n = salts or int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = F.pmod(F.xxhash64(*big.columns), F.lit(n)).cast("int")
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return big.withColumn("__salt", own).join(copies, [key, "__salt"], how).drop("__salt")
