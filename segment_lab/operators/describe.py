"""Descriptive aggregations.

All of these are one or two hash aggregations with map-side partial
aggregation, so a hot group is pre-combined in every task before the shuffle.
Global constants (min/max for scaling) are scalar subqueries: Catalyst merges
them into one aggregate and inlines the result, with no cross join and no
driver round trip in user code.
"""

from __future__ import annotations

import re
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import running_sums
from .joins import salted_join


def _g(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


# --- A1-A5 -----------------------------------------------------------------

def group_describe(df: DataFrame, by, cols: list[str], digits: int | None = 2) -> DataFrame:
    """Mean and sample std per group, rounded half-even (A1).

    A single-row group has a NULL std (pandas NaN).
    """
    aggs = []
    for c in cols:
        m, s = F.avg(c), F.stddev_samp(c)
        if digits is not None:
            m, s = F.bround(m, digits), F.bround(s, digits)
        aggs += [m.alias(f"{c}_mean"), s.alias(f"{c}_std")]
    return df.groupBy(*_g(by)).agg(*aggs)


def phase_pivot(df: DataFrame, by, col: str, value: str, values: list) -> DataFrame:
    """Pivot sum with an explicit value list; empty cells are 0 (A2).

    Giving the values avoids the extra distinct job and keeps the output
    schema stable.
    """
    out = df.groupBy(*_g(by)).pivot(col, values).agg(F.sum(value))
    return out.na.fill(0, subset=[str(v) for v in values])


def phase_share(df: DataFrame, by, col: str, value: str, values: list,
                scale: float = 100.0) -> DataFrame:
    """Row-wise percentage of the pivot (A3)."""
    p = phase_pivot(df, by, col, value, values)
    names = [str(v) for v in values]
    total = sum((F.col(f"`{n}`") for n in names[1:]), F.col(f"`{names[0]}`"))
    return p.select(*_g(by), *[(F.try_divide(F.col(f"`{n}`"), total) * F.lit(scale)).alias(n)
                               for n in names])


def group_size(df: DataFrame, by) -> DataFrame:
    """Rows per group (A4)."""
    return df.groupBy(*_g(by)).agg(F.count(F.lit(1)).alias("n"))


def group_hours(df: DataFrame, by, seconds: str, scale: float = 3600.0) -> DataFrame:
    """Total duration per group in hours (A5)."""
    return df.groupBy(*_g(by)).agg((F.sum(seconds) / F.lit(scale)).alias("hours"))


# --- A6-A8, W3, J8 -----------------------------------------------------------

def tokens(df: DataFrame, by, col: str, sep: str = ",") -> DataFrame:
    """Explode a delimited string into one row per token.

    Tokens are not trimmed, empty tokens are kept, NULL strings give no rows.
    ``sep`` is a literal, not a pattern.
    """
    return df.select(*_g(by), F.explode(F.split(F.col(col), re.escape(sep))).alias("token"))


def token_counts(df: DataFrame, by, col: str, sep: str = ",") -> DataFrame:
    """Occurrences of each token per group."""
    return (tokens(df, by, col, sep).groupBy(*_g(by), "token")
            .agg(F.count(F.lit(1)).alias("n")))


def token_totals(counts: DataFrame, token: str = "token", n: str = "n") -> DataFrame:
    """Merge per-group counts into one count per token."""
    return counts.groupBy(token).agg(F.sum(n).alias("n"))


def token_sketches(df: DataFrame, by, col: str, sep: str = ",", lg_k: int = 14) -> DataFrame:
    """A mergeable HyperLogLog sketch of the tokens of each group (A8): ``(<by>, sketch)``.

    A sketch has a fixed size, is built before the shuffle, and can be stored;
    its estimate is within about ``3 * 1.04 / sqrt(2 ** lg_k)`` of the truth.
    """
    return tokens(df, by, col, sep).groupBy(*_g(by)).agg(F.hll_sketch_agg("token", lg_k).alias("sketch"))


def merged_distinct(sketches: DataFrame, by=None) -> DataFrame:
    """Distinct tokens of coarser groups (all, without ``by``) from stored sketches, without reading the rows again."""
    return sketches.groupBy(*(_g(by) if by else [])).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"))


def token_distinct(counts: DataFrame, by) -> DataFrame:
    """Distinct tokens per group, from the per-group counts.

    The counts are already one row per (group, token), so a plain count
    replaces a ``count(DISTINCT)``.
    """
    return counts.groupBy(*_g(by)).agg(F.count(F.lit(1)).alias("n_distinct"))


def topk(df: DataFrame, by, weight: str, tiebreak: list[str] | str, k: int,
         name: str = "rank") -> DataFrame:
    """Top ``k`` rows per group by ``weight`` desc, ties by ``tiebreak`` asc.

    ``row_number() <= k`` lets Spark insert a partial window-group limit
    before the shuffle, so each task sends at most k rows per group.
    ``by=None`` ranks over the whole table: the best k rows are taken first
    (every task keeps k), and only those are numbered.
    """
    order = [F.col(weight).desc()] + [F.col(t).asc() for t in _g(tiebreak)]
    if by is None:
        best = df.orderBy(*order).limit(k)
        return best.withColumn(name, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    w = Window.partitionBy(*_g(by)).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def priority_lookup(counts: DataFrame, priority: DataFrame, group: str = "group",
                    token: str = "token", rank: str = "priority") -> DataFrame:
    """For each token, the first group (by priority) that contains it.

    The priority table has one row per group; a group's tokens are dealt
    over many tasks by a salted join.
    """
    j = salted_join(counts.select(group, token), priority.select(group, rank), group)
    return j.groupBy(token).agg(F.min_by(F.col(group), F.col(rank)).alias(group))


# --- A9, A10 -----------------------------------------------------------------

def shared_items(df: DataFrame, item: str, group: str, attrs: list[str] | None = None,
                 order: list[str] | None = None, min_groups: int = 2,
                 sep: str = ", ") -> DataFrame:
    """Items present in several groups.

    ``groups`` lists the distinct groups sorted; ``attrs`` take the first
    non-null value in ``order`` (a total order).  The distinct-group set per
    item is pre-combined in every task, so a hot item never ships its rows.
    """
    aggs = [F.array_sort(F.collect_set(group)).alias("__set")]
    for a in attrs or []:
        key = F.struct(*[F.col(o) for o in (order or [])], F.col(a))
        aggs.append(F.min_by(F.col(a), F.when(F.col(a).isNotNull(), key)).alias(a))
    out = (df.groupBy(item).agg(*aggs)
             .withColumn("n_groups", F.size("__set"))
             .filter(F.col("n_groups") >= min_groups)
             .withColumn("groups", F.array_join("__set", sep))
             .drop("__set"))
    return out


def shared_histogram(shared: DataFrame, n: str = "n_groups") -> DataFrame:
    """How many items are shared by exactly n groups (A10)."""
    return shared.groupBy(n).agg(F.count(F.lit(1)).alias("n_items"))


# --- W4, A11 -----------------------------------------------------------------

def scalars(agg_df: DataFrame) -> dict[str, Column]:
    """Each column of a one-row aggregate as a scalar-subquery Column.

    All columns come from ONE subquery returning a struct; every use is the
    same subquery expression, which Spark executes once and reuses, so the
    aggregate is a single pass however many statistics it holds.
    """
    sq = agg_df.select(F.struct(*agg_df.columns).alias("__s")).scalar()
    return {c: sq.getField(c) for c in agg_df.columns}


def minmax_scale(df: DataFrame, cols: list[str], lo: float = -1.0, hi: float = 1.0,
                 suffix: str = "") -> DataFrame:
    """Min-max scale columns to [lo, hi]; a constant column maps to ``lo``."""
    aggs = []
    for c in cols:
        aggs += [F.min(c).alias(f"{c}__mn"), F.max(c).alias(f"{c}__mx")]
    s = scalars(df.agg(*aggs))
    out = df
    for c in cols:
        mn, mx = s[f"{c}__mn"], s[f"{c}__mx"]
        rng = mx - mn
        scaled = F.when(rng > 0, F.lit(lo) + (F.col(c) - mn) / rng * F.lit(hi - lo)) \
                  .otherwise(F.when(F.col(c).isNotNull(), F.lit(lo)))
        out = out.withColumn(c + suffix, scaled)
    return out


QUADRANTS = ["Q1", "Q2", "Q3", "Q4", "Total"]


def quadrant_counts(df: DataFrame, x: str, y: str, denominator: Column | int | None = None,
                    scale: float = 100.0) -> DataFrame:
    """Counts per sign quadrant plus the total, and their percentage.

    Q1: x >= 0, y >= 0; Q2: x < 0, y >= 0; Q3: both < 0; Q4: x >= 0, y < 0.
    A NULL coordinate is in no quadrant but in the total.  ``denominator``
    defaults to this table's row count; the reference divides both sources
    by the first source's count, which callers pass explicitly.
    """
    X, Y = F.col(x), F.col(y)
    agg = df.agg(
        F.count_if((X >= 0) & (Y >= 0)).alias("Q1"),
        F.count_if((X < 0) & (Y >= 0)).alias("Q2"),
        F.count_if((X < 0) & (Y < 0)).alias("Q3"),
        F.count_if((X >= 0) & (Y < 0)).alias("Q4"),
        F.count(F.lit(1)).alias("Total"))
    long = agg.select(F.explode(F.array(*[
        F.struct(F.lit(q).alias("quadrant"), F.col(q).alias("n")) for q in QUADRANTS
    ])).alias("s")).select("s.quadrant", "s.n")
    if denominator is None:
        # a window over the five-row result only
        den = F.max(F.when(F.col("quadrant") == "Total", F.col("n"))).over(Window.partitionBy(F.lit(1)))
    elif isinstance(denominator, int):
        den = F.lit(denominator)
    else:
        den = denominator
    return long.withColumn("pct", F.col("n") / den * F.lit(scale))


# --- A13, A14 ------------------------------------------------------------------

def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pairwise-complete Pearson correlation of every pair (A13), long form.

    One aggregate computes all pairs; rows where either value is NULL are
    skipped per pair.
    """
    pairs = list(combinations(cols, 2))
    agg = df.agg(*[F.corr(a, b).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    return agg.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2"), F.col(f"p{i}").alias("r"))
        for i, (a, b) in enumerate(pairs)])).alias("s")).select("s.f1", "s.f2", "s.r")


def group_profile(df: DataFrame, by, cols: list[str]) -> DataFrame:
    """Group means, min-max normalised across groups (A14); 0/0 gives NULL."""
    means = df.groupBy(*_g(by)).agg(*[F.avg(c).alias(c) for c in cols])
    aggs = []
    for c in cols:
        aggs += [F.min(c).alias(f"{c}__mn"), F.max(c).alias(f"{c}__mx")]
    s = scalars(means.agg(*aggs))
    return means.select(*_g(by), *[
        ((F.col(c) - s[f"{c}__mn"]) / F.nullif(s[f"{c}__mx"] - s[f"{c}__mn"], F.lit(0.0))).alias(c)
        for c in cols])


# --- A15, A16, A19 -------------------------------------------------------------

def class_distribution(df: DataFrame, col: str) -> DataFrame:
    """Rows per class."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def mode(df: DataFrame, col: str, by=None) -> DataFrame:
    """Most frequent value (per group), ties broken by the value ascending.

    Returns ``(by..., col, n, share)`` where share = n / group size.
    """
    keys = _g(by) if by is not None else []
    counts = df.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("n"))
    if not keys:
        tot = scalars(counts.agg(F.sum("n").alias("t")))["t"]
        return (counts.orderBy(F.col("n").desc(), F.col(col).asc()).limit(1)
                .withColumn("share", F.col("n") / tot))
    # Per-group winner from the (group, value) count table: the smallest
    # (-n, value) pair is the most frequent value, ties to the lowest value.
    best = counts.groupBy(*keys).agg(
        F.min(F.struct((F.lit(0) - F.col("n")).alias("neg"), F.col(col).alias("v"))).alias("b"),
        F.sum("n").alias("__tot"))
    return best.select(*keys, F.col("b.v").alias(col), (F.lit(0) - F.col("b.neg")).alias("n"),
                       ((F.lit(0) - F.col("b.neg")) / F.col("__tot")).alias("share"))


def distinct_labels(df: DataFrame, col: str) -> DataFrame:
    """Distinct values of a column."""
    return df.select(col).distinct()


# --- A17 -------------------------------------------------------------------------

def group_quantiles(df: DataFrame, by, cols: list[str], qs=(0.25, 0.5, 0.75),
                    exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """Quantiles per (group, feature) with linear interpolation, plus min/max.

    ``exact=True`` ranks values with the skew-safe ordinal scan and picks the
    two neighbours of each quantile position, so no group is ever held in
    memory; ``exact=False`` uses ``percentile_approx`` sketches.
    Output: ``(by..., feature, q, value)`` with q = 0 and 1 for min and max.
    """
    keys = _g(by)
    long = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in cols
    ])).alias("s")).select(*keys, "s.feature", "s.v").filter(F.col("v").isNotNull())
    qlist = [0.0] + [float(q) for q in qs] + [1.0]
    if not exact:
        agg = long.groupBy(*keys, "feature").agg(
            F.percentile_approx("v", qlist, accuracy).alias("vals"))
        return agg.select(*keys, "feature", F.explode(F.arrays_zip(
            F.array(*[F.lit(q) for q in qlist]).alias("q"), F.col("vals").alias("value"))).alias("z")) \
                  .select(*keys, "feature", F.col("z.q").alias("q"), F.col("z.value").alias("value"))
    # exact: count equal values first, then find the values whose running count
    # covers a target rank.  A row of counts meets only the few targets of its
    # own group and feature, so nothing but the counts is ever shuffled.
    counts = long.groupBy(*keys, "feature", "v").agg(F.count(F.lit(1)).alias("n"))
    ranked = running_sums(counts, [*keys, "feature"], ["v"], {"upto": F.col("n")})
    sizes = counts.groupBy(*keys, "feature").agg(F.sum("n").alias("cnt"))
    known = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    named = sizes.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("feature").alias("__feature"), "cnt")
    on = F.col("feature") == F.col("__feature")
    for c in known:
        on = on & c
    pos = F.lit(0.0) + F.col("q") * (F.col("cnt") - 1)
    hit = ranked.join(named, on).select(*keys, "feature", "v", "n", "upto", "cnt",
                                        F.explode(F.array(*[F.lit(q) for q in qlist])).alias("q")) \
        .withColumn("pos", pos) \
        .filter((F.floor("pos") < F.col("upto")) & (F.ceil("pos") >= F.col("upto") - F.col("n")))
    out = hit.groupBy(*keys, "feature", "q").agg(F.min("v").alias("v_lo"), F.max("v").alias("v_hi"), F.first("pos").alias("pos"))
    return out.select(*keys, "feature", "q",
                      (F.col("v_lo") + (F.col("pos") - F.floor("pos")) * (F.col("v_hi") - F.col("v_lo"))).alias("value"))


def group_density(df: DataFrame, by, col: str, points: int = 100) -> DataFrame:
    """Gaussian kernel density on an even grid per group (A17, violin data).

    Bandwidth is Scott's rule, h = std * n^(-1/5); the grid spans the group's
    [min, max] in ``points`` steps.  Rows are first counted per (group,
    value): a hot group then holds its distinct values only, dealt over many
    tasks, and each adds to every grid point inside its own task, so only
    groups x points partial sums are shuffled.
    """
    keys = _g(by)
    base = df.select(*keys, F.col(col).cast("double").alias("v")).filter(F.col("v").isNotNull())
    st = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("v").alias("sd"),
                                 F.min("v").alias("mn"), F.max("v").alias("mx"))
    st = st.withColumn("h", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))) \
           .filter(F.col("h") > 0)
    grid = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")
    values = base.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("times"))
    key = F.to_json(F.struct(*keys))
    j = salted_join(values.withColumn("__key", key), st.withColumn("__key", key).drop(*keys), "__key") \
        .select(*keys, "v", "times", "n", "h", "mn", "mx", grid)
    x = F.col("mn") + (F.col("mx") - F.col("mn")) * F.col("i") / F.lit(points - 1)
    z = (x - F.col("v")) / F.col("h")
    k = F.exp(F.lit(-0.5) * z * z) / (F.col("n") * F.col("h") * F.lit((2 * 3.141592653589793) ** 0.5))
    return (j.groupBy(*keys, "i", "mn", "mx").agg(F.sum(k * F.col("times")).alias("density"))
             .select(*keys, "i", x.alias("x"), "density"))
