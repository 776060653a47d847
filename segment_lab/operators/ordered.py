"""Skew-safe running sums and ordinals within ordered groups.

A plain ``Window.partitionBy(group).orderBy(order)`` sends every row of a group
to one task; one hot group holding a third of the rows would then be sorted
and scanned by a single task.  Instead:

1. a seeded sample of the order columns, of a size set by ``n`` alone, gives cut
   points that split all rows into about ``n`` equal blocks, and a block number
   becomes an expression of a row's own values (the same row always gets the
   same block);
2. running sums are taken inside each ``(group, block)`` by a window, the only
   exchange of the rows;
3. the sums of each ``(group, block)`` (aggregated before their shuffle) give
   what the group holds in earlier blocks, and are added.

``order`` must be a total order inside a group (callers add a tie-breaker).
Rows with a NULL group form one group of their own; NULL order values come
first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Leading bytes of a text that its block depends on (exact in a double).
PREFIX_BYTES = 6
#: Sampled rows a block, from which cut points are taken: blocks differ by about a sixth of their size.
SAMPLE_ROWS = 40
SEED = 11


def _names(x) -> list[str]:
    if x is None:
        return []
    return [x] if isinstance(x, str) else list(x)


def _rank_value(df: DataFrame, col: str) -> Column:
    """A double that never decreases along the order of ``col``."""
    kind, c = df.schema[col].dataType, F.col(col)
    if isinstance(kind, T.StringType):
        head = F.rpad(F.hex(F.substring(F.encode(c, "UTF-8"), 1, PREFIX_BYTES)), 2 * PREFIX_BYTES, "0")
        return F.conv(head, 16, 10).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return c.cast("timestamp").cast("double")
    return c.cast("double")


def sample_values(df: DataFrame, cols: list[Column], n: int) -> list[tuple]:
    """The values of ``cols`` in about ``SAMPLE_ROWS`` rows a block, drawn row by row.

    Its size depends on the number of blocks only, never on the rows or on
    how often a value occurs, and no task reads more than its own part of
    ``df``.  What is made of it are literals, so a task that runs again sees
    the same ones.
    """
    total, bound = df.count(), SAMPLE_ROWS * n
    picked = df.select(*[c.alias(f"v{k}") for k, c in enumerate(cols)])
    if total > bound:
        picked = picked.sample(fraction=bound / total, seed=SEED)
    return [tuple(r) for r in picked.collect()]  # about ``bound`` rows


def cut_points(values: list, n: int) -> list:
    """At most ``n - 1`` values that split the sampled ones (nulls left out) into ``n`` parts, ascending."""
    known = sorted(v for v in values if v is not None)
    if not known or n < 2:
        return []
    return sorted({known[(k * len(known)) // n] for k in range(1, n)})


def _cuts(df: DataFrame, order: list[str], n: int) -> list[tuple[float, float]]:
    """At most ``n - 1`` cut points (first, second order value), ascending.

    They are values of a seeded sample; a first value that many rows share
    is cut again by the second column, as the sample is ordered by both.
    """
    if n < 2:
        return []
    low = F.lit(float("-inf"))
    keys = [F.nanvl(F.coalesce(_rank_value(df, c), low), F.lit(float("inf"))) for c in order[:2]]
    return cut_points(sample_values(df, keys + [low] * (2 - len(keys)), n), n)


def block(df: DataFrame, order: list[str], n: int) -> Column:
    """Number of cut points at or before a row: a binary search among them."""
    return _block_of(df, order, _cuts(df, order, n))


def _block_of(df: DataFrame, order: list[str], cuts: list[tuple[float, float]]) -> Column:
    if not cuts:
        return F.lit(0)

    def literal(values):
        return F.lit([float(v) for v in values])
    a, b = literal(c[0] for c in cuts), literal(c[1] for c in cuts)
    x = F.coalesce(_rank_value(df, order[0]), F.lit(float("-inf")))
    y = F.coalesce(_rank_value(df, order[1]), F.lit(float("-inf"))) if len(order) > 1 else F.lit(float("-inf"))
    steps = F.array(*[F.lit(1 << k) for k in range(len(cuts).bit_length() - 1, -1, -1)])

    def further(at, step):
        ca, cb = F.get(a, at + step - 1), F.get(b, at + step - 1)
        return F.when((at + step <= len(cuts)) & ((ca < x) | ((ca == x) & (cb <= y))), at + step).otherwise(at)
    return F.aggregate(steps, F.lit(0), further)


def _group_key(df: DataFrame, col: str) -> Column:
    """The group as a text that is never NULL, so NULL rows meet in joins."""
    c = F.col(col)
    if isinstance(df.schema[col].dataType, (T.FloatType, T.DoubleType)):
        c = c + F.lit(0.0)  # -0.0 and 0.0 are one group
    return F.coalesce(c.cast("string"), F.lit("\x00null"))


def running_sums(df: DataFrame, group, order, values: dict[str, Column],
                 n_blocks: int | None = None) -> DataFrame:
    """Add inclusive running sums ``{name: expr}`` within ``group`` ordered by ``order``.

    ``values`` maps output names to numeric column expressions.  The result
    keeps every input column plus one column per entry.
    """
    group, order = _names(group), _names(order)
    n = n_blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tmp = {name: f"__v_{i}" for i, name in enumerate(values)}
    cuts = _cuts(df, order, n)
    keys = [f"__g_{i}" for i in range(len(group))] + ["__blk"]
    base = df.select("*", *[expr.alias(tmp[name]) for name, expr in values.items()],
                     *[_group_key(df, g).alias(k) for g, k in zip(group, keys)], _block_of(df, order, cuts).alias("__blk"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = base.select("*", *[F.sum(t).over(inside).alias(t + "_loc") for t in tmp.values()])
    if not cuts:  # one block: nothing lies before it
        return local.select(*[F.col(c) for c in df.columns], *[F.col(t + "_loc").alias(name) for name, t in tmp.items()])
    totals = base.groupBy(*keys).agg(*[F.sum(t).alias(t + "_tot") for t in tmp.values()])
    earlier = Window.partitionBy(*keys[:-1]).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, *[F.sum(t + "_tot").over(earlier).alias(t + "_off") for t in tmp.values()])
    joined = local.join(offsets, keys, "left")
    out = [F.col(c) for c in df.columns]
    out += [(F.col(t + "_loc") + F.coalesce(F.col(t + "_off"), F.lit(0))).alias(name) for name, t in tmp.items()]
    return joined.select(*out)


def ordinal(df: DataFrame, group, order, name: str = "idx", start: int = 0,
            n_blocks: int | None = None) -> DataFrame:
    """0-based (or ``start``-based) position of each row inside its ordered group."""
    out = running_sums(df, group, order, {name: F.lit(1).cast("long")}, n_blocks)
    if start != 1:
        out = out.withColumn(name, F.col(name) + F.lit(start - 1))
    return out
