"""Cross-validation fold assignment (L1, L2).

Folds are columns computed from a seeded hash, so they are stable across
retries and engines.  Per-class ranks come from the skew-safe ordinal scan.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.randomness import seeded_hash
from ..functions.sizing import checked_collect
from ..session import materialize
from .ordered import _group_key, ordinal

#: Different class-count vectors that one task deals to folds.
DEAL_BLOCK = 4096
#: Groups of one vector that meet its folds in one place.
RANKS_TOGETHER = 1 << 20
#: Values (folds x classes x blocks) that the driver matches to folds.
MAX_LOAD_CELLS = 20_000_000


def stratified_folds(df: DataFrame, label: str, id_col: str, k: int = 5, seed: int = 1987,
                     out: str = "fold") -> DataFrame:
    """Stratified k-fold: inside each class, rows in md5(seed:id) order are
    dealt round-robin to folds 0..k-1 (L1)."""
    h = df.withColumn("__h", seeded_hash(seed, id_col))
    r = ordinal(h, label, ["__h", id_col], "__rk", start=0)
    return r.withColumn(out, (F.col("__rk") % k).cast("int")).drop("__h", "__rk")


def group_folds(df: DataFrame, label: str, group: str, k: int = 5, seed: int = 1987,
                out: str = "fold") -> DataFrame:
    """Stratified group k-fold: all rows of a group share a fold (L2).

    Groups are summarised (size, dominant class), ranked inside their
    dominant class by size (desc) then md5(seed:group), and dealt to folds in
    serpentine order (0..k-1, k-1..0, ...) so large groups spread evenly.
    The fold table (one row per group) is joined back.
    """
    g = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    best = g.groupBy(group).agg(
        F.min(F.struct((F.lit(0) - F.col("n")).alias("neg"), F.col(label).alias("lab"))).alias("b"),
        F.sum("n").alias("size"))
    gs = best.select(group, F.col("b.lab").alias("__cls"), "size",
                     (F.lit(0) - F.col("size")).alias("__negsize"), seeded_hash(seed, group).alias("__h"))
    r = ordinal(gs, "__cls", ["__negsize", "__h", group], "__rk", start=0)
    pos = F.col("__rk") % (2 * k)
    fold = F.when(pos < k, pos).otherwise(2 * k - 1 - pos).cast("int")
    ft = r.select(group, fold.alias(out))
    return df.join(ft, group)


def _spread(loads: np.ndarray, totals: np.ndarray) -> float:
    """How unevenly the folds (rows of ``loads``) share the classes: mean over classes of the deviation between folds."""
    return round(float(np.std(loads / totals, axis=0).mean()), 10)


def _least_spread(loads: np.ndarray, added: np.ndarray, totals: np.ndarray, free) -> int:
    """The fold among ``free`` that leaves the least spread with ``added``; ties go to the emptier, then the lower fold."""
    def cost(f):
        after = loads.copy()
        after[f] += added
        return _spread(after, totals), loads[f].sum(), f
    return min(free, key=cost)


def _parse(key: str, n_classes: int) -> np.ndarray:
    v = np.zeros(n_classes)
    for part in key.split(","):
        c, n = part.split(":")
        v[int(c)] = int(n)
    return v


def _deal(keys: list[str], copies: list[int], totals: np.ndarray, k: int):
    """Folds of the copies of each vector beyond a multiple of ``k``, and the load of each fold."""
    loads, extra = np.zeros((k, len(totals))), []
    for key, m in zip(keys, copies):
        v = _parse(key, len(totals))
        loads += v * (m // k)
        got = []
        for _ in range(m % k):
            f = _least_spread(loads, v, totals, range(k))
            loads[f] += v
            got.append(f)
        extra.append(got)
    return extra, loads


def _match_blocks(block_loads: list[np.ndarray], totals: np.ndarray, k: int) -> list[list[int]]:
    """Fold of every block's own folds: the largest first, each where it leaves the least spread."""
    loads, out = np.zeros((k, len(totals))), []
    for own in block_loads:
        names, free = [0] * k, set(range(k))
        for f in sorted(range(k), key=lambda f: (-own[f].sum(), f)):
            names[f] = _least_spread(loads, own[f], totals, sorted(free)) if out else f
            free.remove(names[f])
            loads[names[f]] += own[f]
        out.append(names)
    return out


def balanced_group_folds(df: DataFrame, label: str, group: str, k: int = 5, seed: int = 1987, out: str = "fold",
                         block: int = DEAL_BLOCK) -> DataFrame:
    """Stratified group k-fold by greedy balance (L2): a group stays whole, and folds share every class evenly.

    Groups with equal class counts are interchangeable, so the deal runs over
    the histogram of class-count vectors, most uneven vector first (ties by
    the vector's text).  Each fold gets as many copies of a vector as all can
    have; the others go one by one where they leave the least spread.  Blocks
    of ``block`` vectors are dealt by a task each; the folds of a block are
    then matched to those before it, largest first, by the same rule.  Inside
    a vector, groups take their places in md5(seed:group) order.

    All columns are kept.  NULL is a group of its own and a class of its own;
    fewer groups than folds leave folds empty; an empty table gives an empty
    one.  A hot group meets its fold by broadcast (groups over a thousandth
    of the rows, fewer than 1000).
    """
    spark = df.sparkSession
    keyed = df.select(_group_key(df, group).alias("__g"), _group_key(df, label).alias("__c"))
    counts = materialize(keyed.groupBy("__g", "__c").agg(F.count(F.lit(1)).alias("n")))
    classes = sorted((r[0], r[1]) for r in checked_collect(
        counts.groupBy("__c").agg(F.sum("n")), MAX_LOAD_CELLS // (2 * k), "classes of a fold assignment", 2))
    if not classes:
        return df.withColumn(out, F.lit(0))
    totals = np.array([n for _, n in classes], float)
    slots = spark.createDataFrame([(c, i) for i, (c, _) in enumerate(classes)], "__c string, __i int")
    # one row per class: bounded by the check above
    vec = F.array_sort(F.collect_list(F.struct("__i", "n")))
    groups = counts.join(F.broadcast(slots), "__c").groupBy("__g").agg(vec.alias("vec"), F.sum("n").alias("__size"))
    squares = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x["n"].cast("double") * x["n"])
    groups = materialize(groups.select(
        "__g", "__size", seeded_hash(seed, "__g").alias("__h"),
        (F.col("__size").cast("double") * F.col("__size") - len(classes) * squares).alias("__even"),
        F.array_join(F.transform("vec", lambda x: F.concat_ws(":", x["__i"], x["n"])), ",").alias("__key")))
    vectors = groups.groupBy("__key").agg(F.count(F.lit(1)).alias("__m"), F.first("__even").alias("__even"))
    placed = ordinal(vectors, [], ["__even", "__key"], "__pos", start=0) \
        .withColumn("__block", F.floor(F.col("__pos") / block).cast("long"))

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__pos")
        extra, loads = _deal(rows["__key"].tolist(), rows["__m"].tolist(), totals, k)
        own = pd.DataFrame({"__block": rows["__block"], "__key": rows["__key"], "__m": rows["__m"], "extra": extra, "loads": None})
        whole = pd.DataFrame({"__block": [int(rows["__block"].iloc[0])], "__key": [None], "__m": [0], "extra": [None],
                              "loads": [loads.ravel().tolist()]})
        return pd.concat([own, whole], ignore_index=True)

    dealt = materialize(placed.groupBy("__block").applyInPandas(
        deal, "__block long, __key string, __m long, extra array<int>, loads array<double>"))
    loads = sorted(checked_collect(dealt.where("__key is null").select("__block", "loads"), MAX_LOAD_CELLS,
                                   "fold loads", k * len(classes)))
    names = _match_blocks([np.array(r["loads"]).reshape(k, -1) for r in loads], totals, k)
    named = spark.createDataFrame([(r["__block"], n) for r, n in zip(loads, names)], "__block long, names array<int>")
    # a vector that many groups share is met in several places, by rank
    places = dealt.where("__key is not null").join(named, "__block").select(
        "__key", "__m", "names", F.transform("extra", lambda x: F.get("names", x)).alias("extra"),
        F.explode(F.expr(f"sequence(0L, (__m - 1) div {RANKS_TOGETHER})")).alias("__part"))
    ranked = ordinal(groups, "__key", ["__h", "__g"], "__rk", start=0) \
        .withColumn("__part", F.expr(f"__rk div {RANKS_TOGETHER}"))
    even = F.expr(f"__m div {k} * {k}")
    fold = F.when(F.col("__rk") < even, F.get("names", (F.col("__rk") % k).cast("int"))) \
        .otherwise(F.get("extra", (F.col("__rk") - even).cast("int")))
    folds = materialize(ranked.join(places, ["__key", "__part"]).select("__g", "__size", fold.alias("__fold")))
    hot = folds.where(F.col("__size") * 1000 > float(totals.sum())).select("__g", F.col("__fold").alias("__hot"))
    salt = F.when(F.col("__hot").isNull(), 0).otherwise(F.pmod(F.xxhash64(*df.columns), F.lit(1 << 20)).cast("int"))
    met = df.withColumn("__g", _group_key(df, group)).join(F.broadcast(hot), "__g", "left").withColumn("__salt", salt)
    others = folds.select("__g", "__fold", F.lit(0).alias("__salt"))
    return met.join(others, ["__g", "__salt"], "left") \
        .select(*df.columns, F.coalesce("__hot", "__fold").alias(out))
