"""Maximum-weight matching of a sparse table by auction rounds.

Persons bid for objects: an unassigned person bids, for the object of its
best net value, what the second best leaves it, plus a step.  With steps
scaled down to one in weights multiplied by the number of persons plus one,
the last assignment is optimal.  So that everyone can be assigned, the table
is doubled: each person has an object of its own of weight 0, each object a
person, and the two copies of a cell's ends are joined by a cell of weight
0; a best full assignment of the doubled table is a best matching of the
given one.

Tables of a bounded number of cells are bid for in arrays, any larger ones in
DataFrame rounds by the same rule.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Cells (three values each) up to which the rounds run in arrays.
ARRAY_CELLS = 200_000
#: The steps of two phases differ by this factor.
SCALING = 5


def _steps(most: int) -> list[int]:
    """Falling bid steps, the last one 1."""
    out, step = [], max(1, most // 2)
    while step > 1:
        out.append(step)
        step //= SCALING
    return [*out, 1]


def _auction_arrays(person: np.ndarray, item: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Item of each of ``n`` persons; cells are ordered by person, and a full assignment exists."""
    weight = weight.astype(object) * (n + 1) if weight.max(initial=0) > (1 << 62) // (n + 1) else weight * (n + 1)
    first = np.searchsorted(person, np.arange(n))
    price = np.zeros(n, weight.dtype)
    most = int(weight.max(initial=0))
    for step in _steps(most):
        owner, held = np.full(n, -1), np.full(n, -1)
        while (free := np.flatnonzero(held < 0)).size:
            value = weight - price[item]
            best = np.maximum.reduceat(value, first)
            # the first cell of the best value, and the best of the others
            at = np.full(n, len(item))
            top = np.flatnonzero(value == best[person])
            np.minimum.at(at, person[top], top)
            rest = value.copy()
            rest[at] = -4 * most - 4
            second = np.maximum(np.maximum.reduceat(rest, first), best - most - 1)
            want, bid = item[at[free]], price[item[at[free]]] + best[free] - second[free] + step
            order = np.lexsort((free, -bid, want))
            won = order[np.r_[True, want[order][1:] != want[order][:-1]]]
            for k in won.tolist():
                p, o = int(free[k]), int(want[k])
                if owner[o] >= 0:
                    held[owner[o]] = -1
                owner[o], held[p], price[o] = p, o, bid[k]
    return held


def _doubled(cells: DataFrame) -> DataFrame:
    """``(person, item, weight)`` of the doubled table; names are told apart by their first letter."""
    side = lambda mark, c: F.concat(F.lit(mark), F.col(c))
    own = lambda c: cells.select(c).distinct()
    zero = F.lit(0).cast("long").alias("weight")
    return cells.select(side("p", "person").alias("person"), side("o", "item").alias("item"), F.col("weight").cast("long").alias("weight")) \
        .unionByName(cells.select(side("o", "item").alias("person"), side("p", "person").alias("item"), zero)) \
        .unionByName(own("person").select(side("p", "person").alias("person"), side("p", "person").alias("item"), zero)) \
        .unionByName(own("item").select(side("o", "item").alias("person"), side("o", "item").alias("item"), zero))


def _auction_frames(cells: DataFrame) -> DataFrame:
    """``(person, item)`` of a best full assignment of ``cells``, one job a round."""
    top = cells.agg(F.max("weight").alias("w"), F.count_distinct("person").alias("n")).first()
    n, most = top["n"], (top["w"] or 0) * (top["n"] + 1)
    scaled = materialize(cells.withColumn("weight", F.col("weight") * (n + 1)))
    state = materialize(cells.select("item").distinct().withColumn("price", F.lit(0).cast("long")))
    for step in _steps(most):
        state = state.select("item", "price", F.lit(None).cast("string").alias("owner"))
        while True:
            state = materialize(state)
            if state.where("owner IS NULL").limit(1).count() == 0:
                break
            free = scaled.join(state.select(F.col("owner").alias("person")).where("person IS NOT NULL"), "person", "left_anti")
            valued = free.join(state.select("item", "price"), "item").withColumn("value", F.col("weight") - F.col("price"))
            # the two best values of a person in one pass: the best cell, and the best of the others by a second look at it
            best = valued.groupBy("person").agg(F.max(F.struct("value", F.col("item").alias("item"), "price")).alias("b"))
            other = valued.join(best, "person").where(F.col("item") != F.col("b.item")).groupBy("person").agg(F.max("value").alias("second"))
            floor = F.col("b.value") - most - 1
            bids = best.join(other, "person", "left").select(
                F.col("b.item").alias("item"), "person",
                (F.col("b.price") + F.col("b.value") - F.greatest(F.coalesce("second", floor), floor) + step).alias("bid"))
            won = bids.groupBy("item").agg(F.max(F.struct("bid", "person")).alias("w"))
            state = state.join(won, "item", "left").select(
                "item", F.coalesce("w.bid", "price").alias("price"), F.coalesce("w.person", "owner").alias("owner"))
    return state.select(F.col("owner").alias("person"), "item")


def matching(cells: DataFrame, array_cells: int = ARRAY_CELLS) -> DataFrame:
    """``(person, item)`` pairs of a matching of the greatest total weight.

    ``cells`` holds ``(person, item, weight)``, each pair at most once, with
    positive whole weights; rows that lack a side take no part.  Cells of
    weight 0 match nobody.
    """
    cells = materialize(cells.where("person IS NOT NULL AND item IS NOT NULL AND weight > 0").select("person", "item", "weight"))
    spark = cells.sparkSession
    both = _doubled(cells)
    if cells.count() <= array_cells:
        rows = sorted(tuple(r) for r in both.collect())  # at most four rows a cell
        if not rows:
            return cells.select("person", "item")
        names = sorted({r[0] for r in rows})
        number = {x: k for k, x in enumerate(names)}
        held = _auction_arrays(np.array([number[r[0]] for r in rows]), np.array([number[r[1]] for r in rows]),
                               np.array([r[2] for r in rows], np.int64), len(names))
        pairs = [(names[p], names[o]) for p, o in enumerate(held.tolist())]
        found = spark.createDataFrame(pairs, "person string, item string")
    else:
        found = _auction_frames(both)
    real = found.where("person LIKE 'p%' AND item LIKE 'o%'")
    return real.select(F.substring("person", 2, 1 << 30).alias("person"), F.substring("item", 2, 1 << 30).alias("item"))
