"""Auction matchings reach the greatest total, in arrays and in DataFrame rounds."""
from itertools import permutations

import numpy as np
import pytest

from segment_lab.operators import agreement, assign


def best_total(cells, persons, items):
    weight = {(p, o): w for p, o, w in cells}
    if len(persons) > len(items):
        persons, items, weight = items, persons, {(o, p): w for (p, o), w in weight.items()}
    return max((sum(weight.get((p, o), 0) for p, o in zip(persons, order)) for order in permutations(items, len(persons))), default=0)


def random_cells(seed):
    rng = np.random.default_rng(seed)
    p, o = int(rng.integers(1, 7)), int(rng.integers(1, 7))
    top = int(rng.choice([3, 50, 10**9]))
    cells = [(f"a{i}", f"b{j}", int(rng.integers(1, top + 1))) for i in range(p) for j in range(o) if rng.random() < 0.6]
    return cells, [f"a{i}" for i in range(p)], [f"b{j}" for j in range(o)]


def check(found, cells, persons, items):
    pairs = [(r["person"], r["item"]) for r in found]
    assert len({p for p, _ in pairs}) == len({o for _, o in pairs}) == len(pairs)
    weight = {(p, o): w for p, o, w in cells}
    assert sum(weight[x] for x in pairs) == best_total(cells, persons, items)


@pytest.mark.parametrize("seed", range(12))
def test_array_rounds_are_optimal(spark, seed):
    cells, persons, items = random_cells(seed)
    df = spark.createDataFrame(cells, "person string, item string, weight long")
    check(assign.matching(df).collect(), cells, persons, items)


def test_frame_rounds_are_optimal(spark):
    cells = [("x", "1", 7), ("x", "2", 6), ("y", "1", 6), ("y", "2", 1), ("z", "2", 2)]
    df = spark.createDataFrame([*cells, (None, "1", 9), ("z", None, 9), ("z", "3", 0)], "person string, item string, weight long")
    check(assign.matching(df, array_cells=0).collect(), cells, ["x", "y", "z"], ["1", "2"])


def test_many_labels_without_a_matrix():
    """Thousands of labels: the cells that occur are all that is held."""
    rng = np.random.default_rng(2)
    n = 3000
    person = np.repeat(np.arange(n), 4)
    item = np.concatenate([[k, *rng.integers(0, n, 3)] for k in range(n)])
    held = assign._auction_arrays(person, item, np.tile([1000, 1, 2, 3], n), n)
    assert (held == np.arange(n)).all()


def test_alignment_pairs_what_shares_no_row(spark):
    rows = [("a", "0", 5), ("a", "1", 4), ("b", "0", 4), ("c", "2", 1)]
    cont = spark.createDataFrame(rows, "y_true string, y_pred string, n long")
    got = {(r["y_true"], r["y_pred"]): r["n"] for r in agreement.cluster_alignment(cont).collect()}
    assert got == {("a", "b"): 5, ("a", "a"): 4, ("b", "b"): 4, ("c", "c"): 1}
    lone = spark.createDataFrame([("a", "0", 3), ("a", "1", 2), ("a", "2", 1), ("b", "0", 1)], "y_true string, y_pred string, n long")
    got = {(r["y_true"], r["y_pred"]): r["n"] for r in agreement.cluster_alignment(lone).collect()}
    assert got in ({("a", "a"): 3, ("a", "b"): 2, ("a", "2"): 1, ("b", "a"): 1}, {("a", "b"): 3, ("a", "a"): 2, ("a", "2"): 1, ("b", "b"): 1})
    assert agreement.cluster_alignment(cont.limit(0)).count() == 0
