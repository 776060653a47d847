"""Greedy stratified group folds against the same deal in plain Python."""
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from segment_lab.operators import folds as FO

SCHEMA = "id long, g string, c string, fold0 int"


def brute_folds(data, k, seed, block):
    """``{group: fold}`` of rows (id, group, label): the deal of the docstring, one group at a time."""
    name = {None: "\x00null"}
    counts = defaultdict(Counter)
    for _, g, c in data:
        counts[name.get(g, g)][name.get(c, c)] += 1
    classes = sorted({c for v in counts.values() for c in v})
    totals = np.array([sum(v[c] for v in counts.values()) for c in classes], float)
    same = defaultdict(list)
    for g, v in counts.items():
        same[tuple(v[c] for c in classes)].append(g)
    text = {v: ",".join(f"{i}:{n}" for i, n in enumerate(v) if n) for v in same}
    order = sorted(same, key=lambda v: (sum(v) ** 2 - len(classes) * sum(n * n for n in v), text[v]))

    def best(loads, v, free):
        costs = []
        for f in free:
            trial = loads.copy()
            trial[f] += v
            costs.append((round(float(np.std(trial / totals, axis=0).mean()), 10), loads[f].sum(), f))
        return min(costs)[2]

    whole, found = np.zeros((k, len(classes))), {}
    for at in range(0, len(order), block):
        own, place = np.zeros((k, len(classes))), {}
        for v in order[at:at + block]:
            members = sorted(same[v], key=lambda g: (hashlib.md5(f"{seed}:{g}".encode()).hexdigest(), g))
            for r, g in enumerate(members):
                left = len(members) // k * k
                place[g] = r % k if r < left else None
                if place[g] is not None:
                    own[place[g]] += v
            for g in members[len(members) // k * k:]:
                place[g] = best(own, np.array(v), range(k))
                own[place[g]] += v
        names, free = {}, list(range(k))
        for f in sorted(range(k), key=lambda f: (-own[f].sum(), f)):
            names[f] = f if at == 0 else best(whole, own[f], free)
            free.remove(names[f])
            whole[names[f]] += own[f]
        found.update({g: names[f] for g, f in place.items()})
    return found


def table(seed, groups):
    r = random.Random(seed)
    data = []
    for g in range(groups):
        lean = r.choice("abc")
        for _ in range(r.choice([1, 1, 2, 3, 8])):
            data.append((len(data), None if g == 3 else f"g{g}", r.choice([lean, lean, "a", None])))
    data += [(len(data) + i, "hot", r.choice("ab")) for i in range(len(data) // 2)]
    return data


@pytest.mark.parametrize("seed,groups,k,block", [(1, 120, 5, 4096), (2, 120, 3, 7), (3, 3, 5, 4096), (4, 200, 4, 1)])
def test_equals_brute_force(spark, seed, groups, k, block):
    data = table(seed, groups)
    df = spark.createDataFrame([(*r, 9) for r in data], SCHEMA)
    got = FO.balanced_group_folds(df, "c", "g", k, 7, block=block).collect()
    want = brute_folds(data, k, 7, block)
    assert sorted((r.id, r.fold0, r.fold) for r in got) == sorted((i, 9, want["\x00null" if g is None else g]) for i, g, _ in data)


def test_one_row_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "x", "a", 0)], SCHEMA)
    assert [r.fold for r in FO.balanced_group_folds(df, "c", "g").collect()] == [0]
    empty = FO.balanced_group_folds(df.limit(0), "c", "g")
    assert empty.columns == [*df.columns, "fold"] and empty.count() == 0


def test_ranks_of_one_vector_meet_in_several_places(spark, monkeypatch):
    monkeypatch.setattr(FO, "RANKS_TOGETHER", 8)
    df = spark.range(103).select("id", F.col("id").cast("string").alias("g"), F.lit("a").alias("c"), F.lit(0).alias("fold0"))
    sizes = Counter(r.fold for r in FO.balanced_group_folds(df, "c", "g").collect())
    assert sorted(sizes.values()) == [20, 20, 21, 21, 21]


def test_closer_than_the_serpentine_deal(spark, small_dir):
    lines = spark.read.parquet(f"{small_dir}/lineitem.parquet").select("l_orderkey", "l_suppkey", "l_returnflag")

    def spread(folds):
        m = folds.groupBy("l_returnflag").pivot("fold", list(range(5))).count().toPandas().set_index("l_returnflag").fillna(0).to_numpy()
        return np.std(m / m.sum(axis=1, keepdims=True), axis=1).mean()
    greedy = FO.balanced_group_folds(lines, "l_returnflag", "l_suppkey")
    assert greedy.count() == lines.count()
    assert greedy.groupBy("l_suppkey").agg(F.count_distinct("fold").alias("k")).where("k > 1").count() == 0
    assert spread(greedy) <= spread(FO.group_folds(lines, "l_returnflag", "l_suppkey"))
