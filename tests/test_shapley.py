"""M7: sampled Shapley values of a forest add up, are exact where all orders are walked, and lie within their bound."""
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors

from segment_lab.operators import shapley


@pytest.fixture(scope="module")
def forest(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(240, 4))
    y = (x[:, 0] + 2 * (x[:, 1] > 0) * x[:, 2] > 0.4).astype(int) + (x[:, 3] > 1)
    df = spark.createDataFrame([(i, float(y[i]), x[i].tolist()) for i in range(240)], "id long, y double, x array<double>").withColumn("features", array_to_vector("x"))
    return RandomForestClassifier(labelCol="y", numTrees=12, maxDepth=5, seed=3).fit(df), df, x


def exact(model, x, z):
    """Shapley values of every feature and class, averaged over background rows, by full enumeration of subsets."""
    d, out = len(x), 0
    for b in z:
        value = {s: np.array(model.predictProbability(Vectors.dense(np.where([j in s for j in range(d)], x, b))))
                 for n in range(d + 1) for s in map(frozenset, combinations(range(d), n))}
        out = out + np.array([sum(factorial(len(s)) * factorial(d - 1 - len(s)) / factorial(d) * (value[s | {j}] - value[s]) for s in value if j not in s)
                              for j in range(d)])
    return out / len(z)


def test_all_orders_give_the_exact_values(spark, forest):
    model, df, x = forest
    got = shapley.forest_shapley(df, model, "features", "id", list("abcd"), ["0", "1", "2"], sample_rows=3, background_rows=4, orders=12).collect()
    assert len(got) == 3 * 3 * 4
    ground = [r["id"] for r in df.selectExpr("id", "md5('1988:' || id) AS h").orderBy("h").limit(4).collect()]
    for i in {r["id"] for r in got}:
        want = exact(model, x[i], x[ground])
        for r in got:
            if r["id"] == i:
                assert abs(r["phi"] - want["abcd".index(r["feature"]), int(r["cls"])]) < 1e-9


def test_sampled_values_add_up_and_keep_the_bound(spark, forest):
    model, df, x = forest
    got = shapley.forest_shapley(df, model, "features", "id", list("abcd"), ["0", "1", "2"], sample_rows=12, background_rows=5, orders=10).collect()
    assert len({r["id"] for r in got}) == 12
    ground = [r["id"] for r in df.selectExpr("id", "md5('1988:' || id) AS h").orderBy("h").limit(5).collect()]
    sums, off = {}, []
    for r in got:
        s = sums.setdefault((r["id"], r["cls"]), [r["base"], r["probability"]])
        s[0] += r["phi"]
    for (i, c), (total, p) in sums.items():
        assert abs(total - p) < 1e-9 and abs(p - model.predictProbability(Vectors.dense(x[i]))[int(c)]) < 1e-9
    want = {i: exact(model, x[i], x[ground]) for i in {r["id"] for r in got}}
    off = [abs(r["phi"] - want[r["id"]]["abcd".index(r["feature"]), int(r["cls"])]) for r in got]
    assert max(off) < shapley.error_bound(20) and np.mean(off) < 0.05


def test_no_rows(spark, forest):
    model, df, _ = forest
    assert shapley.forest_shapley(df.limit(0), model, "features", "id", list("abcd"), ["0", "1", "2"]).count() == 0
