"""L4: the forest against Spark's, its trees against plain splits, and its bounds."""
import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from segment_lab.operators import forest as FR


def table(spark, n=900, seed=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 9)), 3)
    x[:, 8] = rng.random(n) < 0.01  # a rare value
    y = (x[:, 0] + 0.8 * rng.normal(size=n) > 0).astype(int) + 2 * ((x[:, 1] > 1) & (x[:, 2] > -1))
    rows = [(i, float(y[i]), float(1 + y[i]), x[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "id long, y double, w double, a array<double>").withColumn("v", array_to_vector("a")), x, y


def scores(model, df):
    return {r["id"]: (r["prediction"], r["probability"].toArray()) for r in model.transform(df).select("id", "prediction", "probability").collect()}


def test_as_good_as_sparks_forest(spark):
    df, _, y = table(spark)
    train, test = df.where("id % 3 > 0"), df.where("id % 3 = 0")
    own = FR.ForestClassifier("v", "y", "w", trees=60).fit(train)
    other = RandomForestClassifier(featuresCol="v", labelCol="y", weightCol="w", numTrees=60, featureSubsetStrategy="sqrt", maxDepth=30, seed=1).fit(train)
    mine, theirs = scores(own, test), scores(other, test)
    right = [np.mean([s[i][0] == y[i] for i in s]) for s in (mine, theirs)]
    assert abs(right[0] - right[1]) < 0.05
    assert np.mean([np.abs(mine[i][1] - theirs[i][1]).sum() for i in mine]) < 0.2
    assert all(abs(p.sum() - 1) < 1e-9 and p.argmax() == k for k, p in mine.values())
    gaps = np.abs(own.featureImportances.toArray() - other.featureImportances.toArray())
    assert abs(own.featureImportances.toArray().sum() - 1) < 1e-9 and gaps.max() < 0.05


@pytest.mark.parametrize("group_rows", [40, 100_000])
def test_trees_fit_their_rows_whatever_the_layout(spark, group_rows):
    """Fully grown trees give each drawn row its own class, by summed statistics or in one group; partitions change nothing."""
    df, x, y = table(spark, 400)
    fit = lambda t: FR.ForestClassifier("v", "y", "w", trees=5, group_rows=group_rows).fit(t)
    model, again = fit(df), fit(df.repartition(7))
    for a, b in zip(model.trees, again.trees):
        assert np.array_equal(a.feature, b.feature) and np.array_equal(a.cut, b.cut) and np.array_equal(a.child, b.child)
    rows = df.withColumn("h", F.xxhash64("id", "a", F.col("y").cast("int"))).orderBy("id").collect()
    bins = FR._binned(x, model.cuts)
    for t, tree in enumerate(model.trees):
        drawn = FR._draws(np.array([r["h"] for r in rows]), t, 1987) > 0
        assert 0.5 < drawn.mean() < 0.75
        votes = np.zeros((400, 4))
        tree.add(bins, votes)
        # rows in the same bins of all features may differ in class; here there are none
        assert (votes.argmax(axis=1) == y)[drawn].all()


def test_many_copies_of_different_classes_are_one_leaf(spark):
    """More copies than a group holds cannot be split: their node is a leaf with their shares, and no group gets them."""
    rows = [(i, float(i % 4 == 0), 1.0, [0.0, 1.0]) for i in range(300)] + [(300 + i, 2.0, 1.0, [5.0, 1.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, y double, w double, a array<double>").withColumn("v", array_to_vector("a"))
    model = FR.ForestClassifier("v", "y", "w", trees=20, group_rows=50).fit(df)
    got = scores(model, df)
    assert got[300][0] == 2.0 and got[300][1][2] > 0.9
    assert abs(got[1][1][0] - 0.75) < 0.12 and got[1][1][2] < 0.1


def test_depth_rare_values_and_weights(spark):
    df, _, _ = table(spark)
    stump = FR.ForestClassifier("v", "y", "w", trees=3, max_depth=1).fit(df)
    assert all(len(t.feature) <= 3 for t in stump.trees)
    assert list(FR.ForestClassifier("v", "y", "w", trees=1, max_depth=1).fit(df).cuts[8]) == [0.0]
    with pytest.raises(ValueError, match="different weights"):
        FR.ForestClassifier("v", "y", "w").fit(df.withColumn("w", F.col("id").cast("double")))


def test_forest_is_sent_some_trees_at_a_time(spark, monkeypatch):
    """The driver reads and sends pieces of bounded bytes; the rows get the votes of all trees."""
    from pyspark import SparkContext
    sent, send = [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: (sent.append(value), send(self, value))[1])
    df, x, _ = table(spark, 600)
    model = FR.ForestClassifier("v", "y", "w", trees=12, group_rows=100).fit(df)
    assert not sent  # the fit leaves the trees where they grew
    whole = sum(t.feature.nbytes + t.cut.nbytes + t.child.nbytes + t.shares.nbytes for t in model.trees)
    monkeypatch.setattr(FR, "SENT_BYTES", whole // 4)
    got = scores(model, df)
    assert len(sent) > 3 and sum(map(len, sent)) == 12 and max(map(len, sent)) <= 4
    votes, bins = np.zeros((600, model.numClasses)), FR._binned(x, model.cuts)
    for tree in model.trees:
        tree.add(bins, votes)
    assert all(np.allclose(got[i][1], votes[i] / votes[i].sum(), rtol=0, atol=1e-12) for i in got)


def test_trees_of_a_fold_go_once_its_rows_are_scored(spark, monkeypatch):
    from segment_lab.operators import classify
    alive, most = set(), []
    grow, drop = FR.ForestModel.__init__, FR.ForestModel.drop
    monkeypatch.setattr(FR.ForestModel, "__init__", lambda self, *a: (grow(self, *a), alive.add(id(self)), most.append(len(alive)))[0])
    monkeypatch.setattr(FR.ForestModel, "drop", lambda self: (drop(self), alive.discard(id(self)))[0])
    df, _, _ = table(spark, 300)
    out = classify.oof_predictions(df.withColumn("fold", F.col("id") % 3), "y", "v", "id", model="rf").collect()
    assert sorted(r["id"] for r in out) == list(range(300)) and most == [1, 1, 1] and not alive
