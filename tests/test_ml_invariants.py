"""Invariants of the ML operators (no numeric parity with other libraries)."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from segment_lab.operators import cluster as CL
from segment_lab.operators import folds as FO
from segment_lab.operators import reduce as R
from segment_lab.plans import q_models as QM


def test_pca_ratios(spark, small_dir):
    _, k, ratios = R.pca_variance(QM._emb(spark, small_dir), "features")
    r = [x["ratio"] for x in ratios.orderBy("component").collect()]
    assert all(a >= b - 1e-12 for a, b in zip(r, r[1:]))
    assert sum(r) == pytest.approx(1.0, abs=1e-6)
    cum = np.cumsum(r)
    assert k == int((cum <= 0.99).sum()) + 1


def test_stratified_folds_balance(spark, small_dir):
    f = FO.stratified_folds(QM._emb(spark, small_dir), "label", "vec_id", 5, 1987)
    pdf = f.select("vec_id", "label", "fold").toPandas()
    assert pdf["vec_id"].is_unique and len(pdf) == 500
    sizes = pdf.groupby(["label", "fold"]).size().unstack(fill_value=0)
    assert (sizes.max(axis=1) - sizes.min(axis=1)).max() <= 1


def test_group_folds_keep_groups_whole(spark, small_dir):
    import __spark_entry__ as E
    g = E.queries()["group_folds"](spark, small_dir)
    per_doc = g.groupBy("doc_id").agg(F.count_distinct("fold").alias("k")).filter("k > 1")
    assert per_doc.count() == 0


def test_oof_covers_each_row_once(spark, small_dir):
    import __spark_entry__ as E
    s = E.queries()["logreg_oof"](spark, small_dir).toPandas()
    assert len(s) == 500 and s["id"].is_unique
    probs = np.stack(s["probability"].to_numpy())
    assert probs.shape[1] == s["y_true"].nunique()
    assert np.allclose(probs.sum(axis=1), 1.0, atol=1e-6)
    # the prediction is the arg-max of the probability vector in sorted label order
    labels = sorted(s["y_true"].unique())
    assert (s["y_pred"] == [labels[i] for i in probs.argmax(axis=1)]).all()


def test_bisecting_uses_all_rows(spark):
    from pyspark.ml.linalg import Vectors
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(c, 0.2, size=(40, 2)) for c in (0, 5, 10)])
    df = spark.createDataFrame([(i, Vectors.dense(v)) for i, v in enumerate(x)], ["i", "x"])
    out, _ = CL.bisecting_clusters(df, "x", 3, seed=1)
    got = out.toPandas().groupby("cluster")["i"].apply(lambda s: sorted(s)).tolist()
    assert sorted(got) == [list(range(0, 40)), list(range(40, 80)), list(range(80, 120))]


def test_mixed_pipeline_unseen_missing_and_boolean(spark):
    from segment_lab.operators.prep import mixed_pipeline
    train = spark.createDataFrame([(1.0, "a", True), (2.0, "b", False), (3.0, "c", True)], "x double, g string, f boolean")
    new = spark.createDataFrame([(1.0, "zzz", True), (1.0, None, None), (1.0, "b", False)], "x double, g string, f boolean")
    rows = [r["features"].toArray() for r in mixed_pipeline(["x"], ["g", "f"]).fit(train).transform(new).collect()]
    assert all(len(r) == 1 + 3 + 2 for r in rows)
    assert rows[0][1:].tolist() == [0, 0, 0, 0, 1] and rows[1][1:].tolist() == [0] * 5 and rows[2][1:].tolist() == [0, 1, 0, 1, 0]


def test_two_class_logistic_is_binomial(spark):
    from pyspark.ml.linalg import Vectors
    from segment_lab.operators.classify import make_model
    data = [(float(i % 2), Vectors.dense([i % 2 + 0.1 * (i % 5)]), 1.0) for i in range(40)]
    m = make_model("log", n_rows=40.0).fit(spark.createDataFrame(data, ["__y", "features", "weight"]))
    assert m.coefficientMatrix.numRows == 1


def test_linear_shap_is_additive(spark, small_dir):
    from segment_lab.operators import explain as EX
    e, m, labels = QM._logreg_model(spark, small_dir)
    names = [f"d{j}" for j in range(m.numFeatures)]
    top, base = EX.shap_linear(e, m, "features", names, labels, 5)
    assert top.groupBy("cls").count().filter("count != 5").count() == 0
    coef, icpt = m.coefficientMatrix.toArray(), m.interceptVector.toArray()
    xs = np.stack([r["features"].toArray() for r in e.select("features").limit(20).collect()])
    mu = np.stack([r["features"].toArray() for r in e.select("features").collect()]).mean(0)
    for i in range(len(labels)):
        phi = coef[i] * (xs - mu)
        assert np.allclose(phi.sum(1) + base[i], xs @ coef[i] + icpt[i], atol=1e-8)
    # mean |phi| per (class, feature) against brute force over all rows
    allx = np.stack([r["features"].toArray() for r in e.select("features").collect()])
    got = {(r["cls"], r["feature"]): r["mean_abs_phi"] for r in top.collect()}
    for (cls, feat), v in got.items():
        i, j = labels.index(cls), int(feat[1:])
        assert v == pytest.approx(np.abs(coef[i, j] * (allx[:, j] - mu[j])).mean(), rel=1e-9)


def test_permutation_importance_signal_vs_constant(spark):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.linalg import Vectors
    from segment_lab.operators import explain as EX
    data = [(i, float(i % 2), Vectors.dense([float(i % 2) + 0.01 * (i % 7), 5.0])) for i in range(200)]
    df = spark.createDataFrame(data, ["i", "y", "x"])
    rf = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=5, maxDepth=3, seed=1).fit(df)
    imp = {r["feature"]: r["importance"] for r in EX.permutation_importance(df, rf, "x", "y", ["a", "b"], "i", 7).collect()}
    again = {r["feature"]: r["importance"] for r in EX.permutation_importance(df.repartition(7), rf, "x", "y", ["a", "b"], "i", 7).collect()}
    assert imp == again             # donors are chosen by id, not by partition layout
    assert imp["b"] == 0.0          # a constant feature: permuting it changes nothing
    assert imp["a"] > 0.3           # the signal feature: permuting it breaks the prediction


def test_gmm_query_fits_all_but_a_hundredth_of_the_variance(spark, small_dir, monkeypatch):
    sizes, fit = [], CL.gmm_clusters

    def watched(df, vec, k, **kw):
        sizes.append(len(df.select(vec).first()[0]))
        return fit(df, vec, k, **kw)
    monkeypatch.setattr(CL, "gmm_clusters", watched)
    assert QM.gmm_clusters(spark, small_dir).count() == 1
    _, kept = QM._scaled_pca(QM._emb(spark, small_dir), "features")
    assert sizes == [kept] and kept > 2


def test_silhouette_bars(spark):
    """Bars ascend in each cluster, their mean is Spark's silhouette, lone rows have 0 and a single cluster has none."""
    import numpy as np
    from pyspark.ml.functions import array_to_vector
    rng = np.random.default_rng(4)
    rows = [(i, i % 3 if i < 90 else 7, (rng.normal(size=3) + 2 * (i % 3)).tolist()) for i in range(91)]
    df = spark.createDataFrame(rows, "id long, c int, a array<double>").withColumn("v", array_to_vector("a"))
    bars = CL.silhouette_bars(df, "v", "c", "id").collect()
    want = CL.silhouette_sq(df.withColumn("c", F.col("c").cast("double")), "v", "c")
    assert len(bars) == 91 and abs(sum(r["silhouette"] for r in bars) / 91 - want) < 1e-9
    for c in (0, 1, 2, 7):
        own = sorted((r["place"], r["silhouette"]) for r in bars if r["cluster"] == c)
        assert [p for p, _ in own] == list(range(1, len(own) + 1)) and [v for _, v in own] == sorted(v for _, v in own)
    assert [r["silhouette"] for r in bars if r["cluster"] == 7] == [0.0]
    assert {r["silhouette"] for r in CL.silhouette_bars(df.withColumn("c", F.lit(1)), "v", "c", "id").collect()} == {None}
