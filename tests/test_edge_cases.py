"""FIXTURES.md section 2: edge cases as literal rows."""
import math

import pytest
from pyspark.sql import functions as F

from support import rows
from segment_lab.functions.columns import hour_label
from segment_lab.operators import describe as D
from segment_lab.operators import moments as M
from segment_lab.operators import prep as P
from segment_lab.operators import segments as G
from segment_lab.operators import scored as SC
from segment_lab.operators import agreement as AG
from segment_lab.operators.joins import track_segment_join
from segment_lab.operators.timeline import segment_clock
from segment_lab.sources.catalog import job_status_files
from segment_lab.sources.tables import nan_to_null


def test_anova_nan_dropped_vs_propagated(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 1.0), ("a", 2.0, 2.0), ("a", 3.0, float("nan")),
         ("b", 5.0, 5.0), ("b", 6.0, 6.0), ("b", 7.0, 7.0)], "g string, x double, y double")
    df = nan_to_null(df)
    mom = M.moments(df, "g", ["x", "y"])
    drop = {r["feature"]: r for r in M.anova(mom, "drop").collect()}
    prop = {r["feature"]: r for r in M.anova(mom, "propagate").collect()}
    # x: groups (1,2,3) and (5,6,7): SSB = 24, SSW = 4, F = 24 / (4/4) = 24
    assert drop["x"]["F"] == pytest.approx(24.0)
    assert prop["x"]["F"] == pytest.approx(24.0)
    # y: the NaN row is ignored for y only -> groups (1,2) and (5,6,7)
    assert drop["y"]["df_within"] == 3.0
    # means 1.5 and 6: SSB = 24.3, SSW = 2.5, F = 24.3 / (2.5 / 3); t = sqrt(F) on 3 df
    assert drop["y"]["F"] == pytest.approx(29.16)
    assert drop["y"]["p"] == pytest.approx(0.0124484, rel=1e-4)
    assert prop["y"]["F"] is None and prop["y"]["p"] is None


def test_quadrants_nan_and_zero(spark):
    df = nan_to_null(spark.createDataFrame(
        [(0.0, 0.0), (-1.0, 2.0), (-1.0, -1.0), (1.0, -1.0), (float("nan"), 1.0)],
        "x double, y double"))
    got = {r["quadrant"]: (r["n"], r["pct"]) for r in D.quadrant_counts(df, "x", "y").collect()}
    assert got["Q1"] == (1, 20.0)       # exact 0 lands on the >= 0 side
    assert got["Q2"][0] == 1 and got["Q3"][0] == 1 and got["Q4"][0] == 1
    assert got["Total"] == (5, 100.0)   # NaN row: in no quadrant, in the total


def test_constant_column_scaling(spark):
    df = spark.createDataFrame([(1, 3.0, 1.0), (2, 3.0, 3.0)], "id int, c double, v double")
    mm = D.minmax_scale(df, ["c", "v"]).orderBy("id").collect()
    assert [r["c"] for r in mm] == [-1.0, -1.0]
    assert [r["v"] for r in mm] == [-1.0, 1.0]
    z = P.zscore(df, ["c", "v"]).orderBy("id").collect()
    assert [r["c"] for r in z] == [0.0, 0.0]
    assert [r["v"] for r in z] == [-1.0, 1.0]   # population std = 1


def test_cohens_d_zero_pooled_std(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("b", 2.0), ("b", 2.0)], "g string, x double")
    d = M.cohens_d(M.moments(df, "g", ["x"])).collect()
    assert len(d) == 1 and d[0]["d"] == 0.0


def test_cohens_d_value(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("b", 7.0)], "g string, x double")
    d = M.cohens_d(M.moments(df, "g", ["x"])).collect()[0]
    # pooled var = (2 + 2) / 2 = 2, d = (2 - 6) / sqrt(2)
    assert (d["group1"], d["group2"]) == ("a", "b")
    assert d["d"] == pytest.approx(-4 / math.sqrt(2))


def test_tokens_not_trimmed_and_empty_kept(spark):
    df = spark.createDataFrame([("p", "a, b,"), ("p", None)], "g string, s string")
    got = rows(D.token_counts(df, "g", "s"), "token", "n")
    assert got == [("", 1), (" b", 1), ("a", 1)]


def test_left_join_unmatched_track_takes_a_slot(spark):
    tracks = spark.createDataFrame([("pl", 1, "t1"), ("pl", 2, "t2")], "playlist string, no int, tid string")
    segs = spark.createDataFrame([("t1", 0), ("t1", 1)], "sid string, chunk int")
    j = track_segment_join(tracks, segs, "tid", "sid")
    assert j.count() == 3
    clock = segment_clock(j, "playlist", ["no", "chunk"], seconds=30.0, scale=1.0)
    got = sorted((r["no"], r["start_time"]) for r in clock.collect())
    assert got == [(1, 0.0), (1, 30.0), (2, 60.0)]


def test_short_file_is_error_and_tail_dropped(spark):
    # file a: 25 samples -> 2 segments of 10 (tail of 5 dropped); file b: 4 samples -> error
    data = [("a", i, float(i)) for i in range(25)] + [("b", i, 1.0) for i in range(4)]
    samples = spark.createDataFrame(data, "file string, idx long, value double")
    segs = G.segments(samples, 10)
    assert rows(segs.groupBy("file", "chunk").count()) == [("a", 0, 10), ("a", 1, 10)]
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "file string")
    done = spark.createDataFrame([("c",)], "file string")
    st = {r["file"]: r["status"] for r in job_status_files(wanted, done, segs, "file").collect()}
    assert st == {"a": "success", "b": "error", "c": "exists"}


def test_segment_features(spark):
    data = [("a", 0, 1.0), ("a", 1, -1.0), ("a", 2, 1.0), ("a", 3, -1.0)]
    f = G.segment_features(G.segments(spark.createDataFrame(data, "file string, idx long, value double"), 4))
    r = f.collect()[0]
    assert r["mean"] == 0.0 and r["rms"] == 1.0 and r["peak"] == 1.0
    assert r["zcr"] == 1.0 and r["mean_abs_delta"] == 2.0


def test_tied_modes_pick_lowest_label(spark):
    df = spark.createDataFrame([("g", "b"), ("g", "a"), ("h", "z"), ("h", "z"), ("h", "y")], "k string, v string")
    got = rows(D.mode(df, "v", "k"), "k", "v", "n")
    assert got == [("g", "a", 1), ("h", "z", 2)]
    overall = D.mode(df, "v").collect()[0]
    assert (overall["v"], overall["n"]) == ("z", 2)


def test_topk_ties_by_key(spark):
    df = spark.createDataFrame([("g", "b", 3), ("g", "a", 3), ("g", "c", 1)], "k string, t string, w int")
    got = rows(D.topk(df, "k", "w", "t", 2), "t", "rank")
    assert got == [("a", 1), ("b", 2)]


def _scored(spark, data):
    # data: (id, y_true, score of class "a", score of class "b")
    return spark.createDataFrame(
        [(i, t, "a" if sa >= sb else "b", [sa, sb]) for i, t, sa, sb in data],
        "id long, y_true string, y_pred string, probability array<double>")


def test_roc_ties_one_point_per_distinct_score(spark):
    s = _scored(spark, [(1, "a", 0.9, 0.1), (2, "b", 0.9, 0.1), (3, "a", 0.4, 0.6), (4, "b", 0.2, 0.8)])
    pts = SC.roc_points(s).filter(F.col("cls") == "a").orderBy("fpr", "tpr").collect()
    # thresholds for class a: 0.9 (tied pair), 0.4, 0.2 plus the origin
    assert len(pts) == 4
    auc = {r["cls"]: r["auc"] for r in SC.roc_auc(s).collect()}
    # positives a: {0.9, 0.4}, negatives: {0.9, 0.2}; pairs won: (0.9>0.2)=1, (0.9=0.9)=.5, (0.4>0.2)=1, (0.4<0.9)=0
    assert auc["a"] == pytest.approx(2.5 / 4)


def test_fewer_clusters_than_labels_alignment_pads(spark):
    df = spark.createDataFrame([("x", "0"), ("x", "0"), ("y", "0"), ("z", "1")], "t string, p string")
    cont = AG.contingency(df, "t", "p")
    al = AG.cluster_alignment(cont)
    got = rows(al, "y_true", "y_pred", "n")
    assert ("x", "x", 2) in got and ("z", "z", 1) in got
    assert sum(r[2] for r in got) == 4


def test_single_cluster_agreement_by_definition(spark):
    df = spark.createDataFrame([("x", "0"), ("y", "0"), ("z", "0")], "t string, p string")
    sc = AG.agreement_scores(AG.contingency(df, "t", "p")).collect()[0]
    assert sc["ari"] == pytest.approx(0.0)
    assert sc["nmi"] == pytest.approx(0.0)
    assert sc["homogeneity"] == pytest.approx(0.0)
    assert sc["completeness"] == pytest.approx(1.0)


def test_half_even_rounding_and_hour_label(spark):
    df = spark.createDataFrame([(0.25, 1.999), (2.5, 0.5)], "a double, h double")
    r = df.select(F.bround("a", 1).alias("r"), hour_label("h").alias("lbl"),
                  hour_label("h", compat=True).alias("compat")).collect()
    assert r[0]["r"] == 0.2 and r[1]["r"] == 2.5
    assert r[0]["lbl"] == "2:00" and r[0]["compat"] == "1:60"
    assert r[1]["lbl"] == "0:30"


def test_undersample_balances_classes(spark):
    df = spark.createDataFrame([(i, "big" if i < 8 else "small") for i in range(11)], "id long, y string")
    u = P.undersample(df, "y", "id", seed=3)
    got = dict(rows(u.groupBy("y").count()))
    assert got == {"big": 3, "small": 3}
