"""Skew-safe running sums: one hot group holding most rows, against brute force."""
import pandas as pd
from pyspark.sql import functions as F

from segment_lab.operators.ordered import ordinal, running_sums


def test_running_sums_with_hot_group(spark):
    data = [("hot", i, float(i % 7)) for i in range(3000)]
    data += [(f"g{j}", i, 1.0) for j in range(40) for i in range(j % 5 + 1)]
    df = spark.createDataFrame(data, "g string, o long, v double")
    got = running_sums(df, "g", "o", {"cs": F.col("v")}, n_blocks=8).toPandas()
    assert len(got) == len(data)
    ref = pd.DataFrame(data, columns=["g", "o", "v"]).sort_values(["g", "o"])
    ref["cs"] = ref.groupby("g")["v"].cumsum()
    m = got.merge(ref, on=["g", "o"], suffixes=("", "_ref"))
    assert len(m) == len(data)
    assert (m["cs"] - m["cs_ref"]).abs().max() < 1e-9


def test_ordinal_is_dense_and_zero_based(spark):
    data = [("a", i) for i in range(500)] + [("b", 7), ("b", 3)]
    df = spark.createDataFrame(data, "g string, o long")
    got = ordinal(df, "g", "o", "pos", start=0, n_blocks=6).toPandas()
    a = got[got.g == "a"].sort_values("o")
    assert list(a["pos"]) == list(range(500))
    b = got[got.g == "b"].sort_values("o")
    assert list(b["pos"]) == [0, 1]


def test_null_group_is_one_group(spark):
    data = [(None, i, 1.0) for i in range(2000)] + [("a", i, 1.0) for i in range(50)] + [("a", None, 1.0)]
    df = spark.createDataFrame(data, "g string, o long, v double").repartition(5)
    got = ordinal(df, "g", "o", "pos", n_blocks=8).toPandas()
    assert sorted(got[got.g.isna()]["pos"]) == list(range(2000))
    a = got[got.g == "a"].sort_values("pos")
    assert list(a["pos"]) == list(range(51)) and a["o"].isna().iloc[0]  # a missing order value comes first


def test_blocks_split_heavy_first_values(spark):
    """All rows share the first order column: the tie-breaker splits them."""
    df = spark.createDataFrame([("g", 7, i) for i in range(4000)], "g string, o long, t long")
    from segment_lab.operators.ordered import block
    sizes = [r[1] for r in df.groupBy(block(df, ["o", "t"], 8).alias("b")).count().collect()]
    assert len(sizes) >= 7 and max(sizes) < 1000
    got = ordinal(df, "g", ["o", "t"], "pos", n_blocks=8).toPandas().sort_values("t")
    assert list(got["pos"]) == list(range(4000))


def test_text_and_date_orders(spark):
    import datetime
    data = [("g", f"{i:05d}x", datetime.date(2020, 1, 1) + datetime.timedelta(days=i)) for i in range(500)]
    df = spark.createDataFrame(data, "g string, s string, d date").repartition(3)
    for col in ("s", "d"):
        got = ordinal(df, "g", col, "pos", n_blocks=6).toPandas().sort_values(col)
        assert list(got["pos"]) == list(range(500))
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_salted_join_keeps_all_rows_and_spreads_a_hot_key(spark):
    from segment_lab.operators.joins import salted_join
    big = spark.createDataFrame([("hot", i) for i in range(3000)] + [("b", 1), ("none", 2), (None, 3)], "k string, i long")
    small = spark.createDataFrame([("hot", 1.0), ("b", 2.0)], "k string, w double")
    got = salted_join(big, small, "k", "left", 6)
    assert got.count() == 3003 and got.where("w is null").count() == 2 and got.where("w = 1.0").count() == 3000


def test_cut_points_come_from_a_bounded_sample(spark):
    """Whatever the rows and ties, a few rows a block reach the driver, and blocks are about equal."""
    from segment_lab.operators import ordered
    df = spark.range(0, 60_000, 1, 40).select((F.col("id") % 3 == 0).cast("int").alias("hot"), F.col("id").alias("i"))
    for order in (["i"], ["hot", "i"]):
        keys = [F.col(c).cast("double") for c in order]
        assert len(ordered.sample_values(df, keys, 64)) < 1.3 * 64 * ordered.SAMPLE_ROWS
        sizes = [r[1] for r in df.groupBy(ordered.block(df, order, 64).alias("b")).count().collect()]
        assert len(sizes) == 64 and max(sizes) < 2.2 * 60_000 / 64
    assert ordered.cut_points([None, None], 8) == [] and ordered.cut_points([3, 3, None, 3], 8) == [3]
