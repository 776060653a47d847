"""Sources and sinks: file catalog, pending items, partitioned sink, materialise-if-absent."""
import os
import tempfile

from support import rows
from segment_lab.sources.catalog import file_catalog, materialise, pending_items, write_segments
from segment_lab.functions.columns import path_keys


def test_partitioned_sink_and_materialise(spark):
    out = tempfile.mkdtemp(prefix="segsink_", dir="/tmp")
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 3.0)], "playlist string, chunk int, v double")
    write_segments(df, out + "/segs")
    assert sorted(p for p in os.listdir(out + "/segs") if p.startswith("playlist=")) == ["playlist=a", "playlist=b"]
    back = spark.read.parquet(out + "/segs")
    assert rows(back, "playlist", "chunk", "v") == [("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 3.0)]
    calls = []

    def build():
        calls.append(1)
        return df
    m1 = materialise(spark, out + "/mat", build)
    m2 = materialise(spark, out + "/mat", build)
    assert len(calls) == 1 and m1.count() == m2.count() == 3


def test_catalog_pending_and_path_keys(spark, small_dir):
    cat = file_catalog(spark, small_dir, "*.parquet")
    names = {os.path.basename(r["path"]) for r in cat.collect()}
    assert "lineitem.parquet" in names and "orders.parquet" in names
    wanted = spark.createDataFrame([("x",), ("y",), ("z",)], "k string")
    done = spark.createDataFrame([("y",)], "k string")
    assert rows(pending_items(wanted, done, "k")) == [("x",), ("z",)]
    p = spark.createDataFrame([("/r/a/b/c/d/pl1/12-abc-song.mp3",)], "path string")
    r = path_keys(p, "path").collect()[0].asDict()
    assert r["group"] == "pl1" and r["order"] == 12 and r["item_id"] == "abc"


def test_csv_is_read_by_its_header(spark, tmp_path):
    import pytest
    from segment_lab.sources.tables import read_table
    path = tmp_path / "t.csv"
    path.write_text(",b,a,g\n0,2.5,1,x\n1,NaN,3,\n")
    df = read_table(spark, str(path), "a long, b double, g string", fmt="csv", index_col=True)
    assert rows(df, "a", "b", "g") == [(1, 2.5, "x"), (3, None, None)] and df.columns == ["a", "b", "g"]
    with pytest.raises(Exception, match="(?i)zz"):
        read_table(spark, str(path), "zz long", fmt="csv").collect()
    with pytest.raises(Exception):
        read_table(spark, str(path), "g long", fmt="csv").collect()
    bare = tmp_path / "bare.csv"
    bare.write_text("1,x\n2,y\n")
    assert rows(read_table(spark, str(bare), "a long, g string", fmt="csv", header=False)) == [(1, "x"), (2, "y")]


def test_incremental_extraction(spark, tmp_path):
    """A second run does nothing, a failed one resumes, errors are tried again, and no segment is stored twice."""
    import os

    from pyspark.sql import functions as F

    from segment_lab.sources.incremental import extract, extracted
    root = str(tmp_path / "job")
    items = spark.createDataFrame([(i, f"g{i % 3}", i % 5) for i in range(40)], "item long, grp string, size int")
    calls = []

    def build(df, fail=False):
        calls.append(df.count())
        if fail and len(calls) > 2:
            # a part of the step is written, then it breaks
            df.limit(1).withColumn("chunk", F.lit(99)).withColumn("step", F.lit(3)).select("item", "grp", "chunk", "step") \
                .write.mode("append").partitionBy("step", "grp").parquet(root + "/data")
            raise RuntimeError("lost")
        return df.where("size > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("size") - 1))).select("item", "grp", "chunk")
    try:
        extract(spark, items, "item", lambda df: build(df, True), root, "grp", batches=4)
        raise AssertionError("it should have failed")
    except RuntimeError:
        pass
    finished = sum(calls[:2])
    calls.clear()
    got = {r["item"]: (r["status"], r["n_segments"]) for r in extract(spark, items, "item", build, root, "grp", batches=4).collect()}
    assert len(got) == 40 and all((s == "error") == (i % 5 == 0) and n == i % 5 for i, (s, n) in got.items())
    assert 0 < sum(s == "exists" for s, _ in got.values()) <= finished
    assert rows(extracted(spark, root), "item", "chunk") == sorted((i, c) for i in range(40) for c in range(i % 5))
    good = items.where("size > 0")
    calls.clear()
    before = sorted(os.listdir(root + "/manifest"))
    again = extract(spark, good, "item", build, root, "grp", batches=4)
    assert {r["status"] for r in again.collect()} == {"exists"} and not calls and sorted(os.listdir(root + "/manifest")) == before
    longer = items.withColumn("size", F.when(F.col("item") == 5, 2).otherwise(F.col("size")))
    retried = {r["item"]: r["status"] for r in extract(spark, longer, "item", build, root, "grp").collect()}
    assert retried[5] == "success" and retried[10] == "error" and retried[1] == "exists"
