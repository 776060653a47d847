"""The append stream under availableNow equals the batch restricted to closed windows."""
from pyspark.sql import functions as F

from support import rows


def test_stream_equals_closed_batch_windows(spark, small_dir):
    import __spark_entry__ as E
    import duckdb
    got = E.queries()["stream_segments"](spark, small_dir)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{small_dir}/events.parquet'")
    ref = con.execute(E.oracle_sql()["stream_segments"]).fetchall()
    g = rows(got, "window_start", "event_type", "n")
    r = sorted((a, c, d) for a, _, c, d, *_ in ref)
    assert g == r and len(g) > 0


def _batch(events):
    import datetime
    last = events.agg(F.max("ts")).first()[0] - datetime.timedelta(hours=1)
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("e"), "event_type", "n").filter(F.col("e") <= F.lit(last)).drop("e")


def test_stream_over_overlapping_files_and_folders(spark, small_dir, tmp_path):
    """Four part files whose times overlap, as one table folder, give the batch answer."""
    from segment_lab.plans.q_models import EVENTS_SCHEMA
    from segment_lab.streaming import run_stream_segments
    events = spark.read.parquet(f"{small_dir}/events.parquet")
    folder = str(tmp_path / "events.parquet")
    events.repartition(4, "event_id").write.parquet(folder)
    want = rows(_batch(events), "window_start", "event_type", "n")
    for path in (folder, f"{small_dir}/events.parquet"):
        got = run_stream_segments(spark, path, EVENTS_SCHEMA, "ts", ["event_type"], "6 hours", "1 hour", "t")
        assert rows(got, "window_start", "event_type", "n") == want and len(want) > 0


def test_scratch_is_deleted(spark):
    import os
    from segment_lab.session import drop_scratch, scratch_path
    path = scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    assert os.path.exists(path.removeprefix("file:"))
    drop_scratch()
    assert not os.path.exists(path.removeprefix("file:"))


def test_counted_segments_over_out_of_order_files(spark, small_dir, tmp_path):
    """Four files of mixed times, several micro-batches: segments are those of the whole table in time order."""
    from segment_lab.plans.q_models import EVENTS_SCHEMA
    from segment_lab.streaming import run_count_segments
    events = spark.read.parquet(f"{small_dir}/events.parquet")
    events = events.withColumn("value", F.when(F.col("event_id") % 11 != 0, F.col("value")))  # some values are missing
    folder = str(tmp_path / "events.parquet")
    events.repartition(4, "event_id").write.parquet(folder)
    want = {}
    for r in events.orderBy("user_id", "ts", "event_id").collect():
        want.setdefault(r["user_id"], []).append(r["value"])
    for batches in (1, 3):
        got = run_count_segments(spark, folder, EVENTS_SCHEMA, "ts", ["ts", "event_id"], ["user_id"], 7, "t", batches=batches).collect()
        assert sorted((r["user_id"], r["chunk"]) for r in got) == sorted((u, k) for u, v in want.items() for k in range(len(v) // 7))
        for r in got:
            own = [x for x in want[r["user_id"]][7 * r["chunk"]:7 * r["chunk"] + 7] if x is not None]
            assert r["n"] == 7 and (r["min"], r["max"]) == (min(own), max(own))
            assert abs(r["mean"] - sum(own) / len(own)) < 1e-9 and abs(r["rms"] - (sum(x * x for x in own) / len(own)) ** 0.5) < 1e-9
