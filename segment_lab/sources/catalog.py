"""File catalogs, skip-done logic, materialisation and segment sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_catalog(spark: SparkSession, root: str, glob: str = "*.mp3") -> DataFrame:
    """List files under a directory tree.

    Only ``path`` and ``length`` are selected, so the binary-file source never
    reads file contents; listing is distributed by Spark's file index.
    """
    return (spark.read.format("binaryFile")
            .option("pathGlobFilter", glob)
            .option("recursiveFileLookup", "true")
            .load(root)
            .select("path", "length"))


def pending_items(wanted: DataFrame, done: DataFrame, key: str | list[str],
                  done_key: str | list[str] | None = None) -> DataFrame:
    """Wanted items that are not done yet (S5 / J5): a left anti join."""
    keys = [key] if isinstance(key, str) else list(key)
    dkeys = keys if done_key is None else ([done_key] if isinstance(done_key, str) else list(done_key))
    d = done.select([F.col(a).alias(b) for a, b in zip(dkeys, keys)]).distinct()
    return wanted.join(d, on=keys, how="left_anti")


def job_status_files(wanted: DataFrame, done: DataFrame, segments: DataFrame,
                     key: str) -> DataFrame:
    """Per-item status: ``exists`` / ``success`` / ``error``.

    ``exists``: already in ``done``.  Otherwise ``success`` when the item
    produced at least one full segment, else ``error`` (a file shorter than
    one segment).  ``segments`` holds the number of full segments per item
    (``n_segments``), or one row per segment.  Errors are rows, not task
    failures.
    """
    d = done.select(F.col(key)).distinct().withColumn("_done", F.lit(True))
    n = segments if "n_segments" in segments.columns else segments.groupBy(key).agg(F.count(F.lit(1)).alias("n_segments"))
    w = wanted.select(key).distinct()
    return (w.join(d, key, "left").join(n.select(key, "n_segments"), key, "left")
            .select(key,
                    F.coalesce("n_segments", F.lit(0)).alias("n_segments"),
                    F.when(F.col("_done"), F.lit("exists"))
                     .when(F.coalesce("n_segments", F.lit(0)) > 0, F.lit("success"))
                     .otherwise(F.lit("error")).alias("status")))


def materialise(spark: SparkSession, path: str, build: Callable[[], DataFrame],
                mode: str = "errorifexists") -> DataFrame:
    """Read the table at ``path`` if present, else build, write and read it back.

    The read-back cuts lineage: later jobs scan the written parquet, so a lost
    executor recomputes from files, not from the whole upstream plan.
    """
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")):
        build().write.mode("overwrite" if fs.exists(hpath) else mode).parquet(path)
    return spark.read.parquet(path)


def write_segments(df: DataFrame, path: str, partition_by: str | list[str] = "playlist",
                   mode: str = "overwrite", max_records_per_file: int = 5_000_000) -> None:
    """Segment-feature sink (S3): one directory per group, parquet files inside.

    No shuffle is added: each task writes its own slice of every group (the
    writer sorts by the partition columns inside the task), so a hot group is
    spread over all tasks instead of landing in one.
    """
    cols = [partition_by] if isinstance(partition_by, str) else list(partition_by)
    (df.write.mode(mode).option("maxRecordsPerFile", max_records_per_file)
       .partitionBy(*cols).parquet(path))
