"""Extraction jobs that do only what is not done yet, and go on after a failure (S3, S5, G6 as one job).

A job's folder holds ``data``, partitioned by step and group, and
``manifest``, one row an item with what became of it.  A step processes the
pending items of one hash batch: it overwrites its own data partition, then adds its
manifest partition, which is what makes the step count.  A step
that failed in between left no manifest; the next run takes its number again
and overwrites what it left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.randomness import seeded_hash
from ..session import materialize
from .catalog import job_status_files, pending_items


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def manifest(spark: SparkSession, root: str, wanted: DataFrame, key: str) -> DataFrame:
    """``(<key>, n_segments, status, step)`` of all steps that were finished."""
    path = root + "/manifest"
    kind = wanted.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_segments long, status string, step int"
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def extracted(spark: SparkSession, root: str) -> DataFrame:
    """The segments of all finished steps (what a failed step left is not read)."""
    finished = [r[0] for r in spark.read.parquet(root + "/manifest").select("step").distinct().collect()]  # partition names
    return spark.read.parquet(root + "/data").where(F.col("step").isin(finished))


def extract(spark: SparkSession, wanted: DataFrame, key: str, build: Callable[[DataFrame], DataFrame], root: str, group: str,
            batches: int = 1) -> DataFrame:
    """Run the job over ``wanted`` (unique ``key``, the columns that ``build`` reads) and tell each item's status.

    ``build`` maps pending items to segment rows, among whose columns are
    ``key`` and ``group``.  An item is ``exists`` if an earlier run made
    segments of it, ``success`` if this one did, and ``error`` if it has no
    full segment (it is tried again by the next run).  Items go through in
    ``batches`` by a hash of their key; what was finished before a failure is
    kept.  Without pending items nothing is built or written.
    """
    before = materialize(manifest(spark, root, wanted, key).select(key, "status", "step", "n_segments"))
    step = (before.agg(F.max("step")).first()[0] or 0) + 1
    done = before.where("status = 'success'").select(key, "n_segments").distinct()
    todo = pending_items(wanted, done, key)
    share = F.pmod(F.conv(F.substring(seeded_hash("batch", key), 1, 8), 16, 10).cast("long"), F.lit(batches))
    ended = step
    for k in range(batches):
        part = todo.where(share == k)
        if part.limit(1).count() == 0:
            continue
        # the whole folder of the step is replaced, with whatever a failed run left in it
        rows = build(part)
        rows.write.mode("overwrite").partitionBy(group).parquet(f"{root}/data/step={ended}")
        made = spark.read.schema(rows.schema).parquet(f"{root}/data/step={ended}")
        status = job_status_files(part.select(key), done.select(key).limit(0), made.select(key), key)
        status.select(key, F.col("n_segments").cast("long").alias("n_segments"), "status").write.mode("overwrite").parquet(f"{root}/manifest/step={ended}")
        ended += 1
    told = manifest(spark, root, wanted, key).where(F.col("step") >= step).select(key, "n_segments", "status")
    known = wanted.select(key).join(done, key).select(key, "n_segments", F.lit("exists").alias("status"))
    return known.unionByName(told)
