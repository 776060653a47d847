"""Segmentation of a stream (G7): a fixed-length segment is a tumbling window.

``append`` mode with a watermark emits a window only once it is closed
(window end <= max event time - delay); late rows are dropped.  That is the
streaming form of "drop the incomplete tail".  State is kept in the
checkpoint folder, so a restarted query resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path


def stream_segments(stream_df: DataFrame, ts: str, keys: list[str], size: str,
                    delay: str, value: str = "value") -> DataFrame:
    """Windowed descriptors per (window, keys) of a streaming DataFrame."""
    t = stream_df.schema[ts].dataType
    src = stream_df
    if isinstance(t, T.TimestampNTZType):
        # withWatermark needs TIMESTAMP (session zone is UTC).
        src = src.withColumn(ts, F.col(ts).cast("timestamp"))
    v = F.col(value)
    return (src.withWatermark(ts, delay)
               .groupBy(F.window(ts, size).alias("w"), *keys)
               .agg(F.count(F.lit(1)).alias("n"),
                    F.avg(v).alias("mean"),
                    F.min(v).alias("min"),
                    F.max(v).alias("max"),
                    F.sqrt(F.avg(v * v)).alias("rms"))
               .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                       *keys, "n", "mean", "min", "max", "rms"))


def open_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A file stream over one table: a folder of part files, or a single file.

    A file source reads folders only, so a single file is its parent folder
    narrowed to the file's name.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(schema)
    if fs.getFileStatus(hadoop).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", hadoop.getName()).parquet(hadoop.getParent().toString())


def run_stream_segments(spark: SparkSession, path: str, schema: T.StructType, ts: str, keys: list[str],
                        size: str, delay: str, name: str, value: str = "value") -> DataFrame:
    """Drive the stream over all files present now, write parquet, read it back.

    ``availableNow`` takes all files in one micro-batch and stops.  Files
    whose times overlap must not be split over several batches: the watermark
    moves between batches and would drop the later files' rows as late.  The
    sink and its checkpoint live under the session's shared checkpoint folder
    and are deleted at the end; the returned DataFrame reads the sink (no
    result goes through the driver).
    """
    out = scratch_path(spark, f"stream_{name}")
    q = (stream_segments(open_stream(spark, path, schema), ts, keys, size, delay, value)
         .writeStream.outputMode("append").format("parquet")
         .option("checkpointLocation", out + "/_checkpoint")
         .option("path", out + "/data")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(q_schema(spark, keys, schema)).parquet(out + "/data")


def q_schema(spark: SparkSession, keys: list[str], schema: T.StructType) -> T.StructType:
    fields = [T.StructField("window_start", T.TimestampType()),
              T.StructField("window_end", T.TimestampType())]
    fields += [T.StructField(k, schema[k].dataType) for k in keys]
    fields += [T.StructField("n", T.LongType(), False)] + \
              [T.StructField(c, T.DoubleType()) for c in ("mean", "min", "max", "rms")]
    return T.StructType(fields)
