"""Table scans (S1): explicit schemas, NaN normalised to NULL once at the source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def nan_to_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Turn floating NaN into NULL so aggregates skip it (pandas semantics).

    Spark treats NaN as a value (``avg`` over a NaN is NaN, ``NaN >= 0`` is
    true); pandas skips it.  Converting once at the source keeps every
    operator downstream on plain SQL NULL semantics.
    """
    float_cols = {f.name for f in df.schema.fields
                  if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    targets = float_cols if cols is None else float_cols & set(cols)
    if not targets:
        return df
    return df.select([
        F.nanvl(F.col(c), F.lit(None).cast(df.schema[c].dataType)).alias(c)
        if c in targets else F.col(c)
        for c in df.columns
    ])


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
               fmt: str = "parquet", header: bool = True, index_col: bool = False,
               nan_as_null: bool = True) -> DataFrame:
    """Scan a table with an explicit schema.

    ``fmt="csv"`` reads a header CSV by its column names, whatever their
    order; a column of the schema that the file lacks is an error, and so is
    a value that does not fit its type.  ``index_col=True`` drops the first
    column (a written row index), matching ``read_csv(index_col=0)``.
    Parquet keeps its own schema unless one is given.
    """
    if fmt == "csv":
        raw = spark.read.option("header", header).option("mode", "FAILFAST").csv(path)
        if index_col:
            raw = raw.drop(raw.columns[0])
        if schema is not None:
            fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
            if not header:
                raw = raw.toDF(*[f.name for f in fields])
            raw = raw.select([F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in fields])
        df = raw
    else:
        reader = spark.read if schema is None else spark.read.schema(schema)
        df = reader.format(fmt).load(path)
        if index_col:
            df = df.drop(df.columns[0])
    return nan_to_null(df) if nan_as_null else df


def load_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> dict[str, DataFrame]:
    """Lazily bind the driver's parquet tables by name (no data is read)."""
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}
