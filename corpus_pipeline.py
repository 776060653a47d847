"""The corpus pipeline: identify, deduplicate, balance and pack the documents table.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, works on
all rows its predecessor kept, and all but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from segment_lab.llm import byte_repeats, language, mixing, packing, simhash
from segment_lab.llm.common import new_scratch, table
from segment_lab.llm.queries import vocabulary
from segment_lab.session import ship_package


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: texts without a language go."""
    ship_package(spark)
    return language.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of each group of near-duplicates the smallest id stays."""
    ship_package(spark)
    return simhash.keep_first(docs)


def drop_repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: 200-byte strings that occur again are cut out of the texts."""
    ship_package(spark)
    return byte_repeats.keep_unrepeated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: rows are repeated or left out so that tokens follow the target weights."""
    return mixing.mix(docs, mixing.document_levels()).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: token pieces and their places in sequences."""
    ship_package(spark)
    return packing.pack_documents(docs, vocabulary())


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_bytes", drop_repeated_bytes),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The stages learn a model, suffix sort and tokenise: SQL cannot state them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
