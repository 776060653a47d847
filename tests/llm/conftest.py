import random

import pytest

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use inside or in their results
    *[T.StructField(c, T.StringType()) for c in ("id", "batch", "row", "kept", "_text", "lang_pred", "score", "epoch",
                                                "_id", "_key", "key", "range", "w", "fp", "label", "n_words")]])


def sentence(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 8))) for _ in range(n))


def edge_rows():
    """Null ids, texts and columns, empty and blank texts, a very long one, copies, ties and repeated rows."""
    rng = random.Random(7)
    long_text = sentence(rng, 30_000)
    shared = sentence(rng, 80)
    plain = [sentence(rng, 60) for _ in range(6)]
    texts = [(1, plain[0]), (2, plain[0]), (3, plain[1]), (3, plain[1]), (3, plain[2]), (4, None), (5, ""), (6, " \n\t "),
             (7, long_text), (8, sentence(rng, 40) + " " + shared), (9, shared + "\n" + sentence(rng, 30)), (None, plain[0]),
             (None, "null id of its own " + plain[3]), (10, "one"), (11, "é" * 300), (12, "é" * 300 + "ü"), (13, "日本語のテキスト" * 40),
             (14, "\u0085   tail"), (15, plain[4][:200] + " x"), (16, plain[4][:199]), (17, "aa " * 400), (18, "Σίσυφος İstanbul")]
    langs = ["en", "de", None]
    return [(i, t, langs[k % 3], None if k % 4 == 0 else f"src{k % 2}", None if t is None else len(t), *["x"] * 16)
            for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def edge(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables") / "edge")
    spark.createDataFrame(edge_rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
