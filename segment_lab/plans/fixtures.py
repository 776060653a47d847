"""Roles of the driver's tables (see FIXTURES.md section 3).

Each role is a DataFrame derived from the given parquet tables by Spark, plus
the same derivation as a SQL common table expression for the oracles.

* tracks   := orders   (track = order, playlist = priority, phase = status,
                         duration = total price, process flag = status <> 'P')
* ratings  := lineitem aggregated per order (a second rating source)
* signal   := events   (file = user, channel = event type, sample index =
                         position in the channel by (ts, event_id))
* texts    := documents (segments of 30 words)
* classes  := labels    (3-way class low / hi / hi_tox)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import ordinal
from ..sources.tables import nan_to_null

PHASES = ["F", "O", "P"]
SEGMENT_WORDS = 30
DIGITS = "0123456789"


def table(spark: SparkSession, sf_dir: str, name: str, where: str | None = None) -> DataFrame:
    """A given table; ``where`` filters the raw columns, so that it reaches the Parquet scan."""
    raw = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if where is None:
        return nan_to_null(raw)
    # NaN passes a raw comparison; as NULL it does not
    return nan_to_null(raw.where(where)).where(where)


def tracks(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("track_no"),
                    F.col("o_orderpriority").alias("playlist"),
                    F.col("o_orderstatus").alias("phase"),
                    F.floor("o_totalprice").alias("duration_s"),
                    (F.floor("o_totalprice") / 60.0).alias("duration_m"),
                    (F.col("o_orderstatus") != "P").alias("process"),
                    F.col("o_custkey").alias("artist_id"))


TRACKS_SQL = """tracks AS (SELECT o_orderkey AS track_no, o_orderpriority AS playlist,
  o_orderstatus AS phase, floor(o_totalprice)::BIGINT AS duration_s,
  floor(o_totalprice) / 60.0 AS duration_m,
  o_orderstatus <> 'P' AS process, o_custkey AS artist_id FROM orders)"""


def ratings(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    r = li.groupBy("l_orderkey").agg(F.avg("l_discount").alias("valence"),
                                     F.avg("l_tax").alias("arousal"))
    return r.join(o, r.l_orderkey == o.o_orderkey).select(
        F.col("l_orderkey").alias("track_no"), F.col("o_orderpriority").alias("playlist"),
        "valence", "arousal")


RATINGS_SQL = """ratings AS (SELECT r.l_orderkey AS track_no, o.o_orderpriority AS playlist,
  r.valence, r.arousal FROM (SELECT l_orderkey, avg(l_discount) AS valence, avg(l_tax) AS arousal
  FROM lineitem GROUP BY l_orderkey) r JOIN orders o ON r.l_orderkey = o.o_orderkey)"""


def signal(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    s = e.select(F.col("user_id").alias("file"), "ts", "event_id",
                 F.col("event_type").alias("channel"), "value")
    # samples are numbered per channel, so the channels of a file share their positions
    return ordinal(s, ["file", "channel"], ["ts", "event_id"], "idx", start=0)


SIGNAL_SQL = """signal AS (SELECT user_id AS file, ts, event_id, event_type AS channel, value,
  row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS idx FROM events)"""


def classes(spark, d) -> DataFrame:
    lab = table(spark, d, "labels")
    return lab.select("doc_id", F.when(F.col("quality") == 0, "low")
                      .when(F.col("toxic") == 1, "hi_tox").otherwise("hi").alias("cls"))


CLASSES_SQL = """classes AS (SELECT doc_id, CASE WHEN quality = 0 THEN 'low'
  WHEN toxic = 1 THEN 'hi_tox' ELSE 'hi' END AS cls FROM labels)"""


def doc_features(spark, d) -> DataFrame:
    """Per-document text measures joined to the 3-way class (T1-T5 input)."""
    # labelled texts only: the class joins before any text is split
    docs = table(spark, d, "documents").select("doc_id", "text").join(classes(spark, d), "doc_id")
    words = F.split(F.col("text"), " ")
    return docs.select(
        "doc_id",
        F.length("text").cast("double").alias("chars"),
        F.size(words).cast("double").alias("words"),
        F.try_divide(F.size(F.array_distinct(words)), F.size(words)).alias("unique_ratio"),
        F.try_divide(F.length("text") - F.length(F.translate("text", DIGITS, "")), F.length("text"))
         .alias("digit_share"),
        F.size(F.split(F.col("text"), "\n")).cast("double").alias("lines"),
        F.try_divide(F.size(words), F.length("text") - F.length(F.translate("text", DIGITS, ""))).alias("words_per_digit"), "cls")


#: The last measure is NULL for a text without a digit.
DOC_FEATURES = ["chars", "words", "unique_ratio", "digit_share", "lines", "words_per_digit"]

DOC_FEATURES_SQL = """doc_features AS (SELECT d.doc_id,
  length(text)::DOUBLE AS chars,
  len(string_split(text, ' '))::DOUBLE AS words,
  len(list_distinct(string_split(text, ' '))) / len(string_split(text, ' ')) AS unique_ratio,
  length(regexp_replace(text, '[^0-9]', '', 'g')) / nullif(length(text), 0) AS digit_share,
  len(string_split(text, chr(10)))::DOUBLE AS lines,
  len(string_split(text, ' ')) / nullif(length(regexp_replace(text, '[^0-9]', '', 'g')), 0) AS words_per_digit,
  c.cls
  FROM documents d JOIN """ + "(SELECT doc_id, CASE WHEN quality = 0 THEN 'low' WHEN toxic = 1 THEN 'hi_tox' ELSE 'hi' END AS cls FROM labels)" + """ c ON d.doc_id = c.doc_id)"""
