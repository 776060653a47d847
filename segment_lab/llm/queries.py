"""The registered corpus queries: each operator over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from . import byte_repeats, curve, language, licenses, mixing, packing, prefix_trie, quality, simhash, substrings, survival, warc, winnowing
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def query(sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return register


@query()
def op9_simhash(spark, sf_dir):
    """Near-duplicate components of all documents by SimHash and Golay keys."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("text_key", "root")


@query(r"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i + 1, i + 13), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 12, 0))) AS i FROM words)),
dead AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM windows) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM dead),
kept AS (
  SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.p) AS t, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM words) x
  ANTI JOIN gone USING (doc_id, p) GROUP BY x.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
""")
def op2_substrings(spark, sf_dir):
    """Words left of each document once windows of smaller ids are removed."""
    out = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query()
def op1_packing(spark, sf_dir):
    """All documents as token pieces packed into sequences of 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary())


@query("""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS s FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY s) AS m FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, s AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> m THEN m END AS refers_to
FROM r
""")
def op6_warc(spark, sf_dir):
    """All pages written to WARC archives with revisits, and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query()
def op8_mixing(spark, sf_dir):
    """All documents mixed over a domain-language-source tree, one row per copy taken."""
    out = mixing.mix(table(spark, sf_dir, "documents"), mixing.document_levels())
    return out.select("doc_id", mixing.default_domain().alias("domain"), "lang", "source", "epoch", "n_tokens")


@query()
def op4_language(spark, sf_dir):
    """Language of every document by cross-parsing against learned text."""
    return language.identify(table(spark, sf_dir, "documents"))


@query()
def op3_quality(spark, sf_dir):
    """Base counts and line-labelling verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@query(licenses.oracle())
def op10_licenses(spark, sf_dir):
    """Licence labels of every document by diagonal voting."""
    return licenses.scan(table(spark, sf_dir, "documents"))


@query()
def op7_winnowing(spark, sf_dir):
    """Winnowing fingerprints of every document and of its edited text."""
    out = winnowing.fingerprints(table(spark, sf_dir, "documents"))
    return out.withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")


@query("""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i, md5(substring(x, 2 * i + 1, 400)) AS g
      FROM (SELECT doc_id, x, unnest(range(greatest(len(x) // 2 - 199, 0))) AS i FROM h)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS n FROM w) WHERE n > 1),
g AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM r),
k AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM g),
spans AS (SELECT doc_id, s, min(i) AS a, max(i) + 200 AS z FROM k GROUP BY doc_id, s),
pieces AS (
  SELECT doc_id, s, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM spans),
kept AS (
  SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS tail,
         string_agg(substring(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY s) AS y
  FROM pieces JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(y || substring(x, 2 * tail + 1), x))) AS kept_sha256
FROM h LEFT JOIN kept USING (doc_id)
""")
def op5_suffixes(spark, sf_dir):
    """Bytes left of each document once every repeated 200-byte string is removed."""
    out = byte_repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op11_curve(spark, sf_dir):
    """All documents as token pieces laid along a Hilbert curve of their vectors, in sequences of 1024 tokens."""
    return curve.pack_along_curve(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query(r"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
verdicts AS (
  SELECT doc_id, part, CAST(len(w) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 80 * len(w) AS INT)
         + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS INT) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
         + 16 * CAST(coalesce(least < doc_id, least IS NOT NULL) AS INT) AS failed
  FROM (SELECT *, min(doc_id) OVER (PARTITION BY t) AS least FROM words)),
marks AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
counts AS (
  SELECT part, failed, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM verdicts LEFT JOIN marks USING (doc_id) GROUP BY part, failed),
letters(l, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
perms AS (
  SELECT v.l || w.l || x.l || y.l || z.l AS filter_order, [v.b, w.b, x.b, y.b, z.b] AS bits
  FROM letters v, letters w, letters x, letters y, letters z
  WHERE w.b <> v.b AND x.b NOT IN (v.b, w.b) AND y.b NOT IN (v.b, w.b, x.b) AND z.b NOT IN (v.b, w.b, x.b, y.b)),
steps AS (
  SELECT filter_order, CAST(s AS INT) AS step, bits[s] AS bit, CAST(coalesce(list_sum(bits[1:s - 1]), 0) AS INT) AS before
  FROM perms, (SELECT unnest(range(1, 6)) AS s)),
found AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN failed & (before + bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN failed & before = 0 AND failed & bit > 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN failed & before > 0 AND failed & bit > 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN failed = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN failed & before = 0 AND failed & bit > 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN failed & before = 0 AND failed & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM counts, steps GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM found
""")
def op12_survival(spark, sf_dir):
    """What five filters remove in each of their 120 orders, by language."""
    return survival.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(r"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p
  FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (
  SELECT c, count(*) AS n, c - c % 20 AS b, xor(list_reduce(
      flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: [CAST(ord(s) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
      lambda a, o: CASE WHEN o >= 0 THEN xor(a, o) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, CAST(4294967295 AS BIGINT)),
      4294967295) % 4 AS h
  FROM t GROUP BY c),
plan AS (SELECT s.*, least(s.h, coalesce(z.n, 0)) AS k, least(s.h, coalesce(z.n, 0)) + greatest(s.n - s.h, 0) AS len FROM sizes s LEFT JOIN sizes z ON z.c = s.b),
built AS (
  SELECT plan.c, p + 1 AS d, r, x FROM plan JOIN t ON t.c = plan.b AND p < h
  UNION ALL SELECT plan.c, k + p - h + 1, r, x FROM plan JOIN t ON t.c = plan.c AND p >= h),
pre AS (
  SELECT c, d, len(list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda s: s <> '')) AS w,
         md5(string_agg(md5(length(r) || ':' || r || x), '') OVER (PARTITION BY c ORDER BY d)) AS key FROM built
  UNION ALL SELECT c, 0, 0, 'root' FROM plan),
node AS (
  SELECT key, d, min(c) AS conv, count(*) AS n, any_value(w) AS w, max(len) = d AS leaf,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE len = d), '')) AS ends
  FROM pre JOIN plan USING (c) GROUP BY key, d),
parent AS (SELECT y.key, p.key AS up, z.conv FROM node y JOIN pre p ON p.c = y.conv AND p.d = y.d - 1 JOIN node z ON z.key = p.key),
children AS (SELECT up AS key, count(*) AS n_children FROM parent GROUP BY up),
below AS (
  SELECT p.key, sum(CAST(y.leaf AS INT)) AS n_leaves, sum((y.n - 1) * y.w) AS saved
  FROM node y JOIN pre p ON p.c = y.conv AND p.d <= y.d GROUP BY p.key)
SELECT node.conv AS conv_id, CAST(node.d AS BIGINT) AS depth, parent.conv AS parent_conv_id, node.n AS n_convs,
       coalesce(n_children, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends AS ends_sha256
FROM node LEFT JOIN parent USING (key) LEFT JOIN children USING (key) JOIN below USING (key)
""")
def op13_prefixes(spark, sf_dir):
    """Every distinct prefix of all rebuilt conversations, with what sharing it saves."""
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))
