"""Scans, projections, joins, aggregations, windows and segmentation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..operators import describe as D
from ..operators import joins as J
from ..operators import segments as G
from ..operators import timeline as W
from ..sources import catalog as S
from ..sources.tables import read_table
from ..session import materialize
from . import fixtures as X
from .fixtures import (CLASSES_SQL, RATINGS_SQL, SIGNAL_SQL, TRACKS_SQL)
from .registry import query

ORDERS_SCHEMA = T.StructType([
    T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()),
    T.StructField("o_orderstatus", T.StringType()), T.StructField("o_totalprice", T.DoubleType()),
    T.StructField("o_orderdate", T.TimestampNTZType()), T.StructField("o_orderpriority", T.StringType()),
])

LI_FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# ---------------------------------------------------------------- sources ---

@query("scan_tracks", _with(TRACKS_SQL) + "SELECT track_no, playlist, phase, duration_s FROM tracks")
def scan_tracks(spark, d):
    """Explicit-schema scan, projected to the track role."""
    o = read_table(spark, f"{d}/orders.parquet", ORDERS_SCHEMA)
    return o.select(F.col("o_orderkey").alias("track_no"), F.col("o_orderpriority").alias("playlist"),
                    F.col("o_orderstatus").alias("phase"), F.floor("o_totalprice").alias("duration_s"))


LI_META = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"]


@query("feature_columns", """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
  l_returnflag, l_linestatus FROM lineitem""")
def feature_columns(spark, d):
    """P3 + P4: features chosen from the schema by an exclusion list, then split by
    type into numeric and categorical; the scan reads only the chosen columns."""
    li = X.table(spark, d, "lineitem")
    cand = [c for c in li.columns if c not in LI_META]
    numeric, categorical = C.split_types(li, cand)
    assert numeric == C.feature_columns(li, LI_META)
    return li.select("l_orderkey", "l_linenumber", *numeric, *categorical)


@query("pending_items", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_items(spark, d):
    """Documents not yet labelled."""
    docs = X.table(spark, d, "documents").select("doc_id", "lang")
    return S.pending_items(docs, X.table(spark, d, "labels"), "doc_id")


TEXT_SEG_SQL = """words AS (SELECT doc_id, lang, unnest(string_split(text, ' ')) AS w,
    generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM documents),
  segs AS (SELECT doc_id, lang, (pos // 30)::INTEGER AS chunk, count(*) AS n_words,
    avg(length(w)::DOUBLE) AS mean_word_len, stddev_samp(length(w)::DOUBLE) AS std_word_len,
    sum(length(w))::DOUBLE AS n_chars,
    sum(length(regexp_replace(w, '[^0-9]', '', 'g')))::DOUBLE / nullif(sum(length(w)), 0) AS digit_share,
    count(DISTINCT w) / count(*) AS unique_ratio
    FROM words GROUP BY doc_id, lang, chunk HAVING count(*) = 30)"""

TEXT_FEATS = ["mean_word_len", "std_word_len", "n_chars", "digit_share", "unique_ratio"]


def _text_segments(spark, d):
    docs = X.table(spark, d, "documents")
    return G.text_segments(docs, "doc_id", "text", X.SEGMENT_WORDS, keep=["lang"])


@query("text_segments", _with(TEXT_SEG_SQL) + "SELECT * FROM segs")
def text_segments(spark, d):
    """G3 on texts: whole documents cut into 30-word segments, tail dropped."""
    return _text_segments(spark, d)


@query("song_means", _with(TEXT_SEG_SQL) + "SELECT doc_id, " + ", ".join(
    f"avg({c}) AS {c}" for c in TEXT_FEATS) + ", count(*) AS n_segments FROM segs GROUP BY doc_id")
def song_means(spark, d):
    """Segment table to one row per document (feature means)."""
    return G.song_means(_text_segments(spark, d), TEXT_FEATS, key="doc_id")


# ------------------------------------------------------------ projections ---

@query("flag_filter", _with(TRACKS_SQL) + "SELECT track_no, playlist, phase FROM tracks WHERE process")
def flag_filter(spark, d):
    """Keep flagged tracks (pushed into the scan as a status filter)."""
    return C.flag_filter(X.tracks(spark, d), "process").select("track_no", "playlist", "phase")


@query("group_selector", _with(TRACKS_SQL) +
       "SELECT playlist, count(*) AS n FROM tracks WHERE playlist <> '5-LOW' GROUP BY playlist")
def group_selector(spark, d):
    """All playlists but one."""
    t = C.select_group(X.tracks(spark, d), "playlist", "most", exclude="5-LOW")
    return D.group_size(t, "playlist")


@query("path_keys", """SELECT page_id, string_split(url, '/')[4] AS "group",
  TRY_CAST(string_split_regex(string_split(url, '/')[-1], '[?#]')[1] AS INTEGER) AS "order",
  string_split_regex(string_split(url, '/')[-1], '[?#]')[2] AS item_id FROM pages""")
def path_keys(spark, d):
    """P5: language folder, numeric page and query/fragment parsed from URLs."""
    p = X.table(spark, d, "pages").select("page_id", "url")
    return C.path_keys(p, "url", group_part=3, name_sep="[?#]").drop("url")


@query("path_rewrite", "SELECT page_id, replace(url, 'http://', 'https://') AS url FROM pages")
def path_rewrite(spark, d):
    """Input path to output path by substring replacement."""
    p = X.table(spark, d, "pages").select("page_id", "url")
    return C.path_rewrite(p, "url", "http://", "https://")


SPEND_SQL = """spend AS (SELECT c.c_custkey, c.c_acctbal, s.spend FROM customer c LEFT JOIN
  (SELECT o_custkey, sum(floor(o_totalprice))::BIGINT AS spend FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey) s
  ON c.c_custkey = s.o_custkey)"""


def _spend(spark, d):
    c = X.table(spark, d, "customer").select("c_custkey", "c_acctbal")
    s = (X.table(spark, d, "orders").filter(F.col("o_orderstatus") == "P").groupBy("o_custkey")
         .agg(F.sum(F.floor("o_totalprice")).alias("spend")))
    return c.join(s, c.c_custkey == s.o_custkey, "left").drop("o_custkey")


@query("drop_nulls", _with(SPEND_SQL) + "SELECT c_custkey, c_acctbal, spend FROM spend WHERE spend IS NOT NULL")
def drop_nulls(spark, d):
    """Customers without a pending order have a NULL spend and are dropped."""
    return C.drop_nulls(_spend(spark, d))


TIMELINE_SQL = """tl AS (SELECT playlist, track_no, phase, duration_s,
  (sum(duration_s) OVER w - duration_s) / 3600.0 AS start_time,
  sum(duration_s) OVER w / 3600.0 AS end_time FROM tracks
  WINDOW w AS (PARTITION BY playlist ORDER BY track_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def _timeline(spark, d):
    t = X.tracks(spark, d).select("playlist", "track_no", "phase", "duration_s")
    return W.timeline(t, "playlist", "track_no", "duration_s")


@query("timeline", _with(TRACKS_SQL, TIMELINE_SQL) + "SELECT * FROM tl")
def timeline(spark, d):
    """Each track's start and end hour on its playlist's clock."""
    return _timeline(spark, d)


@query("hour_label", _with(TRACKS_SQL, TIMELINE_SQL) + """SELECT track_no,
  printf('%d:%02d', (h * 60 + m) // 60, (h * 60 + m) % 60) AS label,
  printf('%d:%02d', h, m) AS label_compat FROM (SELECT track_no, floor(start_time)::BIGINT AS h,
  round_even((start_time - floor(start_time)) * 60, 0)::BIGINT AS m FROM tl)""")
def hour_label(spark, d):
    """Start hour as h:mm (carried) and the reference's h:60 form."""
    t = _timeline(spark, d)
    return t.select("track_no", C.hour_label("start_time").alias("label"),
                    C.hour_label("start_time", compat=True).alias("label_compat"))


@query("phase_spans", _with(TRACKS_SQL, TIMELINE_SQL) +
       "SELECT playlist, phase, min(start_time) AS span_start, max(end_time) AS span_end FROM tl GROUP BY ALL")
def phase_spans(spark, d):
    """First start and last end of every (playlist, phase)."""
    return W.phase_spans(_timeline(spark, d), "playlist", "phase")


# ------------------------------------------------------------------ joins ---

@query("semi_join_catalog", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_join_catalog(spark, d):
    """Documents that have a label (isin on a table)."""
    return J.semi_join(X.table(spark, d, "documents").select("doc_id", "lang"),
                       X.table(spark, d, "labels"), "doc_id")


@query("rating_join", _with(TRACKS_SQL, RATINGS_SQL) + """SELECT t.playlist, t.track_no, t.phase,
  t.duration_s AS duration_s_df, r.valence AS valence_emo, r.arousal AS arousal_emo
  FROM tracks t JOIN ratings r ON t.playlist = r.playlist AND t.track_no = r.track_no + 1""")
def rating_join(spark, d):
    """Two rating sources on (playlist, track number + 1)."""
    t = X.tracks(spark, d).select("playlist", "track_no", "phase", "duration_s")
    r = X.ratings(spark, d)
    return J.rating_join(t, r, ["playlist", "track_no"], ["duration_s"], offset=1,
                         right_values=["valence", "arousal"])


@query("phase_lookup", _with(TRACKS_SQL, RATINGS_SQL) + """SELECT r.track_no, r.playlist, r.valence,
  r.arousal, t.phase FROM ratings r LEFT JOIN (SELECT * FROM tracks WHERE process) t ON r.track_no = t.track_no AND r.playlist = t.playlist""")
def phase_lookup(spark, d):
    """Fetch the phase of the process-flagged tracks for each rating; the others keep NULL."""
    return J.phase_lookup(X.ratings(spark, d), X.tracks(spark, d).filter("process"), ["track_no", "playlist"], ["phase"])


SEG_JOIN_SQL = """segjoin AS (SELECT d.doc_id, d.lang, s.chunk, s.mean_word_len FROM documents d
  LEFT JOIN segs s ON d.doc_id = s.doc_id)"""


def _seg_join(spark, d):
    docs = X.table(spark, d, "documents").select("doc_id", "lang")
    segs = _text_segments(spark, d).select(F.col("doc_id").alias("seg_doc"), "chunk", "mean_word_len")
    return J.track_segment_join(docs, segs, "doc_id", "seg_doc")


@query("track_segment_join", _with(TEXT_SEG_SQL, SEG_JOIN_SQL) + "SELECT * FROM segjoin")
def track_segment_join(spark, d):
    """Documents left join their segments (short documents keep a NULL row)."""
    return _seg_join(spark, d)


@query("segment_clock", _with(TEXT_SEG_SQL, SEG_JOIN_SQL) + """SELECT doc_id, lang, chunk,
  (row_number() OVER (PARTITION BY lang ORDER BY doc_id, chunk NULLS FIRST) - 1) * 30 / 3600.0 AS start_time,
  (row_number() OVER (PARTITION BY lang ORDER BY doc_id, chunk NULLS FIRST) - 1) * 30 / 3600.0 + 30 / 3600.0
  AS end_time FROM segjoin""")
def segment_clock(spark, d):
    """30 s slots per language in (document, segment) order; NULL rows take a slot."""
    j = _seg_join(spark, d).drop("mean_word_len")
    return W.segment_clock(j, "lang", ["doc_id", "chunk"])


# ------------------------------------------------------------ aggregation ---

LI_SQL = "li AS (SELECT l_returnflag, l_quantity, l_extendedprice / 100.0 AS l_extendedprice, l_discount, l_tax FROM lineitem)"


@query("group_describe", _with(LI_SQL) + "SELECT l_returnflag, " + ", ".join(
    f"round_even(avg({c}), 2) AS {c}_mean, round_even(stddev_samp({c}), 2) AS {c}_std" for c in LI_FEATS)
    + " FROM li GROUP BY l_returnflag")
def group_describe(spark, d):
    """Mean and std per return flag; price rescaled by 1/100."""
    li = X.table(spark, d, "lineitem")
    feats = C.feature_columns(li, exclude=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])
    li = C.rescale(li.select("l_returnflag", *feats), ["l_extendedprice"], 100)
    return D.group_describe(li, "l_returnflag", feats)


PIVOT_SQL = "SELECT playlist, " + ", ".join(
    f"coalesce(sum(CASE WHEN phase = '{p}' THEN duration_m END), 0) AS {p}" for p in X.PHASES) + \
    " FROM tracks GROUP BY playlist"


@query("phase_pivot", _with(TRACKS_SQL) + PIVOT_SQL)
def phase_pivot(spark, d):
    """A2: minutes per (playlist, phase), empty cells 0."""
    return D.phase_pivot(X.tracks(spark, d), "playlist", "phase", "duration_m", X.PHASES)


@query("phase_share", _with(TRACKS_SQL) + "SELECT playlist, " + ", ".join(
    f"{p} / nullif({' + '.join(X.PHASES)}, 0) * 100 AS {p}" for p in X.PHASES) + f" FROM ({PIVOT_SQL})")
def phase_share(spark, d):
    """A3: row percentage of the phase pivot (the flagship slice)."""
    return D.phase_share(X.tracks(spark, d), "playlist", "phase", "duration_m", X.PHASES)


@query("group_size", _with(TRACKS_SQL) + "SELECT playlist, count(*) AS n FROM tracks GROUP BY playlist")
def group_size(spark, d):
    """A4."""
    return D.group_size(X.tracks(spark, d), "playlist")


@query("group_hours", _with(TRACKS_SQL) + "SELECT playlist, sum(duration_s) / 3600.0 AS hours FROM tracks GROUP BY playlist")
def group_hours(spark, d):
    """A5."""
    return D.group_hours(X.tracks(spark, d), "playlist", "duration_s")


TOKENS_SQL = """tok AS (SELECT lang, unnest(string_split(text, ' ')) AS token FROM documents),
  tc AS (SELECT lang, token, count(*) AS n FROM tok GROUP BY lang, token)"""


def _token_counts(spark, d):
    return D.token_counts(X.table(spark, d, "documents"), "lang", "text", sep=" ")


@query("token_counts", _with(TOKENS_SQL) + "SELECT * FROM tc")
def token_counts(spark, d):
    """Word counts per language over whole texts."""
    return _token_counts(spark, d)


@query("topk_overall", _with(TOKENS_SQL) + """SELECT token, n, rank::INTEGER AS rank FROM (SELECT token, sum(n)::BIGINT AS n,
  row_number() OVER (ORDER BY sum(n) DESC, token) AS rank FROM tc GROUP BY token) WHERE rank <= 150""")
def topk_overall(spark, d):
    """The 150 most frequent words over all languages, ranked."""
    totals = _token_counts(spark, d).groupBy("token").agg(F.sum("n").alias("n"))
    return D.topk(totals, None, "n", "token", 150)


@query("token_totals", _with(TOKENS_SQL) + "SELECT token, sum(n)::BIGINT AS n FROM tc GROUP BY token")
def token_totals(spark, d):
    """Counts merged across languages."""
    return D.token_totals(_token_counts(spark, d))


@query("token_distinct", _with(TOKENS_SQL) + "SELECT lang, count(*) AS n_distinct FROM tc GROUP BY lang")
def token_distinct(spark, d):
    """A8."""
    return D.token_distinct(_token_counts(spark, d), "lang")


@query("distinct_sketches", _with(TOKENS_SQL) + """SELECT coalesce(lang, 'all') AS scope, count(DISTINCT token) AS n_distinct, TRUE AS within_bound
  FROM tc GROUP BY GROUPING SETS ((lang), ())""")
def distinct_sketches(spark, d):
    """Stored sketches of each language, and of all merged from them, against the exact counts."""
    sketches = materialize(D.token_sketches(X.table(spark, d, "documents"), "lang", "text", sep=" "))
    guess = D.merged_distinct(sketches, "lang").withColumnRenamed("lang", "scope").unionByName(
        D.merged_distinct(sketches).withColumn("scope", F.lit("all"))).withColumnRenamed("n_distinct", "guess")
    counts = _token_counts(spark, d)
    exact = D.token_distinct(counts, "lang").withColumnRenamed("lang", "scope").unionByName(
        counts.select("token").distinct().agg(F.count(F.lit(1)).alias("n_distinct")).withColumn("scope", F.lit("all")))
    bound = F.col("n_distinct") * (3 * 1.04 / 2 ** 7) + 1
    return exact.join(guess, "scope").select("scope", "n_distinct", (F.abs(F.col("guess") - F.col("n_distinct")) <= bound).alias("within_bound"))


@query("topk_tokens", _with(TOKENS_SQL) + """SELECT * FROM (SELECT lang, token, n,
  row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS rank FROM tc) WHERE rank <= 150""")
def topk_tokens(spark, d):
    """150 most frequent words per language, ties by word."""
    return D.topk(_token_counts(spark, d), "lang", "n", "token", 150)


@query("priority_lookup", _with(TOKENS_SQL) + """SELECT token, arg_min(lang, pr) AS lang FROM
  (SELECT tc.token, tc.lang, p.pr FROM tc JOIN (SELECT lang, row_number() OVER (ORDER BY lang) AS pr
   FROM (SELECT DISTINCT lang FROM documents)) p ON tc.lang = p.lang) GROUP BY token""")
def priority_lookup(spark, d):
    """First language (alphabetical priority) whose texts contain each word."""
    langs = X.table(spark, d, "documents").select("lang").distinct()
    # priority = alphabetical rank over the distinct-language table (one row per group)
    pr = langs.select("lang", F.dense_rank().over(Window.orderBy("lang")).alias("priority"))
    return D.priority_lookup(_token_counts(spark, d), pr, group="lang")


SHARED_SQL = """parts AS (SELECT l.l_partkey, n.n_name, l.l_orderkey, l.l_linenumber, p.p_name, p.p_brand
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey
  JOIN part p ON l.l_partkey = p.p_partkey WHERE l.l_returnflag = 'R' AND l.l_quantity >= 40),
  shared AS (SELECT l_partkey, arg_min(p_name, (l_orderkey, l_linenumber, p_name)) AS p_name,
  arg_min(p_brand, (l_orderkey, l_linenumber, p_brand)) AS p_brand,
  count(DISTINCT n_name)::INTEGER AS n_groups, array_to_string(list_sort(list_distinct(list(n_name))), ', ') AS groups
  FROM parts GROUP BY l_partkey HAVING count(DISTINCT n_name) >= 2)"""


def _shared(spark, d):
    li = X.table(spark, d, "lineitem", "l_returnflag = 'R' AND l_quantity >= 40").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    s = X.table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    n = X.table(spark, d, "nation").select("n_nationkey", "n_name")
    p = X.table(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    # the pair of part and nation goes through the big aggregate; a part's own columns join its result
    pairs = li.join(s, li.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey).select("l_partkey", "n_name")
    shared = D.shared_items(pairs, "l_partkey", "n_name")
    return shared.join(p, shared.l_partkey == p.p_partkey).select("l_partkey", "p_name", "p_brand", "n_groups", "groups")


@query("shared_items", _with(SHARED_SQL) + "SELECT * FROM shared")
def shared_items(spark, d):
    """Parts with large returns from more than one nation, with their attributes."""
    return _shared(spark, d)


@query("shared_histogram", _with(SHARED_SQL) + "SELECT n_groups, count(*) AS n_items FROM shared GROUP BY n_groups")
def shared_histogram(spark, d):
    """A10."""
    return D.shared_histogram(_shared(spark, d))


SCALED_SQL = """sc AS (SELECT c_custkey, c_acctbal, spend,
  CASE WHEN max(c_acctbal) OVER () > min(c_acctbal) OVER () THEN -1 + (c_acctbal - min(c_acctbal) OVER ())
    / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()) * 2 ELSE (CASE WHEN c_acctbal IS NOT NULL THEN -1 END) END AS valence,
  CASE WHEN max(spend) OVER () > min(spend) OVER () THEN -1 + (spend - min(spend) OVER ())
    / (max(spend) OVER () - min(spend) OVER ()) * 2 ELSE (CASE WHEN spend IS NOT NULL THEN -1 END) END AS arousal
  FROM spend)"""


def _scaled(spark, d):
    s = _spend(spark, d).withColumn("valence", F.col("c_acctbal")).withColumn("arousal", F.col("spend"))
    return D.minmax_scale(s, ["valence", "arousal"])


@query("minmax_scale", _with(SPEND_SQL, SCALED_SQL) + "SELECT c_custkey, valence, arousal FROM sc")
def minmax_scale(spark, d):
    """Balance and spend scaled to [-1, 1]."""
    return _scaled(spark, d).select("c_custkey", "valence", "arousal")


@query("quadrant_counts", _with(SPEND_SQL, SCALED_SQL) + """SELECT quadrant, n, n / (SELECT count(*) FROM sc) * 100 AS pct FROM (
  SELECT 'Q1' AS quadrant, count(*) FILTER (WHERE valence >= 0 AND arousal >= 0) AS n FROM sc UNION ALL
  SELECT 'Q2', count(*) FILTER (WHERE valence < 0 AND arousal >= 0) FROM sc UNION ALL
  SELECT 'Q3', count(*) FILTER (WHERE valence < 0 AND arousal < 0) FROM sc UNION ALL
  SELECT 'Q4', count(*) FILTER (WHERE valence >= 0 AND arousal < 0) FROM sc UNION ALL
  SELECT 'Total', count(*) FROM sc)""")
def quadrant_counts(spark, d):
    """Sign quadrants of scaled (balance, spend); NULL spend in Total only."""
    return D.quadrant_counts(_scaled(spark, d), "valence", "arousal")


@query("corr_matrix", _with(LI_SQL.replace("l_extendedprice / 100.0", "l_extendedprice")) + " UNION ALL ".join(
    f"SELECT '{a}' AS f1, '{b}' AS f2, corr({a}, {b}) AS r FROM li"
    for i, a in enumerate(LI_FEATS) for b in LI_FEATS[i + 1:]))
def corr_matrix(spark, d):
    """Pairwise correlations of line-item measures in one aggregate."""
    return D.corr_matrix(X.table(spark, d, "lineitem"), LI_FEATS)


@query("group_profile", _with(LI_SQL.replace("l_extendedprice / 100.0", "l_extendedprice")) + """SELECT l_returnflag, """ + ", ".join(
    f"({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0) AS {c}" for c in LI_FEATS)
    + " FROM (SELECT l_returnflag, " + ", ".join(f"avg({c}) AS {c}" for c in LI_FEATS)
    + " FROM li GROUP BY l_returnflag)")
def group_profile(spark, d):
    """Per-flag means normalised across flags (radar data)."""
    return D.group_profile(X.table(spark, d, "lineitem"), "l_returnflag", LI_FEATS)


@query("class_distribution", _with(CLASSES_SQL) + "SELECT cls, count(*) AS n FROM classes GROUP BY cls")
def class_distribution(spark, d):
    """A15."""
    return D.class_distribution(X.classes(spark, d), "cls")


@query("majority_class", _with(CLASSES_SQL) + """SELECT cls, n, n / (SELECT count(*) FROM classes) AS share
  FROM (SELECT cls, count(*) AS n FROM classes GROUP BY cls) ORDER BY n DESC, cls LIMIT 1""")
def majority_class(spark, d):
    """The most frequent class and its share."""
    return D.mode(X.classes(spark, d), "cls")


@query("group_mode", """SELECT o_orderpriority, arg_min(o_orderstatus, (-n, o_orderstatus)) AS o_orderstatus,
  max(n) AS n, max(n) / sum(n) AS share FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders
  GROUP BY ALL) GROUP BY o_orderpriority""")
def group_mode(spark, d):
    """A16 per group: majority status and purity per priority."""
    return D.mode(X.table(spark, d, "orders"), "o_orderstatus", by="o_orderpriority")


@query("group_quantiles", """SELECT lang, feature, unnest(qs) AS q, unnest(vals) AS value FROM (
  SELECT lang, 'n_chars' AS feature, [0.0, 0.25, 0.5, 0.75, 1.0]::DOUBLE[] AS qs,
  quantile_cont(n_chars::DOUBLE, [0.0, 0.25, 0.5, 0.75, 1.0]) AS vals FROM documents GROUP BY lang)""")
def group_quantiles(spark, d):
    """Exact quartiles, min and max of document length per language."""
    return D.group_quantiles(X.table(spark, d, "documents"), "lang", ["n_chars"])


@query("group_density", """WITH st AS (SELECT lang, count(*) AS n, stddev_samp(n_chars::DOUBLE) AS sd,
  min(n_chars::DOUBLE) AS mn, max(n_chars::DOUBLE) AS mx FROM documents GROUP BY lang),
  st2 AS (SELECT *, sd * pow(n::DOUBLE, -0.2) AS h FROM st WHERE sd * pow(n::DOUBLE, -0.2) > 0),
  g AS (SELECT st2.*, i, mn + (mx - mn) * i / 99 AS x FROM st2, range(0, 100) r(i))
  SELECT g.lang, g.i::INTEGER AS i, g.x, sum(exp(-0.5 * ((g.x - d.n_chars) / g.h) * ((g.x - d.n_chars) / g.h))
    / (g.n * g.h * sqrt(2 * pi()))) AS density FROM g JOIN documents d ON d.lang = g.lang GROUP BY g.lang, g.i, g.x""")
def group_density(spark, d):
    """Gaussian kernel density of document length per language (100 points)."""
    return D.group_density(X.table(spark, d, "documents"), "lang", "n_chars")


@query("distinct_labels", "SELECT DISTINCT label FROM embeddings")
def distinct_labels(spark, d):
    """A19 / O5."""
    return D.distinct_labels(X.table(spark, d, "embeddings"), "label")


@query("trend", _with(TRACKS_SQL, RATINGS_SQL) + """SELECT t.playlist, regr_slope(r.valence, t.track_no) AS slope,
  regr_intercept(r.valence, t.track_no) AS intercept, corr(t.track_no, r.valence) AS r,
  regr_count(r.valence, t.track_no) AS n FROM tracks t JOIN ratings r ON t.track_no = r.track_no GROUP BY t.playlist""")
def trend(spark, d):
    """Linear trend of a rating along the playlist order."""
    t = X.tracks(spark, d).select("track_no", "playlist")
    r = X.ratings(spark, d).select("track_no", "valence")
    return W.trend(t.join(r, "track_no"), "playlist", "track_no", "valence")


# ------------------------------------------------------------ segmentation ---

def _signal(spark, d):
    return X.signal(spark, d)


@query("downmix", _with(SIGNAL_SQL) + "SELECT file, idx, avg(value) AS value FROM signal GROUP BY file, idx")
def downmix(spark, d):
    """G1: channels of a sample averaged."""
    return G.downmix(_signal(spark, d))


DS_SQL = """ds AS (SELECT file, floor(idx * 1 / 2)::BIGINT AS idx, avg(value) AS value FROM
  (SELECT file, idx, avg(value) AS value FROM signal GROUP BY file, idx) GROUP BY file, floor(idx * 1 / 2)::BIGINT)"""


def _downsampled(spark, d):
    return G.downsample(G.downmix(_signal(spark, d)), rate=2, target=1)


@query("downsample", _with(SIGNAL_SQL, DS_SQL) + "SELECT * FROM ds")
def downsample(spark, d):
    """Rate halved by averaging pairs of samples."""
    return _downsampled(spark, d)


SEGS_SQL = """sg AS (SELECT file, idx, value, (idx // 8)::INTEGER AS chunk FROM ds
  QUALIFY count(*) OVER (PARTITION BY file, (idx // 8)::INTEGER) = 8)"""


@query("segments", _with(SIGNAL_SQL, DS_SQL, SEGS_SQL) + "SELECT * FROM sg")
def segments(spark, d):
    """8-sample segments, incomplete tail dropped."""
    return G.segments(_downsampled(spark, d), 8)


@query("segment_features", _with(SIGNAL_SQL, DS_SQL, SEGS_SQL) + """SELECT file, chunk, count(*) AS n_samples,
  avg(value) AS mean, stddev_samp(value) AS std, sqrt(avg(value * value)) AS rms, max(abs(value)) AS peak,
  avg(CASE WHEN prev IS NOT NULL THEN (CASE WHEN sign(value) * sign(prev) < 0 THEN 1.0 ELSE 0.0 END) END) AS zcr,
  avg(abs(value - prev)) AS mean_abs_delta FROM (SELECT *, lag(value) OVER (PARTITION BY file, chunk ORDER BY idx) AS prev
  FROM sg) GROUP BY file, chunk""")
def segment_features(spark, d):
    """Per-segment descriptors, one wide row per (user, segment)."""
    return G.segment_features(G.segments(_downsampled(spark, d), 8))


@query("job_status", _with(TEXT_SEG_SQL) + """SELECT d.doc_id, coalesce(n.n, 0) AS n_segments,
  CASE WHEN d.doc_id IN (SELECT doc_id FROM labels) THEN 'exists' WHEN coalesce(n.n, 0) > 0 THEN 'success'
  ELSE 'error' END AS status FROM (SELECT DISTINCT doc_id FROM documents) d
  LEFT JOIN (SELECT doc_id, count(*) AS n FROM segs GROUP BY doc_id) n ON d.doc_id = n.doc_id""")
def job_status(spark, d):
    """Exists / success / error per document (short texts are errors)."""
    docs = X.table(spark, d, "documents").select("doc_id", "text")
    # full segments of a text by its word count; no segment is cut
    n = F.floor(F.size(F.split("text", " ")) / X.SEGMENT_WORDS)
    full = docs.groupBy("doc_id").agg(F.sum(n).cast("long").alias("n_segments"))
    return S.job_status_files(docs, X.table(spark, d, "labels"), full, "doc_id")
