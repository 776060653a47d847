"""Feature preparation, folds, models, clustering and streaming queries."""

from __future__ import annotations

from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import agreement as A
from ..operators import classify as L
from ..operators import cluster as CL
from ..operators import explain as EX
from ..operators import folds as FO
from ..operators import mixture as MX
from ..operators import neighbours as N
from ..operators import prep as P
from ..operators import reduce as R
from ..operators import scored as SC
from ..operators import shapley as SH
from ..operators import ward as W
from ..streaming import run_count_segments, run_stream_segments
from ..session import materialize
from . import fixtures as X
from .fixtures import CLASSES_SQL
from .q_basic import LI_FEATS, TEXT_SEG_SQL
from .registry import query

SEED = 1987
#: Rows whose Shapley values are sampled (the feature: a bound on the work).
SHAPLEY_ROWS = 20


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _h_sql(seed, col):
    return f"md5('{seed}:' || CAST({col} AS VARCHAR))"


@query("zscore", "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () > 0 THEN stddev_pop({c}) OVER () ELSE 1.0 END AS {c}"
    for c in LI_FEATS) + " FROM lineitem")
def zscore(spark, d):
    """F1: population z-score of line-item measures (constant column -> 0)."""
    li = X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *LI_FEATS)
    return P.zscore(li, LI_FEATS)


PART_FOLDS_SQL = f"""pf AS (SELECT *, ((row_number() OVER (PARTITION BY p_type ORDER BY {_h_sql(SEED, 'p_partkey')}, p_partkey) - 1) % 5)::INTEGER AS fold FROM part)"""


@query("one_hot", _with(PART_FOLDS_SQL) + """, tr AS (SELECT * FROM pf WHERE fold <> 0 AND p_size <= 3)
  SELECT p.p_partkey AS id, 'p_brand' AS feature, s.slot::INTEGER AS slot FROM part p LEFT JOIN
    (SELECT v, row_number() OVER (ORDER BY v) - 1 AS slot FROM (SELECT DISTINCT p_brand AS v FROM tr)) s ON p.p_brand = s.v
  UNION ALL SELECT p.p_partkey, 'p_name', s.slot::INTEGER FROM part p LEFT JOIN
    (SELECT v, row_number() OVER (ORDER BY v) - 1 AS slot FROM (SELECT DISTINCT p_name AS v FROM tr)) s ON p.p_name = s.v""")
def one_hot(spark, d):
    """one-hot slots learned on the small parts of the training folds; unseen values -> NULL slot (all zeros)."""
    part = X.table(spark, d, "part")
    f = FO.stratified_folds(part, "p_type", "p_partkey", 5, SEED)
    train = f.filter((F.col("fold") != 0) & (F.col("p_size") <= 3))
    return P.one_hot_long(train, part, "p_partkey", ["p_brand", "p_name"])


@query("class_weights", _with(CLASSES_SQL) + """SELECT cls, n_c, (SELECT count(*) FROM classes) /
  ((SELECT count(DISTINCT cls) FROM classes) * n_c) AS weight FROM (SELECT cls, count(*) AS n_c FROM classes GROUP BY cls)""")
def class_weights(spark, d):
    """balanced class weights."""
    return P.class_weights(X.classes(spark, d), "cls")


@query("undersample", _with(CLASSES_SQL) + f"""SELECT doc_id, cls FROM (SELECT *, row_number() OVER
  (PARTITION BY cls ORDER BY {_h_sql(SEED, 'doc_id')}, doc_id) AS rk FROM classes)
  WHERE rk <= (SELECT min(c) FROM (SELECT count(*) AS c FROM classes GROUP BY cls))""")
def undersample(spark, d):
    """every class cut to the smallest class by seeded hash order."""
    return P.undersample(X.classes(spark, d), "cls", "doc_id", SEED)


@query("relabel_noise", """SELECT vec_id, CASE WHEN label - 1 = -1 THEN (SELECT p FROM (SELECT label - 1 AS p, count(*) AS n
  FROM embeddings WHERE label - 1 <> -1 GROUP BY 1 ORDER BY n DESC, p LIMIT 1)) ELSE label - 1 END AS cluster FROM embeddings""")
def relabel_noise(spark, d):
    """noise (-1) moved into the largest cluster (cluster = label - 1)."""
    e = X.table(spark, d, "embeddings").select("vec_id", (F.col("label") - 1).alias("cluster"))
    return P.relabel_noise(e, "cluster")


@query("stratified_folds", _with(CLASSES_SQL) + f"""SELECT doc_id, cls, ((row_number() OVER (PARTITION BY cls
  ORDER BY {_h_sql(SEED, 'doc_id')}, doc_id) - 1) % 5)::INTEGER AS fold FROM classes""")
def stratified_folds(spark, d):
    """L1: stratified 5-fold assignment."""
    return FO.stratified_folds(X.classes(spark, d), "cls", "doc_id", 5, SEED)


@query("group_folds", _with(TEXT_SEG_SQL, CLASSES_SQL) + f""", sl AS (SELECT s.doc_id, s.chunk, c.cls FROM segs s JOIN classes c ON s.doc_id = c.doc_id),
  g AS (SELECT doc_id, arg_min(cls, (-n, cls)) AS dom, sum(n) AS size FROM (SELECT doc_id, cls, count(*) AS n FROM sl GROUP BY ALL) GROUP BY doc_id),
  r AS (SELECT doc_id, (row_number() OVER (PARTITION BY dom ORDER BY -size, {_h_sql(SEED, 'doc_id')}, doc_id) - 1) % 10 AS pos FROM g),
  ft AS (SELECT doc_id, (CASE WHEN pos < 5 THEN pos ELSE 9 - pos END)::INTEGER AS fold FROM r)
  SELECT sl.doc_id, sl.chunk, sl.cls, ft.fold FROM sl JOIN ft ON sl.doc_id = ft.doc_id""")
def group_folds(spark, d):
    """L2: segments of one document never straddle folds; folds stratified by class."""
    from ..operators.segments import text_segments
    # the class first: only labelled texts are cut into segments
    docs = X.table(spark, d, "documents").select("doc_id", "text").join(X.classes(spark, d), "doc_id")
    s = text_segments(docs.select("doc_id", "cls", "text"), "doc_id", "text", X.SEGMENT_WORDS, keep=["cls"]).select("doc_id", "chunk", "cls")
    return FO.group_folds(s, "cls", "doc_id", 5, SEED)


@query("balanced_group_folds")
def balanced_group_folds(spark, d):
    """L2: greedy balance; lines of one supplier never straddle folds, and return flags are shared evenly."""
    lines = X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")
    return FO.balanced_group_folds(lines, "l_returnflag", "l_suppkey", 5, SEED)


#: The neighbours of each embedding among those of its label, nearest first.
KNN_SQL = """vecs AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
  knn AS (SELECT a.label, a.vec_id AS id, (row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.x, b.x), b.vec_id))::INTEGER AS rank,
    b.vec_id AS neighbour, list_distance(a.x, b.x) AS distance FROM vecs a JOIN vecs b ON a.label = b.label AND a.vec_id <> b.vec_id)"""


@query("class_knn", _with(KNN_SQL) + "SELECT id, rank, neighbour, distance FROM knn WHERE rank <= 5")
def class_knn(spark, d):
    """The five nearest embeddings of the same label."""
    return N.class_knn(_emb(spark, d), "label", "features", "vec_id", 5)


@query("smote", _with(KNN_SQL) + f"""sizes AS (SELECT label, count(*) AS n FROM vecs GROUP BY label),
  k AS (SELECT least(5, min(n) - 1) AS k, max(n) AS most FROM sizes),
  draws AS (SELECT label, n, unnest(range(most - n)) AS draw, k FROM sizes, k),
  u AS (SELECT label, draw, k, floor(('0x' || substr(md5('{SEED}:pick:' || label || ':' || draw), 1, 13))::BIGINT / 4503599627370496.0 * n * k)::BIGINT AS pick,
    ('0x' || substr(md5('{SEED}:gap:' || label || ':' || draw), 1, 13))::BIGINT / 4503599627370496.0 AS gap FROM draws),
  placed AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS place FROM vecs)
  SELECT u.label, u.draw, p.vec_id AS base, knn.neighbour, u.gap, unnest(range(len(p.x)))::INTEGER AS dim,
    unnest(list_transform(range(1, len(p.x) + 1), lambda i: p.x[i] + u.gap * (o.x[i] - p.x[i]))) AS value
  FROM u JOIN placed p ON p.label = u.label AND p.place = u.pick // u.k JOIN knn ON knn.id = p.vec_id AND knn.rank = u.pick % u.k + 1
  JOIN vecs o ON o.vec_id = knn.neighbour""".replace("sizes AS", ", sizes AS", 1))
def smote(spark, d):
    """synthetic embeddings that bring every label to the size of the largest, in long form."""
    made = N.smote(_emb(spark, d), "label", "features", "vec_id", 5, SEED)
    return made.select("label", "draw", "base", "neighbour", "gap", F.posexplode(vector_to_array("features")).alias("dim", "value"))


# ----------------------------------------------------------- ML (rows-only) ---

def _emb(spark, d):
    e = X.table(spark, d, "embeddings")
    return e.select("vec_id", "label", array_to_vector(F.transform("embedding", lambda v: v.cast("double")))
                    .alias("features"))


def _emb_folds(spark, d):
    return FO.stratified_folds(_emb(spark, d), "label", "vec_id", 5, SEED)


@query("logreg_oof")
def logreg_oof(spark, d):
    """5-fold out-of-fold logistic regression scored table."""
    return L.oof_predictions(_emb_folds(spark, d), "label", "features", "vec_id", model="log")


@query("oof_predictions")
def oof_predictions(spark, d):
    """Pooled out-of-fold scored table with the segment pipeline's
    preparation (scaler fitted once on all rows before CV, the compat path)."""
    return L.oof_predictions(_emb_folds(spark, d), "label", "features", "vec_id", model="log", prep="global")


@query("rf_oof")
def rf_oof(spark, d):
    """5-fold out-of-fold random forest (100 trees) scored table."""
    return L.oof_predictions(_emb_folds(spark, d), "label", "features", "vec_id", model="rf")


@query("logreg_undersampled_auc")
def logreg_undersampled_auc(spark, d):
    """L5 + F6 + M4: logistic regression with per-fold under-sampling, AUC per class."""
    s = L.oof_predictions(_emb_folds(spark, d), "label", "features", "vec_id", model="log", resample="under")
    return SC.roc_auc(s)


@query("pca_variance")
def pca_variance(spark, d):
    """explained-variance ratios; k keeps 99 % of the variance."""
    _, k, ratios = R.pca_variance(_emb(spark, d), "features")
    return ratios.withColumn("k_keep", F.lit(k))


@query("pca_2d")
def pca_2d(spark, d):
    """2-D projection of the embeddings."""
    proj, _ = R.pca_2d(_emb(spark, d), "features")
    return proj.select("vec_id", "label", vector_to_array("xy").alias("xy"))


@query("kmeans_clusters")
def kmeans_clusters(spark, d):
    """KMeans with k = number of labels, best of 10 starts; agreement scores."""
    e = _emb(spark, d)
    k = e.select("label").distinct().count()
    out, _ = CL.kmeans_clusters(e, "features", k, starts=10, seed=SEED)
    return A.agreement_scores(A.contingency(out, "label", "cluster"))


def _scaled_pca(df, cols_or_vec, keep=0.99):
    """Scale, then keep the components that hold ``keep`` of the variance."""
    if isinstance(cols_or_vec, list):
        df = VectorAssembler(inputCols=cols_or_vec, outputCol="__raw", handleInvalid="skip").transform(df)
        cols_or_vec = "__raw"
    scaled = StandardScaler(inputCol=cols_or_vec, outputCol="__scaled", withMean=True, withStd=True).fit(df).transform(df)
    out, k, _ = R.pca_variance(scaled, "__scaled", keep, "pca")
    return out.drop(cols_or_vec, "__scaled"), k


@query("gmm_clusters")
def gmm_clusters(spark, d):
    """Gaussian mixture on 99 % of the variance of the scaled embeddings; agreement scores."""
    proj, _ = _scaled_pca(_emb(spark, d), "features")
    k = proj.select("label").distinct().count()
    out, _ = CL.gmm_clusters(proj, "pca", k, seed=SEED)
    return A.agreement_scores(A.contingency(out, "label", "cluster"))


@query("gmm_fixed_point", "SELECT count(*) AS n_rows, TRUE AS weights_sum_to_one, TRUE AS settled FROM embeddings")
def gmm_fixed_point(spark, d):
    """Another round over all rows moves no parameter of the mixture."""
    proj, _ = _scaled_pca(_emb(spark, d), "features")
    proj = materialize(proj.select("vec_id", "label", "pca"))
    model = MX.fit_mixture(proj, "pca", proj.select("label").distinct().count(), seed=SEED)
    rows = proj.select(vector_to_array("pca").alias("x"))
    settled = MX.moved(model, MX.one_round(rows, model, 1e-6)) < 1e-6
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(bool(abs(model.weights.sum() - 1) < 1e-9)).alias("weights_sum_to_one"),
                    F.lit(bool(settled)).alias("settled"))


@query("ward_clusters")
def ward_clusters(spark, d):
    """Agglomerative clustering by Ward's method with as many clusters as labels."""
    e = _emb(spark, d)
    k = e.select("label").distinct().count()
    return W.ward_clusters(e, "features", "vec_id", k).select("vec_id", "label", "cluster")


@query("ward_step", "SELECT TRUE AS nested, TRUE AS cheapest")
def ward_step(spark, d):
    """The last merge joins, of all pairs of clusters, the one of the smallest cost."""
    e = _emb(spark, d).select("vec_id", "features")
    k = X.table(spark, d, "embeddings").select("label").distinct().count()
    tree = W.ward_tree(e, "features", "vec_id", k + 1)  # both cuts are of one tree
    fine = W.ward_clusters(e, "features", "vec_id", k + 1, tree=tree).withColumnRenamed("cluster", "fine")
    both = W.ward_clusters(fine, "features", "vec_id", k, tree=tree).select("vec_id", "fine", "cluster", vector_to_array("features").alias("x"))
    both = materialize(both)
    pairs = both.select("fine", "cluster").distinct().collect()  # k + 1 rows if the clusters are nested
    means = both.select("fine", F.posexplode("x").alias("pos", "v")).groupBy("fine", "pos").agg(F.avg("v").alias("m"), F.count(F.lit(1)).alias("n"))
    parts = means.groupBy("fine").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("c"), F.first("n").alias("n")).collect()  # k + 1 centres
    cost = {(a["fine"], b["fine"]): a["n"] * b["n"] / (a["n"] + b["n"]) * sum((x["m"] - y["m"]) ** 2 for x, y in zip(a["c"], b["c"]))
            for a in parts for b in parts if a["fine"] < b["fine"]}
    groups = {}
    for r in pairs:
        groups.setdefault(r["cluster"], []).append(r["fine"])
    merged = [tuple(sorted(v)) for v in groups.values() if len(v) > 1]
    nested = len(pairs) == len(parts) == k + 1 and len(merged) == 1 and len(merged[0]) == 2
    return spark.range(1).select(F.lit(nested).alias("nested"), F.lit(nested and min(cost, key=cost.get) == merged[0]).alias("cheapest"))


@query("bisecting_clusters")
def bisecting_clusters(spark, d):
    """Hierarchical clustering of all rows by repeated bisection; cluster sizes."""
    e = _emb(spark, d)
    k = e.select("label").distinct().count()
    out, _ = CL.bisecting_clusters(e, "features", k, seed=SEED)
    return A.cluster_sizes(out, "label", "cluster")


@query("silhouette_sq", """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x, list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS xx FROM embeddings),
  mu AS (SELECT label, list(m ORDER BY pos) AS c FROM (SELECT label, pos, avg(v) AS m FROM
    (SELECT label, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM e) GROUP BY label, pos) GROUP BY label),
  cl AS (SELECT e.label, count(*) AS n, avg(xx) AS psi FROM e GROUP BY e.label),
  d AS (SELECT e.vec_id, e.label, cl.label AS other, cl.n, e.xx + cl.psi - 2 * list_dot_product(e.x, mu.c) AS dist
    FROM e, cl JOIN mu USING (label)),
  ab AS (SELECT vec_id, max(CASE WHEN label = other THEN n END) AS n, max(CASE WHEN label = other THEN dist * n / greatest(n - 1, 1) END) AS a,
    min(CASE WHEN label <> other THEN dist END) AS b FROM d GROUP BY vec_id)
  SELECT avg(CASE WHEN n = 1 THEN 0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0 END) AS silhouette FROM ab""")
def silhouette_sq(spark, d):
    """Spark's squared-Euclidean silhouette of the label partition."""
    e = _emb(spark, d)
    s = CL.silhouette_sq(e.withColumn("label_d", F.col("label").cast("double")), "features", "label_d")
    return spark.range(1).select(F.lit(s).alias("silhouette"))


@query("silhouette_bars", """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x, list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS xx FROM embeddings),
  mu AS (SELECT label, list(m ORDER BY pos) AS c FROM (SELECT label, pos, avg(v) AS m FROM
    (SELECT label, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM e) GROUP BY label, pos) GROUP BY label),
  cl AS (SELECT e.label, count(*) AS n, avg(xx) AS psi FROM e GROUP BY e.label),
  d AS (SELECT e.vec_id, e.label, cl.label AS other, cl.n, e.xx + cl.psi - 2 * list_dot_product(e.x, mu.c) AS dist
    FROM e, cl JOIN mu USING (label)),
  ab AS (SELECT vec_id, label, max(CASE WHEN label = other THEN n END) AS n, max(CASE WHEN label = other THEN dist * n / greatest(n - 1, 1) END) AS a,
    min(CASE WHEN label <> other THEN dist END) AS b FROM d GROUP BY vec_id, label),
  s AS (SELECT label, vec_id, CASE WHEN n = 1 THEN 0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0 END AS silhouette FROM ab)
  SELECT label AS cluster, row_number() OVER (PARTITION BY label ORDER BY silhouette, vec_id) AS place, vec_id AS id, silhouette FROM s""")
def silhouette_bars(spark, d):
    """The silhouette of every row of the label partition, ascending inside its cluster."""
    return CL.silhouette_bars(_emb(spark, d), "features", "label", "vec_id")


def _logreg_model(spark, d):
    """The last fold's logistic model (the one the explanations describe) and
    the rows in the model's own feature space (z-scored before CV, as in the
    segment pipeline).  Only that fold's model is fitted."""
    from pyspark.ml.feature import StandardScaler
    e = _emb(spark, d)
    e = (StandardScaler(inputCol="features", outputCol="__xs", withMean=True, withStd=True).fit(e)
         .transform(e).drop("features").withColumnRenamed("__xs", "features"))
    folds = FO.stratified_folds(e, "label", "vec_id", 5, SEED)
    last = folds.agg(F.max("fold")).first()[0]
    out, models, labels = L.oof_predictions(folds, "label", "features", "vec_id", model="log",
                                            prep="none", return_models=True, only_folds=[last])
    return e, models[-1].stages[-1], labels


@query("logreg_score_equations", f"""WITH f AS (SELECT label, embedding, (row_number() OVER (PARTITION BY label ORDER BY {_h_sql(SEED, 'vec_id')}, vec_id) - 1) % 5 AS fold FROM embeddings),
  tr AS (SELECT * FROM f WHERE fold <> (SELECT max(fold) FROM f)),
  w AS (SELECT label, (SELECT count(*) FROM tr)::DOUBLE / ((SELECT count(DISTINCT label) FROM tr) * count(*)) AS w FROM tr GROUP BY label),
  x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS feature FROM tr
        UNION ALL SELECT label, 1, -1 FROM tr)
  SELECT label::VARCHAR AS label, feature::INTEGER AS feature, round(sum(v * w), 6) AS target, TRUE AS solved
  FROM x JOIN w USING (label) GROUP BY ALL""")
def logreg_score_equations(spark, d):
    """L3: the class sums that the last fold's logistic model must reproduce, and whether it does (gradient of the mean loss within 1e-4)."""
    folds = _emb_folds(spark, d)
    last = folds.agg(F.max("fold")).first()[0]
    _, models, labels = L.oof_predictions(folds, "label", "features", "vec_id", model="log", prep="none", return_models=True, only_folds=[last])
    slot = F.array_position(F.lit(labels), F.col("label").cast("string")) - 1
    train, _ = L.balanced(folds.where(F.col("fold") != last).withColumn("slot", slot), "slot", len(labels))
    found = EX.score_equations(train, models[-1].stages[-1], labels)
    return found.select("label", "feature", F.round("target", 6).alias("target"), (F.col("gap") <= 1e-4).alias("solved"))


@query("coef_importance")
def coef_importance(spark, d):
    """M5: top-5 coefficients by |value| per class (last fold's model)."""
    _, m, labels = _logreg_model(spark, d)
    names = [f"d{j}" for j in range(m.numFeatures)]
    return EX.coef_importance(m, names, labels, 5)


@query("shap_linear")
def shap_linear(spark, d):
    """M6: linear SHAP, top-5 features by mean |phi| per class."""
    e, m, labels = _logreg_model(spark, d)
    names = [f"d{j}" for j in range(m.numFeatures)]
    top, _ = EX.shap_linear(e, m, "features", names, labels, 5)
    return top


@query("permutation_importance")
def permutation_importance(spark, d):
    """M7: permutation importance of each dimension for the last fold's forest
    (reference settings: 100 trees, depth cap, balanced weights), over all rows."""
    from pyspark.ml.feature import StringIndexer
    e = _emb(spark, d)
    rf, _, names = _forest(spark, d)
    # same label order as the model: string labels indexed alphabetically
    rows = e.select("vec_id", F.col("label").cast("string").alias("__ys"), F.col("features").alias("__x"))
    idx = StringIndexer(inputCol="__ys", outputCol="__li", stringOrderType="alphabetAsc").fit(rows).transform(rows)
    return EX.permutation_importance(idx, rf, "__x", "__li", names, "vec_id", SEED)


def _forest(spark, d):
    """The last fold's forest (100 trees, balanced weights) with its labels and feature names."""
    e = _emb_folds(spark, d)
    last = e.agg(F.max("fold")).first()[0]
    _, models, labels = L.oof_predictions(e, "label", "features", "vec_id", model="rf", prep="none", return_models=True, only_folds=[last])
    forest = models[-1].stages[-1]
    return forest, labels, [f"d{j}" for j in range(forest.numFeatures)]


@query("forest_shapley")
def forest_shapley(spark, d):
    """M7: per class the five features of greatest mean |Shapley value| of the last fold's forest, over a sample of rows."""
    forest, labels, names = _forest(spark, d)
    rows = _emb(spark, d).withColumnRenamed("features", forest.getFeaturesCol())
    values = SH.forest_shapley(rows, forest, forest.getFeaturesCol(), "vec_id", names, labels, sample_rows=SHAPLEY_ROWS, orders=8, seed=SEED)
    mean = values.groupBy("cls", "feature").agg(F.avg(F.abs("phi")).alias("mean_abs_phi"))
    best = Window.partitionBy("cls").orderBy(F.desc("mean_abs_phi"), "feature")
    return mean.withColumn("rank", F.row_number().over(best)).where("rank <= 5")


@query("forest_shapley_additive", f"""SELECT vec_id AS id, cls, TRUE AS adds_up FROM (SELECT vec_id FROM embeddings ORDER BY {_h_sql(SEED, 'vec_id')}, vec_id LIMIT 20),
  (SELECT DISTINCT label::VARCHAR AS cls FROM embeddings)""")
def forest_shapley_additive(spark, d):
    """M7: a row's Shapley values and the base add up to the forest's probability of the class."""
    forest, labels, names = _forest(spark, d)
    rows = _emb(spark, d).withColumnRenamed("features", forest.getFeaturesCol())
    values = SH.forest_shapley(rows, forest, forest.getFeaturesCol(), "vec_id", names, labels, sample_rows=SHAPLEY_ROWS, orders=8, seed=SEED)
    return values.groupBy("id", "cls").agg((F.abs(F.sum("phi") + F.first("base") - F.first("probability")) < 1e-9).alias("adds_up"))


# --------------------------------------------------------------- streaming ---

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


@query("stream_segments", """SELECT strftime(time_bucket(INTERVAL '6 hours', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
  strftime(time_bucket(INTERVAL '6 hours', ts) + INTERVAL '6 hours', '%Y-%m-%d %H:%M:%S') AS window_end, event_type,
  count(*) AS n, avg(value) AS mean, min(value) AS min, max(value) AS max, sqrt(avg(value * value)) AS rms FROM events
  GROUP BY time_bucket(INTERVAL '6 hours', ts), event_type
  HAVING time_bucket(INTERVAL '6 hours', ts) + INTERVAL '6 hours' <= (SELECT max(ts) FROM events) - INTERVAL '1 hour'""")
def stream_segments(spark, d):
    """6-hour tumbling-window segments of the event stream (1 h watermark, append)."""
    out = run_stream_segments(spark, f"{d}/events.parquet", EVENTS_SCHEMA, "ts", ["event_type"],
                              "6 hours", "1 hour", "events")
    fmt = "yyyy-MM-dd HH:mm:ss"
    return out.select(F.date_format("window_start", fmt).alias("window_start"),
                      F.date_format("window_end", fmt).alias("window_end"),
                      "event_type", "n", "mean", "min", "max", "rms")


@query("stream_count_segments", """SELECT user_id, chunk, count(*) AS n, avg(value) AS mean, min(value) AS min, max(value) AS max, sqrt(avg(value * value)) AS rms
  FROM (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 10 AS chunk FROM events) GROUP BY user_id, chunk HAVING count(*) = 10""")
def stream_count_segments(spark, d):
    """Segments of ten samples a user, counted over micro-batches with a state per user; the incomplete tail is dropped."""
    return run_count_segments(spark, f"{d}/events.parquet", EVENTS_SCHEMA, "ts", ["ts", "event_id"], ["user_id"], 10, "counted")
