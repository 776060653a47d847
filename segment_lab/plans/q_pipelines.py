"""The three analyses end to end: segments, tracks and clusters; sinks and small companions.

Where a fit's numbers cannot be stated in SQL, its query returns what SQL
knows of them: which rows were scored in which fold, that a probability
vector sums to one, that explanations add up to the margin.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import agreement as A
from ..operators import classify as L
from ..operators import cluster as CL
from ..operators import explain as EX
from ..operators import folds as FO
from ..operators import reduce as R
from ..operators import scored as SC
from ..operators import ward as W
from ..operators.segments import text_segments
from ..session import free_shuffles, materialize, scratch_path
from ..sources.catalog import materialise, write_segments
from ..sources.incremental import extract, extracted
from . import fixtures as X
from .fixtures import CLASSES_SQL
from .q_basic import TEXT_SEG_SQL
from .q_models import SEED, _emb, _h_sql, _logreg_model, _scaled_pca, _with
from .registry import query

SEGMENT_FEATURES = ["mean_word_len", "std_word_len", "n_chars", "digit_share", "unique_ratio"]
GROUP_FOLD_SQL = f"""sl AS (SELECT s.doc_id, s.chunk, c.cls FROM segs s JOIN classes c ON s.doc_id = c.doc_id),
  g AS (SELECT doc_id, arg_min(cls, (-n, cls)) AS dom, sum(n) AS size FROM (SELECT doc_id, cls, count(*) AS n FROM sl GROUP BY ALL) GROUP BY doc_id),
  r AS (SELECT doc_id, (row_number() OVER (PARTITION BY dom ORDER BY -size, {_h_sql(SEED, 'doc_id')}, doc_id) - 1) % 10 AS pos FROM g),
  ft AS (SELECT doc_id, (CASE WHEN pos < 5 THEN pos ELSE 9 - pos END)::INTEGER AS fold FROM r)"""


def _whole(scored):
    """Whether each row's probabilities sum to one."""
    total = F.aggregate("probability", F.lit(0.0), lambda a, x: a + x)
    return scored.withColumn("sums_to_one", F.abs(total - 1.0) < 1e-9)


def _segment_scores(spark, d, model):
    docs = X.table(spark, d, "documents").select("doc_id", "text").join(X.classes(spark, d), "doc_id")
    segs = text_segments(docs, "doc_id", "text", X.SEGMENT_WORDS, keep=["cls"])
    segs = materialize(segs.select("doc_id", "chunk", "cls", *SEGMENT_FEATURES))
    segs, _ = _scaled_pca(segs, SEGMENT_FEATURES)
    folds = FO.group_folds(segs, "cls", "doc_id", 5, SEED).withColumn("seg", F.struct("doc_id", "chunk"))
    return L.oof_predictions(folds, "cls", "pca", "seg", model=model, prep="none", seed=SEED)


@query("segment_pipeline", _with(TEXT_SEG_SQL, CLASSES_SQL) + ", " + GROUP_FOLD_SQL + """
  SELECT sl.doc_id, sl.chunk, ft.fold, sl.cls AS y_true, TRUE AS sums_to_one FROM sl JOIN ft ON sl.doc_id = ft.doc_id""")
def segment_pipeline(spark, d):
    """Segments scaled, reduced to 99 % of the variance and scored out of their document's fold."""
    s = _whole(_segment_scores(spark, d, "log"))
    return s.select("id.doc_id", "id.chunk", "fold", "y_true", "sums_to_one")


@query("segment_report")
def segment_report(spark, d):
    """M3 over the segment pipeline."""
    return SC.class_report(_segment_scores(spark, d, "log"))


@query("track_pipeline", f"""SELECT p_partkey AS id, ((row_number() OVER (PARTITION BY p_type ORDER BY {_h_sql(SEED, 'p_partkey')}, p_partkey) - 1) % 5)::INTEGER AS fold,
  p_type AS y_true, TRUE AS sums_to_one FROM part""")
def track_pipeline(spark, d):
    """Mixed numeric, categorical and boolean columns prepared inside each fold, weights from all rows."""
    part = X.table(spark, d, "part").withColumn("large", F.col("p_size") > 25)
    f = FO.stratified_folds(part, "p_type", "p_partkey", 5, SEED)
    s = _whole(L.oof_mixed(f, "p_type", ["p_size", "p_retailprice"], ["p_brand", "large"], "p_partkey"))
    return s.select("id", "fold", "y_true", "sums_to_one")


def _clustered(spark, d):
    e, _ = _scaled_pca(_emb(spark, d), "features")
    e = materialize(e.select("vec_id", "label", "pca"))
    k = e.select("label").distinct().count()
    return e, k


@query("cluster_pipeline")
def cluster_pipeline(spark, d):
    """KMeans, a Gaussian mixture and Ward merging on 99 % of the variance, judged against the labels."""
    e, k = _clustered(spark, d)
    parts = []
    fits = {"kmeans": lambda: CL.kmeans_clusters(e, "pca", k, seed=SEED)[0], "gmm": lambda: CL.gmm_clusters(e, "pca", k, seed=SEED)[0],
            "ward": lambda: W.ward_clusters(e, "pca", "vec_id", k)}
    for name, fit in fits.items():
        out = fit()
        out = materialize(out.select("vec_id", "label", "pca", "cluster"))
        free_shuffles(spark)  # those of a fit's rounds
        cont = materialize(A.contingency(out, "label", "cluster"))
        score = A.agreement_scores(cont)
        long = score.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("value")) for c in score.columns])).alias("s")).select("s.*")
        purity = A.cluster_purity(cont).agg(F.lit("purity").alias("measure"), (F.sum(F.col("purity") * F.col("size")) / F.sum("size")).alias("value"))
        sil = CL.silhouette_sq(out.withColumn("c", F.col("cluster").cast("double")), "pca", "c")
        own = spark.range(1).select(F.lit("silhouette").alias("measure"), F.nanvl(F.lit(sil), F.lit(None).cast("double")).alias("value"))
        parts.append(long.union(purity).union(own).withColumn("method", F.lit(name)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("aligned_report")
def aligned_report(spark, d):
    """Report of the KMeans clusters after they are matched to the labels."""
    e, k = _clustered(spark, d)
    out, _ = CL.kmeans_clusters(e, "pca", k, seed=SEED)
    return A.aligned_report(materialize(A.contingency(out, "label", "cluster")))


@query("kmeans_nearest", "SELECT vec_id, TRUE AS nearest FROM embeddings")
def kmeans_nearest(spark, d):
    """Every row lies in the cluster whose centre is nearest to it."""
    e = _emb(spark, d)
    out, m = CL.kmeans_clusters(e, "features", e.select("label").distinct().count(), starts=2, seed=SEED)
    x = vector_to_array("features")
    dist = F.array(*[F.aggregate(F.zip_with(x, F.lit([float(v) for v in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
                     for c in m.clusterCenters()])
    return out.select("vec_id", (F.element_at(dist, F.col("cluster") + 1) <= F.array_min(dist) * (1 + 1e-9)).alias("nearest"))


@query("pca_total_variance", """SELECT sum(v) AS total_variance FROM (SELECT var_samp(x) AS v FROM
  (SELECT unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY pos)""")
def pca_total_variance(spark, d):
    """the variance of the rows projected on all components is that of the features."""
    proj, _, _ = R.pca_variance(_emb(spark, d), "features", 1.0)
    long = proj.select(F.posexplode(vector_to_array("pca")).alias("pos", "x"))
    return long.groupBy("pos").agg(F.var_samp("x").alias("v")).agg(F.sum("v").alias("total_variance"))


@query("shap_additive", "SELECT vec_id AS id, label::VARCHAR AS cls, TRUE AS adds_up FROM (SELECT vec_id FROM embeddings), (SELECT DISTINCT label FROM embeddings)")
def shap_additive(spark, d):
    """M6: per row and class, the SHAP values and the base add up to the margin."""
    e, m, labels = _logreg_model(spark, d)
    rows = EX.shap_rows(e, m, "features", "vec_id", labels)
    total = F.aggregate("phi", F.col("base"), lambda a, x: a + x)
    return rows.select("id", "cls", (F.abs(total - F.col("margin")) < 1e-8).alias("adds_up"))


@query("impurity_importance")
def impurity_importance(spark, d):
    """M7: impurity importance of the last fold's forest."""
    e = FO.stratified_folds(_emb(spark, d), "label", "vec_id", 5, SEED)
    last = e.agg(F.max("fold")).first()[0]
    _, models, _ = L.oof_predictions(e, "label", "features", "vec_id", model="rf", prep="none", return_models=True, only_folds=[last])
    rf = models[-1].stages[-1]
    return EX.impurity_importance(rf, [f"d{j}" for j in range(rf.numFeatures)])


@query("sink_round_trip", _with(TEXT_SEG_SQL) + "SELECT d.lang, count(*) AS n, sum(s.chunk)::BIGINT AS chunks FROM segs s JOIN documents d ON s.doc_id = d.doc_id GROUP BY d.lang")
def sink_round_trip(spark, d):
    """Text segments written by group, and read back through the materialised table."""
    docs = X.table(spark, d, "documents").select("doc_id", "lang", "text")
    out = scratch_path(spark, "segments")
    write_segments(text_segments(docs, "doc_id", "text", X.SEGMENT_WORDS, keep=["lang"]).select("doc_id", "lang", "chunk"), out + "/sink", "lang")
    back = materialise(spark, out + "/table", lambda: spark.read.parquet(out + "/sink").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.sum("chunk").alias("chunks")))
    return back


@query("incremental_job", _with(TEXT_SEG_SQL) + """, n AS (SELECT d.doc_id, d.lang, count(s.chunk) AS n_segments,
    ('0x' || substr(md5('batch:' || d.doc_id), 1, 8))::BIGINT % 4 AS batch FROM documents d LEFT JOIN segs s ON d.doc_id = s.doc_id GROUP BY ALL),
  runs AS (SELECT 'first' AS run, doc_id, n_segments, CASE WHEN n_segments > 0 THEN 'success' ELSE 'error' END AS status FROM n WHERE lang = 'de'
  UNION ALL SELECT 'again', doc_id, n_segments, CASE WHEN n_segments > 0 THEN 'exists' ELSE 'error' END FROM n WHERE lang = 'de'
  UNION ALL SELECT 'resumed', doc_id, n_segments, CASE WHEN n_segments = 0 THEN 'error' WHEN lang = 'de' OR batch < 2 THEN 'exists' ELSE 'success' END FROM n)
  SELECT *, (SELECT count(*) FROM segs) AS segments_stored FROM runs""")
def incremental_job(spark, d):
    """A job over one language, the same again, then over all documents, failing at its third batch and resumed."""
    docs = X.table(spark, d, "documents").select("doc_id", "lang", "text")
    root = scratch_path(spark, "incremental")
    made = []

    def build(items):
        made.append(1)
        return text_segments(items, "doc_id", "text", X.SEGMENT_WORDS, keep=["lang"]).select("doc_id", "lang", "chunk")

    def failing(items):
        if len(made) >= 3:
            raise RuntimeError("the job was stopped")
        return build(items)
    german = docs.where("lang = 'de'")
    runs = [extract(spark, german, "doc_id", build, root, "lang").withColumn("run", F.lit("first"))]
    runs = [materialize(r) for r in runs]
    made.clear()
    runs.append(materialize(extract(spark, german, "doc_id", build, root, "lang").withColumn("run", F.lit("again"))))
    made[:] = [1]  # two batches more
    try:
        extract(spark, docs, "doc_id", failing, root, "lang", batches=4)
    except RuntimeError:
        pass  # what was finished is kept
    runs.append(extract(spark, docs, "doc_id", build, root, "lang", batches=4).withColumn("run", F.lit("resumed")))
    out = runs[0].unionByName(runs[1]).unionByName(runs[2])
    stored = extracted(spark, root).count()
    return out.withColumn("segments_stored", F.lit(stored).cast("long"))
