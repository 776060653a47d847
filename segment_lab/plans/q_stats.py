"""Statistics, scored-table metrics and clustering agreement queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.randomness import uniform01
from ..operators import agreement as A
from ..operators import moments as M
from ..operators import scored as SC
from . import fixtures as X
from .fixtures import DOC_FEATURES, DOC_FEATURES_SQL
from .registry import query
from ..operators.folds import stratified_folds
from ..session import materialize


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# ---------------------------------------------------------------- ANOVA ---

LONG_SQL = "long AS (" + " UNION ALL ".join(
    f"SELECT cls AS grp, '{c}' AS feature, {c}::DOUBLE AS v FROM doc_features" for c in DOC_FEATURES) + ")"


def _anova_sql(null_mode: str) -> str:
    where = "WHERE v IS NOT NULL" if null_mode == "drop" else ""
    fexpr = "(ssb / (k - 1)) / (ssw / (N - k))"
    if null_mode == "propagate":
        fexpr = f"CASE WHEN n_null = 0 THEN {fexpr} END"
    return f"""mom AS (SELECT feature, grp, count(v) AS n, avg(v) AS mean, var_samp(v) AS var,
      count(*) FILTER (WHERE v IS NULL) AS n_null FROM long GROUP BY feature, grp),
    g AS (SELECT feature, count(*) AS k, sum(n) AS N, sum(n * mean) / sum(n) AS grand,
      sum(coalesce((n - 1) * var, 0)) AS ssw, sum(n_null) AS n_null FROM mom WHERE n > 0 GROUP BY feature),
    an AS (SELECT g.feature, (g.k - 1)::DOUBLE AS df_between, (g.N - g.k)::DOUBLE AS df_within,
      {fexpr.replace('ssb', 's.ssb')} AS F
      FROM g JOIN (SELECT m.feature, sum(m.n * (m.mean - g2.grand) * (m.mean - g2.grand)) AS ssb
        FROM mom m JOIN g g2 ON m.feature = g2.feature WHERE m.n > 0 GROUP BY m.feature) s
      ON g.feature = s.feature),
    anp AS (SELECT *, CASE WHEN F IS NOT NULL THEN pow(1 + 2 * F / df_within, -df_within / 2) END AS p FROM an)"""


def _mom(spark, d):
    return M.moments(X.doc_features(spark, d), "cls", DOC_FEATURES)


@query("anova_features", _with(DOC_FEATURES_SQL, LONG_SQL, _anova_sql("propagate")) + "SELECT * FROM anp")
def anova_features(spark, d):
    """One-way ANOVA of text measures by 3-way label class, NULL propagates."""
    return M.anova(_mom(spark, d), nulls="propagate")


@query("anova_dropna", _with(DOC_FEATURES_SQL, LONG_SQL, _anova_sql("drop")) + "SELECT * FROM anp")
def anova_dropna(spark, d):
    """The same test with missing values dropped per feature."""
    return M.anova(_mom(spark, d), nulls="drop")


PART_SQL = """long AS (SELECT floor(3 * p_partkey / ((SELECT max(p_partkey) FROM part) + 1))::VARCHAR AS grp,
  'p_retailprice' AS feature, p_retailprice AS v FROM part UNION ALL
  SELECT floor(3 * p_partkey / ((SELECT max(p_partkey) FROM part) + 1))::VARCHAR, 'p_size', p_size::DOUBLE FROM part)"""


@query("anova_part", _with(PART_SQL, _anova_sql("drop")) + "SELECT * FROM anp")
def anova_part(spark, d):
    """T2 on parts: price and size by key third (price differs, size does not)."""
    p = X.table(spark, d, "part")
    mx = p.agg(F.max("p_partkey").alias("m")).select("m").scalar()
    p = p.withColumn("grp", F.floor(3 * F.col("p_partkey") / (mx + 1)).cast("string"))
    return M.anova(M.moments(p, "grp", ["p_retailprice", "p_size"]), nulls="drop")


BONF_SQL = "bonf AS (SELECT *, 0.05 / (SELECT count(*) FROM anp) AS alpha_corrected FROM anp WHERE p < 0.05 / (SELECT count(*) FROM anp))"


@query("anova_bonferroni", _with(DOC_FEATURES_SQL, LONG_SQL, _anova_sql("drop"), BONF_SQL) + "SELECT * FROM bonf")
def anova_bonferroni(spark, d):
    """Features significant after Bonferroni correction."""
    return M.bonferroni(M.anova(_mom(spark, d), nulls="drop"))


COHEN_SQL = """cd AS (SELECT a.feature, a.grp AS group1, b.grp AS group2,
  CASE WHEN sqrt(((a.n - 1) * coalesce(a.var, 0) + (b.n - 1) * coalesce(b.var, 0)) / nullif(a.n + b.n - 2, 0)) > 0
  THEN (a.mean - b.mean) / sqrt(((a.n - 1) * coalesce(a.var, 0) + (b.n - 1) * coalesce(b.var, 0)) / (a.n + b.n - 2))
  ELSE 0.0 END AS d
  FROM mom a JOIN mom b ON a.feature = b.feature AND a.grp < b.grp
  WHERE a.n > 0 AND b.n > 0 AND a.feature IN (SELECT feature FROM bonf))"""


def _cohen(spark, d):
    mom = materialize(_mom(spark, d))     # read by the test and both join sides
    sig = M.bonferroni(M.anova(mom, nulls="drop"))
    return M.cohens_d(mom, sig)


@query("cohens_d", _with(DOC_FEATURES_SQL, LONG_SQL, _anova_sql("drop"), BONF_SQL, COHEN_SQL) + "SELECT * FROM cd")
def cohens_d(spark, d):
    """Cohen's d of every class pair for significant features."""
    return _cohen(spark, d)


@query("large_effects", _with(DOC_FEATURES_SQL, LONG_SQL, _anova_sql("drop"), BONF_SQL, COHEN_SQL)
       + "SELECT * FROM cd WHERE abs(d) >= 0.8")
def large_effects(spark, d):
    """T5: pairs with |d| >= 0.8."""
    return M.large_effects(_cohen(spark, d))


# --------------------------------------------------------- scored table ---

N_FOLDS = 5
SEED = 1987

SCORED_SQL = f"""emb AS (SELECT vec_id, label::VARCHAR AS y_true, embedding::DOUBLE[] AS x,
    ((row_number() OVER (PARTITION BY label ORDER BY md5('{SEED}:' || CAST(vec_id AS VARCHAR)), vec_id) - 1) % {N_FOLDS})::INTEGER AS fold FROM embeddings),
  cent AS (SELECT f, y_true AS lab, list(m ORDER BY pos) AS c FROM (SELECT f, y_true, pos, avg(v) AS m FROM
    (SELECT f, y_true, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM emb, range({N_FOLDS}) fs(f) WHERE fold <> f)
    GROUP BY f, y_true, pos) GROUP BY f, y_true),
  dist AS (SELECT e.vec_id, e.fold, e.y_true, c.lab,
    list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip(e.x, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))),
      lambda acc, y: acc + y) AS d FROM emb e JOIN cent c ON e.fold = c.f),
  dmin AS (SELECT vec_id, min(d) AS md FROM dist GROUP BY vec_id),
  scored AS (SELECT t.vec_id AS id, t.fold, t.y_true, arg_min(t.lab, (t.d, t.lab)) AS y_pred,
    list(exp(m.md - t.d) ORDER BY t.lab) AS e FROM dist t JOIN dmin m ON t.vec_id = m.vec_id GROUP BY t.vec_id, t.fold, t.y_true),
  sc AS (SELECT id, fold, y_true, y_pred, list_transform(e, lambda v: v / list_sum(e)) AS probability FROM scored)"""


def _scored_with_labels(spark, d):
    """Out-of-fold nearest-centroid scores (each fold by the centroids of the others), and the labels."""
    emb = stratified_folds(X.table(spark, d, "embeddings"), "label", "vec_id", N_FOLDS, SEED)
    cents = SC.class_centroids(emb, "embedding", "label", "fold")
    labels = sorted({lab for m in cents.values() for lab, _ in m})
    return SC.nearest_centroid_scores(emb, "vec_id", "embedding", "label", cents, "fold"), labels


def _scored(spark, d):
    return _scored_with_labels(spark, d)[0]


@query("scored_table", _with(SCORED_SQL) + "SELECT id, fold, y_true, y_pred FROM sc")
def scored_table(spark, d):
    """Out-of-fold nearest-centroid predictions over the embeddings (input of M*, T6, C*)."""
    return _scored(spark, d).select("id", "fold", "y_true", "y_pred")


@query("confusion_matrix", _with(SCORED_SQL) + """, labs AS (SELECT DISTINCT l FROM (SELECT y_true AS l FROM sc UNION SELECT y_pred FROM sc)),
  cells AS (SELECT y_true, y_pred, count(*) AS n FROM sc GROUP BY ALL),
  rowsn AS (SELECT y_true, count(*) AS row_n FROM sc GROUP BY y_true)
  SELECT a.l AS y_true, b.l AS y_pred, coalesce(c.n, 0) AS n, round_even(coalesce(c.n, 0)::DOUBLE / r.row_n, 1) AS share
  FROM labs a, labs b LEFT JOIN cells c ON c.y_true = a.l AND c.y_pred = b.l LEFT JOIN rowsn r ON r.y_true = a.l""")
def confusion_matrix(spark, d):
    """M1: row-normalised confusion matrix, rounded half-even to 1 decimal."""
    return SC.confusion_matrix(_scored(spark, d))


@query("accuracy_vs_chance", _with(SCORED_SQL) + """SELECT avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) AS model_acc,
  (SELECT max(c) FROM (SELECT count(*) AS c FROM sc GROUP BY y_true)) / count(*) AS chance_acc, count(*) AS n FROM sc""")
def accuracy_vs_chance(spark, d):
    """M2: model accuracy against the majority-class baseline."""
    return SC.accuracy_vs_chance(_scored(spark, d))


@query("class_report", _with(SCORED_SQL) + """, per AS (SELECT cls, coalesce(tp::DOUBLE / nullif(pp, 0), 0.0) AS precision,
    coalesce(tp::DOUBLE / nullif(support, 0), 0.0) AS recall, support FROM (
    SELECT coalesce(s.cls, p.cls) AS cls, coalesce(s.support, 0) AS support, coalesce(p.pp, 0) AS pp, coalesce(t.tp, 0) AS tp
    FROM (SELECT y_true AS cls, count(*) AS support FROM sc GROUP BY 1) s
    FULL JOIN (SELECT y_pred AS cls, count(*) AS pp FROM sc GROUP BY 1) p ON s.cls = p.cls
    LEFT JOIN (SELECT y_true AS cls, count(*) AS tp FROM sc WHERE y_true = y_pred GROUP BY 1) t ON coalesce(s.cls, p.cls) = t.cls)),
  per2 AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM per)
  SELECT cls, precision, recall, support, f1 FROM per2 UNION ALL
  SELECT 'macro avg', avg(precision), avg(recall), sum(support)::BIGINT, avg(f1) FROM per2 UNION ALL
  SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
    sum(support)::BIGINT, sum(f1 * support) / sum(support) FROM per2""")
def class_report(spark, d):
    """M3: precision / recall / F1 / support with macro and weighted means."""
    return SC.class_report(_scored(spark, d))


CLS_SCORES_SQL = """cs AS (SELECT l.lab AS cls, s.probability[l.k] AS score, s.y_true = l.lab AS is_pos FROM sc s,
    (SELECT lab, row_number() OVER (ORDER BY lab) AS k FROM (SELECT DISTINCT y_true AS lab FROM sc)) l),
  per AS (SELECT cls, score, count(*) FILTER (WHERE is_pos) AS tp, count(*) FILTER (WHERE NOT is_pos) AS fp FROM cs GROUP BY ALL),
  tots AS (SELECT cls, count(*) FILTER (WHERE is_pos) AS P, count(*) FILTER (WHERE NOT is_pos) AS N FROM cs GROUP BY cls),
  cum AS (SELECT *, sum(tp) OVER w AS cum_tp, sum(fp) OVER w AS cum_fp FROM per
    WINDOW w AS (PARTITION BY cls ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query("roc_points", _with(SCORED_SQL, CLS_SCORES_SQL) + """SELECT c.cls, c.score AS threshold, c.cum_fp / t.N AS fpr, c.cum_tp / t.P AS tpr
  FROM cum c JOIN tots t ON c.cls = t.cls UNION ALL SELECT cls, NULL::DOUBLE, 0.0, 0.0 FROM tots""")
def roc_points(spark, d):
    """M4: one-vs-rest ROC points per class."""
    return SC.roc_points(*_scored_with_labels(spark, d))


@query("roc_auc", _with(SCORED_SQL, CLS_SCORES_SQL) + """SELECT cls, sum(fp * (cum_tp - tp / 2.0)) / (sum(tp) * sum(fp))::DOUBLE AS auc
  FROM cum GROUP BY cls""")
def roc_auc(spark, d):
    """M4: one-vs-rest AUC per class (trapezoid, ties exact)."""
    return SC.roc_auc(*_scored_with_labels(spark, d)).orderBy(F.col("auc").desc())


def _mcnemar_sql(mode: str) -> str:
    if mode == "paired":
        b = "count(*) FILTER (WHERE y_true <> y_pred AND y_true = maj)"
        c = "count(*) FILTER (WHERE y_true = y_pred AND y_true <> maj)"
    else:
        b = "count(*) FILTER (WHERE y_true <> y_pred)"
        c = "count(*) FILTER (WHERE y_true = maj)"
    return _with(SCORED_SQL) + f""", m AS (SELECT y_true AS maj FROM sc GROUP BY y_true ORDER BY count(*) DESC, y_true LIMIT 1),
  t AS (SELECT {b} AS b, {c} AS c, avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) AS model_acc,
    avg(CASE WHEN y_true = maj THEN 1.0 ELSE 0.0 END) AS chance_acc FROM sc, m),
  tp AS (SELECT *, CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(t.b + t.c + 1) - lgamma(i + 1)
    - lgamma(t.b + t.c - i + 1) - (t.b + t.c) * ln(2))) FROM range(0, least(t.b, t.c) + 1) r(i))) END AS p FROM t)
  SELECT b, c, model_acc, chance_acc, p, CASE WHEN p < 0.05 AND model_acc > chance_acc THEN 'better'
    WHEN p < 0.05 AND model_acc < chance_acc THEN 'worse' ELSE 'not different' END AS verdict FROM tp"""


@query("mcnemar", _mcnemar_sql("paired"))
def mcnemar(spark, d):
    """Exact McNemar (discordant pairs) against the majority class."""
    return SC.mcnemar(_scored(spark, d), "paired")


@query("mcnemar_compat", _mcnemar_sql("compat"))
def mcnemar_compat(spark, d):
    """The reference's marginal-totals table."""
    return SC.mcnemar(_scored(spark, d), "compat")


# -------------------------------------------------------------- agreement ---

CONT_SQL = "cont AS (SELECT y_true, y_pred, count(*) AS n FROM sc GROUP BY ALL)"


def _agree_sql(cont: str, key: str = "") -> str:
    """Agreement scores over a contingency CTE named ``cont`` (optional key column)."""
    k = f"{key}, " if key else ""
    j = (lambda a, b: " AND ".join([f"{a}.{key} = {b}.{key}"] if key else ["TRUE"]))
    return f"""ra AS (SELECT {k}y_true, sum(n) AS a FROM {cont} GROUP BY ALL),
  cb AS (SELECT {k}y_pred, sum(n) AS b FROM {cont} GROUP BY ALL),
  tt AS (SELECT {k}sum(n)::DOUBLE AS N, sum(n * (n - 1) / 2.0) AS s_ij FROM {cont} {"GROUP BY " + key if key else ""}),
  rs AS (SELECT {k}sum(a * (a - 1) / 2.0) AS s_a, list(a) AS al FROM ra {"GROUP BY " + key if key else ""}),
  cs2 AS (SELECT {k}sum(b * (b - 1) / 2.0) AS s_b, list(b) AS bl FROM cb {"GROUP BY " + key if key else ""}),
  mi AS (SELECT {"c." + key + ", " if key else ""}sum(c.n / t.N * ln(t.N * c.n / (r.a * q.b))) AS mi FROM {cont} c
    JOIN ra r ON c.y_true = r.y_true {"AND c." + key + " = r." + key if key else ""}
    JOIN cb q ON c.y_pred = q.y_pred {"AND c." + key + " = q." + key if key else ""}
    JOIN tt t ON {j("c", "t")} {"GROUP BY c." + key if key else ""}),
  hh AS (SELECT {"t." + key + ", " if key else ""}t.N, t.s_ij, r.s_a, q.s_b, greatest(m.mi, 0.0) AS mi,
    list_reduce(list_prepend(0.0::DOUBLE, list_transform(r.al, lambda x: -(x / t.N) * ln(x / t.N))), lambda u, v: u + v) AS h_true,
    list_reduce(list_prepend(0.0::DOUBLE, list_transform(q.bl, lambda x: -(x / t.N) * ln(x / t.N))), lambda u, v: u + v) AS h_pred
    FROM tt t JOIN rs r ON {j("t", "r")} JOIN cs2 q ON {j("t", "q")} JOIN mi m ON {j("t", "m")}),
  sc2 AS (SELECT {k}CASE WHEN (s_a + s_b) / 2.0 = s_a * s_b / (N * (N - 1) / 2.0) THEN 1.0 ELSE
      (s_ij - s_a * s_b / (N * (N - 1) / 2.0)) / ((s_a + s_b) / 2.0 - s_a * s_b / (N * (N - 1) / 2.0)) END AS ari,
    CASE WHEN h_true = 0 AND h_pred = 0 THEN 1.0 ELSE mi / ((h_true + h_pred) / 2.0) END AS nmi,
    CASE WHEN h_true = 0 THEN 1.0 ELSE mi / h_true END AS homogeneity,
    CASE WHEN h_pred = 0 THEN 1.0 ELSE mi / h_pred END AS completeness FROM hh),
  agr AS (SELECT *, CASE WHEN homogeneity + completeness = 0 THEN 0.0
    ELSE 2 * homogeneity * completeness / (homogeneity + completeness) END AS v_measure FROM sc2)"""


@query("contingency", _with(SCORED_SQL, CONT_SQL) + "SELECT * FROM cont")
def contingency(spark, d):
    """Label x nearest-centroid cluster counts."""
    return A.contingency(_scored(spark, d), "y_true", "y_pred")


@query("cluster_sizes", _with(SCORED_SQL) + """SELECT y_pred AS value, count(*) AS n, 'predicted' AS kind FROM sc GROUP BY 1
  UNION ALL SELECT y_true, count(*), 'true' FROM sc GROUP BY 1""")
def cluster_sizes(spark, d):
    """Predicted and true cluster sizes."""
    return A.cluster_sizes(_scored(spark, d), "y_true", "y_pred")


@query("agreement_scores", _with(SCORED_SQL, CONT_SQL, _agree_sql("cont")) + "SELECT * FROM agr")
def agreement_scores(spark, d):
    """ARI, NMI, homogeneity, completeness, V-measure."""
    return A.agreement_scores(A.contingency(_scored(spark, d), "y_true", "y_pred"))


@query("cluster_purity", _with(SCORED_SQL, CONT_SQL) + """SELECT y_pred, arg_min(y_true, (-n, y_true)) AS majority_true,
  sum(n) AS size, max(n) / sum(n) AS purity FROM cont GROUP BY y_pred""")
def cluster_purity(spark, d):
    """Majority label and purity of every cluster."""
    return A.cluster_purity(A.contingency(_scored(spark, d), "y_true", "y_pred"))


# 3-way alignment: documents' label class against three bins of their
# unique-token ratio (k = 3 keeps the assignment enumerable in SQL).
ALIGN_SQL = """src AS (SELECT cls AS y_true, 'k' || least(2, floor(unique_ratio * 3))::INTEGER::VARCHAR AS y_pred FROM doc_features),
  cont AS (SELECT y_true, y_pred, count(*) AS n FROM src GROUP BY ALL),
  tl AS (SELECT y_true, row_number() OVER (ORDER BY y_true) AS i FROM (SELECT DISTINCT y_true FROM cont)),
  pl AS (SELECT y_pred, row_number() OVER (ORDER BY y_pred) AS j FROM (SELECT DISTINCT y_pred FROM cont)),
  perms AS (SELECT * FROM (VALUES (1, [1, 2, 3]), (2, [1, 3, 2]), (3, [2, 1, 3]), (4, [2, 3, 1]), (5, [3, 1, 2]), (6, [3, 2, 1])) v(pid, pm)),
  score AS (SELECT p.pid, sum(c.n) AS s FROM perms p, cont c JOIN tl ON c.y_true = tl.y_true JOIN pl ON c.y_pred = pl.y_pred
    WHERE p.pm[pl.j] = tl.i GROUP BY p.pid),
  best AS (SELECT pid FROM score ORDER BY s DESC, pid LIMIT 1),
  mapping AS (SELECT pl.y_pred, tl.y_true AS aligned FROM pl, tl, perms p, best b WHERE p.pid = b.pid AND p.pm[pl.j] = tl.i)"""


def _align_src(spark, d):
    f = X.doc_features(spark, d)
    return f.select(F.col("cls").alias("y_true"),
                    F.concat(F.lit("k"), F.least(F.lit(2), F.floor(F.col("unique_ratio") * 3)).cast("int")
                             .cast("string")).alias("y_pred"))


@query("cluster_alignment", _with(DOC_FEATURES_SQL, ALIGN_SQL) + """SELECT c.y_true, m.aligned AS y_pred, sum(c.n)::BIGINT AS n
  FROM cont c JOIN mapping m ON c.y_pred = m.y_pred GROUP BY ALL""")
def cluster_alignment(spark, d):
    """Clusters mapped to labels by maximum matching, aligned matrix."""
    return A.cluster_alignment(A.contingency(_align_src(spark, d), "y_true", "y_pred"))


def _chance_sql() -> str:
    u = lambda s: f"floor((('0x' || substr(md5('{s}:' || id::VARCHAR), 1, 8))::BIGINT / 4294967296.0) * "
    return f"""kk AS (SELECT count(DISTINCT y_pred) AS kp, count(DISTINCT y_true) AS kt FROM sc),
  lab AS (SELECT id, y_true, y_pred AS model, {u(SEED)}kk.kp)::BIGINT::VARCHAR AS random,
    {u(SEED + 1)}kk.kt)::BIGINT::VARCHAR AS random_true, '0' AS single, y_true AS perfect FROM sc, kk),
  r1 AS (SELECT *, row_number() OVER (ORDER BY id) AS rk FROM lab),
  r2 AS (SELECT y_true AS permuted, row_number() OVER (ORDER BY md5('{SEED}:' || id::VARCHAR), id) AS rk FROM lab),
  lab2 AS (SELECT r1.*, r2.permuted FROM r1 JOIN r2 ON r1.rk = r2.rk),
  stacked AS (SELECT 'model' AS baseline, y_true, model AS y_pred FROM lab2 UNION ALL
    SELECT 'random', y_true, random FROM lab2 UNION ALL SELECT 'random_true', y_true, random_true FROM lab2 UNION ALL
    SELECT 'single', y_true, single FROM lab2 UNION ALL SELECT 'perfect', y_true, perfect FROM lab2 UNION ALL
    SELECT 'permuted', y_true, permuted FROM lab2),
  bcont AS (SELECT baseline, y_true, y_pred, count(*) AS n FROM stacked GROUP BY ALL)"""


@query("adjusted_rand", _with(X.CLASSES_SQL, """dcont AS (SELECT c.cls AS y_true, d.lang AS y_pred, count(*) AS n
  FROM documents d JOIN classes c ON d.doc_id = c.doc_id GROUP BY ALL)""", _agree_sql("dcont")) + "SELECT ari FROM agr")
def adjusted_rand(spark, d):
    """Adjusted Rand index between the 3-way document class and the language."""
    docs = X.table(spark, d, "documents").select("doc_id", "lang")
    cont = A.contingency(docs.join(X.classes(spark, d), "doc_id"), "cls", "lang")
    return A.agreement_scores(cont).select("ari")


@query("nmi_v_measure", _with("""lcont AS (SELECT lang AS y_true, source AS y_pred, count(*) AS n
  FROM documents GROUP BY ALL)""", _agree_sql("lcont")) + "SELECT nmi, homogeneity, completeness, v_measure FROM agr")
def nmi_v_measure(spark, d):
    """NMI, homogeneity, completeness and V-measure of document source against language."""
    cont = A.contingency(X.table(spark, d, "documents"), "lang", "source")
    return A.agreement_scores(cont).select("nmi", "homogeneity", "completeness", "v_measure")


@query("chance_baselines", _with(SCORED_SQL, _chance_sql(), _agree_sql("bcont", "baseline"))
       + "SELECT baseline, ari, nmi FROM agr")
def chance_baselines(spark, d):
    """ARI / NMI of the model and of random, single, perfect and permuted labels."""
    return A.chance_baselines(_scored(spark, d), "id", "y_true", "y_pred", SEED)


@query("baseline_verdict", _with(SCORED_SQL, _chance_sql(), _agree_sql("bcont", "baseline")) + """SELECT ari, best_baseline, best_random,
  CASE WHEN ari > best_baseline THEN 'beats all baselines' WHEN ari > best_random THEN 'beats random assignment'
  ELSE 'does not beat random assignment' END AS verdict FROM (SELECT max(ari) FILTER (WHERE baseline = 'model') AS ari,
  max(ari) FILTER (WHERE baseline IN ('random', 'single', 'permuted', 'random_true')) AS best_baseline,
  max(ari) FILTER (WHERE baseline IN ('random', 'random_true')) AS best_random FROM agr)""")
def baseline_verdict(spark, d):
    """Verdict of the model against the chance baselines."""
    return A.baseline_verdict(A.chance_baselines(_scored(spark, d), "id", "y_true", "y_pred", SEED))
