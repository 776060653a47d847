"""Evaluation of a scored table.

The scored table has one row per evaluated item:
``(id, fold, y_true string, y_pred string, probability array<double>)`` with
the probability vector in sorted-label order.  Every metric is one
aggregation over it; ROC running sums use the skew-safe ordered scan.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.special import mcnemar_exact_udf
from .describe import scalars
from ..functions.sizing import checked_collect
from ..session import materialize
from .joins import salted_join
from .ordered import running_sums

MAX_MODEL_CELLS = 1_000_000   # bound on k x d values a centroid model may hold


def _vec(col: str) -> Column:
    return F.transform(F.col(col), lambda x: x.cast("double"))


def class_centroids(df: DataFrame, vec: str, label: str, fold: str | None = None) -> dict[int, list[tuple[str, list[float]]]]:
    """Mean vector per class, sorted by label, for each fold's training rows; a model-sized result.

    Vectors are summed per (class, fold) on Spark with partial aggregation;
    the centroid that scores fold f is the mean over the class's rows outside
    f.  Without ``fold`` there is one model, of all rows, under key 0.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer
    v = F.col(vec)
    if isinstance(df.schema[vec].dataType, T.ArrayType):
        v = array_to_vector(_vec(vec))
    rows = df.select(F.col(label).cast("string").alias("lab"), (F.col(fold) if fold else F.lit(0)).cast("int").alias("f"), v.alias("__v"))
    first = rows.select("__v").first()
    if first is None:
        return {}
    per = rows.groupBy("lab", "f").agg(Summarizer.sum(F.col("__v")).alias("s"), F.count(F.lit(1)).alias("n"))
    got = checked_collect(per, MAX_MODEL_CELLS, "centroid model", len(first[0]))
    parts = {(r["lab"], r["f"]): (r["s"].toArray(), r["n"]) for r in got}
    labels, folds = sorted({k[0] for k in parts}), sorted({k[1] for k in parts})
    out = {}
    for f in folds:
        model = []
        for lab in labels:
            kept = [parts[lab, g] for g in folds if (lab, g) in parts and (fold is None or g != f)]
            if kept:  # a class with all its rows in this fold cannot be predicted there
                n = sum(k for _, k in kept)
                model.append((lab, [float(x) for x in sum(x for x, _ in kept) / n]))
        out[f] = model
    return out


def nearest_centroid_scores(df: DataFrame, id_col: str, vec: str, label: str,
                            centroids: dict[int, list[tuple[str, list[float]]]], fold: str | None = None) -> DataFrame:
    """Score rows against their fold's centroids: y_pred = nearest (ties to the lower label).

    probability = softmax(-squared distance), in the order of the model's
    labels.  Dense k x d arithmetic per row runs in numpy on Arrow batches
    (``mapInPandas``); the centroid matrices are model-sized and shipped with
    the function.
    """
    models = {f: (np.array([x for x, _ in m], dtype=object), np.array([c for _, c in m], dtype="float64")) for f, m in centroids.items()}
    src = df.select(F.col(id_col).alias("id"), F.col(label).cast("string").alias("y_true"),
                    (F.col(fold) if fold else F.lit(0)).cast("int").alias("fold"),
                    _vec(vec).alias("x"))

    def score(batches):
        for all_rows in batches:
            for f, pdf in all_rows.groupby("fold"):
                names, cmat = models[f]
                x = np.stack(pdf["x"].to_numpy()).astype("float64")
                dist = np.empty((len(x), len(cmat)))
                for j in range(len(cmat)):
                    diff = x - cmat[j]
                    dist[:, j] = np.einsum("ij,ij->i", diff, diff)
                best = dist.argmin(axis=1)            # first minimum -> lowest label
                e = np.exp(dist.min(axis=1, keepdims=True) - dist)
                prob = e / e.sum(axis=1, keepdims=True)
                yield pd.DataFrame({"id": pdf["id"], "fold": pdf["fold"], "y_true": pdf["y_true"],
                                    "y_pred": names[best], "probability": list(prob)})

    schema = "id long, fold int, y_true string, y_pred string, probability array<double>"
    return src.mapInPandas(score, schema)


def cells(scored: DataFrame) -> DataFrame:
    """(y_true, y_pred, n): the one pass over a scored table that M1-M3, T6 and
    C7-C11 need.  Its size is labels x labels, independent of the row count;
    it is checkpointed so every metric derived from it reads the small table
    instead of rescanning (and re-scoring) the rows."""
    c = scored.groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    return materialize(c)


def _cells(scored_or_cells: DataFrame) -> DataFrame:
    if "n" in scored_or_cells.columns and "probability" not in scored_or_cells.columns:
        return scored_or_cells
    return cells(scored_or_cells)


def confusion_matrix(scored: DataFrame, digits: int = 1, normalize: bool = True) -> DataFrame:
    """Row-normalised confusion matrix in long form (M1); absent cells are 0.

    Everything comes from the cell counts: the label grid (k x k) is built
    from the distinct labels gathered into one row and left-joined.
    """
    cl = _cells(scored)
    labs = cl.select(F.col("y_true").alias("l")).union(cl.select(F.col("y_pred").alias("l"))) \
             .agg(F.array_sort(F.collect_set("l")).alias("ls"))
    grid = labs.select(F.explode("ls").alias("y_true"), "ls") \
               .select("y_true", F.explode("ls").alias("y_pred"))
    full = grid.join(cl, ["y_true", "y_pred"], "left").na.fill(0, ["n"])
    if not normalize:
        return full
    rows = cl.groupBy("y_true").agg(F.sum("n").alias("row_n"))
    out = full.join(rows, "y_true", "left")
    share = F.try_divide(F.col("n").cast("double"), F.col("row_n").cast("double"))
    if digits is not None:
        share = F.bround(share, digits)
    return out.select("y_true", "y_pred", "n", share.alias("share"))


def accuracy_vs_chance(scored: DataFrame) -> DataFrame:
    """Model accuracy and majority-class accuracy (M2)."""
    cl = _cells(scored)
    per_true = cl.groupBy("y_true").agg(F.sum("n").alias("c"),
                                        F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n"))
                                              .otherwise(0)).alias("right"))
    return per_true.agg((F.sum("right") / F.sum("c")).alias("model_acc"),
                        (F.max("c") / F.sum("c")).alias("chance_acc"),
                        F.sum("c").alias("n"))


def class_report(scored: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, plus macro / weighted avg (M3).

    0 on zero division, as the reference's default.
    """
    cl = _cells(scored)
    tp = cl.filter(F.col("y_true") == F.col("y_pred")).select(F.col("y_true").alias("cls"), F.col("n").alias("tp"))
    sup = cl.groupBy(F.col("y_true").alias("cls")).agg(F.sum("n").alias("support"))
    pp = cl.groupBy(F.col("y_pred").alias("cls")).agg(F.sum("n").alias("pp"))
    j = sup.join(pp, "cls", "full").join(tp, "cls", "left").na.fill(0, ["tp", "support", "pp"])
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("pp").cast("double")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support").cast("double")), F.lit(0.0))
    per = j.select("cls", prec.alias("precision"), rec.alias("recall"), "support")
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"),
                                 F.col("precision") + F.col("recall")), F.lit(0.0))
    per = per.withColumn("f1", f1)
    tot = F.sum("support").cast("double")
    macro = per.agg(F.lit("macro avg").alias("cls"), F.avg("precision").alias("precision"),
                    F.avg("recall").alias("recall"), F.sum("support").alias("support"), F.avg("f1").alias("f1"))
    weighted = per.agg(F.lit("weighted avg").alias("cls"),
                       (F.sum(F.col("precision") * F.col("support")) / tot).alias("precision"),
                       (F.sum(F.col("recall") * F.col("support")) / tot).alias("recall"),
                       F.sum("support").alias("support"),
                       (F.sum(F.col("f1") * F.col("support")) / tot).alias("f1"))
    return per.unionByName(macro).unionByName(weighted)


def sorted_labels(scored: DataFrame) -> list[str]:
    """Distinct true labels, sorted: model-sized (k values), checked.  Pass the
    model's own labels to the ROC functions instead where they are known."""
    labs = checked_collect(scored.select("y_true").distinct(), MAX_MODEL_CELLS, "labels")
    return sorted(r[0] for r in labs)


def _class_scores(scored: DataFrame, labels: list[str] | None) -> DataFrame:
    """(cls, score, is_pos) per row and class; class k = k-th sorted label."""
    ls = F.lit(labels if labels is not None else sorted_labels(scored))
    return scored.select("y_true", F.posexplode("probability").alias("k", "score")) \
                 .select(F.element_at(ls, F.col("k") + 1).alias("cls"), "score",
                         (F.col("y_true") == F.element_at(ls, F.col("k") + 1)).alias("is_pos"))


def roc_points(scored: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """One-vs-rest ROC points per class, one per distinct score (M4).

    Scores are pre-aggregated to (class, score) counts before the ordered
    running sums; a start point (0, 0) with NULL threshold is added.
    """
    cs = _class_scores(scored, labels)
    per = cs.groupBy("cls", "score").agg(F.count_if("is_pos").alias("tp"),
                                         F.count_if(~F.col("is_pos")).alias("fp"))
    cum = running_sums(per.withColumn("neg_score", -F.col("score")), "cls", "neg_score",
                       {"cum_tp": F.col("tp"), "cum_fp": F.col("fp")})
    # a class may hold most points: they meet its totals in many tasks
    tots = per.groupBy("cls").agg(F.sum("tp").alias("n_pos"), F.sum("fp").alias("n_neg"))
    j = salted_join(cum, tots, "cls")
    pts = j.select("cls", F.col("score").alias("threshold"),
                   F.try_divide(F.col("cum_fp").cast("double"), F.col("n_neg").cast("double")).alias("fpr"),
                   F.try_divide(F.col("cum_tp").cast("double"), F.col("n_pos").cast("double")).alias("tpr"))
    start = tots.select("cls", F.lit(None).cast("double").alias("threshold"),
                        F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(start)


def roc_auc(scored: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """AUC per class by the trapezoid rule over the ROC points (M4).

    A group of rows sharing one score adds fp/N * (TP_before + tp/2)/P, so no
    lag over an ordered window is needed; ties are handled exactly.
    """
    cs = _class_scores(scored, labels)
    per = cs.groupBy("cls", "score").agg(F.count_if("is_pos").alias("tp"),
                                         F.count_if(~F.col("is_pos")).alias("fp"))
    cum = running_sums(per.withColumn("neg_score", -F.col("score")), "cls", "neg_score",
                       {"cum_tp": F.col("tp")})
    area = cum.groupBy("cls").agg(
        F.sum(F.col("fp") * (F.col("cum_tp") - F.col("tp") / 2.0)).alias("a"),
        F.sum("tp").alias("n_pos"), F.sum("fp").alias("n_neg"))
    return area.select("cls", F.try_divide(F.col("a"), (F.col("n_pos") * F.col("n_neg")).cast("double")).alias("auc"))


def mcnemar(scored: DataFrame, mode: str = "paired", alpha: float = 0.05) -> DataFrame:
    """Exact McNemar test of the model against the majority-class baseline.

    ``paired``: b = model wrong & chance right, c = model right & chance wrong.
    ``compat``: the reference's table of marginal totals, b = model wrong,
    c = chance right.  All counts come from the cell table.
    """
    cl = _cells(scored)
    per_true = cl.groupBy("y_true").agg(F.sum("n").alias("c"))
    maj = per_true.orderBy(F.col("c").desc(), F.col("y_true").asc()).limit(1).select("y_true").scalar()
    right = F.col("y_true") == F.col("y_pred")
    chance = F.col("y_true") == maj
    n = F.col("n")

    def total(cond):
        return F.sum(F.when(cond, n).otherwise(0))
    if mode == "paired":
        b, c = total(~right & chance), total(right & ~chance)
    elif mode == "compat":
        b, c = total(~right), total(chance)
    else:
        raise ValueError("mode must be 'paired' or 'compat'")
    t = cl.agg(b.alias("b"), c.alias("c"),
               (total(right) / F.sum(n)).alias("model_acc"),
               (total(chance) / F.sum(n)).alias("chance_acc"))
    t = t.withColumn("p", mcnemar_exact_udf("b", "c"))
    verdict = (F.when((F.col("p") < alpha) & (F.col("model_acc") > F.col("chance_acc")), "better")
                .when((F.col("p") < alpha) & (F.col("model_acc") < F.col("chance_acc")), "worse")
                .otherwise("not different"))
    return t.withColumn("verdict", verdict)
