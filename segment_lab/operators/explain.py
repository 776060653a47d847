"""Model explanations (M5-M7).

Linear SHAP for a linear model with independent features is exact:
phi_j = coef_j * (x_j - mean_j) per class (margin space).  Its mean absolute
value factors into |coef| times the feature's mean absolute deviation, so
two vector aggregates over the rows serve every class.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.randomness import seeded_hash


def coef_importance(model, names: list[str], labels: list[str], n: int = 5) -> DataFrame:
    """Top ``n`` coefficients by |value| per class of a fitted LR model (M5).

    The coefficient matrix is model-sized (classes x features).
    """
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    mat = model.coefficientMatrix.toArray()
    rows = [(labels[i], names[j], float(mat[i, j])) for i in range(mat.shape[0]) for j in range(mat.shape[1])]
    df = spark.createDataFrame(rows, "cls string, feature string, coef double")
    from pyspark.sql import Window
    w = Window.partitionBy("cls").orderBy(F.abs("coef").desc(), "feature")
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def shap_linear(df: DataFrame, model, vec: str, names: list[str], labels: list[str],
                top: int = 5) -> DataFrame:
    """Mean |phi| per (class, feature) and the top ``top`` features per class (M6).

    phi_ij = coef_ij * (x_j - mu_j), background = the scored rows.  Since
    |coef_ij * (x_j - mu_j)| = |coef_ij| * |x_j - mu_j|, the mean |phi| is
    |coef_ij| times the mean absolute deviation of feature j: two vector
    aggregates over the rows (mean, then mean |x - mu|) give all classes at
    once.  Returns (top table, base values per class) where base_i =
    intercept_i + coef_i . mu, so that sum_j phi_ij + base_i is the margin.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer
    from pyspark.sql import SparkSession, Window
    mat = model.coefficientMatrix.toArray()
    icpt = model.interceptVector.toArray()
    d = len(names)
    mu = df.select(Summarizer.mean(F.col(vec)).alias("m")).first()["m"].toArray()   # d values
    mu_arr = F.array(*[F.lit(float(v)) for v in mu])
    dev = df.select(array_to_vector(F.zip_with(vector_to_array(F.col(vec)), mu_arr,
                                               lambda a, b: F.abs(a - b))).alias("dev"))
    mad = dev.select(Summarizer.mean(F.col("dev")).alias("m")).first()["m"].toArray()
    spark = SparkSession.getActiveSession()
    rows = [(lab, names[j], float(abs(mat[i, j]) * mad[j])) for i, lab in enumerate(labels) for j in range(d)]
    long = spark.createDataFrame(rows, "cls string, feature string, mean_abs_phi double")
    w = Window.partitionBy("cls").orderBy(F.col("mean_abs_phi").desc(), "feature")
    base = [float(icpt[i] + float(mat[i] @ mu)) for i in range(len(labels))]
    return long.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top), base


def permutation_importance(df: DataFrame, model, vec: str, label_idx: str, names: list[str],
                           id_col: str, seed: int = 1987) -> DataFrame:
    """Accuracy drop when one feature is permuted (M7, forest attribution re-aim).

    Each feature's copy takes the value of that feature from the row whose
    seeded hash rank is next (a deterministic derangement by hash order),
    built with one join on the rank; then one ``transform`` over all copies.
    """
    from pyspark.ml.functions import array_to_vector
    from .ordered import ordinal
    d = len(names)
    base = df.select(F.col(label_idx).alias("__y"), vector_to_array(F.col(vec)).alias("__x"),
                     seeded_hash(seed, id_col).alias("__h"), F.col(id_col).alias("__id"))
    base = base.withColumn("__one", F.lit(0))
    r = ordinal(base, "__one", ["__h", "__id"], "__rk")
    n = r.count()
    donor = r.select(((F.col("__rk") + 1) % n).alias("__rk"), F.col("__x").alias("__dx"))
    j = r.join(donor, "__rk")
    def swap(f):
        return lambda v, i: F.when(i == f, F.col("__dx")[f]).otherwise(v)

    copies = j.select("__y", F.explode(F.array(*[
        F.struct(F.lit(names[f]).alias("feature"), F.transform("__x", swap(f)).alias("px"))
        for f in range(d)] + [F.struct(F.lit("__none__").alias("feature"), F.col("__x").alias("px"))])).alias("s"))
    scored = model.transform(copies.select("__y", "s.feature", array_to_vector("s.px").alias(vec)))
    acc = scored.groupBy("feature").agg(F.avg(F.when(F.col("prediction") == F.col("__y"), 1.0).otherwise(0.0)).alias("acc"))
    ref = acc.filter(F.col("feature") == "__none__").select("acc").scalar()
    return acc.filter(F.col("feature") != "__none__").select("feature", (ref - F.col("acc")).alias("importance"))


def impurity_importance(forest, names: list[str]) -> DataFrame:
    """Impurity-based importance of each feature of a fitted forest (M7), with its rank."""
    from pyspark.sql import SparkSession
    values = forest.featureImportances.toArray()
    order = sorted(range(len(names)), key=lambda j: (-values[j], names[j]))
    return SparkSession.getActiveSession().createDataFrame(
        [(names[j], float(values[j]), r + 1) for r, j in enumerate(order)], "feature string, importance double, rank int")


def shap_rows(df: DataFrame, model, vec: str, id_col: str, labels: list[str]) -> DataFrame:
    """Per-row linear SHAP values (M6): ``(id, cls, phi, base, margin)``, one row per row and class.

    phi_j = coef_j * (x_j - mean_j); a binomial model has one margin, that of
    its second label.
    """
    from pyspark.ml.stat import Summarizer
    mat, icpt = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    shown = labels if mat.shape[0] == len(labels) else labels[1:]
    mu = df.select(Summarizer.mean(F.col(vec)).alias("m")).first()["m"].toArray()
    x = vector_to_array(F.col(vec))
    parts = []
    for i, lab in enumerate(shown):
        coef = F.lit([float(v) for v in mat[i]])
        phi = F.zip_with(F.zip_with(x, F.lit([float(v) for v in mu]), lambda a, b: a - b), coef, lambda a, b: a * b)
        margin = F.aggregate(F.zip_with(x, coef, lambda a, b: a * b), F.lit(float(icpt[i])), lambda a, b: a + b)
        parts.append(F.struct(F.lit(lab).alias("cls"), phi.alias("phi"), F.lit(float(icpt[i] + mat[i] @ mu)).alias("base"), margin.alias("margin")))
    return df.select(F.col(id_col).alias("id"), F.explode(F.array(*parts)).alias("s")).select("id", "s.*")


def score_equations(rows: DataFrame, model, labels: list[str], vec: str = "features", label: str = "label",
                    weight: str = "weight") -> DataFrame:
    """How well a penalised logistic model solves its own equations on its training rows (L3): ``(label, feature, target, gap)``.

    At the optimum, for each class and feature, the weighted features of the
    class's rows (``target``) equal the weighted features of all rows times
    the class's probability, plus the penalty's part (the coefficient, for
    C = 1).  ``gap`` is the difference per unit of weight: the gradient of the
    mean loss.  Feature -1 is the intercept, which is not penalised.  One pass:
    two vector sums a class, no row is multiplied.
    """
    scored = model.transform(rows.withColumn("__p_label", F.col(label).cast("string")).withColumn(model.getFeaturesCol(), F.col(vec)))
    p = vector_to_array(F.col(model.getProbabilityCol()))
    sums = []
    for c, name in enumerate(labels):
        own = F.when(F.col("__p_label") == name, F.col(weight)).otherwise(0.0)
        for what, w in (("t", own), ("f", F.col(weight) * p[c])):
            sums += [Summarizer.metrics("sum").summary(F.col(vec), w)["sum"].alias(f"{what}{c}"), F.sum(w).alias(f"{what}w{c}")]
    one = scored.agg(*sums, F.sum(weight).alias("n"))
    coef = model.coefficientMatrix.toArray()
    if len(coef) == 1:  # two classes: the one row is the second class's, the first's equations mirror it
        coef = [-coef[0], coef[0]]
    d = model.numFeatures

    def cells(c: int, name: str):
        target = F.concat(F.array(F.col(f"tw{c}")), vector_to_array(F.col(f"t{c}")))
        fitted = F.concat(F.array(F.col(f"fw{c}")), vector_to_array(F.col(f"f{c}")))
        penalty = F.lit([0.0, *map(float, coef[c])])
        return F.transform(F.sequence(F.lit(0), F.lit(d)), lambda j: F.struct(
            F.lit(name).alias("label"), (j - 1).alias("feature"), F.get(target, j).alias("target"),
            (F.abs(F.get(fitted, j) + F.get(penalty, j) - F.get(target, j)) / F.col("n")).alias("gap")))
    return one.select(F.explode(F.concat(*[cells(c, name) for c, name in enumerate(labels)])).alias("x")).select("x.*")
