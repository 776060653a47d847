"""Per-(feature, group) moments and the tests built on them.

The reference loops over features and re-groups the table once per feature.
Here one ``unpivot`` + one aggregation yields (feature, group, n, mean, var)
for every feature at once (Expand -> partial aggregate -> one exchange), and
ANOVA, Bonferroni and Cohen's d are computed from that small table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import f_pvalue_udf


def long_form(df: DataFrame, by: str, cols: list[str]) -> DataFrame:
    """(group, feature, v) rows; NULL values are kept."""
    return df.select(F.col(by).alias("grp"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in cols
    ])).alias("s")).select("grp", "s.feature", "s.v")


def moments(df: DataFrame, by: str, cols: list[str]) -> DataFrame:
    """(feature, grp, n, mean, var, n_null) with NULLs skipped in n/mean/var."""
    return long_form(df, by, cols).groupBy("feature", "grp").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.var_samp("v").alias("var"),
        F.count_if(F.col("v").isNull()).alias("n_null"))


def anova(mom: DataFrame, nulls: str = "drop") -> DataFrame:
    """One-way ANOVA per feature from the moments table.

    ``nulls="propagate"``: a feature with any missing value gets NULL F and p
    (the reference's track-level test); ``"drop"`` ignores missing values.
    """
    m = mom.filter(F.col("n") > 0)
    ssw_term = F.coalesce((F.col("n") - 1) * F.col("var"), F.lit(0.0))
    # plain sums: the spread between groups around the smallest group mean,
    # which keeps the difference of squares small
    low = F.min("mean").over(Window.partitionBy("feature"))
    m = m.withColumn("__d", F.col("mean") - low)
    per = m.groupBy("feature").agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("N"),
        F.sum(F.col("n") * F.col("__d")).alias("s1"), F.sum(F.col("n") * F.col("__d") * F.col("__d")).alias("s2"),
        F.sum(ssw_term).alias("ssw"), F.sum("n_null").alias("n_null"))
    ssb = F.greatest(F.col("s2") - F.col("s1") * F.col("s1") / F.col("N"), F.lit(0.0))
    out = per.select("feature", "k", "N", ssb.alias("ssb"), "ssw", "n_null")
    dfb = (F.col("k") - 1).cast("double")
    dfw = (F.col("N") - F.col("k")).cast("double")
    fstat = F.try_divide(F.try_divide(F.col("ssb"), dfb), F.try_divide(F.col("ssw"), dfw))
    if nulls == "propagate":
        fstat = F.when(F.col("n_null") == 0, fstat)
    out = out.select("feature", dfb.alias("df_between"), dfw.alias("df_within"), fstat.alias("F"))
    return out.withColumn("p", F.when(F.col("F").isNotNull(),
                                      f_pvalue_udf("F", "df_between", "df_within")))


def bonferroni(res: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Features with p < alpha / m, m = number of features tested.

    ``res`` has one row per feature, so m is a window count over that small
    table (read once) rather than a second pass through its inputs.
    """
    m = F.count(F.lit(1)).over(Window.partitionBy())
    return res.withColumn("alpha_corrected", F.lit(alpha) / m) \
              .filter(F.col("p") < F.col("alpha_corrected"))


def cohens_d(mom: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """Cohen's d for every pair of groups (g1 < g2) of each feature.

    Pooled variance with n-1; d = 0 when the pooled std is not > 0.  The
    self join runs on the moments table (features x groups rows), equi-joined
    on the feature.
    """
    m = mom.filter(F.col("n") > 0)
    if features is not None:
        m = m.join(features.select("feature").distinct(), "feature", "left_semi")
    a = m.select("feature", F.col("grp").alias("group1"), F.col("n").alias("n1"),
                 F.col("mean").alias("m1"), F.col("var").alias("v1"))
    b = m.select("feature", F.col("grp").alias("group2"), F.col("n").alias("n2"),
                 F.col("mean").alias("m2"), F.col("var").alias("v2"))
    j = a.join(b, "feature").filter(F.col("group1") < F.col("group2"))
    pooled = F.sqrt(F.try_divide(
        (F.col("n1") - 1) * F.coalesce("v1", F.lit(0.0)) + (F.col("n2") - 1) * F.coalesce("v2", F.lit(0.0)),
        (F.col("n1") + F.col("n2") - 2).cast("double")))
    d = F.when(pooled > 0, (F.col("m1") - F.col("m2")) / pooled).otherwise(F.lit(0.0))
    return j.select("feature", "group1", "group2", d.alias("d"))


def large_effects(d: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs with |d| >= threshold, sorted by d descending (T5)."""
    return d.filter(F.abs("d") >= threshold).orderBy(F.col("d").desc(), "feature", "group1", "group2")
