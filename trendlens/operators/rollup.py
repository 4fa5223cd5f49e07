"""Parameter-level roll-ups and report tables.

Inputs are the long result tables (coefficients, interaction coefficients,
SHAP importance, PDP curves, permutation importance) keyed by target; the
feature -> parameter lineage comes from the features table, so attribution
never depends on substring matches.  All relational: group-bys, semi-joins
with small broadcast tables, per-group ``row_number`` for top-k.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

ALPHA = 0.05
MARGINAL = 0.10


def params_table(spark: SparkSession, params: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(p, i) for i, p in enumerate(params)], "parameter string, ord int")


def significant(df: DataFrame, alpha: float = ALPHA, p_col: str = "p") -> DataFrame:
    """Rows with p < alpha; ``band`` marks significant / marginal."""
    return df.where(F.col(p_col) < alpha)


def significance_band(p: str = "p", alpha: float = ALPHA, marginal: float = MARGINAL):
    return (F.when(F.col(p) < alpha, F.lit("significant"))
             .when(F.col(p) < marginal, F.lit("marginal")).otherwise(F.lit("not significant")))


def restrict(df: DataFrame, params: DataFrame) -> DataFrame:
    """Keep only listed parameters, carrying their list order."""
    return df.join(F.broadcast(params), "parameter", "inner")


def shap_by_parameter(importance: DataFrame, features: DataFrame, params: DataFrame,
                      value: str = "mean_abs_shap", by: Sequence[str] = ("target",)) -> DataFrame:
    """Sum of importance per parameter, descending."""
    j = importance.join(F.broadcast(features.select("feature", "parameter")), "feature", "inner")
    return restrict(j.groupBy(*by, "parameter").agg(F.sum(value).alias("importance")), params)


def coef_by_parameter(coefs: DataFrame, params: DataFrame, *, alpha: float | None = None,
                      by: Sequence[str] = ("target",), share: bool = False) -> DataFrame:
    """Sum |coef| per parameter (intercept excluded); with
    ``alpha`` only significant terms.  An interaction term is credited to
    every parameter in it (``share=True`` splits |coef| evenly instead)."""
    c = coefs.where(F.col("term") != "Intercept")
    if alpha is not None:
        c = c.where(F.col("p") < alpha)
    e = c.select(*by, F.abs("coef").alias("_a"), F.size("parameters").alias("_n"),
                 F.explode("parameters").alias("parameter"))
    val = F.col("_a") / F.col("_n") if share else F.col("_a")
    return restrict(e.groupBy(*by, "parameter").agg(F.sum(val).alias("sum_abs_coef")), params)


def with_parameters(coefs: DataFrame, features: DataFrame) -> DataFrame:
    """Attach ``parameters`` (array) to a linear coefficient table by lineage."""
    f = features.select(F.col("feature").alias("term"), F.array("parameter").alias("parameters"))
    return coefs.join(F.broadcast(f), "term", "left").withColumn(
        "parameters", F.coalesce("parameters", F.array().cast("array<string>")))


def pdp_effect_by_parameter(effects: DataFrame, features: DataFrame, params: DataFrame,
                            by: Sequence[str] = ("target",)) -> DataFrame:
    """Mean, max and count of feature effects per parameter."""
    j = effects.join(F.broadcast(features.select("feature", "parameter")), "feature", "inner")
    return restrict(j.groupBy(*by, "parameter").agg(F.avg("effect").alias("effect_mean"),
                                                   F.max("effect").alias("effect_max"),
                                                   F.count(F.lit(1)).alias("n_features")), params)


def top_k(df: DataFrame, k: int, order, by: Sequence[str] = (), tie: str = "feature") -> DataFrame:
    """H1/H3/H4: top-k rows (per ``by`` group) with ``rank``; ties by name."""
    if not by:
        # distributed top-k (TakeOrderedAndProject); the window then sees k rows
        head = df.orderBy(order, F.col(tie).asc()).limit(k)
        return head.withColumn("rank", F.row_number().over(W.orderBy(order, F.col(tie).asc())))
    w = W.partitionBy(*by).orderBy(order, F.col(tie).asc())
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_abs_coef(coefs: DataFrame, k: int = 20, by: Sequence[str] = ("target",)) -> DataFrame:
    """H2: top-k terms by |coef| with direction; intercept and empty dropped."""
    c = coefs.where((F.col("term") != "Intercept") & F.col("coef").isNotNull())
    c = c.withColumn("abs_coef", F.abs("coef")).withColumn(
        "direction", F.when(F.col("coef") < 0, F.lit("negative")).otherwise(F.lit("positive")))
    return top_k(c, k, F.col("abs_coef").desc(), by, tie="term")


def top_significant_terms(coefs: DataFrame, k: int = 20, alpha: float = ALPHA,
                          by: Sequence[str] = ("target", "depth")) -> DataFrame:
    """H3: per target and depth, top-k significant terms by |coef|."""
    c = coefs.where((F.col("term") != "Intercept") & (F.col("p") < alpha)).withColumn("abs_coef", F.abs("coef"))
    return top_k(c, k, F.col("abs_coef").desc(), by, tie="term")


def pdp_top_series(pdp: DataFrame, effects: DataFrame, k: int = 6, by: Sequence[str] = ("target",)) -> DataFrame:
    """H5: PD curves of the k features with the largest effect (semi-join)."""
    top = top_k(effects, k, F.col("effect").desc(), by).select(*by, "feature")
    return pdp.join(F.broadcast(top), [*by, "feature"], "left_semi")


def compare_methods(spark: SparkSession, tables: dict, params: DataFrame,
                    by: Sequence[str] = ("target",)) -> DataFrame:
    """H7: one ranking of parameters across methods.

    ``tables``: method -> DataFrame(by..., parameter, value).  Each method is
    ranked per group (1 = most important); methods are full-outer-joined on
    the parameter and the mean rank orders the result.
    """
    joined = None
    methods = list(tables)
    for m in methods:
        t = tables[m]
        r = t.withColumn(f"rank_{m}", F.rank().over(W.partitionBy(*by).orderBy(F.col("value").desc())))
        r = r.select(*by, "parameter", F.col("value").alias(f"value_{m}"), f"rank_{m}")
        joined = r if joined is None else joined.join(r, [*by, "parameter"], "full_outer")
    ranks = [F.col(f"rank_{m}") for m in methods]
    n = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in ranks), F.lit(0))
    s = sum((F.coalesce(c, F.lit(0)) for c in ranks), F.lit(0))
    out = joined.withColumn("n_methods", n).withColumn("mean_rank", s / n)
    return out.join(F.broadcast(params), "parameter", "inner")


def summary_facts(coefs: DataFrame, fit: DataFrame, importance: DataFrame | None = None,
                  skew: DataFrame | None = None, alpha: float = ALPHA, *,
                  reference_levels: dict | None = None, metrics: DataFrame | None = None,
                  cv: DataFrame | None = None, terms: DataFrame | None = None) -> DataFrame:
    """H6: narrative facts per target as rows
    ``target, section, ord, subject, value, text``: reference levels,
    intercept, significant and marginal terms with direction and size, R²,
    model metrics (R², MAE, RMSE), CV mean ± std, top SHAP features with
    direction, skew notes.  ``terms`` (an interaction coefficient table): the
    significant and marginal terms are taken from it, by label."""
    parts = []
    if reference_levels:
        spark = coefs.sparkSession
        ref = spark.createDataFrame([(c, str(v)) for c, v in reference_levels.items()], "subject string, lvl string")
        parts.append(ref.select(F.lit(None).cast("string").alias("target"), F.lit("reference").alias("section"),
                                F.lit(0).alias("ord"), "subject", F.lit(None).cast("double").alias("value"),
                                F.format_string("%s: baseline level is %s", F.col("subject"), F.col("lvl")).alias("text")))
    if metrics is not None:
        parts.append(metrics.select("target", F.lit("metrics").alias("section"), F.lit(0).alias("ord"),
                                    F.lit("r2").alias("subject"), F.col("r2").alias("value"),
                                    F.format_string("R² = %.4f, MAE = %.4f, RMSE = %.4f", F.col("r2"), F.col("mae"),
                                                    F.col("rmse")).alias("text")))
    if cv is not None:
        parts.append(cv.select("target", F.lit("cv").alias("section"), F.lit(0).alias("ord"),
                               F.lit("cv_r2").alias("subject"), F.col("cv_mean").alias("value"),
                               F.format_string("Cross-validated R² = %.4f ± %.4f", F.col("cv_mean"),
                                               F.col("cv_std")).alias("text")))
    icp = coefs.where(F.col("term") == "Intercept").select(
        "target", F.lit("intercept").alias("section"), F.lit(0).alias("ord"),
        F.lit("Intercept").alias("subject"), F.col("coef").alias("value"),
        F.format_string("Baseline (intercept) is %.4f", F.col("coef")).alias("text"))
    parts.append(icp)
    if terms is not None:
        coefs = terms.select("target", F.col("label").alias("term"), "coef", "p")
    sig = coefs.where((F.col("term") != "Intercept") & (F.col("p") < alpha))
    w = W.partitionBy("target").orderBy(F.abs("coef").desc(), F.col("term"))
    parts.append(sig.withColumn("ord", F.row_number().over(w)).select(
        "target", F.lit("significant").alias("section"), "ord", F.col("term").alias("subject"),
        F.col("coef").alias("value"),
        F.format_string("%s %s the outcome by %.4f per unit (p = %.3g)", F.col("term"),
                        F.when(F.col("coef") > 0, F.lit("increases")).otherwise(F.lit("decreases")),
                        F.abs("coef"), F.col("p")).alias("text")))
    marg = coefs.where((F.col("term") != "Intercept") & (F.col("p") >= alpha) & (F.col("p") < MARGINAL))
    parts.append(marg.select("target", F.lit("marginal").alias("section"), F.lit(0).alias("ord"),
                             F.col("term").alias("subject"), F.col("p").alias("value"),
                             F.format_string("%s is marginal (p = %.3g)", F.col("term"), F.col("p")).alias("text")))
    parts.append(fit.select("target", F.lit("fit").alias("section"), F.lit(0).alias("ord"),
                            F.lit("r2").alias("subject"), F.col("r2").alias("value"),
                            F.format_string("R² = %.4f on %d rows", F.col("r2"), F.col("n")).alias("text")))
    if importance is not None:
        wi = W.partitionBy("target").orderBy(F.col("mean_abs_shap").desc(), F.col("feature"))
        parts.append(importance.withColumn("ord", F.row_number().over(wi)).where(F.col("ord") <= 5).select(
            "target", F.lit("top_shap").alias("section"), "ord", F.col("feature").alias("subject"),
            F.col("mean_abs_shap").alias("value"),
            F.format_string("%s (mean |SHAP| = %.4f, %s on average)", F.col("feature"), F.col("mean_abs_shap"),
                            F.when(F.col("mean_shap") >= 0, F.lit("raises")).otherwise(F.lit("lowers"))).alias("text")))
    if skew is not None:
        # skew notes describe the table, not one target
        parts.append(skew.where("flagged").select(
            F.lit(None).cast("string").alias("target"), F.lit("skew").alias("section"), F.col("ord"),
            F.col("column").alias("subject"), F.col("skew").alias("value"),
            F.format_string("%s is skewed (g1 = %.3f)", F.col("column"), F.col("skew")).alias("text")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
