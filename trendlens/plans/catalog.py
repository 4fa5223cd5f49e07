"""Registered queries: one per operator family, each over the driver tables.

Every query reads whole tables (or data Spark derives from them).  Doubles
are rounded identically here and in the oracle SQL so the driver's value
hash compares like with like.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendlens.functions.labels import display_name
from trendlens.operators import clean, encode, explain, forest, interact, levels, linear, pca, rollup, stats
from trendlens.operators.index import kfold, stable_index
from trendlens.plans import frames as fr
from trendlens.sources import joins, results

D4, D6, D8 = 4, 6, 8


def _r(c, d):
    return F.round(F.col(c), d).alias(c)


# ------------------------------------------------------------------ sources

def q_first_child_left_join(spark, sf):
    cu = fr.table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    od = fr.table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    li = fr.table(spark, sf, "lineitem")
    od_all = fr.table(spark, sf, "orders")
    ms = [joins.Measurement(li, "l_orderkey", ["l_extendedprice"], F.col("l_returnflag") != "R", ["line_price"]),
          joins.Measurement(od_all, "o_orderkey", ["o_totalprice"], F.col("o_orderstatus") != "P",
                            ["order_total"])]
    return joins.first_child_left_join(cu, "c_custkey", od, "o_custkey", "o_orderkey", ms,
                                       not_null=["c_mktsegment"])


def q_left_join_flag(spark, sf):
    cu = fr.table(spark, sf, "customer").select("c_custkey")
    od = fr.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")
    j = joins.left_join_flag(cu, od, "c_custkey", "o_custkey", F.col("o_orderstatus") != "P")
    return j.select("c_custkey", "o_orderkey", "o_totalprice")


def q_salted_left_join(spark, sf):
    """C1 under skew: regions LEFT JOIN their customers, where every region
    key holds a large share of the right side.  Keys above a quarter of one
    task's fair share are salted; the result must equal the plain join."""
    reg = fr.table(spark, sf, "region")
    cust = (fr.table(spark, sf, "customer").join(fr.table(spark, sf, "nation"),
                                                 F.col("c_nationkey") == F.col("n_nationkey"))
            .select("n_regionkey", "c_custkey", "c_acctbal"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = cust.count() // (4 * parts)  # one small count: the threshold scales with the table
    hot = joins.hot_keys(cust, "n_regionkey", min_rows=max(share, 1))
    out = joins.salted_left_join(reg, cust, "r_regionkey", "n_regionkey", hot=hot)
    return out.select("r_regionkey", "r_name", "c_custkey", "c_acctbal")


def q_salted_left_nulls(spark, sf):
    """C1 with a null-heavy right key: customers of two regions out of five
    lose their region key, and every key above the threshold is salted."""
    reg = fr.table(spark, sf, "region")
    key = F.when(~F.col("n_regionkey").isin(1, 3), F.col("n_regionkey"))
    cust = (fr.table(spark, sf, "customer").join(fr.table(spark, sf, "nation"),
                                                 F.col("c_nationkey") == F.col("n_nationkey"))
            .select(key.alias("rkey"), "c_custkey", "c_acctbal"))
    out = joins.salted_left_join(reg, cust, "r_regionkey", "rkey", min_rows=7)
    return out.select("r_regionkey", "r_name", "c_custkey", "c_acctbal")


def q_fold_sizes(spark, sf):
    """Rows of every contiguous fold (the first n mod k have one more)."""
    return _p_folds(spark, sf).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_key"),
                                                   F.max("p_partkey").alias("last_key"))


def q_perm_pairing(spark, sf):
    """Every repeat pairs each row with one donor and uses each donor once."""
    base, n = stable_index(fr.table(spark, sf, "part").select("p_partkey"), ["p_partkey"])
    base = base.select("row_idx")
    pairs = explain.permutation_pairs(base, n, repeats=3)
    return pairs.groupBy("repeat").agg(F.count(F.lit(1)).alias("receivers"), F.countDistinct("row_idx").alias("rows"),
                                   F.countDistinct("donor_idx").alias("donors"))


def q_ols_large_mean(spark, sf):
    """E1-E4 on a column far from zero: epoch seconds that span under three hours."""
    o = fr.table(spark, sf, "orders").select(
        (F.lit(1.7e9) + F.pmod("o_orderkey", F.lit(10007))).alias("at"), F.col("o_totalprice").cast("double").alias("price"))
    out = linear.regression(o, ["at"], ["price"]).coefficients
    # the normal tail: with thousands of rows Student's t differs beyond the places compared
    return out.where("term = 'at'").select("term", _r("coef", D8), _r("std_err", D8), _r("t", D6),
                                           (F.col("p").between(0, 1) & (F.col("ci_lo") < F.col("coef"))
                                            & (F.col("ci_hi") > F.col("coef"))).alias("bounded"))


def q_preview(spark, sf):
    # (orderkey, linenumber) is not unique in the driver data: order by every output column
    key = ["l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "net"]
    return results.preview(fr.frame_l(spark, sf), key).select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", _r("net", D4))


def q_sql_source(spark, sf):
    """A2: the analysis table as a SQL query over catalog views."""
    fr.table(spark, sf, "part").createOrReplaceTempView("part")
    from trendlens.sources.load import read_sql

    return read_sql(spark, "SELECT p_partkey, p_brand, p_size, p_retailprice FROM part WHERE p_brand IS NOT NULL")


def q_csv_roundtrip(spark, sf):
    """A1: a CSV written by Spark from ``part`` (missing sizes as empty
    fields) read back with NA mapping and typed by role."""
    from trendlens.roles import Roles
    from trendlens.session import scratch_path
    from trendlens.sources.load import read_csv

    path = scratch_path(spark, "csv")
    (fr.table(spark, sf, "part").select("p_partkey", "p_brand", F.expr("nullif(p_size, 1)").alias("p_size"),
                                        "p_retailprice")
       .write.option("header", True).csv(path))
    df = read_csv(spark, path, Roles(["p_brand"], ["p_size"], ["p_retailprice"]))
    return df.select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_brand", "p_size", "p_retailprice")


def q_latest_run(spark, sf):
    """Two runs of a result table written partitioned by run; only the
    newest is read back."""
    from trendlens.session import scratch_path

    base = scratch_path(spark, "results")
    prof = clean.level_profile(fr.frame_p(spark, sf), ["p_brand", "p_type"])
    results.write_result(prof.where(F.col("ord") == 0), base, "levels", "20000101_000000")
    results.write_result(prof, base, "levels", "20000102_000000")
    return results.latest_run(spark, base, "levels").select("run_id", "column", "n_levels", "ord")


# ----------------------------------------------------------------- cleaning

def q_drop_audit(spark, sf):
    return clean.drop_audit(fr.frame_l_nulls(spark, sf), fr.L_ROLES.columns)


def q_dropna_rows(spark, sf):
    return clean.drop_missing(fr.frame_l_nulls(spark, sf), fr.L_ROLES.columns).select(
        "l_orderkey", "l_linenumber", "l_discount")


def q_impute_mean(spark, sf):
    out = clean.impute_mean(fr.frame_l_nulls(spark, sf), ["l_discount"])
    return out.select("l_orderkey", "l_linenumber", _r("l_discount", D8))


def q_target_null_counts(spark, sf):
    return clean.target_null_counts(fr.frame_l_nulls(spark, sf), ["l_extendedprice", "l_discount"])


def q_lump_topn(spark, sf):
    return clean.lump_levels(fr.frame_p(spark, sf), ["p_brand", "p_type"], top_n=10).select(
        "p_partkey", "p_brand", "p_type")


def q_level_profile(spark, sf):
    return clean.level_profile(fr.frame_p(spark, sf), ["p_brand", "p_type", "p_size"], warn_at=20)


def q_lump_nulls(spark, sf):
    """A missing category is the level ``nan``; it takes part in lumping."""
    p = fr.frame_p(spark, sf).withColumn("p_brand", F.when(F.col("p_size") % 3 != 0, F.col("p_brand")))
    return clean.lump_levels(p, ["p_brand"], top_n=10).select("p_partkey", "p_brand")


# ----------------------------------------------------------------- features

def _l_lumped(spark, sf, with_levels: bool = False):
    L = clean.drop_missing(fr.frame_l_once(spark, sf), fr.L_ROLES.columns)
    keep, levels = clean.fit_lumping_levels(L, list(fr.L_ROLES.categoricals))
    out = clean.apply_lumping(L, keep)
    return (out, levels) if with_levels else out


def q_one_hot_dropfirst(spark, sf):
    df = _l_lumped(spark, sf)
    fs = encode.fit_features(df, ["l_returnflag", "l_linestatus"], [])
    return fs.transform(df, keep=["l_orderkey", "l_linenumber"])


def q_feature_parameters(spark, sf):
    """The fitted features table of frame L with lineage,
    the substring-compat attribution, linear labels and display names."""
    from trendlens.functions.labels import linear_label, parameter_of

    df, fs = _l_features(spark, sf)
    t = fs.table(spark)
    return t.select("feature", "parameter", "level", "kind",
                    parameter_of(F.col("feature"), list(fr.L_ROLES.parameters)).alias("parameter_compat"),
                    linear_label(F.col("parameter"), F.col("level"), F.col("feature")).alias("label"),
                    display_name(F.col("feature")).alias("display"))


def q_zscore(spark, sf):
    out = encode.zscore(fr.frame_l(spark, sf), ["l_quantity", "l_discount", "l_tax"], ["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", *[_r(c, D8) for c in ["l_quantity", "l_discount", "l_tax"]])


def q_feature_matrix_long(spark, sf):
    df = _l_lumped(spark, sf)
    fs = encode.fit_features(df, ["l_returnflag", "l_linestatus"], ["l_quantity"])
    out = encode.feature_long(df, fs, ["l_orderkey", "l_linenumber"], nonzero_only=True)
    return out.select("l_orderkey", "l_linenumber", "feature", _r("value", D8))


def q_feature_cells(spark, sf):
    """Every cell of the feature matrix, zeros included."""
    df = _l_lumped(spark, sf)
    fs = encode.fit_features(df, ["l_returnflag", "l_linestatus"], ["l_quantity"])
    out = encode.feature_long(df, fs, ["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", "feature", _r("value", D8))


# --------------------------------------------------------------- statistics

def q_skew_check(spark, sf):
    out = stats.skew_check(fr.frame_v(spark, sf), ["value", "user_id", "event_id"])
    return out.select("ord", "column", _r("skew", D8), "flagged")


def q_corr_matrix(spark, sf):
    out = stats.correlation(fr.frame_l(spark, sf), ["l_quantity", "l_discount", "l_tax", "l_extendedprice"])
    return out.select("col_a", "col_b", _r("r", D8))


def q_corr_by_group(spark, sf):
    """Pairwise-complete correlations by group, with different nulls."""
    li = fr.table(spark, sf, "lineitem").select(
        "l_returnflag", F.expr("nullif(l_discount, 0.0D)").alias("disc"), F.expr("if(l_quantity % 5 = 0, null, l_quantity)").alias("qty"),
        F.col("l_extendedprice").cast("double").alias("price"))
    out = stats.correlation(li, ["disc", "qty", "price"], by=["l_returnflag"])
    return out.select("l_returnflag", "col_a", "col_b", _r("r", D8))


def q_skew_by_group(spark, sf):
    """Skewness by group."""
    out = stats.skew_check(fr.table(spark, sf, "events"), ["value"], by=["event_type"])
    return out.select("event_type", "column", _r("skew", D6), "flagged")


def q_pca_by_group(spark, sf):
    """Component variances of two standardised columns by group."""
    li = fr.table(spark, sf, "lineitem")
    res = pca.pca(li, [("qty", F.col("l_quantity").cast("double")), ("price", F.col("l_extendedprice").cast("double") / 1000)],
                  by=["l_returnflag"])
    return res.variance.select("l_returnflag", "pc", _r("variance", D4), _r("ratio", D8))


def q_level_dictionary(spark, sf):
    """Every brand and type with its place among the encoded columns."""
    p = fr.table(spark, sf, "part")
    return levels.level_dictionary(p, ["p_brand", "p_type"], {"p_type": "LARGE"})


def q_one_hot_entries(spark, sf):
    """Encoded rows as (index, value) pairs, by joins on the level table."""
    p = fr.table(spark, sf, "part")
    d = levels.level_dictionary(p, ["p_brand", "p_type"], {"p_type": "LARGE"})
    return levels.feature_entries(p, d, ["p_brand", "p_type"], ["p_partkey"], [("num__p_size", F.col("p_size"))])


def q_yeo_johnson_fixed(spark, sf):
    out, _ = stats.yeo_johnson(fr.frame_v(spark, sf), ["value"], lambdas={"value": 0.5})
    return out.select("event_id", _r("value_transformed", D8))


def q_yeo_johnson_fitted(spark, sf):
    v = fr.frame_v(spark, sf)
    out, params = stats.yeo_johnson(v, ["value"], threshold=1.0)
    lam = params["value"][0] if params else None
    sk = stats.skew_check(out, ["value_transformed"]).select(F.col("skew").alias("skew_after"))
    return sk.select(F.lit("value").alias("column"), F.lit(lam).alias("lambda"), "skew_after")


def q_yeo_johnson_lambda(spark, sf):
    """The maximum-likelihood lambda of a skewed column, to three places."""
    lam = stats.fit_yeo_johnson(fr.frame_v(spark, sf), ["value"])["value"][0]
    return spark.createDataFrame([("value", round(lam, 3))], "column string, lambda double")


# ------------------------------------------------------------ linear models

def _coef_out(fit: linear.LinearFit, by=()):
    return fit.coefficients.select(*by, "target", "term", _r("coef", D4), _r("std_err", D4), _r("t", D6))


def q_ols_simple(spark, sf):
    return _coef_out(linear.regression(fr.frame_l_once(spark, sf), ["l_quantity"], ["net"]))


def q_wls_simple(spark, sf):
    return _coef_out(linear.regression(fr.frame_w(spark, sf), ["avg_qty"], ["avg_price"], use_wls=True))


def _fit_out(fit: linear.LinearFit):
    return fit.fit.select("target", "method", "n", "rank", "df_resid", _r("r2", D8))


def q_ols_fit_stats(spark, sf):
    """N, rank, residual df and R^2 of an OLS fit."""
    return _fit_out(linear.regression(fr.frame_l_once(spark, sf), ["l_quantity"], ["net"]))


def q_wls_fallback(spark, sf):
    """A target none of whose weights can be used is fitted by OLS."""
    w = fr.frame_w(spark, sf).withColumn("avg_priceStd", F.lit(None).cast("double"))
    fit = linear.regression(w, ["avg_qty"], ["avg_price"], use_wls=True)
    return fit.coefficients.join(fit.fit.select("target", "method"), "target").select(
        "method", "term", _r("coef", D4), _r("std_err", D4))


def q_wls_fallback_by_group(spark, sf):
    """Only the groups without weights fall back."""
    w = fr.frame_w(spark, sf).withColumn("part", F.pmod("l_partkey", F.lit(3)).cast("int"))
    w = w.withColumn("avg_priceStd", F.when(F.col("part") != 1, F.col("avg_priceStd")))
    fit = linear.regression(w, ["avg_qty"], ["avg_price"], use_wls=True, by=["part"])
    slope = fit.coefficients.where("term = 'avg_qty'")
    return slope.join(fit.fit.select("part", "method", "n"), "part").select("part", "method", "n", _r("coef", D4))


def q_ols_near_collinear(spark, sf):
    """E1/E3 on two columns that differ in the eighth digit (condition 5e7), by triangular factors."""
    li = fr.table(spark, sf, "lineitem").select(
        F.col("l_quantity").cast("double").alias("a"), (F.col("l_quantity") + F.col("l_discount") * F.lit(1e-5)).alias("b"),
        F.col("l_extendedprice").cast("double").alias("y"))
    out = linear.regression(li, ["a", "b"], ["y"], method="qr").coefficients
    return out.where("term = 'b'").select("term", F.round(F.col("coef") * 1e-5, 2).alias("coef"),
                                          F.round(F.col("std_err") * 1e-5, 2).alias("std_err"), _r("t", D4))


def q_ols_many_levels(spark, sf):
    """E1/B7 with a column for every part key: levels are absorbed, not listed."""
    li = fr.table(spark, sf, "lineitem").select(
        F.col("l_partkey").cast("string").alias("part"), F.col("l_quantity").cast("double").alias("qty"),
        F.col("l_extendedprice").cast("double").alias("price"))
    out = linear.absorbed_regression(li, "part", ["qty"], "price").coefficients
    return out.select("term", _r("coef", D4), _r("std_err", D4))


def q_ols_many_levels_fit(spark, sf):
    """E4 of the regression with a column for every part key."""
    li = fr.table(spark, sf, "lineitem").select(
        F.col("l_partkey").cast("string").alias("part"), F.col("l_quantity").cast("double").alias("qty"),
        F.col("l_extendedprice").cast("double").alias("price"))
    return linear.absorbed_regression(li, "part", ["qty"], "price").fit.select(
        "n", "rank", "df_resid", _r("r2", D8))


def q_wls_fit_stats(spark, sf):
    """The same for WLS, where R^2 is weighted and centred on the weighted mean."""
    return _fit_out(linear.regression(fr.frame_w(spark, sf), ["avg_qty"], ["avg_price"], use_wls=True))


def q_ols_two_feature(spark, sf):
    return _coef_out(linear.regression(fr.frame_l_once(spark, sf), ["l_quantity", "l_discount"], ["net"]))


def q_ols_by_group(spark, sf):
    return _coef_out(linear.regression(fr.frame_p(spark, sf), ["p_size"], ["p_retailprice"], by=["p_type"]),
                     by=["p_type"])


def q_ols_inference(spark, sf):
    """P value and confidence limits of the slope in every group."""
    c = linear.regression(fr.frame_p(spark, sf), ["p_size"], ["p_retailprice"], by=["p_type"]).coefficients
    return c.where("term = 'p_size'").select("p_type", _r("p", D6), _r("ci_lo", D4), _r("ci_hi", D4))


def q_significance_bands(spark, sf):
    """Significant, marginal and other slopes, one group a brand."""
    c = linear.regression(fr.frame_p(spark, sf), ["p_size"], ["p_retailprice"], by=["p_brand"]).coefficients
    return c.where("term = 'p_size'").select("p_brand", _r("p", D6), rollup.significance_band().alias("band"))


def _l_features(spark, sf):
    """Cleaned, lumped L frame (joined once, re-read per pass) and its fitted features.
    Levels come from the lumping fit; one more pass fits the numerics."""
    lumped, levels = _l_lumped(spark, sf, with_levels=True)
    df = clean.drop_missing(lumped, fr.L_ROLES.columns)
    fs = encode.fit_features(df, list(fr.L_ROLES.categoricals), list(fr.L_ROLES.numerics), levels=levels)
    return df, fs


def q_ols_full_coefs(spark, sf):
    """Full L model (all one-hot + scaled inputs, both targets); checked by
    the normal equations: the residuals of both are orthogonal to every column."""
    df, fs = _l_features(spark, sf)
    targets = list(fr.L_ROLES.targets)
    fit = linear.regression(df, fs.specs, targets, targets_complete=True)
    scored = df
    for t in targets:
        scored = linear.predict(scored, fit.coefficients, fs.specs, t, out=f"_hat_{t}")
    e = [F.col(t) - F.col(f"_hat_{t}") for t in targets]
    cols = [("Intercept", F.lit(1.0))] + fs.specs
    agg = scored.agg(*[F.sum(r * r).alias(f"_ee{j}") for j, r in enumerate(e)],
                     *[F.sum(r * c).alias(f"_x{j}_{i}") for j, r in enumerate(e) for i, (_, c) in enumerate(cols)],
                     *[F.sum(c * c).alias(f"_c{i}") for i, (_, c) in enumerate(cols)])

    def orthogonal(j, i):
        return F.abs(F.col(f"_x{j}_{i}")) <= F.lit(1e-9) * F.sqrt(F.col(f"_ee{j}") * F.col(f"_c{i}"))

    items = [F.struct(F.lit(n).alias("term"), reduce(and_, [orthogonal(j, i) for j in range(len(e))]).alias("orthogonal"))
             for i, (n, _) in enumerate(cols)]
    return agg.select(F.explode(F.array(*items)).alias("s")).select("s.*")


def _p_folds(spark, sf):
    return kfold(fr.frame_p(spark, sf), ["p_partkey"], k=5)


def q_linear_cv_r2(spark, sf):
    out = linear.cv_r2(_p_folds(spark, sf), ["p_size"], ["p_retailprice"])
    return out.select("target", "fold", _r("r2", D8))


def q_metrics_by_group(spark, sf):
    p = fr.frame_p(spark, sf)
    fit = linear.regression(p, ["p_size"], ["p_retailprice"], by=["p_type"])
    scored = linear.predict(p, fit.coefficients, ["p_size"], "p_retailprice", by=["p_type"])
    m = stats.metrics(scored, "p_retailprice", "prediction", by=["p_type"])
    return m.select("p_type", "n", _r("r2", D8), _r("mae", D6), _r("rmse", D6))


# --------------------------------------------------------------- interactions

def _d2_fit(spark, sf):
    L = fr.frame_l_once(spark, sf)
    keep, levels = clean.fit_lumping_levels(L, ["l_returnflag", "o_orderpriority"])
    df = clean.apply_lumping(L, keep)
    return interact.interactions(df, ["l_returnflag", "o_orderpriority"], [], ["net"], max_depth=2, levels=levels)


def q_interaction_cells_d2(spark, sf):
    c = _d2_fit(spark, sf).coefficients.where(F.col("depth") == 2)
    return c.select("target", "term", "label", _r("coef", D4), _r("std_err", D4), _r("t", D6))


def _num_d1_fit(spark, sf):
    return interact.interactions(fr.frame_l_once(spark, sf), [], ["l_discount", "l_tax"], ["net"], max_depth=1)


def q_interaction_numeric_d1(spark, sf):
    """E7 with numeric inputs only: net ~ 1 + l_discount + l_tax."""
    c = _num_d1_fit(spark, sf).coefficients
    return c.select("target", "depth", "term", "label", _r("coef", D4), _r("std_err", D4), _r("t", D6))


def q_significant_terms_numeric(spark, sf):
    """B11 + H3 on a model whose terms are significant."""
    top = rollup.top_significant_terms(_num_d1_fit(spark, sf).coefficients, k=20)
    return top.select("target", "depth", "term", _r("coef", D4), "rank")


def q_param_rollup_numeric(spark, sf):
    """Sum |coef| of significant terms per parameter."""
    params = rollup.params_table(spark, ["l_discount", "l_tax"])
    out = rollup.coef_by_parameter(_num_d1_fit(spark, sf).coefficients, params, alpha=0.05, by=("target", "depth"))
    return out.select("target", "depth", "parameter", _r("sum_abs_coef", D4))


def q_interaction_coefs_all_depths(spark, sf):
    lumped, levels = _l_lumped(spark, sf, with_levels=True)
    df = clean.drop_missing(lumped, fr.L_ROLES.columns)
    fit = interact.interactions(df, list(fr.L_ROLES.categoricals), list(fr.L_ROLES.numerics), ["net"],
                                levels=levels)
    return fit.coefficients.select("target", "depth", "term", "label", "coef", "std_err", "p")


def q_interaction_status(spark, sf):
    lumped, levels = _l_lumped(spark, sf, with_levels=True)
    df = clean.drop_missing(lumped, fr.L_ROLES.columns)
    fit = interact.interactions(df, list(fr.L_ROLES.categoricals), list(fr.L_ROLES.numerics), ["net"],
                                levels=levels)
    return fit.status.select("target", "depth", "n_columns", "status", "n", "rank")


# ------------------------------------------------------------------------ PCA

def q_pca_variance(spark, sf):
    df = fr.frame_l_once(spark, sf)
    fs = encode.fit_features(df, [], ["l_quantity", "l_discount"])
    res = pca.pca(df, fs.specs)
    return res.variance.select("pc", _r("ratio", D8), _r("cumulative", D8))


def q_pca_top_contributors(spark, sf):
    df, fs = _l_features(spark, sf)
    res = pca.pca(df, fs.specs)
    return res.top(k=5).select("pc", "rank", "feature", "loading", "ratio")


def q_pca_components_for(spark, sf):
    """Components needed for 80 % and 95 % of the variance."""
    df = fr.frame_l_once(spark, sf)
    fs = encode.fit_features(df, [], ["l_quantity", "l_discount"])
    return pca.pca(df, fs.specs).components_for()


def q_pca_summary(spark, sf):
    df, fs = _l_features(spark, sf)
    return pca.pca(df, fs.specs).summary()


def _pca_two(spark, sf):
    L = fr.frame_l_once(spark, sf)
    return pca.pca(L, [("quantity", F.col("l_quantity")), ("price", F.col("l_extendedprice") / 1000)])


def q_pca_loadings(spark, sf):
    """Loadings of two unscaled columns, the largest of each positive."""
    return _pca_two(spark, sf).loadings.select("pc", "feature", _r("loading", D6))


def q_pca_top_two(spark, sf):
    """Contributors in order of |loading| up to the 95 % component."""
    return _pca_two(spark, sf).top(k=5).select("pc", "rank", "feature", _r("loading", D6), _r("ratio", D8))


def q_pdp_grid_percentiles(spark, sf):
    """G6 grid: distinct values, or 100 points between exact percentiles."""
    g = explain.pdp_grid(fr.frame_l_once(spark, sf, ["l_extendedprice", "l_quantity"]), ["l_extendedprice", "l_quantity"])
    return g.select("feature", F.posexplode("values").alias("point", "value")).select(
        "feature", "point", _r("value", D6))


# ------------------------------------------------------------ linear twins

def _p_simple(spark, sf):
    p = fr.frame_p(spark, sf)
    fit = linear.regression(p, ["p_size"], ["p_retailprice"])
    rows = fit.coefficients.select("term", "coef").collect()  # 2 numbers
    return p, {r["term"]: r["coef"] for r in rows}


def q_linear_shap_importance(spark, sf):
    p, beta = _p_simple(spark, sf)
    imp = explain.linear_shap_importance(p, [("p_size", F.col("p_size"))], beta)
    return imp.select("feature", _r("mean_abs_shap", D6))


def q_linear_shap_values(spark, sf):
    """G1 (linear twin): per-row SHAP values phi = b (x - mean)."""
    p, beta = _p_simple(spark, sf)
    ph = explain.linear_shap(p, [("p_size", F.col("p_size"))], beta)
    return ph.select("p_partkey", F.round(F.col("phi_p_size"), D6).alias("phi_p_size"))


def q_linear_pdp_1d(spark, sf):
    p, beta = _p_simple(spark, sf)
    grid = explain.pdp_grid(p, ["p_size"])
    means = {"p_size": p.agg(F.avg("p_size")).first()[0]}
    return explain.linear_pdp_1d(grid, beta, means, ["p_size"]).select("feature", "value", _r("pd", D6))


def _p_two(spark, sf):
    p = fr.frame_p(spark, sf).withColumn("is_large", (F.col("p_type") == "LARGE").cast("double"))
    names = ["p_size", "is_large"]
    fit = linear.regression(p, names, ["p_retailprice"])
    beta = {r["term"]: r["coef"] for r in fit.coefficients.select("term", "coef").collect()}
    m = p.agg(*[F.avg(n).alias(n) for n in names]).first()
    return p, names, beta, {n: m[n] for n in names}


def q_linear_pdp_2d(spark, sf):
    p, names, beta, means = _p_two(spark, sf)
    grid = explain.pdp_grid(p, names)
    return explain.linear_pdp_2d(grid, beta, means, names).select("f1", "v1", "f2", "v2", _r("pd", D6))


# ------------------------------------------------------------------- forest

_FOREST_CACHE: dict = {}


def _forest(spark, sf, trees=forest.TREES, depth=forest.MAX_DEPTH):
    # one fitted forest per (application, data, parameters); a new session never sees stale frames
    key = (spark.sparkContext.applicationId, sf, trees, depth)
    if key not in _FOREST_CACHE:
        p = clean.lump_levels(clean.drop_missing(fr.frame_p(spark, sf), fr.P_ROLES.columns),
                              list(fr.P_ROLES.categoricals))
        fs = encode.fit_features(p, list(fr.P_ROLES.categoricals), list(fr.P_ROLES.numerics))
        # read by training, SHAP, PDP grids and permutation: cached like an estimator input
        wide = fs.transform(p, keep=["p_partkey", "p_retailprice"]).persist(StorageLevel.MEMORY_AND_DISK)
        vec = forest.assemble(wide, fs.names, keep=["p_partkey", "p_retailprice"])
        model = forest.fit_forest(vec, "p_retailprice", trees=trees, max_depth=depth, key=["p_partkey"])
        lt = forest.tree_tables(spark, model, len(fs.names))
        _FOREST_CACHE[key] = (fs, wide, vec, model, lt)
    return _FOREST_CACHE[key]


def q_forest_metrics(spark, sf):
    fs, wide, vec, model, lt = _forest(spark, sf)
    return stats.metrics(model.transform(vec), "p_retailprice", "prediction")


def q_forest_cv_r2(spark, sf):
    """5 contiguous folds by key; a forest per fold, scored on its fold."""
    from trendlens.plans.analysis import Options, forest_cv

    fs, wide, vec, model, lt = _forest(spark, sf)
    return forest_cv(vec, "p_retailprice", ["p_partkey"], Options())


def q_tree_shap_importance(spark, sf):
    fs, wide, vec, model, lt = _forest(spark, sf)
    return explain.shap_importance(wide, fs.names, lt)


def q_tree_shap_additivity(spark, sf):
    fs, wide, vec, model, lt = _forest(spark, sf)
    add = explain.shap_additivity(model.transform(vec), fs.names, lt)
    return add.select(_rz("max_abs_error", D6), "n")


def q_tree_shap_values(spark, sf):
    """G1: per-row tree SHAP values (long form) for every part."""
    fs, wide, vec, model, lt = _forest(spark, sf)
    return explain.shap_values(wide, fs.names, lt, keep=["p_partkey"])


def q_tree_pdp_1d(spark, sf):
    fs, wide, vec, model, lt = _forest(spark, sf)
    return explain.tree_pdp_1d(explain.pdp_grid(wide, fs.names), lt)


def q_tree_pdp_2d(spark, sf):
    fs, wide, vec, model, lt = _forest(spark, sf)
    return explain.tree_pdp_2d(explain.pdp_grid(wide, fs.names), lt)


def q_perm_importance(spark, sf):
    fs, wide, vec, model, lt = _forest(spark, sf)
    from pyspark.ml.feature import VectorAssembler

    va = VectorAssembler(inputCols=fs.names, outputCol="features")

    def score(d):
        return model.transform(va.transform(d))

    perm = explain.permutation_importance(wide, fs.names, "p_retailprice", ["p_partkey"], score, repeats=10, seed=0)
    return explain.permutation_summary(perm, fs.table(spark))


def q_tree_shap_by_parameter(spark, sf):
    fs, wide, vec, model, lt = _forest(spark, sf)
    imp = explain.shap_importance(wide, fs.names, lt).withColumn("target", F.lit("p_retailprice"))
    params = rollup.params_table(spark, list(fr.P_ROLES.parameters))
    return rollup.shap_by_parameter(imp, fs.table(spark), params)


def q_shap_top5(spark, sf):
    """Top-5 features by mean |SHAP| with their signed mean."""
    fs, wide, vec, model, lt = _forest(spark, sf)
    imp = explain.shap_importance(wide, fs.names, lt)
    return rollup.top_k(imp, 5, F.col("mean_abs_shap").desc()).select("rank", "feature", "mean_abs_shap", "mean_shap")


def q_perm_by_parameter(spark, sf):
    """Permutation importance summed per input column (lineage)."""
    s = q_perm_importance(spark, sf)
    params = rollup.params_table(spark, list(fr.P_ROLES.parameters))
    return rollup.restrict(s.groupBy("parameter").agg(F.sum("importance_mean").alias("importance")), params)


# ----------------------------------- one tree of one split: closed forms

def _stump_input(spark, sf):
    p = fr.frame_p(spark, sf).select("p_partkey", F.col("p_size").cast("double").alias("p_size"),
                                     (F.col("p_type") == "LARGE").cast("double").alias("is_large"), "p_retailprice")
    names = ["p_size", "is_large"]
    return p, names, forest.assemble(p, names, keep=["p_partkey", "p_retailprice"])


_STUMP = {"trees": 1, "max_depth": 1, "max_bins": 256, "bootstrap": False}


def _stump(spark, sf):
    """A forest of one tree with one split, every midpoint a candidate."""
    p, names, vec = _stump_input(spark, sf)
    model = forest.fit_forest(vec, "p_retailprice", **_STUMP, key=["p_partkey"])
    return p, names, vec, model, forest.tree_tables(spark, model, len(names))


def _rz(c, d):
    return (F.round(F.col(c), d) + F.lit(0.0)).alias(c)  # no negative zero


def q_stump_leaves(spark, sf):
    """E5: split feature, interval, cover and value of both leaves."""
    p, names, vec, model, lt = _stump(spark, sf)
    end = F.lit(float("inf"))
    out = lt.leaves(spark).select(
        F.array(*[F.lit(n) for n in names])[F.col("feature")[0]].alias("feature"),
        F.nullif(F.col("above")[0], -end).alias("above"), F.nullif(F.col("upto")[0], end).alias("upto"),
        F.col("share")[0].alias("cover"), "value")
    return out.select("feature", "above", "upto", _r("cover", D8), _r("value", D6))


def q_stump_metrics(spark, sf):
    """In-sample scores of the fitted tree."""
    p, names, vec, model, lt = _stump(spark, sf)
    return stats.metrics(model.transform(vec), "p_retailprice", "prediction").select(
        "n", _r("r2", D8), _r("mae", D6), _r("rmse", D6))


def q_stump_cv_r2(spark, sf):
    """Five contiguous folds, a tree for each trained on the others."""
    from trendlens.plans.analysis import Options, forest_cv

    p, names, vec = _stump_input(spark, sf)
    return forest_cv(vec, "p_retailprice", ["p_partkey"], Options(**_STUMP)).select("fold", _r("r2", D8))


def q_stump_shap_values(spark, sf):
    """G1: the split feature's SHAP value is prediction - base, the other's is 0."""
    p, names, vec, model, lt = _stump(spark, sf)
    return explain.shap_values(p, names, lt, keep=["p_partkey"]).select(
        "p_partkey", "feature", _rz("phi", D6), _r("base", D6))


def q_stump_shap_sample(spark, sf):
    """G1 with ``sample``: the values of about a quarter of the parts, the same parts in every run."""
    p, names, vec, model, lt = _stump(spark, sf)
    some = explain.sample_rows(p, ["p_partkey"], p.count() // 4, seed=7)
    return explain.shap_values(some, names, lt, keep=["p_partkey"]).select(
        "p_partkey", "feature", _rz("phi", D6), _r("base", D6))


def q_stump_shap_importance(spark, sf):
    """The top 20 features by mean |SHAP|."""
    p, names, vec, model, lt = _stump(spark, sf)
    top = rollup.top_k(explain.shap_importance(p, names, lt), 20, F.col("mean_abs_shap").desc())
    return top.select("rank", "feature", _rz("mean_abs_shap", D6), _rz("mean_shap", D6), "n")


def q_stump_signed_shap(spark, sf):
    """Features ranked by the signed mean over the large parts only."""
    p, names, vec, model, lt = _stump(spark, sf)
    imp = explain.shap_importance(p.where("is_large = 1"), names, lt)
    signed = imp.withColumn("mean_shap", _rz("mean_shap", D6))
    return rollup.top_k(signed, 5, F.col("mean_shap").desc()).select("rank", "feature", "mean_shap")


def q_stump_shap_by_parameter(spark, sf):
    """Importance summed per input column by lineage."""
    p, names, vec, model, lt = _stump(spark, sf)
    imp = explain.shap_importance(p, names, lt).withColumn("target", F.lit("p_retailprice"))
    feats = spark.createDataFrame([("p_size", "p_size"), ("is_large", "p_type")], "feature string, parameter string")
    out = rollup.shap_by_parameter(imp, feats, rollup.params_table(spark, ["p_size", "p_type"]))
    return out.select("target", "parameter", _rz("importance", D6))


def q_stump_pdp_1d(spark, sf):
    """A step in the split feature, the mean in the other."""
    p, names, vec, model, lt = _stump(spark, sf)
    return explain.tree_pdp_1d(explain.pdp_grid(p, names), lt).select("feature", "value", _r("pd", D6))


def q_stump_pdp_2d(spark, sf):
    """The step again, over both features' grids."""
    p, names, vec, model, lt = _stump(spark, sf)
    return explain.tree_pdp_2d(explain.pdp_grid(p, names), lt).select("f1", "v1", "f2", "v2", _r("pd", D6))


def q_stump_pdp_mean(spark, sf):
    """G6 by average prediction: curves over the large parts' rows only."""
    p, names, vec, model, lt = _stump(spark, sf)
    leaves = explain.leaf_counts(p.where("is_large = 1"), names, lt, pairs=False)
    return explain.tree_pdp_1d(explain.pdp_grid(p, names), lt, leaves).select("feature", "value", _r("pd", D6))


def q_stump_pdp_mean_2d(spark, sf):
    """G7 by average prediction, over the large parts' rows only."""
    p, names, vec, model, lt = _stump(spark, sf)
    leaves = explain.leaf_counts(p.where("is_large = 1"), names, lt)
    return explain.tree_pdp_2d(explain.pdp_grid(p, names), lt, leaves=leaves).select("f1", "v1", "f2", "v2", _r("pd", D6))


# ------------------- one tree grown to the end: predictions are cell means

def _deep(spark, sf):
    p, names, vec = _stump_input(spark, sf)
    model = forest.fit_forest(vec, "p_retailprice", trees=1, max_bins=256, bootstrap=False, key=["p_partkey"])
    return p, names, vec, model


def q_deep_tree_metrics(spark, sf):
    """A tree without a depth limit predicts the mean of every (size, large) cell."""
    p, names, vec, model = _deep(spark, sf)
    return stats.metrics(model.transform(vec), "p_retailprice", "prediction").select(
        "n", _r("r2", D8), _r("mae", D6), _r("rmse", D6))


def q_deep_shap_sums(spark, sf):
    """Base and SHAP values of every row of the deep tree add up to its cell's mean."""
    p, names, vec, model = _deep(spark, sf)
    trees = forest.tree_tables(spark, model, len(names))
    return explain.shap_sums(p, names, trees, ["p_partkey"]).select("p_partkey", _r("explained", D6))


def q_deep_leaf_totals(spark, sf):
    """E5: covers of the deep tree's leaves add up to one, their weighted values to the mean."""
    p, names, vec, model = _deep(spark, sf)
    trees = forest.tree_tables(spark, model, len(names))
    share = F.aggregate("share", F.lit(1.0), lambda a, x: a * x)
    return trees.leaves(spark).agg(F.count(F.lit(1)).alias("leaves"), F.round(F.sum(share), D8).alias("cover"),
                                   F.round(F.sum(share * F.col("value")), D6).alias("base"))


def q_perm_stored_model(spark, sf):
    """Permutation importance of a model that was saved and read back."""
    from pyspark.ml.feature import VectorAssembler

    p, names, vec, model = _deep(spark, sf)
    again = forest.load_model(forest.save_model(spark, model))
    narrow = VectorAssembler(inputCols=names, outputCol="features")
    perm = explain.permutation_importance(
        p.withColumn("unused", F.lit(1.0)), [*names, "unused"], "p_retailprice", ["p_partkey"],
        lambda d: again.transform(narrow.transform(d)), repeats=3)
    s = explain.permutation_summary(perm)
    base = perm.agg(F.max("r2_base").alias("r2_base"))
    return s.crossJoin(F.broadcast(base)).select(
        "feature", _r("r2_base", D8), (F.col("importance_mean") > 0).alias("matters"))


# ------------------------------------------------------------------ roll-ups

def q_param_rollup(spark, sf):
    c = _d2_fit(spark, sf).coefficients.where(F.col("depth") == 2)
    params = rollup.params_table(spark, ["l_returnflag", "o_orderpriority"])
    out = rollup.coef_by_parameter(c, params, alpha=0.05)
    return out.select("target", "parameter", _r("sum_abs_coef", D4))


def q_significant_terms(spark, sf):
    c = _d2_fit(spark, sf).coefficients
    top = rollup.top_significant_terms(c.where(F.col("depth") == 2), k=20)
    return top.select("target", "depth", "term", _r("coef", D4), "rank")


def _band_fit(spark, sf):
    """net ~ 1 + l_returnflag:disc_band, whose bands are significant."""
    L = fr.frame_l_once(spark, sf).withColumn("disc_band", F.concat(
        F.lit("d"), F.floor(F.round(F.col("l_discount") * 100) / 4).cast("string")))
    keep, levels = clean.fit_lumping_levels(L, ["l_returnflag", "disc_band"])
    df = clean.apply_lumping(L, keep)
    fit = interact.interactions(df, ["l_returnflag", "disc_band"], [], ["net"], max_depth=2, levels=levels)
    return fit.coefficients.where(F.col("depth") == 2)


def q_param_rollup_bands(spark, sf):
    """D10 on categorical terms that are significant: each term counts for all its members."""
    params = rollup.params_table(spark, ["l_returnflag", "disc_band"])
    out = rollup.coef_by_parameter(_band_fit(spark, sf), params, alpha=0.05)
    return out.select("target", "parameter", _r("sum_abs_coef", D4))


def q_significant_terms_bands(spark, sf):
    """B11 + H3 on categorical terms that are significant."""
    top = rollup.top_significant_terms(_band_fit(spark, sf), k=20)
    return top.select("target", "depth", "term", _r("coef", D4), "rank")


def q_interaction_status_d2(spark, sf):
    """Columns, state, rows and rank of each depth's own fit."""
    return _d2_fit(spark, sf).status.select("target", "depth", "n_columns", "status", "n", "rank")


def q_topk_abs_coef(spark, sf):
    c = _d2_fit(spark, sf).coefficients.where(F.col("depth") == 2)
    top = rollup.top_abs_coef(c, k=20)
    return top.select("target", "term", _r("coef", D4), "direction", "rank")


def q_term_labels(spark, sf):
    c = _d2_fit(spark, sf).coefficients.where(F.col("depth") == 2)
    return c.select("term", "label",
                    display_name(F.col("term")).alias("display"))


def _two_effects(spark, sf):
    p, names, beta, means = _p_two(spark, sf)
    grid = explain.pdp_grid(p, names)
    return explain.pdp_effect(explain.linear_pdp_1d(grid, beta, means, names))


def q_coef_by_parameter(spark, sf):
    """Sum |coef| per input column (lineage), intercept excluded."""
    p, names, beta, means = _p_two(spark, sf)
    fit = linear.regression(p, names, ["p_retailprice"])
    feats = spark.createDataFrame([(n, n) for n in names], "feature string, parameter string")
    coefs = rollup.with_parameters(fit.coefficients, feats)
    out = rollup.coef_by_parameter(coefs, rollup.params_table(spark, names))
    return out.select("target", "parameter", _r("sum_abs_coef", D6))


def q_pdp_effect_by_parameter(spark, sf):
    """Mean / max / count of PD effects per input column."""
    eff = _two_effects(spark, sf).withColumn("target", F.lit("p_retailprice"))
    p, names, beta, means = _p_two(spark, sf)
    feats = spark.createDataFrame([(n, n) for n in names], "feature string, parameter string")
    out = rollup.pdp_effect_by_parameter(eff, feats, rollup.params_table(spark, names))
    return out.select("parameter", _r("effect_mean", D6), _r("effect_max", D6), "n_features")


def q_cv_summary(spark, sf):
    """CV mean and population std of the fold R^2."""
    out = stats.score_summary(linear.cv_r2(_p_folds(spark, sf), ["p_size"], ["p_retailprice"]))
    return out.select("target", _r("cv_mean", D8), _r("cv_std", D8), "folds")


def q_pdp_effect_rank(spark, sf):
    eff = _two_effects(spark, sf).withColumn("target", F.lit("p_retailprice"))
    top = rollup.top_k(eff, 10, F.col("effect").desc(), by=["target"])
    return top.select("feature", _r("effect", D6), _r("pd_min", D6), _r("pd_max", D6), "rank")


def q_pdp_top_series(spark, sf):
    """H5 (+C4): PD series of the top-6 features by effect, via semi-join."""
    p, names, beta, means = _p_two(spark, sf)
    grid = explain.pdp_grid(p, names)
    pd1 = explain.linear_pdp_1d(grid, beta, means, names).withColumn("target", F.lit("p_retailprice"))
    eff = explain.pdp_effect(pd1, by=("target", "feature"))
    return rollup.pdp_top_series(pd1, eff, k=6).select("feature", "value", _r("pd", D6))


def q_method_rank(spark, sf):
    p, names, beta, means = _p_two(spark, sf)
    params = rollup.params_table(spark, names)
    t = F.lit("p_retailprice").alias("target")
    coef = spark.createDataFrame([(n, abs(beta[n])) for n in names], "parameter string, value double")
    shap = explain.linear_shap_importance(p, [(n, F.col(n)) for n in names], beta).select(
        F.col("feature").alias("parameter"), F.col("mean_abs_shap").alias("value"))
    grid = explain.pdp_grid(p, names)
    pdp = explain.pdp_effect(explain.linear_pdp_1d(grid, beta, means, names)).select(
        F.col("feature").alias("parameter"), F.col("effect").alias("value"))
    tables = {m: d.select(t, "parameter", "value") for m, d in (("coef", coef), ("shap", shap), ("pdp", pdp))}
    out = rollup.compare_methods(spark, tables, params)
    return out.select("parameter", "rank_coef", "rank_shap", "rank_pdp", _r("mean_rank", D6))


def q_summary_facts(spark, sf):
    df, fs = _l_features(spark, sf)
    fit = linear.regression(df, fs.specs, ["net", "l_extendedprice"], targets_complete=True)
    sk = stats.skew_check(df, list(fr.L_ROLES.numerics) + list(fr.L_ROLES.targets))
    return rollup.summary_facts(fit.coefficients, fit.fit, skew=sk)


def q_linear_facts(spark, sf):
    """H6: intercept, significant slope, fit and skew notes in words (the p value is left out of the text)."""
    fit = linear.regression(fr.frame_l_once(spark, sf), ["l_discount"], ["net"])
    sk = stats.skew_check(fr.frame_v(spark, sf), ["value", "user_id", "event_id"])
    facts = rollup.summary_facts(fit.coefficients, fit.fit, skew=sk)
    return facts.select("target", "section", "ord", "subject", _r("value", D4),
                        F.regexp_replace("text", r" \(p = [^)]*\)", "").alias("text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "sql_source": q_sql_source,
    "csv_roundtrip": q_csv_roundtrip,
    "latest_run": q_latest_run,
    "first_child_left_join": q_first_child_left_join,
    "salted_left_join": q_salted_left_join,
    "salted_left_nulls": q_salted_left_nulls,
    "fold_sizes": q_fold_sizes,
    "perm_pairing": q_perm_pairing,
    "ols_large_mean": q_ols_large_mean,
    "left_join_flag": q_left_join_flag,
    "preview": q_preview,
    "drop_audit": q_drop_audit,
    "dropna_rows": q_dropna_rows,
    "impute_mean": q_impute_mean,
    "target_null_counts": q_target_null_counts,
    "lump_topn": q_lump_topn,
    "level_profile": q_level_profile,
    "one_hot_dropfirst": q_one_hot_dropfirst,
    "feature_parameters": q_feature_parameters,
    "zscore": q_zscore,
    "feature_matrix_long": q_feature_matrix_long,
    "feature_cells": q_feature_cells,
    "skew_check": q_skew_check,
    "corr_matrix": q_corr_matrix,
    "yeo_johnson_fixed": q_yeo_johnson_fixed,
    "yeo_johnson_fitted": q_yeo_johnson_fitted,
    "ols_simple": q_ols_simple,
    "wls_simple": q_wls_simple,
    "ols_fit_stats": q_ols_fit_stats,
    "wls_fit_stats": q_wls_fit_stats,
    "wls_fallback": q_wls_fallback,
    "wls_fallback_by_group": q_wls_fallback_by_group,
    "ols_near_collinear": q_ols_near_collinear,
    "ols_many_levels": q_ols_many_levels,
    "ols_many_levels_fit": q_ols_many_levels_fit,
    "ols_two_feature": q_ols_two_feature,
    "ols_by_group": q_ols_by_group,
    "ols_full_coefs": q_ols_full_coefs,
    "linear_cv_r2": q_linear_cv_r2,
    "metrics_by_group": q_metrics_by_group,
    "interaction_cells_d2": q_interaction_cells_d2,
    "interaction_numeric_d1": q_interaction_numeric_d1,
    "significant_terms_numeric": q_significant_terms_numeric,
    "significant_terms_bands": q_significant_terms_bands,
    "param_rollup_bands": q_param_rollup_bands,
    "param_rollup_numeric": q_param_rollup_numeric,
    "interaction_coefs_all_depths": q_interaction_coefs_all_depths,
    "interaction_status": q_interaction_status,
    "interaction_status_d2": q_interaction_status_d2,
    "pca_variance": q_pca_variance,
    "pca_top_contributors": q_pca_top_contributors,
    "pca_summary": q_pca_summary,
    "pca_components_for": q_pca_components_for,
    "linear_shap_importance": q_linear_shap_importance,
    "linear_shap_values": q_linear_shap_values,
    "linear_pdp_1d": q_linear_pdp_1d,
    "linear_pdp_2d": q_linear_pdp_2d,
    "forest_metrics": q_forest_metrics,
    "forest_cv_r2": q_forest_cv_r2,
    "tree_shap_importance": q_tree_shap_importance,
    "tree_shap_additivity": q_tree_shap_additivity,
    "tree_shap_by_parameter": q_tree_shap_by_parameter,
    "tree_shap_values": q_tree_shap_values,
    "tree_pdp_1d": q_tree_pdp_1d,
    "tree_pdp_2d": q_tree_pdp_2d,
    "perm_importance": q_perm_importance,
    "perm_by_parameter": q_perm_by_parameter,
    "shap_top5": q_shap_top5,
    "param_rollup": q_param_rollup,
    "significant_terms": q_significant_terms,
    "topk_abs_coef": q_topk_abs_coef,
    "term_labels": q_term_labels,
    "coef_by_parameter": q_coef_by_parameter,
    "pdp_effect_by_parameter": q_pdp_effect_by_parameter,
    "cv_summary": q_cv_summary,
    "pdp_effect_rank": q_pdp_effect_rank,
    "pdp_top_series": q_pdp_top_series,
    "method_rank": q_method_rank,
    "summary_facts": q_summary_facts,
    "linear_facts": q_linear_facts,
    "lump_nulls": q_lump_nulls,
    "yeo_johnson_lambda": q_yeo_johnson_lambda,
    "ols_inference": q_ols_inference,
    "significance_bands": q_significance_bands,
    "pca_loadings": q_pca_loadings,
    "pca_top_two": q_pca_top_two,
    "pdp_grid_percentiles": q_pdp_grid_percentiles,
    "stump_leaves": q_stump_leaves,
    "stump_metrics": q_stump_metrics,
    "stump_cv_r2": q_stump_cv_r2,
    "stump_shap_values": q_stump_shap_values,
    "stump_shap_sample": q_stump_shap_sample,
    "stump_shap_importance": q_stump_shap_importance,
    "stump_signed_shap": q_stump_signed_shap,
    "stump_shap_by_parameter": q_stump_shap_by_parameter,
    "stump_pdp_1d": q_stump_pdp_1d,
    "stump_pdp_2d": q_stump_pdp_2d,
    "corr_by_group": q_corr_by_group,
    "skew_by_group": q_skew_by_group,
    "pca_by_group": q_pca_by_group,
    "level_dictionary": q_level_dictionary,
    "one_hot_entries": q_one_hot_entries,
    "stump_pdp_mean": q_stump_pdp_mean,
    "stump_pdp_mean_2d": q_stump_pdp_mean_2d,
    "deep_tree_metrics": q_deep_tree_metrics,
    "deep_shap_sums": q_deep_shap_sums,
    "deep_leaf_totals": q_deep_leaf_totals,
    "perm_stored_model": q_perm_stored_model,
}
