"""Wide and grouped fits: level tables, absorbed levels, QR, masked correlations, committed runs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trendlens.operators import interact, levels, linear, stats
from trendlens.plans import analysis
from trendlens.roles import Roles
from trendlens.sources import results


def test_many_columns_with_different_nulls_correlate_like_pandas(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 40)) + rng.normal(size=(300, 1)) + 1e6
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 7] = 3.0
    cols = [f"c{i}" for i in range(40)]
    pdf = pd.DataFrame(x, columns=cols).assign(g=np.arange(300) % 3)
    got = stats.correlation(spark.createDataFrame(pdf).repartition(4), cols).toPandas()
    want = pdf[cols].corr()
    for r in got.itertuples():
        w = want.loc[r.col_a, r.col_b]
        assert (np.isnan(w) and np.isnan(r.r)) or abs(r.r - w) < 1e-9
    assert len(got) == 1600
    by = stats.correlation(spark.createDataFrame(pdf), cols[:3], by=["g"]).toPandas()
    for g, part in pdf.groupby("g"):
        w = part[cols[:3]].corr()
        for r in by[by.g == g].itertuples():
            assert abs(r.r - w.loc[r.col_a, r.col_b]) < 1e-9


def test_dictionary_of_many_levels_stays_a_table(spark):
    df = spark.range(60_000).selectExpr("id", "concat('L', lpad(id % 50000, 6, '0')) as a", "if(id % 7 = 0, null, id % 3) as b",
                                        "cast(id % 4 as double) as x")
    d = levels.level_dictionary(df, ["a", "b"]).cache()
    assert d.count() == 50_003 and d.where("idx is null").count() == 2
    idx = [r.idx for r in d.where("idx is not null").orderBy("idx").collect()]
    assert idx == list(range(50_001))
    e = levels.feature_entries(df, d, ["a", "b"], ["id"], [("num__x", df.x)])
    one = {r.feature: (r.idx, r.value) for r in e.where("id = 8").collect()}
    assert one == {"cat__a_L000008": (7, 1.0), "cat__b_2": (50_000, 1.0)}
    assert {r.feature for r in e.where("id = 7").collect()} == {"cat__a_L000007", "num__x"}
    with pytest.raises(ValueError):
        levels.level_dictionary(df, ["b"], {"b": "9"})
    assert levels.level_dictionary(df.where("false"), ["a"]).count() == 0


def test_absorbed_levels_equal_the_regression_on_all_their_columns(spark):
    rng = np.random.default_rng(8)
    n = 500
    pdf = pd.DataFrame({"g": rng.choice(list("abcdefgh"), n), "x": rng.normal(1e5, 2, n), "z": rng.normal(size=n)})
    pdf["y"] = pdf.x * 3 - pdf.z + (pdf.g == "c") * 5 + rng.normal(size=n)
    pdf.loc[3, "g"], pdf.loc[5, "x"], pdf.loc[6, "y"] = None, np.nan, np.nan
    df = spark.createDataFrame(pdf)
    for ref in (None, "d"):
        got = {r.term: r for r in linear.absorbed_regression(df, "g", ["x", "z"], "y", reference=ref).coefficients.collect()}
        lv = [v for v in "abcdefgh" if v != (ref or "a")]
        specs = [(f"cat__g_{v}", (df.g == v).cast("double")) for v in lv] + ["x", "z"]
        whole = linear.regression(df.where("g is not null"), specs, ["y"])
        want = {r.term: r for r in whole.coefficients.collect()}
        assert got.keys() == want.keys()
        for t, w in want.items():
            scale = 1e-3 if t == "Intercept" else 1e-6
            assert abs(got[t].coef - w.coef) < scale and abs(got[t].std_err / w.std_err - 1) < 1e-6, t
        fit = linear.absorbed_regression(df, "g", ["x", "z"], "y", reference=ref).fit.first()
        f = whole.fit.first()
        assert (fit.n, fit["rank"]) == (f.n, f["rank"]) and abs(fit.r2 - f.r2) < 1e-9


def test_triangular_factors_tell_near_copies_apart_by_group(spark):
    rng = np.random.default_rng(6)
    n = 900
    a, d = rng.normal(50, 10, n), rng.normal(size=n)
    pdf = pd.DataFrame({"g": np.arange(n) % 3, "a": a, "b": a + 1e-6 * d, "y": 2 * a + 3 * d + rng.normal(size=n) * 1e-3})
    pdf.loc[2, "a"] = np.nan
    out = linear.regression(spark.createDataFrame(pdf).repartition(5), ["a", "b"], ["y"], by=["g"], method="qr")
    for g, part in pdf.dropna().groupby("g"):
        x = np.column_stack([np.ones(len(part)), part.a, (part.b - part.a) * 1e6])
        beta = np.linalg.lstsq(x, part.y, rcond=None)[0]
        got = {r.term: r.coef for r in out.coefficients.where(f"g = {g}").collect()}
        assert abs(got["b"] * 1e-6 / beta[2] - 1) < 1e-6
        f = out.fit.where(f"g = {g}").first()
        assert f["rank"] == 3 and f.n == len(part)
    same = linear.regression(spark.createDataFrame(pdf), ["a", ("flat", F.col("a") * 0 + 1)], ["y"], method="qr")
    assert same.fit.first()["rank"] == 2
    out.unpersist()


def test_weighted_targets_without_weights_fall_back(spark):
    pdf = pd.DataFrame({"x": np.arange(100.0), "y": np.arange(100.0) * 2 + 1, "yStd": np.full(100, np.nan)})
    fit = linear.regression(spark.createDataFrame(pdf), ["x"], ["y"])
    assert fit.fit.first().method == "OLS" and abs({r.term: r.coef for r in fit.coefficients.collect()}["x"] - 2) < 1e-9
    pdf.loc[:4, "yStd"] = 0.5
    assert linear.regression(spark.createDataFrame(pdf), ["x"], ["y"]).fit.first().method == "WLS"


def test_an_aborted_run_is_not_the_latest(spark, tmp_path):
    base = str(tmp_path)
    one = spark.createDataFrame([(1,)], "v int")
    analysis.write_run({"a": one, "b": one}, base, "20000101")
    results.write_result(one.selectExpr("2 as v"), base, "a", "20000102")   # dies before its second table
    analysis.write_run({"b": one.selectExpr("3 as v")}, base, "20000103")
    assert results.latest_run(spark, base, "a").first().v == 1
    assert results.latest_run(spark, base, "b").first().v == 3
    with pytest.raises(ValueError):
        results.latest_run(spark, base, "c")


def test_every_dataset_gets_its_own_run(spark):
    rng = np.random.default_rng(1)
    n = 120
    pdf = pd.DataFrame({"id": range(n), "set": np.where(np.arange(n) % 2, "p", "q"), "c": rng.choice(list("uvw"), n),
                        "x": rng.normal(size=n)})
    pdf["y"] = np.where(pdf.set == "p", 2, -1) * pdf.x
    roles = Roles(["c"], ["x"], ["y"])
    opts = analysis.Options(trees=3, max_depth=3, run_interactions=False, run_permutation=False, run_pdp=False, key=("id",))
    t = analysis.analyze_by(spark, spark.createDataFrame(pdf), "set", roles, opts)
    slope = {r.set: r.coef for r in t["coefficients"].where("term = 'num__x'").collect()}
    assert slope["p"] > 0 > slope["q"]
    assert {r.set for r in t["forest_metrics"].collect()} == {"p", "q"} and "top_shap" in t


def test_interactions_by_group_equal_those_of_the_groups_alone(spark):
    rng = np.random.default_rng(13)
    n = 240
    pdf = pd.DataFrame({"g": np.arange(n) % 2, "a": rng.choice(list("pq"), n), "x": rng.normal(size=n)})
    pdf["y"] = pdf.x * (pdf.a == "p") * (pdf.g + 1) + rng.normal(size=n)
    df, lv = spark.createDataFrame(pdf), {"a": ["p", "q"]}
    both = interact.interactions(df, ["a"], ["x"], ["y"], levels=lv, by=["g"])
    assert both.status.where("status = 'fitted'").count() == 4
    for g in (0, 1):
        one = interact.interactions(df.where(f"g = {g}"), ["a"], ["x"], ["y"], levels=lv)
        want = {(r.depth, r.term): r.coef for r in one.coefficients.collect()}
        got = {(r.depth, r.term): r.coef for r in both.coefficients.where(f"g = {g}").collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    wide = interact.interactions(df, ["a"], ["x"], ["y"], levels=lv, by=["g"], max_columns=1)
    assert {(r.g, r.depth, r.status) for r in wide.status.collect()} == {(g, d, "too wide") for g in (0, 1) for d in (1, 2)}
