import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trendlens.operators import interact, linear, pca
from trendlens.operators.index import kfold, stable_index


def _df(spark, n=300, seed=0):
    rng = np.random.default_rng(seed)
    x1, x2 = rng.normal(size=n), rng.uniform(0, 5, size=n)
    y = 2 + 3 * x1 - 0.5 * x2 + rng.normal(size=n)
    s = rng.uniform(0.5, 2, size=n)
    pdf = pd.DataFrame({"id": np.arange(n), "x1": x1, "x2": x2, "y": y, "yStd": s, "g": rng.integers(0, 3, n)})
    return spark.createDataFrame(pdf), pdf


def test_ols_matches_numpy_both_paths(spark):
    df, pdf = _df(spark)
    xd = np.column_stack([np.ones(len(pdf)), pdf.x1, pdf.x2])
    beta = np.linalg.lstsq(xd, pdf.y, rcond=None)[0]
    for method in ("sql", "arrow"):
        fit = linear.regression(df, ["x1", "x2"], ["y"], use_wls=False, method=method)
        c = {r.term: r for r in fit.coefficients.collect()}
        assert np.allclose([c["Intercept"].coef, c["x1"].coef, c["x2"].coef], beta, atol=1e-9)
        f = fit.fit.first()
        assert f.n == len(pdf) and f.rank == 3 and f.method == "OLS"


def test_wls_uses_std_column(spark):
    df, pdf = _df(spark)
    fit = linear.regression(df, ["x1"], ["y"], use_wls=True)
    w = 1 / (pdf.yStd ** 2 + 1e-6)
    xd = np.column_stack([np.ones(len(pdf)), pdf.x1])
    sw = np.sqrt(w)
    beta = np.linalg.lstsq(xd * sw.values[:, None], pdf.y * sw, rcond=None)[0]
    c = {r.term: r.coef for r in fit.coefficients.collect()}
    assert np.allclose([c["Intercept"], c["x1"]], beta, atol=1e-9)
    assert fit.fit.first().method == "WLS"


def test_grouped_fits_and_targets_with_own_nulls(spark):
    df, pdf = _df(spark)
    df = df.withColumn("y2", F.when(F.col("id") % 7 == 0, None).otherwise(F.col("y") * 2))
    fit = linear.regression(df, ["x1"], ["y", "y2"], use_wls=False, by=["g"])
    rows = fit.fit.collect()
    assert len(rows) == 6
    for r in rows:
        sub = pdf[pdf.g == r.g]
        expect = len(sub) if r.target == "y" else int((sub.id % 7 != 0).sum())
        assert r.n == expect


def test_folds_are_contiguous_and_sized_like_ntile(spark):
    df = spark.createDataFrame([(i,) for i in range(13)], "k int")
    f = {r.k: r.fold for r in kfold(df, ["k"], k=5).collect()}
    sizes = [sum(1 for v in f.values() if v == j) for j in range(5)]
    assert sizes == [3, 3, 3, 2, 2]
    assert [f[i] for i in range(13)] == sorted(f[i] for i in range(13))
    idx, n = stable_index(spark.range(0, 1000).withColumn("k", -F.col("id")), ["k"])
    got = sorted((r.k, r.row_idx) for r in idx.collect())
    assert n == 1000 and [r for _, r in got] == list(range(1000))


def test_linear_cv_matches_refits(spark):
    df, pdf = _df(spark, n=103)
    folded = kfold(df, ["id"], k=5)
    cv = {r.fold: r.r2 for r in linear.cv_r2(folded, ["x1", "x2"], ["y"]).collect()}
    fd = {r.id: r.fold for r in folded.select("id", "fold").collect()}
    pdf["fold"] = pdf.id.map(fd)
    for k in range(5):
        tr, te = pdf[pdf.fold != k], pdf[pdf.fold == k]
        xd = np.column_stack([np.ones(len(tr)), tr.x1, tr.x2])
        b = np.linalg.lstsq(xd, tr.y, rcond=None)[0]
        pred = b[0] + b[1] * te.x1 + b[2] * te.x2
        r2 = 1 - ((te.y - pred) ** 2).sum() / ((te.y - te.y.mean()) ** 2).sum()
        assert abs(cv[k] - r2) < 1e-9


def test_contrast_coding_columns_equal_rank(spark):
    levels = {"a": ["a1", "a2"], "b": ["b1", "b2", "b3"], "c": ["c1", "c2"]}
    rng = np.random.default_rng(9)
    rows = [(a, b, c, float(rng.normal()), float(rng.normal())) for _ in range(6)
            for a, b, c in itertools.product(levels["a"], levels["b"], levels["c"])]
    pdf = pd.DataFrame(rows, columns=["a", "b", "c", "x", "z"])
    for d in range(1, 6):
        cols = interact.design(["a", "b", "c"], ["x", "z"], levels, d)
        spark.createDataFrame(pdf)  # session active
        # evaluate the columns in numpy from their specs
        mat = np.column_stack([np.ones(len(pdf))] + [
            np.prod([(pdf[f] == lv).astype(float) if lv is not None else pdf[f] for f, lv in c.spec], axis=0)
            for c in cols[1:]])
        assert np.linalg.matrix_rank(mat) == mat.shape[1], (d, mat.shape)
    names = [c.term for c in interact.design(["a", "b"], [], levels, 2)]
    assert names == ["Intercept", 'C(Q("b"))[T.b2]', 'C(Q("b"))[T.b3]',
                     'C(Q("a"))[T.a2]:C(Q("b"))[b1]', 'C(Q("a"))[T.a2]:C(Q("b"))[b2]',
                     'C(Q("a"))[T.a2]:C(Q("b"))[b3]']
    ax = [c.term for c in interact.design(["a", "b"], ["x"], levels, 2)]
    assert 'C(Q("a"))[a1]:Q("x")' in ax and 'C(Q("b"))[T.b2]:Q("x")' in ax


def test_interaction_d2_equals_cell_means(spark):
    rng = np.random.default_rng(5)
    a = rng.choice(["p", "q"], 200)
    b = rng.choice(["u", "v", "w"], 200)
    y = rng.normal(size=200) + (a == "q") * 2 + (b == "w") * 1.0
    pdf = pd.DataFrame({"a": a, "b": b, "y": y})
    fit = interact.interactions(spark.createDataFrame(pdf), ["a", "b"], [], ["y"], max_depth=2)
    c = {r.term: r.coef for r in fit.coefficients.where("depth = 2").collect()}
    m = pdf.groupby(["a", "b"]).y.mean()
    assert abs(c["Intercept"] - m[("p", "u")]) < 1e-9
    assert abs(c['C(Q("b"))[T.w]'] - (m[("p", "w")] - m[("p", "u")])) < 1e-9
    assert abs(c['C(Q("a"))[T.q]:C(Q("b"))[v]'] - (m[("q", "v")] - m[("p", "v")])) < 1e-9
    st = {r.depth: r.status for r in fit.status.collect()}
    assert st == {1: "fitted", 2: "fitted"}


def test_wide_depth_is_fitted(spark):
    pdf = pd.DataFrame({"a": [f"a{i % 40}" for i in range(3000)], "b": [f"b{i % 27}" for i in range(3000)],
                        "y": np.arange(3000.0) % 17})
    fit = interact.interactions(spark.createDataFrame(pdf), ["a", "b"], [], ["y"])
    st = {r.depth: (r.status, r.n_columns, r["rank"]) for r in fit.status.collect()}
    assert st[2] == ("fitted", 1080, 1080) and fit.coefficients.where("depth = 2").count() == 1080


def _raw_design(pdf, cats, nums, levels, d):
    cols = interact.design(cats, nums, levels, d)
    return [c.term for c in cols], np.column_stack([np.ones(len(pdf))] + [
        np.prod([(pdf[f] == lv).astype(float) if lv is not None else pdf[f] for f, lv in c.spec], axis=0) for c in cols[1:]])


def test_interactions_from_cells_equal_least_squares_on_rows(spark):
    rng = np.random.default_rng(21)
    n = 400
    pdf = pd.DataFrame({"a": rng.choice(list("pqr"), n), "b": rng.choice(list("uv"), n), "x": rng.normal(50, 3, n),
                        "z": rng.uniform(-1, 1, n)})
    pdf["y"] = (pdf.a == "q") * pdf.x + pdf.z * pdf.x + rng.normal(size=n)
    pdf["w"] = np.where(np.arange(n) % 5 == 0, np.nan, pdf.y * 2 + pdf.z)
    levels = {"a": ["p", "q", "r"], "b": ["u", "v"]}
    fit = interact.interactions(spark.createDataFrame(pdf), ["a", "b"], ["x", "z"], ["y", "w"], levels=levels)
    for t in ("y", "w"):
        some = pdf[pdf[t].notna()]
        for d in range(1, 5):
            terms, m = _raw_design(some, ["a", "b"], ["x", "z"], levels, d)
            want = np.linalg.lstsq(m, some[t].to_numpy(), rcond=None)[0]
            got = {r.term: r.coef for r in fit.coefficients.where(f"depth = {d} and target = '{t}'").collect()}
            assert list(got) and np.allclose([got[x] for x in terms], want, rtol=1e-5, atol=1e-6), (t, d)
            r = fit.status.where(f"depth = {d} and target = '{t}'").first()
            assert (r.n, r["rank"], r.status) == (len(some), m.shape[1], "fitted")


def test_interactions_on_large_means(spark):
    """Epoch seconds: an exact line keeps its intercept and slope."""
    i = np.arange(3000)
    pdf = pd.DataFrame({"t": 1.7e9 + (i * 7919) % 10007, "z": (i * 31) % 17 / 4.0})
    pdf["y"] = 2e-4 * pdf.t
    fit = interact.interactions(spark.createDataFrame(pdf), [], ["t", "z"], ["y"])
    c = {r.term: r.coef for r in fit.coefficients.where("depth = 1").collect()}
    assert abs(c["Intercept"]) < 1e-3 and abs(c['Q("t")'] / 2e-4 - 1) < 1e-9 and abs(c['Q("z")']) < 1e-9
    assert fit.status.where("status = 'fitted'").count() == 2


def test_a_wide_depth_is_solved_from_few_cells_or_fails_alone(spark):
    rng = np.random.default_rng(2)
    n = 60
    pdf = pd.DataFrame({c: [f"{c}{v}" for v in rng.integers(0, 11, n)] for c in "abcd"})
    pdf["y"] = rng.normal(size=n)
    pdf = pd.concat([pdf, pdf.assign(y=pdf.y + 1)], ignore_index=True)
    df = spark.createDataFrame(pdf)
    fit = interact.interactions(df, list("abcd"), [], ["y"])
    st = {r.depth: r for r in fit.status.collect()}
    levels = {c: sorted(pdf[c].unique()) for c in "abcd"}
    assert st[4].status == "fitted" and st[4].n_columns == np.prod([len(levels[c]) for c in "abcd"]) > 5000
    cells = pdf.groupby(list("abcd")).y.mean()
    assert st[4]["rank"] == len(cells) and st[4].n == len(pdf)
    terms, m = _raw_design(pdf, list("abcd"), [], levels, 4)
    got = {r.term: r.coef for r in fit.coefficients.where("depth = 4").collect()}
    beta = np.array([got[x] for x in terms])
    assert np.allclose(m @ beta, pdf.join(cells.rename("f"), on=list("abcd")).f)
    assert np.allclose(beta, np.linalg.pinv(m) @ pdf.y.to_numpy(), atol=1e-8)
    narrow = interact.interactions(df, list("abcd"), [], ["y"], max_columns=50)
    assert {r.depth: r.status for r in narrow.status.collect()} == {1: "fitted", 2: "too wide", 3: "too wide", 4: "too wide"}
    assert {r.depth for r in narrow.coefficients.collect()} == {1}


def test_failing_depth_leaves_the_others(spark):
    # squares of x stay finite, those of x times z do not
    pdf = pd.DataFrame({"x": [1e90, 2e90, 4e90, 5e90], "z": [1e90, 7e90, 2e90, 3e90], "y": [1.0, 2.0, 3.0, 5.0]})
    fit = interact.interactions(spark.createDataFrame(pdf), [], ["x", "z"], ["y"])
    assert {r.depth: r.status for r in fit.status.collect()} == {1: "fitted", 2: "failed"}
    assert {r.depth for r in fit.coefficients.collect()} == {1}


def test_moments_keep_two_columns_of_one_name(spark):
    from trendlens.functions.linalg import unpack
    from trendlens.operators import gram

    df = spark.createDataFrame([(1.0, 2.0), (3.0, 5.0)], "a double, b double")
    r = gram.moments(df, [("same", F.col("a")), ("same", F.col("b"))], method="arrow").first()
    m = unpack(r["_g"][:-1], 3)
    assert m[1, 1] == 10.0 and m[1, 2] == 17.0 and m[2, 2] == 29.0


def test_many_levels_encode_to_sparse_vectors(spark):
    from trendlens.operators import encode

    df = spark.range(4500).select("id", F.concat(F.lit("v"), F.col("id") % 1500).alias("c"), F.col("id").alias("x"))
    fs = encode.fit_features(df, ["c"], ["x"])
    assert len(fs.names) == 1500
    where = {f: i for i, f in enumerate(fs.names)}
    rows = fs.vector(df, ["id", "c"]).collect()
    assert len(rows) == 4500
    for r in rows:
        hot = [i for i in r.features.indices if i < 1499]
        assert hot == ([where[f"cat__c_{r.c}"]] if r.c != "v0" else [])


def test_pca_two_standardised_variables(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=500)
    z = 0.6 * x + rng.normal(size=500)
    df = spark.createDataFrame(pd.DataFrame({"x": (x - x.mean()) / x.std(), "z": (z - z.mean()) / z.std()}))
    res = pca.pca(df, ["x", "z"])
    v = sorted((r.pc, r.ratio, r.cumulative) for r in res.variance.collect())
    r = abs(np.corrcoef(x, z)[0, 1])
    assert abs(v[0][1] - (1 + r) / 2) < 1e-10 and abs(v[1][2] - 1.0) < 1e-12
    n = res.components_for().first()
    assert n.n_95 == 2


def test_grouped_predict_joins_per_group_coefficients(spark):
    df, pdf = _df(spark)
    fit = linear.regression(df, ["x1"], ["y"], use_wls=False, by=["g"])
    scored = {r.id: r.prediction for r in linear.predict(df, fit.coefficients, ["x1"], "y", by=["g"]).collect()}
    for g, sub in pdf.groupby("g"):
        b = np.polyfit(sub.x1, sub.y, 1)
        for i, x in zip(sub.id, sub.x1):
            assert abs(scored[i] - (b[1] + b[0] * x)) < 1e-8
    import pytest

    with pytest.raises(ValueError, match="pass by="):
        linear.predict(df, fit.coefficients, ["x1"], "y")


def test_shared_moments_equal_stacked_for_complete_targets(spark):
    df, pdf = _df(spark)
    df = df.withColumn("y2", df.y * 3 - df.x2)
    a = linear.regression(df, ["x1", "x2"], ["y", "y2"], use_wls=False)
    b = linear.regression(df, ["x1", "x2"], ["y", "y2"], use_wls=False, targets_complete=True)
    ca = sorted((r.target, r.term, round(r.coef, 9), round(r.std_err, 9)) for r in a.coefficients.collect())
    cb = sorted((r.target, r.term, round(r.coef, 9), round(r.std_err, 9)) for r in b.coefficients.collect())
    assert ca == cb
    fa = sorted((r.target, r.n, round(r.r2, 10)) for r in a.fit.collect())
    fb = sorted((r.target, r.n, round(r.r2, 10)) for r in b.fit.collect())
    assert fa == fb


def test_interactions_multi_target_with_own_nulls(spark):
    rng = np.random.default_rng(8)
    a = rng.choice(["p", "q"], 120)
    x = rng.normal(size=120)
    y1 = (a == "q") * 1.5 + 2 * x + rng.normal(size=120)
    y2 = np.where(np.arange(120) % 5 == 0, np.nan, y1 * -1 + x)
    pdf = pd.DataFrame({"a": a, "x": x, "y1": y1, "y2": y2})
    sdf = spark.createDataFrame(pdf).withColumn("y2", F.when(~F.isnan("y2"), F.col("y2")))
    both = interact.interactions(sdf, ["a"], ["x"], ["y1", "y2"])
    one = interact.interactions(sdf, ["a"], ["x"], ["y1"])
    c_both = {(r.depth, r.term): r.coef for r in both.coefficients.where("target = 'y1'").collect()}
    c_one = {(r.depth, r.term): r.coef for r in one.coefficients.collect()}
    assert c_both.keys() == c_one.keys() and all(abs(c_both[k] - c_one[k]) < 1e-9 for k in c_one)
    n2 = {r.depth: r.n for r in both.status.where("target = 'y2'").collect()}
    assert set(n2.values()) == {120 - 24}


@pytest.mark.parametrize("parts", [4, 16, 50])
def test_index_and_folds_hold_beyond_the_range_sample(spark, parts):
    from trendlens.operators.index import stable_index

    n = 20_000
    df = spark.range(0, n).withColumn("k", F.xxhash64("id"))
    idx, m = stable_index(df, ["k"], num_partitions=parts)
    r = idx.agg(F.countDistinct("row_idx").alias("d"), F.min("row_idx").alias("lo"), F.max("row_idx").alias("hi")).first()
    assert (m, r["d"], r["lo"], r["hi"]) == (n, n, 0, n - 1)


def test_sampled_rows_follow_the_key_alone(spark):
    from trendlens.operators import explain

    df = spark.range(2000).selectExpr("id", "if(id % 7 = 0, null, id) as k", "id * 2.0 as x")
    some = lambda d, n, key=("id",), seed=0: sorted(r["id"] for r in explain.sample_rows(d, list(key), n, seed).collect())
    one = some(df, 500)
    assert one == some(df.repartition(7), 500) and one != some(df, 500, seed=1)
    assert 400 < len(one) < 600 and set(some(df, 100)) <= set(one)
    nulls = set(some(df, 500, key=("k",))) & set(range(0, 2000, 7))
    assert nulls in (set(), set(range(0, 2000, 7)))          # rows of one key go together
    assert len(some(df, 2000)) == len(some(df, 10**9)) == 2000 and some(df, 0) == some(df, -5) == []
    assert some(df.where("false"), 5) == []
