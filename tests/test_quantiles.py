import math

import numpy as np
import pandas as pd

from trendlens.operators import explain, stats


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    n = 3000
    pdf = pd.DataFrame({"wide": rng.standard_cauchy(n) ** 3, "tied": rng.integers(0, 3, n).astype(float),
                        "huge": rng.choice([-1.7e308, -1.0, 0.0, 1e-300, 1.7e308], n), "one": np.full(n, 4.25)})
    probs = [0.0, 0.05, 0.3333, 0.5, 0.95, 1.0]
    got = stats.exact_quantiles(spark.createDataFrame(pdf), list(pdf.columns), probs, bins=16)
    for c in ("wide", "tied", "one"):
        assert np.allclose(got[c], np.quantile(pdf[c], probs), rtol=1e-12, atol=0)
    assert got["huge"][0] == -1.7e308 and got["huge"][-1] == 1.7e308


def test_exact_quantiles_ignore_what_is_no_number(spark):
    df = spark.createDataFrame([(1.0, None), (math.nan, None), (math.inf, None), (None, None), (2.0, None)],
                               "a double, b double")
    assert stats.exact_quantiles(df, ["a", "b"], [0.25, 0.5]) == {"a": [1.25, 1.5], "b": [None, None]}
    assert stats.exact_quantiles(df.where("false"), ["a"], [0.5]) == {"a": [None]}


def test_pdp_grid_switches_at_the_exact_distinct_count(spark):
    df = spark.range(120).select(_mod("id", 99).alias("few"), _mod("id", 100).alias("many"))
    grid = {r["feature"]: r["values"] for r in explain.pdp_grid(df, ["few", "many"]).collect()}
    assert grid["few"] == [float(v) for v in range(99)]
    x = [float(i % 100) for i in range(120)]
    lo, hi = np.quantile(x, [0.05, 0.95])
    assert np.allclose(grid["many"], np.linspace(lo, hi, 100))


def _mod(c, k):
    from pyspark.sql import functions as F

    return (F.col(c) % k).cast("double")


def test_lambda_beyond_the_first_window(spark):
    x = 12.0 - np.exp(0.4 * np.random.default_rng(3).normal(size=400))
    lam = stats.fit_yeo_johnson(spark.createDataFrame(pd.DataFrame({"x": x})), ["x"])["x"][0]

    def llf(v):
        # (1 + x)^v over its mid value: no overflow, the likelihood but for a constant
        z = np.exp(v * (np.log1p(x) - np.log(12.0)))
        return -len(x) / 2 * np.log(np.var(z) / v ** 2) + v * (np.log1p(x) - np.log(12.0)).sum()

    assert lam > 5 and llf(lam) >= max(llf(lam - 0.01), llf(lam + 0.01))
