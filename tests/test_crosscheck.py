"""Cross-checks against Spark ML / JVM implementations on full-rank data."""

import numpy as np
import pandas as pd
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import PCA as MLPCA
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression

from trendlens.functions.tdist import t_sf2
from trendlens.operators import linear, pca, stats


def _frame(spark, n=400):
    rng = np.random.default_rng(21)
    x = rng.normal(size=(n, 3))
    y = 1 + x @ np.array([0.5, -2.0, 0.0]) + rng.normal(size=n)
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=y)
    return spark.createDataFrame(pdf)


def test_ols_against_spark_ml_normal_solver(spark):
    df = _frame(spark)
    vec = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    ml = LinearRegression(featuresCol="features", labelCol="y", solver="normal", regParam=0.0,
                          standardization=False).fit(vec)
    ours = {r.term: r for r in linear.regression(df, ["a", "b", "c"], ["y"], use_wls=False).coefficients.collect()}
    assert abs(ours["Intercept"].coef - ml.intercept) < 1e-9
    assert np.allclose([ours[t].coef for t in "abc"], ml.coefficients.toArray(), atol=1e-9)
    se = ml.summary.coefficientStandardErrors  # features..., intercept
    assert np.allclose([ours[t].std_err for t in "abc"] + [ours["Intercept"].std_err], se, rtol=1e-7)
    pv = ml.summary.pValues
    assert np.allclose([ours[t].p for t in "abc"] + [ours["Intercept"].p], pv, atol=1e-7)


def test_t_tail_against_jvm(spark):
    jvm = spark.sparkContext._jvm
    for df_, t in [(3, 1.2), (10, 2.228), (57, -0.4), (1000, 3.1)]:
        dist = jvm.org.apache.commons.math3.distribution.TDistribution(float(df_))
        ref = 2 * (1 - dist.cumulativeProbability(abs(t)))
        assert abs(t_sf2(t, df_) - ref) < 1e-10


def test_pca_against_spark_ml(spark):
    df = _frame(spark)
    vec = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    ml = MLPCA(k=3, inputCol="features", outputCol="pcs").fit(vec)
    ours = sorted((r.pc, r.ratio) for r in pca.pca(df, ["a", "b", "c"]).variance.collect())
    assert np.allclose([r for _, r in ours], ml.explainedVariance.toArray(), atol=1e-10)


def test_metrics_against_regression_evaluator(spark):
    df = _frame(spark).withColumn("pred", __import__("pyspark.sql.functions", fromlist=["col"]).col("a") * 0.4)
    m = stats.metrics(df, "y", "pred").first()
    for name, ours in (("r2", m.r2), ("mae", m.mae), ("rmse", m.rmse)):
        ref = RegressionEvaluator(labelCol="y", predictionCol="pred", metricName=name).evaluate(df)
        assert abs(ours - ref) < 1e-9
