import itertools
import math

import numpy as np
import pandas as pd
import pytest

from trendlens.operators import explain, forest


@pytest.fixture(scope="module")
def tiny(spark):
    rng = np.random.default_rng(11)
    n = 60
    pdf = pd.DataFrame({"id": np.arange(n), "a": rng.integers(0, 2, n).astype(float),
                        "b": rng.normal(size=n), "c": rng.uniform(0, 3, n)})
    pdf["y"] = 2 * pdf.a + pdf.b ** 2 - pdf.c + rng.normal(scale=0.1, size=n)
    df = spark.createDataFrame(pdf)
    names = ["a", "b", "c"]
    vec = forest.assemble(df, names, keep=["id", "y"])
    model = forest.fit_forest(vec, "y", trees=5, max_depth=4, seed=1)
    trees = forest.tree_tables(spark, model, 3, group_nodes=40)
    return pdf, df, vec, names, model, trees


def _value(leaves, x, s):
    """Path-dependent expectation of the forest given features in s."""
    tot = 0.0
    for leaf in leaves:
        w = leaf.value
        for f, a, u, z in zip(leaf.feature, leaf.above, leaf.upto, leaf.share):
            w *= float(a < x[f] <= u) if f in s else z
        tot += w
    return tot


def _phi(spark, df, names, trees):
    rows = explain.shap_values(df, names, trees, keep=["id"]).collect()
    out = np.zeros((df.count(), len(names)))
    for r in rows:
        out[r.id, r.feature_idx] = r.phi
    return out


def test_tree_shap_equals_brute_force_shapley(spark, tiny):
    pdf, df, vec, names, model, trees = tiny
    assert trees.n_groups > 1
    lt = trees.leaves(spark).collect()
    x = pdf[names].to_numpy()[:6]
    phi = _phi(spark, df, names, trees)
    p = len(names)
    for r in range(len(x)):
        for j in range(p):
            others = [k for k in range(p) if k != j]
            ref = 0.0
            for size in range(p):
                for s in itertools.combinations(others, size):
                    wgt = math.factorial(size) * math.factorial(p - size - 1) / math.factorial(p)
                    ref += wgt * (_value(lt, x[r], set(s) | {j}) - _value(lt, x[r], set(s)))
            assert abs(phi[r, j] - ref) < 1e-9


def test_additivity_against_spark_predictions(spark, tiny):
    pdf, df, vec, names, model, lt = tiny
    out = explain.shap_additivity(model.transform(vec), names, lt).first()
    assert out.max_abs_error < 1e-9 and out.n == len(pdf)
    imp = {r.feature: r.mean_abs_shap for r in explain.shap_importance(df, names, lt).collect()}
    ref = np.abs(_phi(spark, df, names, lt)).mean(axis=0)
    assert all(abs(imp[n] - ref[i]) < 1e-9 for i, n in enumerate(names))


def test_pdp_recursion_equals_path_expectation(spark, tiny):
    pdf, df, vec, names, model, trees = tiny
    lt = trees.leaves(spark).collect()
    grid = explain.pdp_grid(df, names, resolution=10)
    pd1 = explain.tree_pdp_1d(grid, trees).collect()
    assert len(pd1) == 22
    for r in pd1[:12]:
        j = names.index(r.feature)
        x = np.zeros(3)
        x[j] = r.value
        assert abs(r.pd - _value(lt, x, {j})) < 1e-9
    pd2 = explain.tree_pdp_2d(grid, trees).collect()
    assert len(pd2) == 2 * 10 + 2 * 10 + 10 * 10
    for r in pd2[::9]:
        i, j = names.index(r.f1), names.index(r.f2)
        x = np.zeros(3)
        x[i], x[j] = r.v1, r.v2
        assert abs(r.pd - _value(lt, x, {i, j})) < 1e-9
    sizes = {r.feature: len(r["values"]) for r in grid.collect()}
    assert sizes["a"] == 2 and sizes["b"] == 10


def test_permutation_of_unused_feature_is_zero(spark, tiny):
    pdf, df, vec, names, model, lt = tiny
    from pyspark.ml.feature import VectorAssembler

    va = VectorAssembler(inputCols=names, outputCol="features")
    df2 = df.withColumn("unused", df.b * 0 + 1.0)
    perm = explain.permutation_importance(df2, names + ["unused"], "y", ["id"],
                                          lambda d: model.transform(va.transform(d)), repeats=3, seed=0)
    s = {r.feature: r.importance_mean for r in explain.permutation_summary(perm).collect()}
    assert s["unused"] == 0.0 and s["b"] > 0
    assert perm.count() == 3 * 4


def test_partial_dependence_over_the_data_is_the_average_prediction(spark, tiny, monkeypatch):
    pdf, df, vec, names, model, trees = tiny
    lt = trees.leaves(spark).collect()
    every = pd.concat([pdf, pdf.iloc[:7]], ignore_index=True)
    grid = explain.pdp_grid(df, names, resolution=6)
    leaves = explain.leaf_counts(df.union(df.where("id < 7")), names, trees)
    monkeypatch.setattr(explain, "GRID_CELLS", 7)   # several blocks of features

    def average(values):
        x = every[names].to_numpy().copy()
        for j, v in values.items():
            x[:, j] = v
        return np.mean([_value(lt, r, {0, 1, 2}) for r in x])

    for r in explain.tree_pdp_1d(grid, trees, leaves).collect():
        assert abs(r.pd - average({names.index(r.feature): r.value})) < 1e-9
    got = explain.tree_pdp_2d(grid, trees, leaves=leaves).collect()
    assert len(got) == 2 * 6 + 2 * 6 + 36
    for r in got[::5]:
        assert abs(r.pd - average({names.index(r.f1): r.v1, names.index(r.f2): r.v2})) < 1e-9


def test_deep_trees_repeated_features_and_missing_values(spark):
    """Paths of 20 and more splits on two features; NaN goes the way of large values."""
    rng = np.random.default_rng(3)
    n = 400
    pdf = pd.DataFrame({"id": np.arange(n), "a": rng.integers(0, 40, n).astype(float), "b": rng.integers(0, 9, n).astype(float)})
    pdf["y"] = np.exp(pdf.a / 4) + pdf.b * rng.normal(size=n)
    df = spark.createDataFrame(pdf)
    vec = forest.assemble(df, ["a", "b"], keep=["id", "y"])
    model = forest.fit_forest(vec, "y", trees=3, max_bins=64, key=["id"])
    trees = forest.tree_tables(spark, model, 2, group_nodes=300)
    assert max(t.depth for t in model.trees) > 10 and trees.n_groups > 1
    got = explain.shap_additivity(model.transform(vec), ["a", "b"], trees).first()
    scale = float(pdf.y.abs().max())
    assert got.n == n and got.max_abs_error < 1e-9 * scale
    odd = df.limit(5).selectExpr("id", "a", "cast(null as double) as b")
    lt = trees.leaves(spark).collect()
    for r in explain.shap_sums(odd, ["a", "b"], trees, ["id"]).collect():
        a = float(pdf.a[r.id])
        assert abs(r.explained - _value(lt, [a, 1e300], {0, 1})) < 1e-9 * scale


def test_a_forest_does_not_depend_on_the_partitions(spark):
    rng = np.random.default_rng(5)
    n = 500
    pdf = pd.DataFrame({"id": np.arange(n), "a": rng.normal(size=n), "b": rng.integers(0, 5, n).astype(float)})
    pdf["y"] = pdf.a + pdf.b * rng.normal(size=n)
    nodes = []
    for parts in (4, 16):
        vec = forest.assemble(spark.createDataFrame(pdf.sample(frac=1, random_state=parts)).repartition(parts), ["a", "b"], keep=["id", "y"])
        model = forest.fit_forest(vec, "y", trees=4, max_depth=6, key=["id"])
        nodes.append(sorted(map(tuple, forest.tree_tables(spark, model, 2).leaves(spark).select("tree", "leaf", "above", "upto").collect())))
    assert nodes[0] == nodes[1]


def test_a_stored_model_scores_like_the_live_one(spark, tiny):
    pdf, df, vec, names, model, lt = tiny
    again = forest.load_model(forest.save_model(spark, model))
    from pyspark.ml.feature import VectorAssembler

    va = VectorAssembler(inputCols=names, outputCol="features")
    run = [{(r.feature, r.repeat): r.importance for r in explain.permutation_importance(
        df, names, "y", ["id"], lambda d, m=m: m.transform(va.transform(d)), repeats=2).collect()} for m in (model, again)]
    assert run[0].keys() == run[1].keys() and all(abs(run[0][k] - run[1][k]) < 1e-12 for k in run[0])


def test_shuffled_index_is_a_bijection_and_importance_matches_plain_python(spark, tiny):
    for n in (1, 2, 3, 17, 1000):
        for repeat in (0, 1, 5):
            got = explain.shuffled_index(np.arange(n), n, 0, np.full(n, repeat))
            assert sorted(got.tolist()) == list(range(n))
    pdf, df, vec, names, model, trees = tiny
    lt = trees.leaves(spark).collect()
    predict = lambda x: np.array([_value(lt, r, {0, 1, 2}) for r in x])
    x, y = pdf[names].to_numpy(), pdf["y"].to_numpy()
    sst = ((y - y.mean()) ** 2).sum()
    from pyspark.ml.feature import VectorAssembler

    va = VectorAssembler(inputCols=names, outputCol="features")
    got = explain.permutation_importance(df, names, "y", ["id"], lambda d: model.transform(va.transform(d)), repeats=2).collect()
    for r in got:
        v = x.copy()
        v[:, r.feature_idx] = x[explain.shuffled_index(np.arange(len(x)), len(x), 0, np.full(len(x), r.repeat)), r.feature_idx]
        want = (((y - predict(v)) ** 2).sum() - ((y - predict(x)) ** 2).sum()) / sst
        assert abs(r.importance - want) < 1e-9


def test_training_partitions_do_not_follow_the_rows():
    assert [forest.layout_parts(n) for n in (0, 1, 4096, 20_000)] == [1, 1, 1, 5]
    assert forest.layout_parts(1_200_000) == 16
    assert forest.layout_parts(7_200_000) == 24


def test_training_rows_lie_by_features_whatever_the_input_partitions(spark, tiny):
    from pyspark.ml.functions import vector_to_array

    pdf, df, vec, names, model, trees = tiny
    many = vec.withColumn("features", vec.features).select("id", "y", "features")
    got = []
    for parts in (1, 7):
        out = forest.laid_out(many.repartition(parts), ["id"], "features").select("id", vector_to_array("features").alias("f"))
        got.append([(tuple(r.f), r.id) for r in out.collect()])
    assert got[0] == got[1] == sorted(got[0]) and len(got[0]) == len(pdf)


def test_equal_variants_are_scored_once(spark):
    rng = np.random.default_rng(3)
    n = 400
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "a": rng.integers(0, 2, n).astype(float),
                                             "b": rng.integers(0, 3, n).astype(float), "y": rng.normal(1e6, 1.0, n)}))
    sizes = []

    def score(d):
        sizes.append(d.count())
        return d.withColumn("prediction", 1e6 + d.a - d.b)

    got = explain.permutation_importance(df, ["a", "b"], "y", ["id"], score, repeats=3).collect()
    assert sizes[0] == n and sizes[1] <= 3 * 2 * 6
    pdf = df.toPandas()
    x, y = pdf[["a", "b"]].to_numpy(), pdf["y"].to_numpy()
    err = lambda v: ((y - (1e6 + v[:, 0] - v[:, 1])) ** 2).sum()
    for r in got:
        v = x.copy()
        v[:, r.feature_idx] = x[explain.shuffled_index(np.arange(n), n, 0, np.full(n, r.repeat)), r.feature_idx]
        assert abs(r.importance - (err(v) - err(x)) / ((y - y.mean()) ** 2).sum()) < 1e-8


def _binned_rows(spark, n=600, seed=8):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"id": rng.permutation(n) * 3, "a": rng.integers(0, 50, n).astype(float),
                        "b": rng.integers(0, 2, n).astype(float), "c": rng.integers(0, 6, n) / 7})
    pdf["y"] = 1e4 + np.sin(pdf.a) * 5 + pdf.b * pdf.c + rng.normal(size=n)
    return pdf, forest.assemble(spark.createDataFrame(pdf), ["a", "b", "c"], keep=["id", "y"])


def test_a_fit_takes_no_more_jobs_when_trees_are_deeper(spark):
    pdf, vec = _binned_rows(spark)
    sc, jobs = spark.sparkContext, []
    for depth in (1, 30):
        sc.setJobGroup(f"fit-{depth}", "fit")
        model = forest.fit_forest(vec, "y", trees=3, max_depth=depth, key=["id"])
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"fit-{depth}")))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1] and max(t.depth for t in model.trees) > 8


def test_forests_grown_from_cells_are_those_of_spark_ml(spark, monkeypatch):
    from trendlens.operators import grow

    pdf, vec = _binned_rows(spark)
    got = []
    for cells in (grow.MOST_CELLS, 0):
        monkeypatch.setattr(grow, "MOST_CELLS", cells)
        model = forest.fit_forest(vec, "y", trees=2, max_bins=16, bootstrap=False, min_instances=3, max_depth=7, key=["id"])
        assert hasattr(model, "stored_at") == bool(cells)
        importance = model.featureImportances.toArray()
        got.append((model.totalNumNodes, [t.depth for t in model.trees], importance,
                    {r.id: r.prediction for r in model.transform(vec).collect()}))
    assert got[0][:2] == got[1][:2]
    assert np.allclose(got[0][2], got[1][2]) and got[0][3].keys() == got[1][3].keys()
    assert all(abs(v - got[1][3][k]) < 1e-8 for k, v in got[0][3].items())


def test_cell_sums_of_a_bootstrapped_forest_match_plain_python(spark, monkeypatch):
    from trendlens.operators import grow

    pdf, vec = _binned_rows(spark)
    monkeypatch.setattr(grow, "BLOCK_ROWS", 50)      # several blocks a cell
    model = forest.fit_forest(vec, "y", trees=10, max_bins=64, seed=5, key=["id"])
    assert len(model.trees) == model.getNumTrees == 10 and model.numFeatures == 3
    pdf = pdf.sort_values("id").reset_index(drop=True)
    w = grow.bootstrap_weights(np.arange(len(pdf)), 10, 5).astype(float)
    assert abs(w.mean() - 1) < 0.05 and abs(w.var() - 1) < 0.1
    roots = spark.read.parquet(f"{model.stored_at}/data").where("nodeData.id = 0").select("treeID", "nodeData.impurityStats").collect()
    for r in roots:
        own, y = w[:, r.treeID], pdf.y.to_numpy()
        assert np.allclose(r.impurityStats, [own.sum(), (own * y).sum(), (own * y * y).sum()], rtol=1e-12)
    # grown to the end, a tree predicts the weighted mean of every cell it drew rows of
    one, x = model.trees[3], ["a", "b", "c"]
    cells = pdf.assign(w=w[:, 3], wy=w[:, 3] * pdf.y).groupby(x)[["w", "wy"]].sum().query("w > 0")
    from pyspark.ml.linalg import Vectors

    for v, r in list(cells.iterrows())[::5]:
        assert abs(one.predict(Vectors.dense(*v)) - r.wy / r.w) < 1e-7


def test_cuts_split_skewed_values_as_spark_ml_does():
    from trendlens.operators.grow import candidate_cuts

    assert candidate_cuts([0.0, 1.0, 4.0], [5, 1, 1], 5).tolist() == [0.5, 2.5]
    assert candidate_cuts([3.0], [9], 5).tolist() == []
    assert candidate_cuts([1.0, 2.0, 3.0, 4.0, 5.0], [1, 1, 6, 1, 1], 2).tolist() == [2.5, 3.5]


def test_values_that_spark_ml_judges_are_left_to_it(spark):
    odd = spark.createDataFrame([(i, float(i % 3), None if i == 4 else float(i)) for i in range(20)], "id int, a double, y double")
    with pytest.raises(Exception):
        forest.fit_forest(forest.assemble(odd, ["a"], keep=["id", "y"]), "y", trees=1, key=["id"])
    one = spark.createDataFrame([(1, 2.0, 3.0)], "id int, a double, y double")
    vec = forest.assemble(one, ["a"], keep=["id", "y"])
    assert forest.predictions(forest.fit_forest(vec, "y", trees=1, bootstrap=False, key=["id"]), vec).first().prediction == 3.0


def test_predictions_are_those_of_the_stored_model(spark, monkeypatch):
    from trendlens.operators import grow

    pdf, vec = _binned_rows(spark)
    model = forest.fit_forest(vec, "y", trees=9, key=["id"])
    odd = forest.assemble(vec.unionByName(vec.limit(40)).selectExpr("id", "y", "a + 0.3 as a", "b", "c"), ["a", "b", "c"], keep=["id", "y"])
    want = sorted((r.id, r.prediction) for r in model.transform(odd).collect())
    for most in (grow.MOST_NODES, 0):
        monkeypatch.setattr(grow, "MOST_NODES", most)
        out = forest.predictions(model, odd.select("id", "features"))
        got = sorted((r.id, r.prediction) for r in out.collect())
        assert out.columns == ["id", "prediction"] and len(got) == len(pdf) + 40
        assert all(a == b and abs(p - q) < 1e-8 for (a, p), (b, q) in zip(want, got))
