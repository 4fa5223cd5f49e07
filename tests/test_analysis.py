from pyspark.sql import functions as F

from conftest import SF001
from trendlens.operators import forest
from trendlens.plans import analysis, frames
from trendlens.roles import Roles
from trendlens.session import scratch_path
from trendlens.sources import results


def test_end_to_end_run_and_rollup(spark):
    df = frames.frame_p(spark, SF001).withColumn("p_retailprice2", F.col("p_retailprice") * 2 + F.col("p_size"))
    roles = Roles(["p_brand", "p_type"], ["p_size"], ["p_retailprice", "p_retailprice2"])
    opts = analysis.Options(trees=5, max_depth=3, key=("p_partkey",), run_permutation=True,
                            interaction_max_depth=2, cv_folds=3)
    run = analysis.analyze(spark, df, roles, opts)
    t = run.tables
    assert {r.target for r in t["fit"].collect()} == {"p_retailprice", "p_retailprice2"}
    assert t["forest_cv"].count() == 6
    assert t["interaction_status"].where("status = 'fitted'").count() == 4
    s = analysis.summarize(spark, run)
    mr = s["method_rank"].collect()
    assert {r.parameter for r in mr} <= {"p_brand", "p_type", "p_size"} and mr
    assert s["summary_facts"].where("section = 'fit'").count() == 2
    assert {"pca_summary", "shap_values", "target_values", "permutation"} <= set(t)
    everything = scratch_path(spark, "all")
    analysis.write_run({**t, **s}, everything, "r1")
    for name in {**t, **s}:
        assert set({**t, **s}[name].columns) <= set(results.latest_run(spark, everything, name).columns), name
    again = {name: results.latest_run(spark, everything, name).count() for name in ("feature_matrix", "shap_values")}
    assert again == {"feature_matrix": df.count(), "shap_values": 2 * df.count() * len(run.features.names)}
    paths = analysis.write_models(spark, run.models, everything, "r1")
    vec = forest.assemble(run.features.transform(df, keep=["p_partkey"]), run.features.names, keep=["p_partkey"])
    again = forest.load_model(paths["p_retailprice"]).transform(vec)
    assert again.exceptAll(run.models["p_retailprice"].transform(vec)).count() == 0
    base = scratch_path(spark, "results")
    rid = analysis.write_run({"fit": t["fit"], "coefficients": t["coefficients"]}, base, "20260101_000000")
    analysis.write_run({"fit": t["fit"]}, base, "20260102_000000")
    latest = results.latest_run(spark, base, "fit")
    assert {r.run_id for r in latest.collect()} == {"20260102_000000"} and rid == "20260101_000000"


def test_significant_only_restricts_pdp_to_top_shap(spark):
    df = frames.frame_p(spark, SF001)
    roles = Roles(["p_brand", "p_type"], ["p_size"], ["p_retailprice"])
    opts = analysis.Options(trees=5, max_depth=3, significant_only=True, pdp_top_k=3, run_interactions=False)
    run = analysis.analyze(spark, df, roles, opts)
    assert run.tables["pdp_1d"].select("feature").distinct().count() == 3
    assert run.tables["pdp_2d"].select("f1", "f2").distinct().count() == 3


def test_drop_audit_counts_the_raw_input(spark):
    df = frames.frame_p(spark, SF001).withColumn("p_size", F.expr("nullif(p_size, 1)"))
    roles = Roles(["p_type"], ["p_size"], ["p_retailprice"])
    opts = analysis.Options(run_forest=False, run_interactions=False)
    run = analysis.analyze(spark, df, roles, opts)
    a = run.tables["drop_audit"].first()
    n_null = df.where("p_size IS NULL").count()
    assert a.rows_before == df.count() and a.rows_dropped == n_null and n_null > 0
    assert run.tables["fit"].first().n == df.count() - n_null
