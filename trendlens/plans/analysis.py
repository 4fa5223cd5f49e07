"""End-to-end analysis: the library's equivalent of one analysis run.

``analyze`` builds every result table of a run as lazy DataFrames keyed by
target (nothing overwrites between targets) and ``summarize`` rolls them up
to parameter level.  ``write_run`` persists them as tables partitioned by
``run_id`` (and target) under a shared base path.

Passes over the input: lumping fit (1), encoder fit (1), one moment pass for
all linear targets, one for all interaction depths and targets, one for
correlation and one for skewness; forest training per target; SHAP/PDP are
row/grid passes with the forest broadcast.  The cleaned frame is persisted
(memory and disk) because every model reads it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendlens.operators import clean, encode, explain, forest, interact, linear, pca, rollup, stats
from trendlens.operators.index import kfold
from trendlens.roles import Roles
from trendlens.sources import load, results


@dataclass
class Options:
    dropna_required: bool = True
    use_wls: bool = True
    significant_only: bool = False
    alpha: float = 0.05
    lump_top_n: int = 10
    run_forest: bool = True
    run_shap: bool = True
    run_pdp: bool = True
    run_interactions: bool = True
    run_permutation: bool = True
    trees: int = forest.TREES
    max_depth: int = forest.MAX_DEPTH
    max_bins: int = 32
    bootstrap: bool = True
    cv_folds: int = 5
    interaction_max_depth: int | None = None
    pdp_pairs: bool = True
    pdp_top_k: int = 5
    key: tuple = ()
    shap_sample: int | None = None     # explain about this many rows, chosen by key (needs ``key``)


@dataclass
class Run:
    roles: Roles
    features: encode.FeatureSet
    tables: dict = field(default_factory=dict)
    models: dict = field(default_factory=dict)


def prepare(df: DataFrame, roles: Roles, opts: Options) -> tuple[DataFrame, encode.FeatureSet]:
    """Clean, persist (every fit and model reads it), then fit lumping and
    the encoder on the cached rows; the lumped frame is a projection of the
    cached one, so later passes read the cache too."""
    load.check_roles(df, roles)
    keep_cols = list(dict.fromkeys([*opts.key, *roles.columns,
                                    *[f"{t}Std" for t in roles.targets if f"{t}Std" in df.columns]]))
    df = df.select(*keep_cols)
    if opts.dropna_required:
        df = clean.drop_missing(df, roles.columns)
    else:
        df = clean.impute_mean(df, list(roles.numerics))
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    keep, levels = clean.fit_lumping_levels(df, list(roles.categoricals), top_n=opts.lump_top_n)
    df = clean.apply_lumping(df, keep)
    fs = encode.fit_features(df, list(roles.categoricals), list(roles.numerics),
                             reference_levels=roles.reference_levels, levels=levels)
    return df, fs


def analyze(spark: SparkSession, df: DataFrame, roles: Roles, opts: Options | None = None) -> Run:
    opts = opts or Options()
    raw = df
    df, fs = prepare(df, roles, opts)
    counts = clean.target_null_counts(df, list(roles.targets)).collect()
    targets = [r["target"] for r in counts if not r["all_null"]]
    run = Run(roles, fs)
    t = run.tables
    t["features"] = fs.table(spark)
    if opts.key:
        # Preview rows, the feature matrix (one sparse vector a row) and the targets, once
        t["preview"] = results.preview(df, list(opts.key))
        t["feature_matrix"] = fs.vector(df, list(opts.key))
        t["target_values"] = df.select(*opts.key, *[c for c in targets if c not in opts.key])
    t["drop_audit"] = clean.drop_audit(raw, roles.columns)  # on the input, before cleaning
    t["levels"] = clean.level_profile(df, list(roles.categoricals))
    t["skew"] = stats.skew_check(df, list(roles.numerics) + targets)
    t["correlation"] = stats.correlation(df, list(roles.numerics))
    p = pca.pca(df, fs.specs)
    t["pca_variance"], t["pca_loadings"], t["pca_top"] = p.variance, p.loadings, p.top()
    t["pca_summary"] = p.summary()

    fit = linear.regression(df, fs.specs, targets, use_wls=opts.use_wls, alpha=opts.alpha,
                            targets_complete=opts.dropna_required)
    coefs = rollup.with_parameters(fit.coefficients, t["features"])
    if opts.significant_only:
        coefs = coefs.where((F.col("p") < opts.alpha) | (F.col("term") == "Intercept"))
    t["coefficients"], t["fit"] = coefs, fit.fit

    if opts.run_interactions:
        it = interact.interactions(df, list(roles.categoricals), list(roles.numerics), targets,
                                   max_depth=opts.interaction_max_depth, alpha=opts.alpha)
        t["interactions"], t["interaction_status"] = it.coefficients, it.status

    if opts.run_forest:
        keep = list(opts.key)
        wide = fs.transform(df, keep=keep + targets)
        imps, phis, pd1s, pd2s, mets, cvs, perms = [], [], [], [], [], [], []
        for tgt in targets:
            sub = wide.where(F.col(tgt).isNotNull())
            vec = forest.assemble(sub, fs.names, keep=keep + [tgt])
            model = forest.fit_forest(vec, tgt, trees=opts.trees, max_depth=opts.max_depth,
                                      max_bins=opts.max_bins, bootstrap=opts.bootstrap, key=keep or None)
            run.models[tgt] = model
            mets.append(stats.metrics(model.transform(vec), tgt, "prediction").withColumn("target", F.lit(tgt)))
            if keep:
                cvs.append(forest_cv(vec, tgt, keep, opts).withColumn("target", F.lit(tgt)))
            if opts.run_shap or opts.run_pdp:
                lt = forest.tree_tables(spark, model, len(fs.names))
                imp = None
                if opts.run_shap:
                    told = sub
                    if opts.shap_sample is not None:
                        if not keep:
                            raise ValueError("shap_sample needs a key to choose rows by")
                        told = explain.sample_rows(sub, keep, opts.shap_sample)
                    imp = explain.shap_importance(told, fs.names, lt).withColumn("target", F.lit(tgt))
                    imps.append(imp)
                    if keep:
                        phis.append(explain.shap_values(told, fs.names, lt, keep).withColumn("target", F.lit(tgt)))
                if opts.run_pdp:
                    grid = explain.pdp_grid(sub, fs.names)
                    pairs = None
                    if opts.significant_only and imp is not None:
                        # as the reference: curves and surfaces for the top SHAP features only
                        top = [r["feature_idx"] for r in rollup.top_k(
                            imp, opts.pdp_top_k, F.col("mean_abs_shap").desc()).select("feature_idx").collect()]
                        grid = grid.where(F.col("feature_idx").isin(top))
                        pairs = [(i, j) for a, i in enumerate(sorted(top)) for j in sorted(top)[a + 1:]]
                    pd1s.append(explain.tree_pdp_1d(grid, lt).withColumn("target", F.lit(tgt)))
                    if opts.pdp_pairs:
                        pd2s.append(explain.tree_pdp_2d(grid, lt, pairs).withColumn("target", F.lit(tgt)))
            if opts.run_permutation and keep:
                from pyspark.ml.feature import VectorAssembler

                va = VectorAssembler(inputCols=fs.names, outputCol="features")
                perm = explain.permutation_importance(sub, fs.names, tgt, keep,
                                                      lambda d, m=model: m.transform(va.transform(d)))
                perms.append(explain.permutation_summary(perm, t["features"]).withColumn("target", F.lit(tgt)))
        for name, parts in (("forest_metrics", mets), ("forest_cv", cvs), ("shap_importance", imps), ("shap_values", phis),
                            ("pdp_1d", pd1s), ("pdp_2d", pd2s), ("permutation", perms)):
            if parts:
                out = parts[0]
                for q in parts[1:]:
                    out = out.unionByName(q)
                t[name] = out
    return run


def forest_cv(vec: DataFrame, label: str, key, opts: Options) -> DataFrame:
    """E6 for the forest: contiguous folds in key order, one forest per fold
    trained on the other folds and scored on its own (``fold, r2``)."""
    folded = kfold(vec, list(key), k=opts.cv_folds).persist(StorageLevel.MEMORY_AND_DISK)
    scores = []
    for k in range(opts.cv_folds):
        m = forest.fit_forest(folded.where(F.col("fold") != k), label, trees=opts.trees, max_depth=opts.max_depth,
                              max_bins=opts.max_bins, bootstrap=opts.bootstrap, key=key)
        # scored at once, one row: only one fold's forest is held at a time
        scores.append((k, stats.metrics(forest.predictions(m, folded.where(F.col("fold") == k).select(label, "features")),
                                        label, "prediction").first()["r2"]))
    folded.unpersist()
    return vec.sparkSession.createDataFrame(scores, "fold int, r2 double").coalesce(1)


def summarize(spark: SparkSession, run: Run, alpha: float = 0.05) -> dict:
    """Parameter-level roll-ups (D9-D13, G9, H1-H7) over a run's tables."""
    t = run.tables
    params = rollup.params_table(spark, run.roles.parameters)
    out = {}
    out["regression_by_parameter"] = rollup.coef_by_parameter(t["coefficients"], params)
    if "interactions" in t:
        out["interactions_by_parameter"] = rollup.coef_by_parameter(
            t["interactions"], params, alpha=alpha, by=("target", "depth"))
        out["top_interaction_terms"] = rollup.top_significant_terms(t["interactions"], alpha=alpha)
    out["top_coefficients"] = rollup.top_abs_coef(t["coefficients"])
    methods = {"regression": out["regression_by_parameter"].select(
        "target", "parameter", F.col("sum_abs_coef").alias("value"))}
    if "shap_importance" in t:
        out["shap_by_parameter"] = rollup.shap_by_parameter(t["shap_importance"], t["features"], params)
        out["top_shap"] = rollup.top_k(t["shap_importance"], 20, F.col("mean_abs_shap").desc(), by=["target"])
        methods["shap"] = out["shap_by_parameter"].select("target", "parameter", F.col("importance").alias("value"))
    if "pdp_1d" in t:
        eff = explain.pdp_effect(t["pdp_1d"], by=("target", "feature"))
        out["pdp_effects"] = rollup.top_k(eff, 10, F.col("effect").desc(), by=["target"])
        out["pdp_by_parameter"] = rollup.pdp_effect_by_parameter(eff, t["features"], params)
        out["pdp_top_series"] = rollup.pdp_top_series(t["pdp_1d"], eff)
        methods["pdp"] = out["pdp_by_parameter"].select("target", "parameter", F.col("effect_mean").alias("value"))
    if "permutation" in t:
        out["permutation_by_parameter"] = rollup.restrict(
            t["permutation"].groupBy("target", "parameter").agg(F.sum("importance_mean").alias("importance")), params)
        methods["permutation"] = out["permutation_by_parameter"].select(
            "target", "parameter", F.col("importance").alias("value"))
    out["method_rank"] = rollup.compare_methods(spark, methods, params)
    cv = stats.score_summary(t["forest_cv"]) if "forest_cv" in t else None
    out["summary_facts"] = rollup.summary_facts(
        t["coefficients"], t["fit"], t.get("shap_importance"), t["skew"], alpha,
        reference_levels=run.features.reference_levels, metrics=t.get("forest_metrics"), cv=cv,
        terms=t.get("interactions"))
    return out


def write_run(tables: dict, base: str, run_id: str | None = None) -> str:
    """Every table appended under ``base/<name>`` partitioned by
    run (and target where present).  The run counts as a result once all of
    them are there: its record is written last."""
    run_id = run_id or results.new_run_id()
    for name, df in tables.items():
        part = ["target"] if "target" in df.columns else []
        results.write_result(df, base, name, run_id, part)
        spark = df.sparkSession
    if tables:
        results.commit_run(spark, base, run_id, list(tables))
    return run_id


def analyze_by(spark: SparkSession, df: DataFrame, by: str, roles: Roles, opts: Options | None = None) -> dict[str, DataFrame]:
    """One full analysis, forest included, for every value of ``by`` (a
    dataset column with few values), every table with that column in front.
    Groups are analysed one after another; each is a distributed run."""
    out: dict[str, DataFrame] = {}
    kind = df.schema[by].dataType
    values = [r[0] for r in df.select(by).where(F.col(by).isNotNull()).distinct().orderBy(by).collect()]
    for v in values:
        run = analyze(spark, df.where(F.col(by) == F.lit(v)), roles, opts)
        for name, table in {**run.tables, **summarize(spark, run)}.items():
            named = table.select(F.lit(v).cast(kind).alias(by), *[c for c in table.columns if c != by])
            out[name] = out[name].unionByName(named, allowMissingColumns=True) if name in out else named
    return out


def write_models(spark: SparkSession, models: dict, base: str, run_id: str) -> dict:
    """Every target's forest under ``base/models``; returns target -> path."""
    return {t: forest.save_model(spark, m, f"{base.rstrip('/')}/models/run_id={run_id}/target={t}")
            for t, m in models.items()}
