"""OLS / WLS with full coefficient inference (E1-E4), multi-target and
grouped fits (A15), and k-fold cross-validated R^2 for linear models (E6).

Plan: targets are stacked into ``(target, y, w)`` rows, one moment pass is
grouped by ``(by..., target)``, and every group is solved by a small task
(``mapInPandas`` over the moment rows) -- the driver never holds a matrix, so
``by`` may have millions of groups.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendlens.functions.linalg import solve_centred, fold_score, inference, solve_moments, solve_triangle, unpack
from trendlens.operators.gram import _as_specs, moments, not_missing, triangles
from trendlens.session import scratch_path

WLS_EPS = 1e-6


@dataclass
class LinearFit:
    coefficients: DataFrame
    fit: DataFrame
    moments: DataFrame
    terms: list[str]

    def unpersist(self) -> None:
        """Release the sums behind both tables."""
        self.moments.unpersist()


def wls_weight(df: DataFrame, target: str, use_wls: bool = True) -> tuple[Column, str]:
    """Weight 1/(std^2 + 1e-6) when ``<target>Std`` exists and WLS is on."""
    std_col = f"{target}Std"
    if use_wls and std_col in df.columns:
        s = F.col(std_col).cast("double")
        return F.lit(1.0) / (s * s + F.lit(WLS_EPS)), "WLS"
    return F.lit(1.0), "OLS"


def column_means(df: DataFrame, cols: Sequence[Column]) -> np.ndarray:
    """Mean of every column over its own non-missing rows (0 where there are
    none): moments are taken about these, so columns far from zero keep their
    precision.  One aggregate of one row."""
    if not cols:
        return np.zeros(0)
    row = df.agg(*[F.avg(F.when(not_missing(c), c.cast("double"))).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return np.array([x if x is not None and np.isfinite(x) else 0.0 for x in row], dtype=float)


def _weights(df: DataFrame, targets: Sequence[str], use_wls: bool, weights: dict | None) -> dict[str, tuple[Column, str]]:
    """Weight and method of every target."""
    return {t: (weights[t], "WLS") if weights and t in weights else wls_weight(df, t, use_wls) for t in targets}


def _usable(df: DataFrame, of: dict[str, tuple[Column, str]], by: Sequence[str]) -> dict[str, list[tuple[Column, str]]]:
    """The fits to try for every target, best last.  A weighted target without
    one usable weight is fitted by OLS; with groups, which of them lack
    weights is seen after the fact, so both are summed."""
    plain = (F.lit(1.0), "OLS")
    weighted = [t for t, (_, m) in of.items() if m == "WLS"]
    if not weighted:
        return {t: [of[t]] for t in of}
    if by:
        return {t: [plain, of[t]] if t in weighted else [of[t]] for t in of}
    ok = [F.count(F.when(not_missing(of[t][0]) & not_missing(F.col(t)) & (of[t][0] > 0), 1)) for t in weighted]
    n = dict(zip(weighted, df.agg(*ok).first()))
    return {t: [of[t] if t not in n or n[t] else plain] for t in of}


def stack_targets(df: DataFrame, targets: Sequence[str], keep: Sequence[Column], fits: dict,
                  means: dict | None = None) -> DataFrame:
    """One row a row, target and fit tried: ``target, method, y, w``."""
    items = []
    for t in targets:
        for w, method in fits[t]:
            items.append(F.struct(F.lit(t).alias("target"), F.lit(method).alias("method"),
                                  (F.col(t).cast("double") - F.lit(float((means or {}).get(t, 0.0)))).alias("y"),
                                  w.cast("double").alias("w")))
    s = df.select(*keep, F.explode(F.array(*items)).alias("_t"))
    return s.select(*[c for c in s.columns if c != "_t"], "_t.target", "_t.method", "_t.y", "_t.w")


def _key_fields(df: DataFrame, by: Sequence[str]):
    return [T.StructField(df.schema[c].name, df.schema[c].dataType, True) for c in by]


def regression(df: DataFrame, features: Sequence, targets: Sequence[str], *,
               use_wls: bool = True, weights: dict | None = None,
               by: Sequence[str] = (), alpha: float = 0.05,
               method: str = "auto", targets_complete: bool = False) -> LinearFit:
    """Fit y_t ~ 1 + features for every target t (and every ``by`` group).

    ``features``: column names or ``(name, Column)`` pairs (e.g. from
    ``FeatureSet.specs``).  Rows with a missing target or weight are skipped
    per target, rows with a missing feature are skipped.  A target (in a
    group) none of whose weights can be used is fitted by OLS, and its
    ``method`` says so.  ``method="qr"`` reduces rows to triangular factors
    instead of moments, for columns that nearly depend on each other.

    ``targets_complete=True`` (every row has every target, e.g. after
    dropping missing values) with no per-target weights uses ONE shared
    moment matrix over (1, x, y_1..y_t): no row is duplicated per target and
    each target's system is a sub-matrix of it.
    """
    specs = _as_specs(features)
    by = list(by)
    weighted = any(wls_weight(df, t, use_wls)[1] == "WLS" for t in targets) or bool(weights)
    if targets_complete and len(targets) > 1 and not weighted and method != "qr":
        return _shared_regression(df, specs, list(targets), by, alpha, method)
    fits = _usable(df, _weights(df, targets, use_wls, weights), by)
    group = by + ["target", "method"]
    terms = ["Intercept"] + [n for n, _ in specs]
    key_fields = _key_fields(df, by)
    if method == "qr":
        stacked = stack_targets(df, targets, [F.col(c) for c in by] + [
            c.cast("double").alias(f"_f{i}") for i, (_, c) in enumerate(specs)], fits)
        tri = triangles(stacked, [f"_f{i}" for i in range(len(specs))] + ["y"], weight=F.col("w"), by=group)
        tri = _preferred(tri, by, fits).persist()
        return LinearFit(_solve_table(tri, by, key_fields, terms, alpha, None),
                         _fit_table(tri, by, key_fields, alpha, None), tri, terms)
    shift, y_shift = _shifts(df, specs, targets)
    feat_cols = [(c.cast("double") - F.lit(float(m))).alias(f"_f{i}") for i, ((_, c), m) in enumerate(zip(specs, shift))]
    stacked = stack_targets(df, targets, [F.col(c) for c in by] + feat_cols, fits, y_shift)
    cols = [(f"_f{i}", F.col(f"_f{i}")) for i in range(len(specs))] + [("y", F.col("y"))]
    # tiny (one row per group): cached so coefficient and fit tables share one scan
    mom = _preferred(moments(stacked, {"linear": cols}, weight=F.col("w"), by=group, method=method), by, fits).persist()
    shifts = {t: np.append(shift, y_shift[t]) for t in targets}
    coef = _solve_table(mom, by, key_fields, terms, alpha, shifts)
    fit = _fit_table(mom, by, key_fields, alpha, shifts)
    return LinearFit(coef, fit, mom, terms)


def _preferred(sums: DataFrame, by: Sequence[str], fits: dict) -> DataFrame:
    """Of several fits of a group and target the weighted one, if it has rows."""
    if all(len(f) == 1 for f in fits.values()):
        return sums
    rest = [c for c in sums.columns if c not in (*by, "target")]
    best = sums.groupBy(*by, "target").agg(F.max_by(F.struct(*rest), F.col("method")).alias("_s"))
    return best.select(*by, "target", *[F.col(f"_s.{c}") for c in rest])


def _shifts(df: DataFrame, specs, targets: Sequence[str]) -> tuple[np.ndarray, dict[str, float]]:
    means = column_means(df, [c for _, c in specs] + [F.col(t) for t in targets])
    return means[:len(specs)], {t: float(m) for t, m in zip(targets, means[len(specs):])}


def _shared_regression(df, specs, targets, by, alpha, method) -> LinearFit:
    p = len(specs)
    shift, y_shift = _shifts(df, specs, targets)
    shifts = {t: np.append(shift, y_shift[t]) for t in targets}
    cols = ([(f"_f{i}", c.cast("double") - F.lit(float(m))) for i, ((_, c), m) in enumerate(zip(specs, shift))]
            + [(f"_y{j}", F.col(t).cast("double") - F.lit(y_shift[t])) for j, t in enumerate(targets)])
    shared = moments(df, {"shared": cols}, by=by, method=method)
    key_fields = _key_fields(df, by)
    schema = T.StructType(key_fields + [T.StructField("target", T.StringType()),
                                        T.StructField("method", T.StringType()),
                                        T.StructField("_block", T.StringType()),
                                        T.StructField("_k", T.IntegerType()),
                                        T.StructField("_g", T.ArrayType(T.DoubleType()))])
    from trendlens.functions.linalg import pack

    def split(it):
        for pdf in it:
            out = []
            for r in pdf.to_dict("records"):
                g = np.asarray(r["_g"], dtype=float)
                k = int(r["_k"])
                m = unpack(g[:-1], k)
                for j, t in enumerate(targets):
                    idx = list(range(p + 1)) + [p + 1 + j]
                    sub = m[np.ix_(idx, idx)]
                    out.append([r[c] for c in by] + [t, "OLS", "linear", p + 2,
                                                     np.append(pack(sub), g[-1]).tolist()])
            yield pd.DataFrame(out, columns=[f.name for f in schema.fields])

    mom = shared.mapInPandas(split, schema).persist()
    terms = ["Intercept"] + [n for n, _ in specs]
    return LinearFit(_solve_table(mom, by, key_fields, terms, alpha, shifts),
                     _fit_table(mom, by, key_fields, alpha, shifts), mom, terms)


_COEF_FIELDS = [T.StructField("target", T.StringType()), T.StructField("term", T.StringType()),
                T.StructField("term_idx", T.IntegerType()),
                T.StructField("coef", T.DoubleType()), T.StructField("std_err", T.DoubleType()),
                T.StructField("t", T.DoubleType()), T.StructField("p", T.DoubleType()),
                T.StructField("ci_lo", T.DoubleType()), T.StructField("ci_hi", T.DoubleType())]

_FIT_FIELDS = [T.StructField("target", T.StringType()), T.StructField("method", T.StringType()),
               T.StructField("n", T.LongType()), T.StructField("rank", T.IntegerType()),
               T.StructField("df_resid", T.DoubleType()), T.StructField("r2", T.DoubleType()),
               T.StructField("rss", T.DoubleType()), T.StructField("sigma2", T.DoubleType())]


def _solved(r: dict, alpha: float, shifts: dict | None) -> dict:
    """Solution of one row of moments, or of one triangle (no shifts)."""
    if shifts is None:
        tri = np.asarray(r["_r"], dtype=float)
        k = int(round(len(tri) ** 0.5))
        return solve_triangle(tri.reshape(k, k), float(r["_n"]), alpha=alpha)
    g = np.asarray(r["_g"], dtype=float)
    return solve_moments(g[:-1], int(r["_k"]), float(g[-1]), alpha=alpha, shift=shifts[r["target"]])


def _solve_table(mom: DataFrame, by, key_fields, terms, alpha, shifts) -> DataFrame:
    schema = T.StructType(key_fields + _COEF_FIELDS)
    names = [f.name for f in schema.fields]

    def solve(it):
        for pdf in it:
            out = []
            for r in pdf.to_dict("records"):
                s = _solved(r, alpha, shifts)
                for i, term in enumerate(terms):
                    out.append([r[c] for c in by] + [
                        r["target"], term, i, s["coef"][i], s["std_err"][i], s["t"][i],
                        s["p"][i], s["ci_lo"][i], s["ci_hi"][i]])
            yield pd.DataFrame(out, columns=names)

    return mom.mapInPandas(solve, schema)


def _fit_table(mom: DataFrame, by, key_fields, alpha, shifts) -> DataFrame:
    schema = T.StructType(key_fields + _FIT_FIELDS)
    names = [f.name for f in schema.fields]

    def solve(it):
        for pdf in it:
            out = []
            for r in pdf.to_dict("records"):
                s = _solved(r, alpha, shifts)
                out.append([r[c] for c in by] + [
                    r["target"], r["method"], int(s["n"]), s["rank"], float(s["df_resid"]),
                    s["r2"], s["rss"], s["sigma2"]])
            yield pd.DataFrame(out, columns=names)

    return mom.mapInPandas(solve, schema)


def cv_r2(df: DataFrame, features: Sequence, targets: Sequence[str], fold_col: str = "fold",
          *, use_wls: bool = False) -> DataFrame:
    """k-fold CV R^2 of a linear model from ONE pass.

    Moments are grouped by fold; the training moments of fold k are the total
    minus fold k, and the held-out SSE/SST come from fold k's own moments.
    Output: ``target, fold, r2``.
    """
    specs = _as_specs(features)
    shift, y_shift = _shifts(df, specs, targets)
    shifts = {t: np.append(shift, y_shift[t]) for t in targets}
    feat_cols = [(c.cast("double") - F.lit(float(m))).alias(f"_f{i}") for i, ((_, c), m) in enumerate(zip(specs, shift))]
    fits = _usable(df, _weights(df, targets, use_wls, None), ())
    stacked = stack_targets(df, targets, [F.col(fold_col)] + feat_cols, fits, y_shift)
    cols = [(f"_f{i}", F.col(f"_f{i}")) for i in range(len(specs))] + [("y", F.col("y"))]
    mom = moments(stacked, {"linear": cols}, weight=F.col("w"), by=["target", fold_col])
    # all folds of a target meet in one task: one row per fold, bounded by k
    schema = T.StructType([T.StructField("target", T.StringType()),
                           T.StructField("fold", T.IntegerType()),
                           T.StructField("r2", T.DoubleType())])

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        gs = {int(f): np.asarray(g, dtype=float) for f, g in zip(pdf[fold_col], pdf["_g"])}
        k = int(pdf["_k"].iloc[0])
        total = sum(gs.values())
        out = []
        for f in sorted(gs):
            train = total - gs[f]
            about = shifts[pdf["target"].iloc[0]]
            s = solve_moments(train[:-1], k, float(train[-1]), shift=about)
            sse, sst, _ = fold_score(s["coef"], gs[f][:-1], k, about)
            out.append([pdf["target"].iloc[0], f, 1.0 - sse / sst if sst > 0 else float("nan")])
        return pd.DataFrame(out, columns=["target", "fold", "r2"])

    return mom.groupBy("target").applyInPandas(score, schema)


def predict(df: DataFrame, coefficients: DataFrame, features: Sequence, target: str,
            out: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """Score rows with a fitted coefficient table.

    Ungrouped fit: the coefficient vector is a bounded object (p + 1
    numbers), read once and inlined as literals, so scoring stays a codegen
    expression.  Grouped fit (``by``): the table is pivoted to one row per
    group and joined on the group keys (AQE broadcasts it when its measured
    size is small), so any number of groups scales.
    """
    specs = _as_specs(features)
    coefs = coefficients.where(F.col("target") == target)
    if by:
        wide = coefs.groupBy(*by).agg(*[
            F.max(F.when(F.col("term_idx") == i, F.col("coef"))).alias(f"_b{i}") for i in range(len(specs) + 1)])
        expr = F.coalesce(F.col("_b0"), F.lit(0.0))
        for i, (_, c) in enumerate(specs, start=1):
            expr = expr + F.coalesce(F.col(f"_b{i}"), F.lit(0.0)) * c.cast("double")
        return df.join(wide, list(by), "left").withColumn(out, expr).drop(*[f"_b{i}" for i in range(len(specs) + 1)])
    extra = set(coefs.columns) - {f.name for f in _COEF_FIELDS}
    if extra:
        raise ValueError(f"coefficients are grouped by {sorted(extra)}; pass by=")
    rows = coefs.select("term_idx", "coef").collect()  # p + 1 rows
    beta = {int(r["term_idx"]): float(r["coef"]) for r in rows}
    expr = F.lit(beta.get(0, 0.0))
    for i, (_, c) in enumerate(specs, start=1):
        expr = expr + F.lit(beta.get(i, 0.0)) * c.cast("double")
    return df.withColumn(out, expr)


# ------------------------------------------------- a categorical of any width

def absorbed_regression(df: DataFrame, level_col: str, features: Sequence, target: str, *,
                        reference: str | None = None, alpha: float = 0.05) -> LinearFit:
    """Least squares with one column a level of ``level_col`` (the reference,
    by default the first in order, dropped), however many levels there are.

    The level columns of the normal equations are diagonal, so they are
    eliminated: what is left is a small system about the levels' means, solved
    in one task, and every level's coefficient follows from its own means, in
    tasks.  Levels stay a table.  The coefficient table has ``cat__<column>_<level>``
    for the levels and is that of the regression on all their columns;
    ``term_idx`` is null for levels.  Rows with a missing value take no part.
    """
    specs = _as_specs(features)
    p = len(specs)
    z = [c.cast("double") for _, c in specs] + [F.col(target).cast("double")]
    shift = column_means(df, z)
    names = [f"_z{i}" for i in range(p + 1)]
    rows = df.select(F.col(level_col).cast("string").alias("_level"),
                     *[(c - F.lit(float(m))).alias(n) for c, m, n in zip(z, shift, names)])
    for c in names:
        rows = rows.where(not_missing(F.col(c)))
    rows = rows.where(F.col("_level").isNotNull())
    by_level = rows.groupBy("_level").agg(F.count(F.lit(1)).cast("double").alias("n"),
                                          *[F.avg(c).alias(c) for c in names])
    path = scratch_path(df.sparkSession, "levels")
    by_level.write.parquet(path)
    table = df.sparkSession.read.schema(by_level.schema).parquet(path)
    # between the levels: moments of their means, weighted by their rows
    total = moments(rows, {"total": names}).select("_k", F.col("_g").alias("total"))
    between = moments(table, {"between": names}, weight=F.col("n")).select(F.col("_g").alias("between"))
    ref = table.orderBy("_level").limit(1) if reference is None else table.where(F.col("_level") == reference)
    sums = total.crossJoin(F.broadcast(between)).crossJoin(
        F.broadcast(ref.select(*[F.col(c).alias(f"_r{c}") for c in ["n", *names]]))).crossJoin(
        F.broadcast(table.agg(F.count(F.lit(1)).alias("levels"))))
    mom = sums.persist()
    terms = ["Intercept"] + [n for n, _ in specs]
    within = T.StructType([T.StructField("slopes", T.ArrayType(T.DoubleType())), T.StructField("inv", T.ArrayType(T.DoubleType())),
                           T.StructField("n", T.LongType()), T.StructField("rank", T.IntegerType()),
                           T.StructField("rss", T.DoubleType()), T.StructField("tss", T.DoubleType()),
                           *[T.StructField(f"_r{c}", T.DoubleType()) for c in ["n", *names]]])

    def solve(frames):
        for pdf in frames:
            for r in pdf.to_dict("records"):
                g = unpack(np.asarray(r["total"], float)[:-1], int(r["_k"]))
                c = g - unpack(np.asarray(r["between"], float)[:-1], int(r["_k"]))
                a, b, rest = c[1:-1, 1:-1], c[1:-1, -1], c[-1, -1]
                inv, null = solve_centred(a, np.diag(g)[1:-1])
                slopes = inv @ b
                y = g[-1, -1] - g[0, -1] ** 2 / g[0, 0]
                yield pd.DataFrame([[slopes, inv.ravel(), int(g[0, 0]), int(r["levels"]) + p - null.shape[1],
                                     max(rest - slopes @ b, 0.0), y, *[r[f"_r{c}"] for c in ["n", *names]]]],
                                   columns=within.names)

    small = mom.mapInPandas(solve, within)
    schema = T.StructType(_COEF_FIELDS)
    fit_schema = T.StructType(_FIT_FIELDS)

    def level_rows(frames):
        for pdf in frames:
            if pdf.empty:
                continue
            s = pdf.iloc[0]
            slopes, n_ref = np.asarray(s["slopes"], float), s["_rn"]
            inv = np.asarray(s["inv"], float).reshape(p, p)
            x = pdf[names[:-1]].to_numpy(float).reshape(len(pdf), p)
            ref_x = np.array([s[f"_r{c}"] for c in names[:-1]], float)
            own = pdf["_level"].notna().to_numpy()
            away = np.where(own[:, None], x - ref_x, 0.0)
            effect = (pdf[names[-1]].to_numpy(float) - s[f"_r{names[-1]}"]) - away @ slopes
            var = 1 / pdf["n_level"].to_numpy(float) + 1 / n_ref + np.einsum("ij,jk,ik->i", away, inv, away)
            ref = (own & (pdf["_level"] == pdf["_ref"])).to_numpy()
            out = inference(effect[~ref], var[~ref], float(s["n"]), int(s["rank"]), s["rss"], s["tss"], alpha)
            yield pd.DataFrame({"target": target, "term": f"cat__{level_col}_" + pdf["_level"][~ref], "term_idx": None,
                                **{c: out[c] for c in ("coef", "std_err", "t", "p", "ci_lo", "ci_hi")}},
                               columns=schema.names)

    def slope_rows(frames):
        for pdf in frames:
            for s in pdf.to_dict("records"):
                slopes, inv = np.asarray(s["slopes"], float), np.asarray(s["inv"], float).reshape(p, p)
                raw = np.array([s[f"_r{c}"] for c in names[:-1]], float) + shift[:-1]
                start = s[f"_r{names[-1]}"] + shift[-1] - slopes @ raw
                var = np.append(1 / s["_rn"] + raw @ inv @ raw, np.diag(inv))
                out = inference(np.append(start, slopes), var, float(s["n"]), int(s["rank"]), s["rss"], s["tss"], alpha)
                yield pd.DataFrame({"target": target, "term": terms, "term_idx": range(p + 1),
                                    **{c: out[c] for c in ("coef", "std_err", "t", "p", "ci_lo", "ci_hi")}},
                                   columns=schema.names)

    def fit_rows(frames):
        for pdf in frames:
            for s in pdf.to_dict("records"):
                free = float(s["n"] - s["rank"])
                yield pd.DataFrame([[target, "OLS", s["n"], s["rank"], free, 1 - s["rss"] / s["tss"] if s["tss"] > 0 else np.nan,
                                     s["rss"], s["rss"] / free if free > 0 else np.nan]], columns=fit_schema.names)

    first = table.agg(F.min("_level").alias("_ref")) if reference is None else table.agg(F.lit(reference).alias("_ref"))
    every = table.withColumnRenamed("n", "n_level").crossJoin(F.broadcast(small)).crossJoin(F.broadcast(first))
    coef = small.mapInPandas(slope_rows, schema).unionByName(every.mapInPandas(level_rows, schema))
    return LinearFit(coef, small.mapInPandas(fit_rows, fit_schema), mom, terms)
