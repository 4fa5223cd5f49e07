"""Column statistics (D1-D3, D8, D14): skewness check, Yeo-Johnson,
pairwise correlation, regression metrics, score summaries.

Every statistic is one aggregate over all requested columns (one scan), with
results stacked to long form by ``explode`` over a tiny one-row result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

SKEW_THRESHOLD = 1.0


def _clean(c: str) -> Column:
    """Double value with NaN turned into NULL (so aggregates skip it)."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def _stack(agg: DataFrame, items: list[Column], by: Sequence[str] = ()) -> DataFrame:
    return agg.select(*by, F.explode(F.array(*items)).alias("s")).select(*by, "s.*")


def skew_check(df: DataFrame, cols: Sequence[str], threshold: float = SKEW_THRESHOLD, by: Sequence[str] = ()) -> DataFrame:
    """Population skewness g1 per column (NULL/NaN ignored) and group,
    flagged when |g1| > threshold; ``ord`` keeps the input column order."""
    agg = df.groupBy(*by).agg(*[F.skewness(_clean(c)).alias(f"_s{i}") for i, c in enumerate(cols)])
    items = [F.struct(F.lit(i).alias("ord"), F.lit(c).alias("column"), F.col(f"_s{i}").alias("skew"))
             for i, c in enumerate(cols)]
    out = _stack(agg, items, by)
    return out.withColumn("flagged", F.coalesce(F.abs("skew") > F.lit(threshold), F.lit(False)))


PAIRS_IN_SQL = 12   # more columns than this are correlated by matrix products


def correlation(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """D3: Pearson correlation of every ordered pair over jointly present
    rows (pairwise deletion), by group.  A constant column has no correlation
    (null).  Few columns are one aggregate; more, or groups, are matrix
    products of values and masks (``_masked_correlation``)."""
    cols = [c for c in cols if c in df.columns]
    if by or len(cols) > PAIRS_IN_SQL:
        return _masked_correlation(df, cols, list(by))
    aggs, items = [], []
    for i, a in enumerate(cols):
        for j in range(i, len(cols)):
            b = cols[j]
            xa = F.when(_clean(b).isNotNull(), _clean(a))
            xb = F.when(_clean(a).isNotNull(), _clean(b))
            r = F.try_divide(F.covar_pop(xa, xb), F.stddev_pop(xa) * F.stddev_pop(xb))
            aggs.append(r.alias(f"_r{i}_{j}"))
            items.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
                                  F.col(f"_r{i}_{j}").alias("r")))
            if i != j:
                items.append(F.struct(F.lit(b).alias("col_a"), F.lit(a).alias("col_b"),
                                      F.col(f"_r{i}_{j}").alias("r")))
    agg = df.agg(*aggs)
    # clamp rounding noise of the self-correlation
    return _stack(agg, items).withColumn(
        "r", F.when(F.col("col_a") == F.col("col_b"), F.when(F.col("r").isNotNull(), F.lit(1.0)))
              .otherwise(F.col("r")))


def _masked_correlation(df: DataFrame, cols: Sequence[str], by: list[str]) -> DataFrame:
    """Pairwise-complete correlations of many columns in one Arrow pass.

    With X the values about their means (missing: 0) and M the mask of present
    ones, M'M, X'M, (X*X)'M and X'X hold every pair's count and sums.  A task
    adds them up over its batches and emits one row a group and column; these
    are summed by (group, column), and a group's columns meet in one task: four
    numbers a pair.
    """
    from trendlens.operators.gram import FAN_IN, spread
    from trendlens.operators.linear import column_means

    p = len(cols)
    shift = column_means(df, [F.col(c) for c in cols])
    src = spread(df.select(*by, *[(F.col(c).cast("double") - F.lit(float(m))).alias(f"_x{i}")
                                  for i, (c, m) in enumerate(zip(cols, shift))]))
    keys = [df.schema[c] for c in by]
    part = T.StructType([*keys, T.StructField("_i", T.IntegerType()), T.StructField("_g", T.ArrayType(T.DoubleType()))])

    def sums(frames):
        acc: dict = {}
        for pdf in frames:
            x = pdf[[f"_x{i}" for i in range(p)]].to_numpy(float, na_value=np.nan)
            mask = (~np.isnan(x)).astype(float)
            x = np.where(mask > 0, x, 0.0)
            groups = pdf.groupby(by, sort=False, dropna=False).indices.items() if by else [((), slice(None))]
            for key, at in groups:
                key = key if isinstance(key, tuple) else (key,)
                v, m = x[at], mask[at]
                got = np.hstack([m.T @ m, v.T @ m, (v * v).T @ m, v.T @ v])
                acc[key] = acc[key] + got if key in acc else got
        rows = [[*key, i, g[i]] for key, g in acc.items() for i in range(p)]
        if rows:
            yield pd.DataFrame(rows, columns=part.names)

    parts = src.mapInPandas(sums, part).withColumn("_level", F.floor(F.spark_partition_id() / FAN_IN))
    for at in ([*by, "_i", "_level"], [*by, "_i"]):
        parts = parts.groupBy(*at).agg(Summarizer.sum(array_to_vector("_g")).alias("_v")).withColumn(
            "_g", vector_to_array("_v")).drop("_v")
    out = T.StructType([*keys, T.StructField("col_a", T.StringType()), T.StructField("col_b", T.StringType()),
                        T.StructField("r", T.DoubleType())])

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        g = np.array(pdf.sort_values("_i")["_g"].tolist()).reshape(p, 4, p)
        n, s, ss, xy = g[:, 0], g[:, 1], g[:, 2], g[:, 3]
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = s / n
            var = ss / n - mean * mean
            var = np.where(var > 1e-14 * (ss / n), var, 0.0)
            r = (xy / n - mean * mean.T) / np.sqrt(var * var.T)
        known = np.isfinite(r)
        r = np.where(known, np.clip(r, -1.0, 1.0), np.nan)
        np.fill_diagonal(r, np.where(np.diag(known), 1.0, np.nan))
        a, b = np.meshgrid(np.arange(p), np.arange(p), indexing="ij")
        frame = pd.DataFrame({"col_a": np.array(cols)[a.ravel()], "col_b": np.array(cols)[b.ravel()], "r": r.ravel()})
        for i, c in enumerate(by):
            frame.insert(i, c, [pdf[c].iloc[0]] * len(frame))
        return frame

    got = parts.groupBy(*by).applyInPandas(pairs, out)
    return got.withColumn("r", F.when(~F.isnan("r"), F.col("r")))


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], bins: int = 1024) -> dict:
    """Percentiles of every column, interpolated linearly between exact order
    statistics: ``{col: [value per prob]}`` (``None`` without finite values;
    null, NaN and infinite values are ignored).

    Order statistics are found by counting, not by sorting.  A pass counts
    ``bins`` bins between the bounds known to hold each wanted rank and
    narrows the bounds to the least and greatest value of the bin that has it,
    until both are one value.  A pass is one scan with map-side counts; one
    row a wanted rank comes back.
    """
    x = [F.when(F.abs(_clean(c)) < float("inf"), _clean(c)) for c in cols]
    head = df.agg(*[e for i, c in enumerate(x) for e in (
        F.count(c).alias(f"_n{i}"), F.min(c).alias(f"_a{i}"), F.max(c).alias(f"_b{i}"))]).first()
    need = {(i, p): (head[f"_n{i}"] - 1) * p for i in range(len(x)) if head[f"_n{i}"] for p in probs}
    known, bounds = {}, {}  # (column, rank) -> value; (column, rank) -> (least, greatest, rows before)
    for (i, _), at in need.items():
        for rank in (math.floor(at), math.ceil(at)):
            bounds[i, rank] = (head[f"_a{i}"], head[f"_b{i}"], 0)
    while True:
        known |= {k: lo for k, (lo, hi, _) in bounds.items() if lo == hi}
        bounds = {k: b for k, b in bounds.items() if k not in known}
        if not bounds:
            break
        ids = list(bounds)
        items = []
        for t, (i, rank) in enumerate(ids):
            lo, hi, _ = bounds[i, rank]
            # halves: the width of the range must not overflow
            part = (x[i] / 2 - F.lit(lo / 2)) / F.lit(hi / 2 - lo / 2) * bins
            items.append(F.when(x[i].between(lo, hi), F.struct(
                F.lit(t).alias("t"), F.least(F.floor(part).cast("int"), F.lit(bins - 1)).alias("bin"), x[i].alias("x"))))
        counts = (df.select(F.explode(F.array_compact(F.array(*items))).alias("s")).groupBy("s.t", "s.bin")
                  .agg(F.count(F.lit(1)).alias("n"), F.min("s.x").alias("lo"), F.max("s.x").alias("hi")))
        sums = F.sum("n").over(W.partitionBy("t").orderBy("bin"))
        wanted = F.element_at(F.array(*[F.lit(k[1] - bounds[k][2]).cast("long") for k in ids]), F.col("t") + 1)
        rows = (counts.withColumn("upto", sums)
                .where((F.col("upto") > wanted) & (F.col("upto") - F.col("n") <= wanted)).collect())
        bounds = {ids[r["t"]]: (r["lo"], r["hi"], bounds[ids[r["t"]]][2] + r["upto"] - r["n"]) for r in rows}

    def value(i, p):
        if (i, p) not in need:
            return None
        at = need[i, p]
        lo, hi = known[i, math.floor(at)], known[i, math.ceil(at)]
        return lo + (hi - lo) * (at - math.floor(at))

    return {c: [value(i, p) for p in probs] for i, c in enumerate(cols)}


def metrics(df: DataFrame, y: str, yhat: str, by: Sequence[str] = ()) -> DataFrame:
    """R^2, MAE, RMSE (grouped by ``by``) in one aggregate."""
    e = F.col(y).cast("double") - F.col(yhat).cast("double")
    agg = df.groupBy(*by).agg(
        F.sum(e * e).alias("_sse"), F.avg(F.abs(e)).alias("mae"),
        F.count(F.lit(1)).alias("n"), F.var_pop(F.col(y).cast("double")).alias("_vy"))
    return agg.select(*by, "n",
                      (F.lit(1.0) - F.try_divide(F.col("_sse"), F.col("_vy") * F.col("n"))).alias("r2"),
                      "mae", F.sqrt(F.col("_sse") / F.col("n")).alias("rmse"))


def score_summary(scores: DataFrame, value: str = "r2", by: Sequence[str] = ("target",)) -> DataFrame:
    """Mean and population std of fold scores."""
    return scores.groupBy(*by).agg(F.avg(value).alias("cv_mean"), F.stddev_pop(value).alias("cv_std"),
                                   F.count(F.lit(1)).alias("folds"))


# ---------------------------------------------------------------- Yeo-Johnson

def yj_expr(x: Column, lam: float) -> Column:
    """Yeo-Johnson transform of ``x`` for a fixed lambda (pure expression)."""
    pos = x >= 0
    if abs(lam) < 1e-12:
        a = F.log1p(x)
    else:
        a = (F.pow(x + 1.0, F.lit(lam)) - 1.0) / F.lit(lam)
    if abs(lam - 2.0) < 1e-12:
        b = -F.log1p(-x)
    else:
        b = -(F.pow(-x + 1.0, F.lit(2.0 - lam)) - 1.0) / F.lit(2.0 - lam)
    return F.when(pos, a).otherwise(b)


def yj_numpy(x, lam):
    """Yeo-Johnson of x (n, 1) for a grid of lambdas (1, G), vectorised."""
    import numpy as np

    pos = x >= 0
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        l0 = np.abs(lam) < 1e-12
        a = np.where(l0, np.log1p(np.where(pos, x, 0.0)),
                     (np.power(np.where(pos, x, 0.0) + 1.0, lam) - 1.0) / np.where(l0, 1.0, lam))
        l2 = np.abs(lam - 2.0) < 1e-12
        xn = np.where(pos, 0.0, -x)
        b = np.where(l2, -np.log1p(xn), -(np.power(xn + 1.0, 2.0 - lam) - 1.0) / np.where(l2, 1.0, 2.0 - lam))
    return np.where(pos, a, b)


def _yj_pass(df: DataFrame, cols: Sequence[str], grids: dict, centre: dict) -> dict:
    """One scan: for every column and every grid lambda, the sums of the
    transform and of its square, both less the transform of ``centre`` (Arrow
    batches, numpy), merged across tasks with the moment-merge aggregate.  Returns the best (llf, lambda, mean,
    std) per column."""
    import numpy as np
    import pandas as pd

    from trendlens.operators.gram import spread, merge_partials

    cols = list(cols)
    src = spread(df.select(*[_clean(c).alias(f"_y{i}") for i, c in enumerate(cols)]))
    lam_of = {c: np.asarray(grids[c], dtype=float) for c in cols}
    shift = {c: yj_numpy(np.array([[centre[c] or 0.0]]), lam_of[c][None, :]) for c in cols}
    schema = "_block string, _g array<double>"

    def partial(it):
        acc = {}
        for pdf in it:
            for i, c in enumerate(cols):
                x = pdf[f"_y{i}"].to_numpy(dtype=float, na_value=np.nan)
                x = x[~np.isnan(x)]
                if x.size == 0:
                    continue
                with np.errstate(over="ignore", invalid="ignore"):  # such a lambda is passed over
                    psi = yj_numpy(x[:, None], lam_of[c][None, :]) - shift[c]
                    vec = np.concatenate([psi.sum(axis=0), (psi * psi).sum(axis=0),
                                          [float(x.size), float((np.sign(x) * np.log1p(np.abs(x))).sum())]])
                acc[c] = acc[c] + vec if c in acc else vec
        if acc:
            yield pd.DataFrame({"_block": list(acc), "_g": [v.tolist() for v in acc.values()]})

    merged = merge_partials(src.mapInPandas(partial, schema), [], {c: len(lam_of[c]) for c in cols})
    rows = {r["_block"]: np.asarray(r["_g"], dtype=float) for r in merged.collect()}  # one row per column
    best = {}
    for c in cols:
        g = rows.get(c)
        lams = lam_of[c]
        cand = (float("nan"), 1.0, None, None)
        if g is not None:
            G = len(lams)
            sa, sb, n, sl = g[:G], g[G:2 * G], g[2 * G], g[2 * G + 1]
            for lam, a, b, s in zip(lams, sa, sb, shift[c][0]):
                var = b / n - (a / n) ** 2
                if not (var > 0) or math.isinf(var) or math.isnan(var):
                    continue
                llf = -n / 2.0 * math.log(var) + (lam - 1.0) * sl
                if math.isnan(cand[0]) or llf > cand[0]:
                    cand = (llf, float(lam), a / n + float(s), math.sqrt(var))
        best[c] = cand
    return best


def fit_yeo_johnson(df: DataFrame, cols: Sequence[str], lo: float = -3.0, hi: float = 5.0,
                    points: int = 401, passes: int = 3) -> dict:
    """Maximum-likelihood lambda per column by a zooming grid search.

    Each pass is ONE scan evaluating every grid lambda of every column
    (sums of the transform and its square give the profile likelihood);
    three passes of 401 points reach a lambda resolution of ~5e-7.  Where the
    likelihood still grows when the transform leaves the range of doubles, the
    last lambda inside it is returned.
    Returns ``{col: (lambda, mean, std)}`` of the transformed column.
    """
    grids = {c: [lo + (hi - lo) * k / (points - 1) for k in range(points)] for c in cols}
    step = (hi - lo) / (points - 1)
    means = df.agg(*[F.avg(_clean(c)).alias(f"_m{i}") for i, c in enumerate(cols)]).first()
    centre = {c: means[f"_m{i}"] for i, c in enumerate(cols)}
    # an optimum on the edge of the window moves the window outward, as long as the likelihood grows
    likelihood = {c: -math.inf for c in cols}
    while True:
        best = _yj_pass(df, cols, grids, centre)
        moved = False
        for c in cols:
            lam, g = best[c][1], grids[c]
            grew = best[c][0] > likelihood[c]
            likelihood[c] = best[c][0]
            if grew and (lam <= g[0] + 1e-12 or lam >= g[-1] - 1e-12):
                width = g[-1] - g[0]
                start = g[0] - width + step if lam <= g[0] + 1e-12 else g[-1] - step
                grids[c] = [start + width * k / (points - 1) for k in range(points)]
                moved = True
        if not moved:
            break
    best = {}
    for _ in range(passes):
        best = _yj_pass(df, cols, grids, centre)
        grids = {}
        for c in cols:
            lam = best[c][1]
            grids[c] = [lam - step + 2 * step * k / (points - 1) for k in range(points)]
        step = 2 * step / (points - 1)
    return {c: (best[c][1], best[c][2], best[c][3]) for c in cols}


def yeo_johnson(df: DataFrame, cols: Sequence[str], lambdas: dict | None = None,
                threshold: float | None = None, suffix: str = "_transformed"):
    """Add ``<col>_transformed`` = standardised Yeo-Johnson transform.

    With ``threshold`` only columns whose |skew| exceeds it are transformed.
    ``lambdas`` fixes lambda per column (no search).  Returns
    ``(df_out, params)`` where params is ``{col: (lambda, mean, std)}``.
    """
    cols = list(cols)
    if threshold is not None:
        sk = skew_check(df, cols, threshold).where("flagged").select("column").collect()
        flagged = {r["column"] for r in sk}
        cols = [c for c in cols if c in flagged]
    if not cols:
        return df, {}
    if lambdas is None:
        params = fit_yeo_johnson(df, cols)
    else:
        aggs = []
        for i, c in enumerate(cols):
            t = yj_expr(_clean(c), lambdas[c])
            aggs += [F.avg(t).alias(f"_m{i}"), F.stddev_pop(t).alias(f"_s{i}")]
        row = df.agg(*aggs).first()
        params = {c: (lambdas[c], row[f"_m{i}"], row[f"_s{i}"]) for i, c in enumerate(cols)}
    out = df
    for c, (lam, mean, sd) in params.items():
        scale = sd if sd and sd > 0 else 1.0
        out = out.withColumn(f"{c}{suffix}", (yj_expr(_clean(c), lam) - F.lit(mean)) / F.lit(scale))
    return out, params
