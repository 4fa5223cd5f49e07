"""PCA from the moment pass.

One scan builds the feature moment matrix; a single small task turns it
into covariance, eigen-decomposes it and emits the long result table.  No
rows and no matrix pass through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from trendlens.functions.linalg import unpack
from trendlens.operators.gram import _as_specs, moments

_SCHEMA = T.StructType([
    T.StructField("pc", T.IntegerType()), T.StructField("feature_idx", T.IntegerType()),
    T.StructField("feature", T.StringType()), T.StructField("loading", T.DoubleType()),
    T.StructField("variance", T.DoubleType()), T.StructField("ratio", T.DoubleType()),
    T.StructField("cumulative", T.DoubleType()),
    T.StructField("n_80", T.IntegerType()), T.StructField("n_95", T.IntegerType())])


@dataclass
class PCAResult:
    table: DataFrame
    by: tuple = ()

    @property
    def variance(self) -> DataFrame:
        """``pc, variance, ratio, cumulative``."""
        return self.table.where(F.col("feature_idx") == 0).select(*self.by, "pc", "variance", "ratio", "cumulative")

    @property
    def loadings(self) -> DataFrame:
        return self.table.select(*self.by, "pc", "feature", "loading")

    def components_for(self, thresholds: Sequence[float] = (0.8, 0.95)) -> DataFrame:
        """First component whose cumulative ratio reaches each threshold
        (the last component when none does)."""
        v = self.variance
        aggs = []
        for t in thresholds:
            aggs.append(F.coalesce(F.min(F.when(F.col("cumulative") >= F.lit(t) - 1e-12, F.col("pc"))),
                                   F.max("pc")).alias(f"n_{int(round(t * 100))}"))
        return v.groupBy(*self.by).agg(*aggs)  # one row per PCA: p rows in, bounded

    def top(self, k: int = 5, max_pcs: int = 15, threshold: float = 0.95) -> DataFrame:
        """Top-k features by |loading| for the first min(n_threshold,
        max_pcs) components; ``rank`` 1..k, ties by feature name."""
        ncol = "n_95" if abs(threshold - 0.95) < 1e-9 else "n_80"
        t = self.table.where(F.col("pc") <= F.least(F.col(ncol), F.lit(max_pcs)))
        w = W.partitionBy(*self.by, "pc").orderBy(F.abs("loading").desc(), F.col("feature").asc())
        return (t.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
                 .select(*self.by, "pc", "rank", "feature", "loading", "ratio"))


    def summary(self, k: int = 5, max_pcs: int = 15, threshold: float = 0.95) -> DataFrame:
        """D7 report: ``component, variance_explained, cumulative_variance,
        top_features`` ("name(|loading|)" joined in rank order), for the
        first min(n_threshold, max_pcs) components."""
        top = self.top(k, max_pcs, threshold)
        item = F.struct(F.col("rank"), F.format_string("%s(%.3f)", F.col("feature"), F.abs("loading")).alias("s"))
        lists = top.groupBy(*self.by, "pc").agg(F.array_sort(F.collect_list(item)).alias("_l"))  # <= k per pc
        return (lists.join(self.variance, [*self.by, "pc"])
                .select(*self.by, "pc", F.concat(F.lit("PC"), F.col("pc").cast("string")).alias("component"),
                        F.format_string("%.3f", F.col("ratio")).alias("variance_explained"),
                        F.format_string("%.3f", F.col("cumulative")).alias("cumulative_variance"),
                        F.array_join(F.transform("_l", lambda x: x["s"]), ", ").alias("top_features")))


def pca(df: DataFrame, features: Sequence, by: Sequence[str] = ()) -> PCAResult:
    """Principal components of every group of ``by`` (one without), each solved
    from its own moments in a task."""
    specs, by = _as_specs(features), tuple(by)
    names = [n for n, _ in specs]
    mom = moments(df, {"pca": specs}, by=by)
    schema = T.StructType([df.schema[c] for c in by] + _SCHEMA.fields)

    def eig(it):
        for pdf in it:
            keys = zip(*[pdf[c] for c in by]) if by else [()] * len(pdf)
            for key, g, k in zip(keys, pdf["_g"], pdf["_k"]):
                g = np.asarray(g, dtype=float)
                k = int(k)
                n = g[-1]
                m = unpack(g[:-1], k)
                mean = m[0, 1:] / n
                cov = (m[1:, 1:] - n * np.outer(mean, mean)) / max(n - 1.0, 1.0)
                w, v = np.linalg.eigh(cov)
                order = np.argsort(w)[::-1]
                w = np.clip(w[order], 0.0, None)
                v = v[:, order]
                ncomp = int(min(n, k - 1))
                total = w.sum()
                rows = []
                cum = 0.0
                ratios = w[:ncomp] / total if total > 0 else np.full(ncomp, np.nan)
                cums = np.cumsum(ratios)

                def first_reaching(t):
                    hit = np.nonzero(cums >= t - 1e-12)[0]
                    return int(hit[0] + 1) if hit.size else ncomp

                n80, n95 = first_reaching(0.8), first_reaching(0.95)
                for c in range(ncomp):
                    vec = v[:, c]
                    if vec[np.argmax(np.abs(vec))] < 0:
                        vec = -vec
                    ratio = w[c] / total if total > 0 else float("nan")
                    cum += ratio
                    for fi, fname in enumerate(names):
                        rows.append([*key, c + 1, fi, fname, float(vec[fi]), float(w[c]), float(ratio), float(cum),
                                     n80, n95])
                yield pd.DataFrame(rows, columns=schema.names)

    return PCAResult(mom.mapInPandas(eig, schema), by)
