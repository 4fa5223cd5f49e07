"""Feature building (B7-B10): one-hot with the reference level dropped,
population-std standardisation, and a features table that keeps lineage
(feature -> original input column) instead of re-parsing names.

Feature columns are plain Spark expressions (``(c = level)`` as double,
``(x - mean) / scale``), so every downstream pass stays inside codegen; a
``VectorAssembler`` is applied only where an ML estimator needs a vector.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Feature:
    name: str
    parameter: str
    kind: str  # "categorical" | "numeric"
    level: str | None
    expr: Column
    mean: float | None = None
    scale: float | None = None


@dataclass
class FeatureSet:
    features: list[Feature]
    reference_levels: dict = field(default_factory=dict)
    levels: dict = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.features]

    @property
    def specs(self) -> list[tuple[str, Column]]:
        return [(f.name, f.expr) for f in self.features]

    def transform(self, df: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
        cols = [F.col(c) for c in keep] if keep is not None else [F.col(c) for c in df.columns]
        return df.select(*cols, *[f.expr.alias(f.name) for f in self.features])

    def vector(self, df: DataFrame, keep: Sequence[str] = (), out: str = "features") -> DataFrame:
        """``keep...`` and one sparse vector a row, in the order of ``features``.  Levels are
        looked up, so the cost of a row does not grow with their number; the reference
        level, an unseen one and null have no entry."""
        from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler

        labels: dict[str, list[str]] = {}
        nums = []
        for f in self.features:
            if f.kind == "categorical":
                labels.setdefault(f.parameter, []).append(f.level)
            else:
                nums.append(f.expr.alias(f"_x{len(nums)}"))
        cats = [f"_c{i}" for i in range(len(labels))]
        parts = [f"_x{i}" for i in range(len(nums))]
        got = df.select(*keep, *[F.col(c).cast("string").alias(a) for c, a in zip(labels, cats)], *nums)
        if cats:
            for c, known in zip(cats, labels.values()):
                got = StringIndexerModel.from_labels(known, c, f"_i{c}", handleInvalid="keep").transform(got)
            hot = [f"_h{c}" for c in cats]
            got = OneHotEncoder(inputCols=[f"_i{c}" for c in cats], outputCols=hot, dropLast=True).fit(got).transform(got)
            parts = hot + parts
        return VectorAssembler(inputCols=parts, outputCol=out, handleInvalid="keep").transform(got).select(*keep, out)

    def table(self, spark: SparkSession) -> DataFrame:
        """``idx, feature, parameter, level, kind`` (bounded: one row per feature)."""
        rows = [(i, f.name, f.parameter, f.level, f.kind) for i, f in enumerate(self.features)]
        return spark.createDataFrame(rows, "idx int, feature string, parameter string, level string, kind string")


def fit_features(df: DataFrame, categoricals: Sequence[str], numerics: Sequence[str],
                 reference_levels: dict | None = None, scale: bool = True,
                 levels: dict | None = None) -> FeatureSet:
    """Fit the encoder/scaler (one aggregate for all statistics).

    Categoricals are expected as strings (``stringify``/``lump_levels``).
    Levels are sorted; the reference level (default: first sorted, as a
    drop-first one-hot does) gets no column.  Numerics are centred and
    divided by the population std (zero std -> 1).
    """
    reference_levels = dict(reference_levels or {})
    if levels is not None:  # already known (e.g. from the lumping fit): numerics only
        _, num_stats = _profile(df, [], numerics)
        levels = {c: sorted(levels[c]) for c in categoricals}
    else:
        levels, num_stats = _profile(df, categoricals, numerics)
    feats: list[Feature] = []
    for c in categoricals:
        lv = levels[c]
        ref = reference_levels.get(c, lv[0] if lv else None)
        if ref not in lv and lv:
            raise ValueError(f"reference level {ref!r} not found in column {c!r}")
        reference_levels[c] = ref
        for level in lv:
            if level == ref:
                continue
            feats.append(Feature(f"cat__{c}_{level}", c, "categorical", level,
                                 (F.col(c).cast("string") == F.lit(level)).cast("double")))
    for c in numerics:
        mean, sd = num_stats[c]
        sc = sd if (sd is not None and sd > 0) else 1.0
        expr = (F.col(c).cast("double") - F.lit(mean)) / F.lit(sc) if scale else F.col(c).cast("double")
        feats.append(Feature(f"num__{c}", c, "numeric", None, expr, mean, sc))
    return FeatureSet(feats, reference_levels, levels)


def _profile(df: DataFrame, cats: Sequence[str], nums: Sequence[str]):
    """ONE scan for the whole encoder fit: categorical levels and numeric
    mean / population std come out of a single stacked aggregate.

    One row a level comes to the driver: the levels are the model's columns.
    A column of ids is lumped first (``clean.lump_levels``).
    """
    if not cats and not nums:
        return {}, {}
    items = ([F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level"),
                       F.lit(None).cast("double").alias("x")) for c in cats]
             + [F.struct(F.lit(c).alias("column"), F.lit(None).cast("string").alias("level"),
                         F.col(c).cast("double").alias("x")) for c in nums])
    numset = set(nums)
    st = (df.select(F.explode(F.array(*items)).alias("s")).select("s.*")
            .groupBy("column", "level")
            .agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std")))
    levels = {c: [] for c in cats}
    num_stats = {c: (0.0, 1.0) for c in nums}
    for r in st.collect():
        c = r["column"]
        if c in numset and r["level"] is None:
            num_stats[c] = (r["mean"], r["std"])
        if c in levels and r["level"] is not None:
            levels[c].append(r["level"])
    return {c: sorted(v) for c, v in levels.items()}, num_stats


def _distinct_levels(df: DataFrame, cols: Sequence[str]) -> dict:
    """Sorted distinct levels per column (see ``_profile``)."""
    return _profile(df, cols, [])[0]


def one_hot(df: DataFrame, fs: FeatureSet, keep: Sequence[str]) -> DataFrame:
    return fs.transform(df, keep=list(keep))


def zscore(df: DataFrame, cols: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(x - mean) / population std, zero std -> 1 (statistics from one
    aggregate, inlined as literals: 2 numbers per column)."""
    fs = fit_features(df, [], cols)
    return df.select(*keep, *[f.expr.alias(f.parameter) for f in fs.features])


def feature_long(df: DataFrame, fs: FeatureSet, keep: Sequence[str], nonzero_only: bool = False) -> DataFrame:
    """Long feature matrix: ``keep..., feature, value``; every cell, or the
    cells that are not zero."""
    items = [F.struct(F.lit(f.name).alias("feature"), f.expr.alias("value")) for f in fs.features]
    out = df.select(*keep, F.explode(F.array(*items)).alias("s")).select(*keep, "s.feature", "s.value")
    return out.where(F.col("value") != 0) if nonzero_only else out
