"""Levels as a table (B7, B9): one-hot encoding whose dictionary never leaves
the executors.

``level_dictionary`` numbers the levels of every categorical in order, without
the reference levels; ``feature_entries`` gives the encoded rows as (index,
value) pairs by joins on that table.  Use these where ``encode.fit_features``,
which keeps one expression a level, would have too many; regressions on such a
column are ``linear.absorbed_regression``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendlens.operators.gram import not_missing
from trendlens.operators.index import stable_index


def _pairs(df: DataFrame, categoricals: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """``keep..., col, level``: one row a categorical cell that is not null."""
    cells = F.array(*[F.struct(F.lit(i).alias("col"), F.col(c).cast("string").alias("level"))
                      for i, c in enumerate(categoricals)])
    return df.select(*keep, F.explode(cells).alias("_p")).select(*keep, "_p.col", "_p.level").where("level is not null")


def level_dictionary(df: DataFrame, categoricals: Sequence[str], reference_levels: dict | None = None) -> DataFrame:
    """``column, level, n, idx, feature``: every level with its number of rows and
    its place among the encoded columns (null for reference levels: the ones
    given, else a column's first).  Columns in the given order, levels sorted.
    """
    cols = list(categoricals)
    n = _pairs(df, cols, []).groupBy("col", "level").agg(F.count(F.lit(1)).alias("n"))
    ranked, _ = stable_index(n, ["col", "level"], out="_rank")
    given = reference_levels or {}
    first = {r["col"]: r["level"] for r in ranked.groupBy("col").agg(F.min("level").alias("level")).collect()}  # a row a column
    ref = {i: given.get(cols[i], level) for i, level in first.items()}
    if not ref:
        return ranked.select(F.lit(None).cast("string").alias("column"), "level", "n", F.lit(None).cast("long").alias("idx"),
                             F.lit(None).cast("string").alias("feature"))
    found = {r["col"] for r in ranked.where(F.greatest(F.lit(False), *[(F.col("col") == i) & (F.col("level") == v)
                                                                       for i, v in ref.items()])).collect()}
    for i, v in ref.items():
        if i not in found:
            raise ValueError(f"reference level {v!r} not found in column {cols[i]!r}")
    name = F.array(*[F.lit(c) for c in cols])[F.col("col")]
    mine = F.array(*[F.lit(ref.get(i)) for i in range(len(cols))])[F.col("col")]
    before = F.lit(0)
    for i in ref:     # reference levels ahead of a level take no place
        before = before + (F.lit(i) < F.col("col")).cast("int")
    before = before + (mine < F.col("level")).cast("int")
    return ranked.select(name.alias("column"), "level", "n",
                         F.when(F.col("level") != mine, F.col("_rank") - before).alias("idx"),
                         F.when(F.col("level") != mine, F.concat(F.lit("cat__"), name, F.lit("_"), F.col("level"))).alias("feature"))


def feature_entries(df: DataFrame, dictionary: DataFrame, categoricals: Sequence[str], keep: Sequence[str],
                    numerics: Sequence[tuple[str, Column]] = ()) -> DataFrame:
    """``keep..., idx, feature, value``: the encoded row's entries that are not
    zero, numerics after all levels.  Levels not in the dictionary, reference
    levels and nulls have none.  A level that holds many rows is split by the
    engine's skew join."""
    cols = list(categoricals)
    name = F.array(*[F.lit(c) for c in cols])[F.col("col")] if cols else F.lit(None)
    known = dictionary.where(F.col("idx").isNotNull()).select("column", "level", "idx", "feature")
    cells = _pairs(df, cols, keep).withColumn("column", name) if cols else None
    out = None
    if cells is not None:
        out = cells.join(known, ["column", "level"]).select(*keep, "idx", "feature", F.lit(1.0).alias("value"))
    if numerics:
        start = dictionary.agg(F.coalesce(F.max("idx") + 1, F.lit(0))).first()[0]
        items = F.array(*[F.struct(F.lit(start + i).alias("idx"), F.lit(n).alias("feature"), c.cast("double").alias("value"))
                          for i, (n, c) in enumerate(numerics)])
        nums = df.select(*keep, F.explode(items).alias("_e")).select(*keep, "_e.*").where(
            not_missing(F.col("value")) & (F.col("value") != 0))
        out = nums if out is None else out.unionByName(nums)
    return out
