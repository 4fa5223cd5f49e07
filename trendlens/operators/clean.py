"""Row cleaning and categorical preparation.

All lazy; the only things computed eagerly are bounded statistics that an
estimator must know before it can transform (means for imputation).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

NULL_LEVEL = "nan"
OTHER = "Other"


def _is_floating(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))


def present(df: DataFrame, c: str) -> Column:
    """Column value is present: not NULL and, for floating types, not NaN."""
    cond = F.col(c).isNotNull()
    if _is_floating(df, c):
        cond = cond & ~F.isnan(F.col(c))
    return cond


def all_present(df: DataFrame, cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [present(df, c) for c in cols], F.lit(True))


def drop_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """B1: keep rows where every listed column is present.

    Spelled as explicit IS NOT NULL / NOT isnan predicates (not ``dropna``)
    so the null checks reach the parquet scan as pushed filters.
    """
    return df.where(all_present(df, cols))


def drop_audit(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """B2: rows before / after / dropped in a single aggregate."""
    return (df.agg(F.count(F.lit(1)).alias("rows_before"),
                   F.count_if(all_present(df, cols)).alias("rows_after"))
              .select("rows_before", "rows_after",
                      (F.col("rows_before") - F.col("rows_after")).alias("rows_dropped")))


def target_null_counts(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Non-missing count per target in one aggregate; ``all_null`` marks
    targets that must be skipped."""
    agg = df.agg(*[F.count_if(present(df, t)).alias(f"_n{i}") for i, t in enumerate(targets)],
                 F.count(F.lit(1)).alias("_rows"))
    stacked = F.explode(F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(t).alias("target"), F.col(f"_n{i}").alias("n_present"))
        for i, t in enumerate(targets)]))
    return (agg.select(stacked.alias("s"), "_rows")
               .select("s.ord", "s.target", "s.n_present",
                       (F.col("_rows") - F.col("s.n_present")).alias("n_missing"),
                       (F.col("s.n_present") == 0).alias("all_null")))


def stringify(df: DataFrame, cols: Sequence[str], null_level: str = NULL_LEVEL) -> DataFrame:
    """Categoricals as strings; a surviving null becomes the level 'nan'."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(null_level)) for c in cols})


def level_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, level, n) for all categorical columns in one scan.

    Columns are stacked so one aggregate (with map-side partial counts, so a
    hot level costs nothing extra) covers them all.
    """
    items = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in cols]
    return (df.select(F.explode(F.array(*items)).alias("s"))
              .groupBy(F.col("s.column").alias("column"), F.col("s.level").alias("level"))
              .agg(F.count(F.lit(1)).alias("n")))


def top_levels(counts: DataFrame, top_n: int, salt_buckets: int = 64) -> DataFrame:
    """Top-N levels per column by count (ties: level ascending).

    Two-level selection so no window partition ever holds all levels of a
    high-cardinality column: first the top N inside hash buckets of the
    level, then the top N among the <= buckets*N survivors.
    """
    order = [F.col("n").desc(), F.col("level").asc()]
    bucket = F.pmod(F.xxhash64("level"), F.lit(salt_buckets))
    pre = (counts.withColumn("_b", bucket)
                 .withColumn("_r", F.row_number().over(W.partitionBy("column", "_b").orderBy(*order)))
                 .where(F.col("_r") <= top_n).drop("_r", "_b"))
    return (pre.withColumn("rank", F.row_number().over(W.partitionBy("column").orderBy(*order)))
               .where(F.col("rank") <= top_n))


def fit_lumping_levels(df: DataFrame, cols: Sequence[str], top_n: int = 10, other: str = OTHER,
                       null_level: str = NULL_LEVEL, salt_buckets: int = 64) -> tuple[dict, dict]:
    """Like ``fit_lumping`` and, from the SAME job, the sorted levels each
    column has after lumping (kept levels, plus ``other`` when any level was
    lumped) -- so encoders downstream need no extra pass to discover them.

    Distinct-level totals come from per-bucket sizes carried by the first
    window stage (one row per bucket), so the collected result stays bounded:
    at most N kept rows plus ``salt_buckets`` size rows per column.
    """
    if not cols:
        return {}, {}
    counts = level_counts(stringify(df, cols, null_level), cols)
    order = [F.col("n").desc(), F.col("level").asc()]
    wb = W.partitionBy("column", "_b")
    pre = (counts.withColumn("_b", F.pmod(F.xxhash64("level"), F.lit(salt_buckets)))
                 .withColumn("_r", F.row_number().over(wb.orderBy(*order)))
                 .withColumn("_bs", F.count(F.lit(1)).over(wb))
                 .where(F.col("_r") <= top_n))
    ranked = pre.withColumn("rank", F.row_number().over(W.partitionBy("column").orderBy(*order)))
    rows = ranked.where((F.col("rank") <= top_n) | (F.col("_r") == 1)).select(
        "column", "level", "rank", "_r", "_bs").collect()
    keep = {c: [] for c in cols}
    total = {c: 0 for c in cols}
    for r in rows:
        if r["rank"] <= top_n:
            keep[r["column"]].append(r["level"])
        if r["_r"] == 1:
            total[r["column"]] += int(r["_bs"])
    levels = {c: sorted(set(keep[c]) | ({other} if total[c] > len(keep[c]) else set())) for c in cols}
    return keep, levels


def fit_lumping(df: DataFrame, cols: Sequence[str], top_n: int = 10,
                null_level: str = NULL_LEVEL) -> dict:
    """Kept levels per column: the N most frequent (ties: level ascending).

    One job: stacked level counts (map-side partial counts, so a hot level
    costs nothing extra) and a salted two-level top-N.  The result has at
    most N levels per column -- a proven bound -- and is returned to the
    caller like any fitted estimator state.
    """
    if not cols:
        return {}
    keep = top_levels(level_counts(stringify(df, cols, null_level), cols), top_n)
    out = {c: [] for c in cols}
    for r in keep.select("column", "level").collect():
        out[r["column"]].append(r["level"])
    return out


def apply_lumping(df: DataFrame, keep: dict, other: str = OTHER, null_level: str = NULL_LEVEL) -> DataFrame:
    """Map every level outside the kept set to ``other`` (a projection: no
    join, no shuffle, stays in codegen)."""
    df = stringify(df, list(keep), null_level)
    return df.withColumns({c: F.when(F.col(c).isin(lv), F.col(c)).otherwise(F.lit(other))
                           for c, lv in keep.items()})


def lump_levels(df: DataFrame, cols: Sequence[str], top_n: int = 10, other: str = OTHER,
                null_level: str = NULL_LEVEL) -> DataFrame:
    """B3+B4: stringify, keep the N most frequent levels of each column and
    map the rest to ``other`` (fit once, then a pure projection)."""
    return apply_lumping(df, fit_lumping(df, cols, top_n, null_level), other, null_level)


def level_profile(df: DataFrame, cols: Sequence[str], warn_at: int = 20) -> DataFrame:
    """Distinct level count per column, flagged above ``warn_at``."""
    order = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(i))])
    return (level_counts(df, cols).groupBy("column").agg(F.count(F.lit(1)).alias("n_levels"))
            .select("column", "n_levels", (F.col("n_levels") > warn_at).alias("high_cardinality"),
                    order[F.col("column")].alias("ord")))


def impute_mean(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace NULL/NaN in numeric inputs by the column mean (over
    present values).  ``pyspark.ml.feature.Imputer`` does exactly this: one
    aggregate to fit, a literal fill to transform."""
    from pyspark.ml.feature import Imputer

    tmp = [f"__imp_{i}" for i in range(len(cols))]
    casted = df.withColumns({t: F.col(c).cast("double") for t, c in zip(tmp, cols)})
    model = Imputer(strategy="mean", inputCols=tmp, outputCols=[f"{t}_o" for t in tmp]).fit(casted)
    out = model.transform(casted)
    return (out.withColumns({c: F.col(f"{t}_o") for c, t in zip(cols, tmp)})
               .drop(*tmp, *[f"{t}_o" for t in tmp]))
