"""Moment ("Gram") pass: sum(w * z z^T) for z = (1, x_1..x_k) per group.

One scan, map-side partial aggregation, no shuffle beyond the tiny final
merge, so it is immune to key skew and its output size depends only on the
number of groups and columns, never on rows.

Two physical forms:

* few columns -> one ``groupBy().agg(sum(w*zi*zj) ...)``; stays inside
  whole-stage codegen.
* many columns or several column blocks -> ``mapInPandas`` computes the
  partial matrix of every block per Arrow batch with BLAS and emits one small
  row per (task, group, block); the partials are merged element-wise with
  ``Summarizer.sum`` (a JVM aggregate with partial merge).

Output: ``by..., _block, _k, _g`` where ``g`` is the packed upper triangle of the
k x k matrix followed by the unweighted row count.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTITIONS = "spark.trendlens.partitions"
FAN_IN = 256  # partial vectors summed by one task of the first merge level
SQL_MAX_K = 13  # 1 + 12 columns -> 91 sums: below codegen's field limit

ColSpec = tuple[str, Column]


def _as_specs(cols) -> list[ColSpec]:
    out = []
    for c in cols:
        if isinstance(c, str):
            out.append((c, F.col(c)))
        else:
            out.append((c[0], c[1]))
    return out


def spread(df: DataFrame) -> DataFrame:
    """Input of a CPU-bound stage (Python kernels, tree training), dealt over
    ``spark.trendlens.partitions`` tasks if the caller set that; else as it
    comes from the scan, without a shuffle."""
    n = df.sparkSession.conf.get(PARTITIONS, None)
    return df.repartition(int(n)) if n else df


def not_missing(c: Column) -> Column:
    """Non-null and not NaN (double semantics)."""
    d = c.cast("double")
    return d.isNotNull() & ~F.isnan(d)


def moments(df: DataFrame, blocks: Mapping[str, Sequence] | Sequence, *,
            weight: Column | None = None, by: Sequence[str] = (),
            method: str = "auto") -> DataFrame:
    if not isinstance(blocks, Mapping):
        blocks = {"main": blocks}
    specs = {b: _as_specs(c) for b, c in blocks.items()}
    by = list(by)
    single = len(specs) == 1
    k_max = max(len(v) for v in specs.values()) + 1
    if method == "sql" or (method == "auto" and single and k_max <= SQL_MAX_K):
        name, cols = next(iter(specs.items()))
        return _sql_moments(df, name, cols, weight, by)
    return _arrow_moments(df, specs, weight, by)


def _sql_moments(df, name, cols, weight, by):
    w = (weight if weight is not None else F.lit(1.0)).cast("double")
    z = [F.lit(1.0)] + [c.cast("double") for _, c in cols]
    cond = not_missing(w)
    for _, c in cols:
        cond = cond & not_missing(c)
    k = len(z)
    sums = []
    for i in range(k):
        for j in range(i, k):
            e = w
            if i > 0:
                e = e * z[i]
            if j > 0:
                e = e * z[j]
            sums.append(F.sum(e))
    sums.append(F.count(F.lit(1)).cast("double"))
    agg = df.where(cond).groupBy(*by).agg(F.array(*sums).alias("_g"))
    return agg.select(*by, F.lit(name).alias("_block"), F.lit(k).alias("_k"), "_g")


def _arrow_moments(df, specs, weight, by):
    # flatten all distinct column expressions into positional inputs
    names: list[tuple[str, int]] = []
    exprs: list[Column] = []
    index: dict[str, list[int]] = {}
    seen: dict[tuple[str, int], int] = {}
    for b, cols in specs.items():
        idx = []
        times: dict[str, int] = {}
        for nm, c in cols:
            # blocks share columns by name; two columns of one name in a block stay two
            key = (nm, times.get(nm, 0))
            times[nm] = key[1] + 1
            if key not in seen:
                seen[key] = len(names)
                names.append(key)
                exprs.append(c.cast("double").alias(f"_m{len(names) - 1}"))
            idx.append(seen[key])
        index[b] = idx
    w = (weight if weight is not None else F.lit(1.0)).cast("double").alias("_w")
    key_fields = [df.schema[c] for c in by]
    src = spread(df.select(*[F.col(c) for c in by], w, *exprs))
    out_schema = T.StructType(
        [T.StructField(f.name, f.dataType, True) for f in key_fields]
        + [T.StructField("_block", T.StringType()),
           T.StructField("_g", T.ArrayType(T.DoubleType()))])
    block_items = list(index.items())
    ncols = len(names)

    def partial(it):
        acc: dict = {}
        for pdf in it:
            if pdf.empty:
                continue
            x_all = pdf[[f"_m{i}" for i in range(ncols)]].to_numpy(dtype=float, na_value=np.nan)
            w_all = pdf["_w"].to_numpy(dtype=float, na_value=np.nan)
            if by:
                groups = pdf.groupby(by, sort=False, dropna=False).indices.items()
            else:
                groups = [((), np.arange(len(pdf)))]
            for key, rows in groups:
                key = key if isinstance(key, tuple) else (key,)
                xw = w_all[rows]
                for b, idx in block_items:
                    x = x_all[np.ix_(rows, idx)] if idx else np.empty((len(rows), 0))
                    ok = ~np.isnan(xw)
                    if idx:
                        ok &= ~np.isnan(x).any(axis=1)
                    if not ok.any():
                        continue
                    z = np.column_stack([np.ones(int(ok.sum())), x[ok]])
                    wz = z * xw[ok][:, None]
                    gm = wz.T @ z
                    vec = np.append(gm[np.triu_indices(gm.shape[0])], float(ok.sum()))
                    slot = (key, b)
                    if slot in acc:
                        acc[slot] += vec
                    else:
                        acc[slot] = vec
        if acc:
            rows_out = []
            for (key, b), vec in acc.items():
                rows_out.append(list(key) + [b, vec])
            yield pd.DataFrame(rows_out, columns=list(by) + ["_block", "_g"])

    parts = src.mapInPandas(partial, out_schema)
    return merge_partials(parts, by, {b: len(idx) + 1 for b, idx in block_items})


def merge_partials(parts: DataFrame, by: Sequence[str], k_by_block: Mapping[str, int]) -> DataFrame:
    """Element-wise sum of per-task partial moment vectors (``_g`` arrays) per
    (by..., block) in two levels: ``FAN_IN`` neighbouring tasks first, then
    their sums, so no reducer takes one vector of every task."""
    level = parts.select(*by, "_block", array_to_vector("_g").alias("_gv"),
                         F.floor(F.spark_partition_id() / FAN_IN).alias("_level"))
    first = level.groupBy(*by, "_block", "_level").agg(Summarizer.sum(F.col("_gv")).alias("_gv"))
    merged = first.groupBy(*by, "_block").agg(Summarizer.sum(F.col("_gv")).alias("_gv"))
    k_of = F.create_map(*[x for b, k in k_by_block.items() for x in (F.lit(b), F.lit(k))])
    return merged.select(*by, "_block", k_of[F.col("_block")].alias("_k"),
                         vector_to_array("_gv").alias("_g"))


def triangles(df: DataFrame, cols: Sequence, *, weight: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Triangular factors of the rows ``sqrt(w) (1, x_1..x_k)`` by group: a
    tall-skinny QR.  Every task reduces its rows to one k + 1 by k + 1 triangle
    a group, batch by batch; triangles are stacked and reduced again, ``FAN_IN``
    neighbours first, then theirs.  Unlike moments a factor does not square
    the condition of the columns.  Output: ``by..., _r`` (row-major), ``_n``.
    """
    specs, by = _as_specs(cols), list(by)
    k = len(specs) + 1
    w = (weight if weight is not None else F.lit(1.0)).cast("double").alias("_w")
    src = spread(df.select(*by, w, *[c.cast("double").alias(f"_q{i}") for i, (_, c) in enumerate(specs)]))
    schema = T.StructType([df.schema[c] for c in by] + [T.StructField("_r", T.ArrayType(T.DoubleType())),
                                                        T.StructField("_n", T.DoubleType())])

    def reduced(rows: np.ndarray) -> np.ndarray:
        r = np.linalg.qr(rows, mode="r")
        return np.vstack([r, np.zeros((k - len(r), k))]) if len(r) < k else r

    def factor(frames):
        acc: dict = {}
        for pdf in frames:
            x = np.column_stack([np.ones(len(pdf))] + [pdf[f"_q{i}"].to_numpy(float, na_value=np.nan) for i in range(k - 1)])
            weights = pdf["_w"].to_numpy(float, na_value=np.nan)
            ok = ~np.isnan(x).any(axis=1) & ~np.isnan(weights)
            groups = pdf.groupby(by, sort=False, dropna=False).indices.items() if by else [((), np.arange(len(pdf)))]
            for key, at in groups:
                key = key if isinstance(key, tuple) else (key,)
                at = at[ok[at]]
                if len(at):
                    rows = x[at] * np.sqrt(weights[at])[:, None]
                    r, n = acc.get(key, (np.zeros((0, k)), 0.0))
                    acc[key] = reduced(np.vstack([r, rows])), n + len(at)
        if acc:
            yield pd.DataFrame([[*key, r.ravel(), n] for key, (r, n) in acc.items()], columns=schema.names)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        stack = np.vstack([np.asarray(r).reshape(k, k) for r in pdf["_r"]])
        return pd.DataFrame([[*[pdf[c].iloc[0] for c in by], reduced(stack).ravel(), pdf["_n"].sum()]], columns=schema.names)

    parts = src.mapInPandas(factor, schema).withColumn("_level", F.floor(F.spark_partition_id() / FAN_IN))
    first = parts.groupBy(*by, "_level").applyInPandas(merge, schema)
    return first.groupBy(*by).applyInPandas(merge, schema)
