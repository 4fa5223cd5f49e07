"""Interaction regressions at every depth.

For depth d the model is ``y ~ 1 + (sum of all d-way products of the
inputs)`` with no lower-order terms.  Categorical factors are contrast coded
by the usual redundancy rule for such formulas (terms bucketed by their
numeric factors; inside a bucket each term's categorical part is expanded
into subsets of reduced factors, subsets already spanned are dropped and
pairs S, S+{f-} are merged into f+), which yields exactly as many columns
as the design's rank on full factorial data.

Execution: ONE ``groupBy`` of all categorical inputs gives the *cells*, each
with sums of products of the numeric inputs (about their means) and targets.
No row is read again: in a cell every design column is a fixed product of
numeric inputs or zero, so a depth's moment matrix is assembled from cells, as
``(i, j, sum)`` triples that Spark adds up, and every (target, depth) is solved
in a task of its own.  A depth of more than ``max_columns`` columns is solved
from its cells when they are few, and is else reported as too wide, alone.
Products of inputs far from zero are expanded about the means, so epoch
seconds keep their precision.  Raw (unscaled) inputs are used, as in the
reference.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendlens.functions.linalg import inference, pack, solve_moments
from trendlens.operators.encode import _distinct_levels
from trendlens.operators.gram import not_missing
from trendlens.operators.linear import column_means
from trendlens.session import scratch_path

MAX_COLUMNS = 2500      # columns (or cell rows) of one dense solve: 50 MB
SUMS_IN_SQL = 64        # more sums than this go through one vector aggregate


@dataclass
class DesignColumn:
    term: str       # raw formula-style name
    label: str      # display label, e.g. "a = x × b"
    parameters: tuple
    spec: tuple = ()  # ((factor, level or None for a numeric), ...)

    @property
    def expr(self) -> Column:
        """The column over raw inputs."""
        out = F.lit(1.0)
        for f, v in self.spec:
            c = F.col(f).cast("double") if v is None else (F.col(f).cast("string") == F.lit(v)).cast("double")
            out = out * c
        return out


def _subsets_sorted(factors: Sequence[str]):
    idx = list(range(len(factors)))
    subs = []
    for r in range(len(idx) + 1):
        subs.extend(itertools.combinations(idx, r))
    return [tuple(factors[i] for i in s) for s in subs]


def _pick_codings(cat_factors: Sequence[str], used: set) -> list[dict]:
    """Codings for one term: list of {factor: full_rank?} per subterm."""
    subterms = []
    for subset in _subsets_sorted(cat_factors):
        st = frozenset((f, False) for f in subset)
        if st not in used:
            subterms.append(st)
    used.update(subterms)
    changed = True
    while changed:
        changed = False
        for si, short in enumerate(subterms):
            for li in range(si + 1, len(subterms)):
                long = subterms[li]
                if len(long) - len(short) == 1 and long.issuperset(short):
                    (extra,) = tuple(long - short)
                    subterms[si] = frozenset(set(short) | {(extra[0], True)})
                    subterms.pop(li)
                    changed = True
                    break
            if changed:
                break
    subterms.sort(key=len)
    return [dict(st) for st in subterms]


def design(categoricals: Sequence[str], numerics: Sequence[str], levels: dict,
           depth: int) -> list[DesignColumn]:
    """Contrast-coded columns of the depth-``depth`` interaction model
    (intercept first)."""
    cats = set(categoricals)
    all_terms = list(categoricals) + list(numerics)
    terms = [()] + list(itertools.combinations(all_terms, depth))
    buckets: dict = {}
    order = []
    for t in terms:
        key = frozenset(f for f in t if f not in cats)
        if key not in buckets:
            buckets[key] = []
            order.append(key)
        buckets[key].append(t)
    if frozenset() in buckets:
        order.remove(frozenset())
        order.insert(0, frozenset())
    cols: list[DesignColumn] = []
    for key in order:
        used: set = set()
        for t in sorted(buckets[key], key=len):
            cat_f = [f for f in t if f in cats]
            for coding in _pick_codings(cat_f, used):
                factors = [f for f in t if f not in cats or f in coding]
                per_factor = []
                for f in factors:
                    if f in cats:
                        lv = levels[f] if coding[f] else levels[f][1:]
                        tag = "" if coding[f] else "T."
                        per_factor.append([(f'C(Q("{f}"))[{tag}{v}]', f"{f} = {v}", (f, v)) for v in lv])
                    else:
                        per_factor.append([(f'Q("{f}")', f, (f, None))])
                if not factors:
                    cols.append(DesignColumn("Intercept", "Intercept", ()))
                    continue
                # left-most factor varies fastest
                for combo in itertools.product(*reversed(per_factor)):
                    combo = combo[::-1]
                    cols.append(DesignColumn(":".join(c[0] for c in combo), " × ".join(c[1] for c in combo),
                                             tuple(factors), tuple(c[2] for c in combo)))
    return cols


@dataclass
class InteractionFit:
    coefficients: DataFrame   # target, depth, term_idx, term, label, parameters, coef, std_err, t, p, ci_lo, ci_hi
    status: DataFrame         # target, depth, n_columns, status, n, rank, r2
    designs: dict


_COEF = T.StructType([
    T.StructField("target", T.StringType()), T.StructField("depth", T.IntegerType()),
    T.StructField("term_idx", T.IntegerType()), T.StructField("term", T.StringType()),
    T.StructField("label", T.StringType()), T.StructField("parameters", T.ArrayType(T.StringType())),
    T.StructField("coef", T.DoubleType()), T.StructField("std_err", T.DoubleType()),
    T.StructField("t", T.DoubleType()), T.StructField("p", T.DoubleType()),
    T.StructField("ci_lo", T.DoubleType()), T.StructField("ci_hi", T.DoubleType())])

_STATUS = T.StructType([
    T.StructField("target", T.StringType()), T.StructField("depth", T.IntegerType()),
    T.StructField("n_columns", T.IntegerType()), T.StructField("status", T.StringType()),
    T.StructField("n", T.LongType()), T.StructField("rank", T.IntegerType()),
    T.StructField("r2", T.DoubleType())])


@dataclass
class Cells:
    """Layout of the sums that every cell carries."""
    categoricals: list
    numerics: list
    targets: list
    subsets: list        # products of numeric inputs, as index tuples, () first
    sums: dict           # exponent tuple -> place of the sum of that monomial
    cross: dict          # (target, subset) -> place of the sum of target times product
    square: dict         # target -> place
    centre: np.ndarray   # means of the numerics
    y_centre: dict

    @classmethod
    def plan(cls, categoricals, numerics, targets, depth, centre, y_centre):
        q = len(numerics)
        subsets = [s for r in range(min(depth, q) + 1) for s in itertools.combinations(range(q), r)]
        sums: dict = {}
        for a in subsets:
            for b in subsets:
                e = tuple((i in a) + (i in b) for i in range(q))
                sums.setdefault(e, len(sums))
        at = len(sums)
        cross = {}
        for t in targets:
            for a in subsets:
                cross[t, a] = at
                at += 1
        square = {t: at + i for i, t in enumerate(targets)}
        return cls(list(categoricals), list(numerics), list(targets), subsets, sums, cross, square, centre, y_centre)

    @property
    def width(self) -> int:
        return len(self.sums) + len(self.cross) + len(self.square)

    def expressions(self) -> list[Column]:
        u = [F.col(f"_n{i}") for i in range(len(self.numerics))]

        def monomial(e):
            out = F.lit(1.0)
            for i, n in enumerate(e):
                for _ in range(n):
                    out = out * u[i]
            return out

        out = [monomial(e) for e in self.sums]
        for t, a in self.cross:
            e = tuple(int(i in a) for i in range(len(u)))
            out.append(F.coalesce(F.col(f"_y{self.targets.index(t)}"), F.lit(0.0)) * monomial(e))
        for t in self.square:
            y = F.coalesce(F.col(f"_y{self.targets.index(t)}"), F.lit(0.0))
            out.append(y * y)
        return out

    def blocks(self, g: np.ndarray, target: str) -> np.ndarray:
        """Moment matrices (cells x s + 1 x s + 1) over the centred products, then the target."""
        s = len(self.subsets)
        q = len(self.numerics)
        out = np.empty((len(g), s + 1, s + 1))
        for i, a in enumerate(self.subsets):
            for j, b in enumerate(self.subsets):
                out[:, i, j] = g[:, self.sums[tuple((k in a) + (k in b) for k in range(q))]]
            out[:, i, s] = out[:, s, i] = g[:, self.cross[target, a]]
        out[:, s, s] = g[:, self.square[target]]
        return out

    def expansion(self, factors: Sequence[int], keep_constant: bool) -> np.ndarray:
        """Coefficients of a product of raw inputs over the centred products."""
        out = np.zeros(len(self.subsets))
        for i, a in enumerate(self.subsets):
            if set(a) <= set(factors) and (a or keep_constant):
                out[i] = np.prod([self.centre[k] for k in factors if k not in a])
        return out


def cell_table(df: DataFrame, cells: Cells, by: Sequence[str] = ()) -> DataFrame:
    """One row a group, combination of levels and of present targets (``_mask``)
    with the sums of ``cells`` in ``_g``: one scan with map-side partial sums, stored."""
    spark = df.sparkSession
    cats = [F.col(c).cast("string").alias(f"_c{i}") for i, c in enumerate(cells.categoricals)]
    nums = [(F.col(c).cast("double") - F.lit(float(m))).alias(f"_n{i}")
            for i, (c, m) in enumerate(zip(cells.numerics, cells.centre))]
    ys = [F.when(not_missing(F.col(t)), F.col(t).cast("double") - F.lit(cells.y_centre[t])).alias(f"_y{i}")
          for i, t in enumerate(cells.targets)]
    rows = df.select(*by, *cats, *nums, *ys)
    for i in range(len(cats)):
        rows = rows.where(F.col(f"_c{i}").isNotNull())
    for i in range(len(nums)):
        rows = rows.where(not_missing(F.col(f"_n{i}")))
    mask = F.concat(*[F.when(F.col(f"_y{i}").isNull(), "0").otherwise("1") for i in range(len(ys))])
    key = [*by, *[f"_c{i}" for i in range(len(cats))]]
    grouped = rows.withColumn("_mask", mask).groupBy(*key, "_mask")
    parts = cells.expressions()
    if len(parts) <= SUMS_IN_SQL:
        out = grouped.agg(F.array(*[F.sum(e) for e in parts]).alias("_g"))
    else:
        out = grouped.agg(Summarizer.sum(array_to_vector(F.array(*parts))).alias("_v"))
        out = out.select(*key, "_mask", vector_to_array("_v").alias("_g"))
    path = scratch_path(spark, "cells")
    out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)


class _Layout:
    """Which design columns a cell activates: at most one a block of columns
    that share their factors."""

    def __init__(self, cells: Cells, columns: Sequence[DesignColumn], levels: dict):
        places: dict = {}
        code = {f: {v: i for i, v in enumerate(levels[f])} for f in levels}
        for at, dc in enumerate(columns[1:], start=1):
            places.setdefault(tuple(f for f, _ in dc.spec), []).append((at, dc.spec))
        self.k, self.blocks, self.vectors, self.levels = len(columns), [], [], levels
        self.shift = np.zeros(len(columns) - 1)
        for factors, members in places.items():
            cats = [f for f in factors if f in levels]
            nums = [cells.numerics.index(f) for f in factors if f not in levels]
            shape = [len(levels[f]) + 1 for f in cats]           # the last slot: a level not listed
            table = np.full(shape, -1, np.int64)
            for at, spec in members:
                table[tuple(code[f][v] for f, v in spec if v is not None)] = at
            self.blocks.append(([cells.categoricals.index(f) for f in cats], table))
            self.vectors.append(cells.expansion(nums, bool(cats)))
            if not cats:
                self.shift[int(table) - 1] = np.prod([cells.centre[i] for i in nums])
        self.v = np.array(self.vectors).reshape(len(self.blocks), len(cells.subsets))

    def active(self, codes: np.ndarray) -> np.ndarray:
        """(cells x blocks) design column of every block in every cell, or -1."""
        return np.column_stack([table[tuple(codes[:, c] for c in cats)] if cats else np.full(len(codes), int(table))
                                for cats, table in self.blocks]).reshape(len(codes), len(self.blocks))


def _codes(pdf: pd.DataFrame, cells: Cells, levels: dict) -> np.ndarray:
    out = np.empty((len(pdf), len(cells.categoricals)), np.int64)
    for i, c in enumerate(cells.categoricals):
        code = pd.Categorical(pdf[f"_c{i}"], categories=list(levels[c])).codes.astype(np.int64)
        out[:, i] = np.where(code < 0, len(levels[c]), code)
    return out


def _gram_triples(table: DataFrame, cells: Cells, layouts: dict[int, _Layout], levels: dict, by: list[str]) -> DataFrame:
    """``by..., target, depth, i, j, v``: upper triangle of every depth's moment
    matrix over (1, columns, target), summed over cells; each batch adds up its own."""
    chunk = 2000
    schema = T.StructType([table.schema[c] for c in by] + [
        T.StructField("target", T.StringType()), T.StructField("depth", T.IntegerType()), T.StructField("i", T.IntegerType()),
        T.StructField("j", T.IntegerType()), T.StructField("v", T.DoubleType()), T.StructField("n", T.DoubleType())])

    def triples(pdf, target):
        """(depth, i, j, v, n) of some cells of one group that have the target."""
        m = cells.blocks(np.array(pdf["_g"].tolist(), float).reshape(len(pdf), cells.width), target)
        codes, n, s = _codes(pdf, cells, levels), len(pdf), len(cells.subsets)
        for d, lay in layouts.items():
            # rows of v: the intercept, every block, the target
            nb = len(lay.blocks)
            v = np.zeros((nb + 2, s + 1))
            v[0, 0], v[1:nb + 1, :s], v[nb + 1, s] = 1.0, lay.v, 1.0
            need = np.flatnonzero(v.any(axis=0))     # what overflows elsewhere stays out
            small = np.einsum("ai,cij,bj->cab", v[:, need], m[:, need[:, None], need], v[:, need], optimize=True)
            act = np.column_stack([np.zeros(n, np.int64), lay.active(codes), np.full(n, lay.k, np.int64)])
            a, b = np.triu_indices(nb + 2)
            x, y = act[:, a], act[:, b]
            ok = (x >= 0) & (y >= 0)
            x, y, val = x[ok], y[ok], small[:, a, b][ok]
            key, at = np.unique(np.minimum(x, y) * (lay.k + 1) + np.maximum(x, y), return_inverse=True)
            yield d, key // (lay.k + 1), key % (lay.k + 1), np.bincount(at, val, minlength=len(key)), np.where(
                key == 0, m[:, 0, 0].sum(), 0.0)

    def run(frames):
        for frame in frames:
            groups = frame.groupby(by, sort=False, dropna=False) if by else [((), frame)]
            for key, group in groups:
                for ti, t in enumerate(cells.targets):
                    have = group[group["_mask"].str[ti] == "1"]
                    for lo in range(0, len(have), chunk):
                        for d, i, j, v, n in triples(have.iloc[lo:lo + chunk], t):
                            out = pd.DataFrame({"target": t, "depth": np.int32(d), "i": i.astype(np.int32),
                                                "j": j.astype(np.int32), "v": v, "n": n})
                            for at, c in enumerate(by):
                                out.insert(at, c, [key[at]] * len(out))
                            yield out

    parts = table.mapInPandas(run, schema)
    return parts.groupBy(*by, "target", "depth", "i", "j").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))


def interactions(df: DataFrame, categoricals: Sequence[str], numerics: Sequence[str],
                 targets: Sequence[str], *, max_depth: int | None = None, alpha: float = 0.05,
                 levels: dict | None = None, max_columns: int = MAX_COLUMNS,
                 by: Sequence[str] = ()) -> InteractionFit:
    """Fit every depth up to ``max_depth`` (default: all inputs) in every group
    of ``by``.  Depths stand alone: one that is too wide to solve (``too wide``) or cannot be solved
    (``failed``) has a status row and no coefficients, the others keep theirs.

    A depth with more than ``max_columns`` design columns is solved from its
    cells, when those make at most ``max_columns`` rows; rows without a
    level, a numeric input or the target take no part.
    """
    by = list(by)
    categoricals = [c for c in categoricals if c in df.columns]
    numerics = [c for c in numerics if c in df.columns]
    n_inputs = len(categoricals) + len(numerics)
    if n_inputs == 0:
        raise ValueError("no input columns for interaction models")
    levels = levels or _distinct_levels(df, categoricals)
    levels = {c: list(levels[c]) for c in categoricals}
    top = n_inputs if max_depth is None else min(max_depth, n_inputs)
    designs = {d: design(categoricals, numerics, levels, d) for d in range(1, top + 1)}
    means = column_means(df, [F.col(c) for c in [*numerics, *targets]])
    cells = Cells.plan(categoricals, numerics, list(targets), top, means[:len(numerics)],
                       {t: float(m) for t, m in zip(targets, means[len(numerics):])})
    table = cell_table(df, cells, by)
    layouts = {d: _Layout(cells, cols, levels) for d, cols in designs.items()}
    dense = {d: x for d, x in layouts.items() if x.k <= max_columns}
    wide = {d: x for d, x in layouts.items() if x.k > max_columns}
    few = bool(wide) and table.count() * (len(cells.subsets) + 1) <= max_columns
    meta = {d: [(dc.term, dc.label, list(dc.parameters)) for dc in cols] for d, cols in designs.items()}

    def rows(key, t, d, solve):
        """One row with the depth's status (term_idx -1), then one a coefficient."""
        k, n_coef = layouts[d].k, len(_COEF.fields) - 2
        try:
            s = solve()
            if not np.isfinite(s["coef"]).all():
                raise ArithmeticError("the moments of this depth overflow")
        except Exception:  # isolate a failing depth (E8)
            return [[*key, t, d, -1] + [None] * (n_coef - 1) + [k, "failed", None, None, None]]
        out = [[*key, t, d, -1] + [None] * (n_coef - 1) + [k, "fitted", int(s["n"]), s["rank"], s["r2"]]]
        for i, (term, label, params) in enumerate(meta[d]):
            out.append([*key, t, d, i, term, label, params, *[s[c][i] for c in ("coef", "std_err", "t", "p", "ci_lo", "ci_hi")],
                        *[None] * (len(_STATUS.fields) - 2)])
        return out

    schema = T.StructType([df.schema[c] for c in by] + _COEF.fields + _STATUS.fields[2:])
    mine = lambda pdf: [pdf[c].iloc[0] for c in by]
    frame = lambda out: pd.DataFrame(out, columns=schema.names)

    def solve_dense(pdf: pd.DataFrame) -> pd.DataFrame:
        t, d = pdf["target"].iloc[0], int(pdf["depth"].iloc[0])
        lay = layouts[d]
        m = np.zeros((lay.k + 1, lay.k + 1))
        m[pdf["i"], pdf["j"]] = pdf["v"]
        shift = np.append(lay.shift, cells.y_centre[t])
        return frame(rows(mine(pdf), t, d, lambda: solve_moments(pack(m), lay.k + 1, float(pdf["n"].sum()), alpha=alpha, shift=shift)))

    def solve_cells(pdf: pd.DataFrame) -> pd.DataFrame:
        t, d = pdf["target"].iloc[0], int(pdf["depth"].iloc[0])
        g = np.array(pdf["_g"].tolist(), float).reshape(len(pdf), cells.width)
        return frame(rows(mine(pdf), t, d, lambda: _solve_rows(cells, layouts[d], t, g, _codes(pdf, cells, levels), alpha)))

    spark = df.sparkSession
    solved = spark.createDataFrame([], schema)
    if dense:
        solved = _gram_triples(table, cells, dense, levels, by).groupBy(*by, "target", "depth").applyInPandas(solve_dense, schema)
    # wide depths: each with the cells there are, or reported
    depths = F.explode(F.array(*[F.lit(d) for d in wide]).cast("array<int>")).alias("depth")
    every = spark.createDataFrame([(t, i) for i, t in enumerate(targets)], "target string, _t int")
    if wide and few:
        each = table.crossJoin(F.broadcast(every.select("*", depths)))
        each = each.where(F.col("_mask").substr(F.col("_t") + 1, F.lit(1)) == "1")
        solved = solved.unionByName(each.groupBy(*by, "target", "depth").applyInPandas(solve_cells, schema))
    elif wide:
        groups = table.select(*by).distinct().crossJoin(F.broadcast(every)) if by else every
        width = F.element_at(F.map_from_arrays(F.array(*[F.lit(d) for d in wide]),
                                               F.array(*[F.lit(x.k) for x in wide.values()])), F.col("depth"))
        given = {"term_idx": F.lit(-1), "n_columns": width, "status": F.lit("too wide")}
        solved = solved.unionByName(groups.select(*by, "target", depths).select(*[
            given.get(f.name, F.col(f.name) if f.name in (*by, "target", "depth") else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields]))
    path = scratch_path(spark, "interactions")
    solved.write.parquet(path)
    stored = spark.read.schema(schema).parquet(path)
    return InteractionFit(stored.where("term_idx >= 0").select(*by, *_COEF.names),
                          stored.where("term_idx < 0").select(*by, *_STATUS.names), designs)


def _solve_rows(cells: Cells, lay: _Layout, target: str, g: np.ndarray, codes: np.ndarray, alpha: float) -> dict:
    """Least squares with more columns than cell rows: every cell's moments are
    factored into a few rows, and the minimum-norm solution is found among them."""
    s = len(cells.subsets)
    w, q = np.linalg.eigh(cells.blocks(g, target))
    rows = np.sqrt(np.clip(w, 0.0, None))[:, :, None] * q.transpose(0, 2, 1)      # cells x rows x (products, target)
    act = lay.active(codes)
    full = lay.v.copy()
    pure = np.array([not cats for cats, _ in lay.blocks])
    full[pure, 0] = lay.shift[[int(table) - 1 for cats, table in lay.blocks if not cats]]
    x = np.zeros((len(g), s + 1, lay.k))
    x[:, :, 0] = rows[:, :, 0]
    for b in range(len(lay.blocks)):
        c = np.flatnonzero(act[:, b] >= 0)
        x[c, :, act[c, b]] = rows[c, :, :s] @ full[b]
    x = x.reshape(-1, lay.k)
    y = (rows[:, :, s] + rows[:, :, 0] * cells.y_centre[target]).reshape(-1)
    scale = np.sqrt((x * x).sum(axis=0))
    scale[scale == 0] = 1.0
    lam, u = np.linalg.eigh((x / scale) @ (x / scale).T)
    rank = int((lam > lam.max() * 1e-10).sum())
    z = x.T @ np.linalg.pinv(x @ x.T, rcond=1e-10, hermitian=True)
    beta = z @ y
    n = float(g[:, cells.sums[(0,) * len(cells.numerics)]].sum())
    resid = y - x @ beta
    ones = rows[:, :, 0].reshape(-1)
    mean = ones @ y / (ones @ ones)
    tss = float(((y - mean * ones) ** 2).sum())
    return inference(beta, np.einsum("ij,ij->i", z, z), n, rank, float(resid @ resid), tss, alpha)
