"""Model explanation (G1-G9): tree SHAP, linear SHAP, importance, additivity,
1-D / 2-D partial dependence, permutation importance.

Rows enter tree SHAP as *signatures*: per feature, the number of the forest's
thresholds below the value.  Rows of one signature take the same way through
every tree, so they share their SHAP values exactly, whatever the values were.
Signatures are hashed to blocks, trees dealt to groups (see ``forest``), and a
task explains one block by one group; the values of a signature are the sum
over groups.  A task thus holds one block and one group, however many rows or
nodes there are.

Tree SHAP is path-dependent (expectations under the trees' cover shares).  For a
leaf whose path tests the features U, with cover share z_k and indicator o_k(x)
of "x meets the path's conditions on k", feature j is credited

    v * (o_j - z_j) * integral_0^1 prod_{k != j} ((1-t) z_k + t o_k) dt,

a polynomial that Gauss-Legendre quadrature with ceil(|U|/2) nodes integrates
exactly.  A depth-first walk keeps the product at the quadrature nodes for all
rows of the block, and every edge credits its feature with the sum over the
leaves below it.

Partial dependence needs leaves only, never rows: every task adds up its leaves'
steps over the grid.  ``leaf_counts`` replaces cover shares by counts of data
rows, which gives the average prediction over the data.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendlens.functions.linalg import gauss_legendre_01
from trendlens.operators.forest import Trees
from trendlens.operators.gram import spread
from trendlens.operators.index import stable_index
from trendlens.operators.stats import exact_quantiles
from trendlens.session import scratch_path

GRID_RESOLUTION = 100
PERCENTILES = (0.05, 0.95)
BLOCK_ROWS = 2048       # signatures explained by one task at a time
MAX_TASKS = 20_000
GRID_CELLS = 1024       # grid points of the features that one 2-D task holds


# ----------------------------------------------------------------- signatures

def _bin_rows(names: Sequence[str], cuts: Sequence[Sequence[float]], batch: pa.RecordBatch) -> np.ndarray:
    """Bins (rows x features) of a batch; a missing value is above every cut."""
    at = batch.schema.get_field_index
    cols = [np.asarray(batch.column(at(n)).cast(pa.float64()).to_numpy(zero_copy_only=False), float) for n in names]
    kind = np.uint16 if max(map(len, cuts), default=0) < 1 << 16 else np.uint32
    return np.column_stack([np.searchsorted(c, x, side="left") for c, x in zip(cuts, cols)]).astype(kind)


def _packed(bins: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(bins)], pa.binary())


def _unpacked(column, n_features: int) -> np.ndarray:
    """Bins (features x rows) of packed signatures."""
    joined = b"".join(column)
    kind = np.uint16 if len(joined) == 2 * n_features * len(column) else np.uint32
    return np.ascontiguousarray(np.frombuffer(joined, kind).reshape(-1, n_features).T)


def with_signature(df: DataFrame, names: Sequence[str], trees: Trees, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns and the row's signature ``_bins``."""
    names, keep, cuts = list(names), list(keep), trees.cuts
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("_bins", T.BinaryType())])

    def run(batches):
        for batch in batches:
            cols = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*cols, _packed(_bin_rows(fed, cuts, batch))], [*keep, "_bins"])

    fed = [f"_x{i}" for i in range(len(names))]
    src = df.select(*keep, *[F.col(n).cast("double").alias(x) for n, x in zip(names, fed)])
    return spread(src).mapInArrow(run, schema)


def signatures(df: DataFrame, names: Sequence[str], trees: Trees) -> tuple[DataFrame, int]:
    """``_bins, _cnt``: the distinct signatures with their numbers of rows (each
    batch counts its own first), stored, and how many there are."""
    cuts, spark = trees.cuts, df.sparkSession
    fed = [f"_x{i}" for i in range(len(names))]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                bins, n = np.unique(_bin_rows(fed, cuts, batch), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([_packed(bins), pa.array(n.astype(np.float64))], ["_bins", "_cnt"])

    src = spread(df.select(*[F.col(n).cast("double").alias(x) for n, x in zip(names, fed)]))
    path = scratch_path(spark, "signatures")
    src.mapInArrow(run, "_bins binary, _cnt double").groupBy("_bins").agg(F.sum("_cnt").alias("_cnt")).write.parquet(path)
    stored = spark.read.schema("_bins binary, _cnt double").parquet(path)
    return stored, stored.count()


def _blocks_by_groups(sig: DataFrame, n: int, table: DataFrame, trees: Trees, run, schema: str) -> DataFrame:
    """``run(key, signatures, table rows)`` for every block of signatures and tree
    group.  Both sides are dealt by (block, group): signatures go to every
    group, groups to every block."""
    n_blocks = max(1, -(-n // BLOCK_ROWS))
    parts = min(MAX_TASKS, 4 * n_blocks * trees.n_groups)
    rows = sig.withColumn("_block", F.pmod(F.xxhash64("_bins"), F.lit(n_blocks)).cast("int")).withColumn(
        "group", F.explode(F.sequence(F.lit(0), F.lit(trees.n_groups - 1))))
    every = table.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    deal = [F.col("_block"), F.col("group")]
    return rows.repartition(parts, *deal).groupBy(*deal).cogroup(
        every.repartition(parts, *deal).groupBy(*deal)).applyInPandas(run, schema)


# ------------------------------------------------------------------ tree SHAP

def _path_width(low, high, feature) -> int:
    """The largest number of distinct features on a path."""
    best, stack = 1, [(0, frozenset())]
    while stack:
        at, seen = stack.pop()
        if low[at] < 0:
            best = max(best, len(seen))
        else:
            seen = seen | {feature[at]}
            stack += [(low[at], seen), (high[at], seen)]
    return best


def tree_phi(nodes: pd.DataFrame, cuts: Sequence[Sequence[float]], bins: np.ndarray, phi: np.ndarray) -> None:
    """Add one tree's SHAP values of all rows (``bins``: features x rows) to
    ``phi`` (features x rows)."""
    by_id = nodes.set_index("id")
    low, high = by_id["low"].to_dict(), by_id["high"].to_dict()
    cover, value = by_id["cover"].to_dict(), by_id["value"].to_dict()
    inner = by_id[by_id["low"] >= 0]
    feature = {i: int(f) for i, f in inner["feature"].items()}
    cut = {i: int(np.searchsorted(cuts[int(f)], c)) for i, f, c in zip(inner.index, inner["feature"], inner["cut"])}
    t, w = gauss_legendre_01((_path_width(low, high, feature) + 1) // 2)
    t, w = t[:, None], w[None, :]
    path: dict[int, tuple] = {}

    def credit(f, state, total, sign):
        o, z, a, b = state
        share = np.where(o, (w / a.T) @ total, (w / b.T) @ total)[0]
        phi[f] += sign * np.where(o, 1.0 - z, -z) * share

    def below(i, g):
        if low[i] < 0:
            return value[i] * g
        f = feature[i]
        goes_low = bins[f] <= cut[i]
        old, total = path.get(f), None
        for child, o in ((low[i], goes_low), (high[i], ~goes_low)):
            z = cover[child] / cover[i]
            if old is None:
                a, b = (1.0 - t) * z + t, (1.0 - t) * z
                factor = np.where(o, a, b)
            else:
                o0, z0, a0, b0 = old
                z, o = z * z0, o & o0
                a, b = (1.0 - t) * z + t, (1.0 - t) * z
                factor = np.where(o, a / a0, np.where(o0, b / a0, b / b0))
            path[f] = (o, z, a, b)
            factor *= g
            part = below(child, factor)
            credit(f, path[f], part, 1.0)
            if old is not None:
                credit(f, old, part, -1.0)
            total = part if total is None else np.add(total, part, out=total)
        if old is None:
            del path[f]
        else:
            path[f] = old
        return total

    below(0, np.ones((len(t), bins.shape[1])))


def shap_by_signature(df: DataFrame, names: Sequence[str], trees: Trees) -> DataFrame:
    """``_bins, _cnt, phi``: SHAP values of every signature of ``df``."""
    sig, n = signatures(df, names, trees)
    p, cuts = trees.n_features, trees.cuts

    def run(key, rows: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or nodes.empty:
            return pd.DataFrame({"_bins": [], "_cnt": [], "phi": []})
        bins = _unpacked(rows["_bins"].tolist(), p)
        phi = np.zeros((p, len(rows)))
        for _, tree in nodes.groupby("tree", sort=True):
            tree_phi(tree, cuts, bins, phi)
        return pd.DataFrame({"_bins": rows["_bins"], "_cnt": rows["_cnt"], "phi": list(phi.T)})

    nodes = trees.nodes(df.sparkSession)
    parts = _blocks_by_groups(sig, n, nodes, trees, run, "_bins binary, _cnt double, phi array<double>")
    if trees.n_groups == 1:
        return parts
    total = parts.groupBy("_bins").agg(F.first("_cnt").alias("_cnt"), Summarizer.sum(array_to_vector("phi")).alias("_v"))
    return total.select("_bins", "_cnt", vector_to_array("_v").alias("phi"))


def _named(names: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.col("feature_idx") + 1)


def shap_importance(df: DataFrame, names: Sequence[str], trees: Trees) -> DataFrame:
    """``feature_idx, feature, mean_abs_shap, mean_shap, n``, summed over
    signatures with their numbers of rows."""
    long = shap_by_signature(df, names, trees).select("_cnt", F.posexplode("phi").alias("feature_idx", "phi"))
    total = F.sum("_cnt")
    return (long.groupBy("feature_idx")
                .agg((F.sum(F.abs("phi") * F.col("_cnt")) / total).alias("mean_abs_shap"),
                     (F.sum(F.col("phi") * F.col("_cnt")) / total).alias("mean_shap"), total.cast("long").alias("n"))
                .select("feature_idx", _named(names).alias("feature"), "mean_abs_shap", "mean_shap", "n"))


def sample_rows(df: DataFrame, key: Sequence[str], rows: int, seed: int = 0) -> DataFrame:
    """About ``rows`` rows of ``df`` to explain where all would cost too much
    (an opt-in; nothing samples by default).  A row is taken when the first 32
    bits of the MD5 of ``seed|key...`` fall below its share, so a rerun or
    another layout takes the same rows, and rows of one key go together.  Null
    parts of a key are skipped.  Asking for at least all rows takes all."""
    n = df.count()
    if rows >= n:
        return df
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key]).cast("binary"))
    return df.where(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") < F.lit(max(rows, 0) * 2**32 // n))


def _rows_with_phi(df: DataFrame, names: Sequence[str], trees: Trees, keep: Sequence[str]) -> DataFrame:
    return with_signature(df, names, trees, keep).join(shap_by_signature(df, names, trees), "_bins")


def shap_values(df: DataFrame, names: Sequence[str], trees: Trees, keep: Sequence[str]) -> DataFrame:
    """G1: per-row SHAP values, long form ``keep..., base, feature_idx, phi, feature``."""
    return (_rows_with_phi(df, names, trees, keep)
            .select(*keep, F.lit(trees.base_value).alias("base"), F.posexplode("phi").alias("feature_idx", "phi"))
            .withColumn("feature", _named(names)))


def shap_sums(df: DataFrame, names: Sequence[str], trees: Trees, keep: Sequence[str]) -> DataFrame:
    """G2 by row: ``keep...`` and ``explained``, base plus all SHAP values."""
    total = F.aggregate("phi", F.lit(trees.base_value), lambda a, x: a + x)
    return _rows_with_phi(df, names, trees, keep).select(*keep, total.alias("explained"))


def shap_additivity(df: DataFrame, names: Sequence[str], trees: Trees, prediction: str = "prediction") -> DataFrame:
    """Max |base + sum(phi) - model prediction| (prediction from Spark ML)."""
    sums = shap_sums(df, names, trees, [prediction])
    return sums.agg(F.max(F.abs(F.col("explained") - F.col(prediction))).alias("max_abs_error"),
                    F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------- linear SHAP

def linear_shap(df: DataFrame, specs: Sequence[tuple[str, Column]], beta: dict) -> DataFrame:
    """phi_j = beta_j * (x_j - mean_j) as column expressions (``phi_<name>``)."""
    means = df.agg(*[F.avg(c.cast("double")).alias(f"_m{i}") for i, (_, c) in enumerate(specs)]).first()
    return df.select(*df.columns, *[
        (F.lit(beta[n]) * (c.cast("double") - F.lit(means[f"_m{i}"]))).alias(f"phi_{n}")
        for i, (n, c) in enumerate(specs)])


def linear_shap_importance(df: DataFrame, specs: Sequence[tuple[str, Column]], beta: dict) -> DataFrame:
    """mean |phi| and mean phi per feature in one aggregate."""
    ph = linear_shap(df, specs, beta)
    aggs = []
    for i, (n, _) in enumerate(specs):
        aggs += [F.avg(F.abs(F.col(f"phi_{n}"))).alias(f"_a{i}"), F.avg(F.col(f"phi_{n}")).alias(f"_s{i}")]
    agg = ph.agg(*aggs, F.count(F.lit(1)).alias("_n"))
    items = [F.struct(F.lit(i).alias("feature_idx"), F.lit(n).alias("feature"),
                      F.col(f"_a{i}").alias("mean_abs_shap"), F.col(f"_s{i}").alias("mean_shap"))
             for i, (n, _) in enumerate(specs)]
    return agg.select(F.explode(F.array(*items)).alias("s"), "_n").select("s.*", F.col("_n").alias("n"))


# -------------------------------------------------------- partial dependence

APPROX_SCREEN = 1000  # HLL estimates above this are certainly >= the grid resolution


def pdp_grid(df: DataFrame, names: Sequence[str], resolution: int = GRID_RESOLUTION,
             percentiles: tuple = PERCENTILES) -> DataFrame:
    """G6 grid: sorted distinct values when a feature has fewer than
    ``resolution`` of them, else ``resolution`` evenly spaced points between
    the (exact, interpolated) percentiles; null and NaN are no values.
    Output ``feature_idx, feature, values``: at most ``resolution`` a feature.

    One HyperLogLog pass screens the features: a continuous feature (estimate
    far above ``resolution``) never has its distinct values shuffled; only
    features that may be small get an exact distinct count, which is then
    bounded by the screen.
    """
    names = list(names)
    if resolution >= APPROX_SCREEN:
        raise ValueError("resolution must stay below the approximate-distinct screen")
    est = df.agg(*[F.approx_count_distinct(F.col(n)).alias(f"_a{i}") for i, n in enumerate(names)]).first()
    items = [F.struct(F.lit(i).alias("feature_idx"), F.col(n).cast("double").alias("value"))
             for i, n in enumerate(names) if est[f"_a{i}"] <= APPROX_SCREEN]
    values = {}
    if items:
        long = df.select(F.explode(F.array(*items)).alias("s")).select("s.*").where(
            F.col("value").isNotNull() & ~F.isnan("value"))
        per = long.distinct().groupBy("feature_idx").agg(F.array_sort(F.collect_list("value")).alias("values"))
        values = {r["feature_idx"]: r["values"] for r in per.where(F.size("values") < resolution).collect()}
    wide = [i for i in range(len(names)) if i not in values]
    if wide:
        ends = exact_quantiles(df, [names[i] for i in wide], percentiles)
        for i in wide:
            lo, hi = ends[names[i]]
            if lo is not None:
                values[i] = [lo + (hi - lo) * k / (resolution - 1) for k in range(resolution)]
    return df.sparkSession.createDataFrame([(i, names[i], values[i]) for i in sorted(values)],
                                           "feature_idx int, feature string, values array<double>")


def leaf_counts(df: DataFrame, names: Sequence[str], trees: Trees, pairs: bool = True) -> DataFrame:
    """Leaves with ``weights``: shares of the rows of ``df`` that meet all
    conditions of the path, then, per feature of the path, all but its, then
    (with ``pairs``) per pair of them, all but exactly the two.  The data-weighted
    counterpart of cover shares."""
    sig, n = signatures(df, names, trees)
    p, cuts = trees.n_features, trees.cuts
    rows_n = sig.agg(F.sum("_cnt")).first()[0] or 1.0
    lists = ["feature", "above", "upto", "share"]

    def run(key, rows: pd.DataFrame, leaves: pd.DataFrame) -> pd.DataFrame:
        out = leaves.drop(columns="_block")
        if leaves.empty or rows.empty:
            out["weights"] = [[0.0]] * len(out)
            return out.iloc[:0]
        bins, cnt = _unpacked(rows["_bins"].tolist(), p), rows["_cnt"].to_numpy() / rows_n
        weights = []
        for feature, above, upto in zip(leaves["feature"], leaves["above"], leaves["upto"]):
            m = len(feature)
            lo = np.array([np.searchsorted(cuts[f], a) if a > -np.inf else -1 for f, a in zip(feature, above)], np.int64)
            hi = np.array([np.searchsorted(cuts[f], u) if u < np.inf else 1 << 40 for f, u in zip(feature, upto)], np.int64)
            x = bins[np.asarray(feature, int)]
            off = (x <= lo[:, None]) | (x > hi[:, None])
            missed = off.sum(axis=0)
            one = missed == 1
            row = [[cnt[missed == 0].sum()], off[:, one] @ cnt[one]]
            if pairs:
                two = missed == 2
                both = (off[:, two] * cnt[two]) @ off[:, two].T
                row.append(both[np.triu_indices(m, 1)])
            weights.append(np.concatenate(row))
        out["weights"] = weights
        return out

    leaves = trees.leaves(df.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in leaves.schema.fields) + ", weights array<double>"
    parts = _blocks_by_groups(sig, n, leaves, trees, run, schema)
    total = parts.groupBy("group", "tree", "leaf").agg(
        F.first("value").alias("value"), *[F.first(c).alias(c) for c in lists],
        Summarizer.sum(array_to_vector("weights")).alias("_w"))
    return total.select("group", "tree", "leaf", "value", *lists, vector_to_array("_w").alias("weights"))


class _Steps:
    """Leaves of one frame, flattened: entry i says that leaf ``leaf[i]`` tests
    ``feature[i]`` and allows ``(above[i], upto[i]]``."""

    def __init__(self, pdf: pd.DataFrame):
        sizes = pdf["feature"].map(len).to_numpy(int)
        flat = lambda c: np.concatenate([np.asarray(x, float) for x in pdf[c]] or [np.zeros(0)])
        self.n, self.sizes = len(pdf), sizes
        self.leaf = np.repeat(np.arange(len(pdf)), sizes)
        self.feature, self.above, self.upto = flat("feature").astype(int), flat("above"), flat("upto")
        value = pdf["value"].to_numpy(float)
        if "weights" in pdf:
            w = list(pdf["weights"])
            one = np.concatenate([np.asarray(x[1:1 + m]) for x, m in zip(w, sizes)] or [np.zeros(0)])
            self.whole = value * np.array([x[0] for x in w])           # all conditions met
            self.extra = value[self.leaf] * one                        # all but this entry's
            self.pair = [v * np.asarray(x[1 + m:]) for v, x, m in zip(value, w, sizes)]
        else:
            share = flat("share")
            whole = np.ones(len(pdf))
            np.multiply.at(whole, self.leaf, share)
            self.whole = value * whole
            self.extra = self.whole[self.leaf] * (1 / share - 1)
            self.pair = None
            self.share = share

    def inside(self, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        """(values x entries) whether a grid value is in the entries' intervals."""
        return (values[:, None] > self.above[at]) & (values[:, None] <= self.upto[at])


def _grid_values(grid: DataFrame) -> dict[int, tuple[str, np.ndarray]]:
    """The grid on the driver: ``resolution`` values a feature at most."""
    return {r["feature_idx"]: (r["feature"], np.asarray(r["values"], float))
            for r in grid.select("feature_idx", "feature", "values").collect()}


def _summed(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    return parts.groupBy(*by).agg(Summarizer.sum(array_to_vector("pd")).alias("_v")).select(
        *by, vector_to_array("_v").alias("pd"))


def tree_pdp_1d(grid: DataFrame, trees: Trees, leaves: DataFrame | None = None) -> DataFrame:
    """Every feature's curve over its grid.  By default the recursion method
    (cover shares); with ``leaves`` from ``leaf_counts`` the average prediction
    over the data."""
    spark = grid.sparkSession
    values = _grid_values(grid)

    def run(frames):
        total = {j: np.zeros(len(v)) for j, (_, v) in values.items()}
        for pdf in frames:
            steps = _Steps(pdf)
            for j, (_, v) in values.items():
                at = np.flatnonzero(steps.feature == j)
                c = steps.whole[steps.leaf[at]] + steps.extra[at]
                order = np.argsort(v, kind="stable")
                edge = np.zeros(len(v) + 1)
                np.add.at(edge, np.searchsorted(v[order], steps.above[at], side="right"), c)
                np.add.at(edge, np.searchsorted(v[order], steps.upto[at], side="right"), -c)
                total[j][order] += steps.whole.sum() - steps.whole[steps.leaf[at]].sum() + np.cumsum(edge)[:-1]
        yield pd.DataFrame({"feature_idx": list(total), "pd": list(total.values())})

    src = leaves if leaves is not None else trees.leaves(spark)
    sums = _summed(src.mapInPandas(run, "feature_idx int, pd array<double>"), ["feature_idx"])
    at = grid.join(sums, "feature_idx").select("feature", F.explode(F.arrays_zip("values", "pd")).alias("g"))
    return at.select("feature", F.col("g.values").alias("value"), F.col("g.pd").alias("pd"))


def feature_pairs(grid: DataFrame, pairs: Sequence[tuple[int, int]] | None, n_features: int) -> DataFrame:
    """Pairs of *features* (p(p-1)/2 at most, bounded by the feature count)
    joined to their grids by equi-joins."""
    spark = grid.sparkSession
    pairs = pairs if pairs is not None else list(itertools.combinations(range(n_features), 2))
    pdf = spark.createDataFrame(pairs or [(-1, -1)], "i int, j int").where("i >= 0")
    g1 = grid.select(F.col("feature_idx").alias("i"), F.col("feature").alias("f1"), F.col("values").alias("v1"))
    g2 = grid.select(F.col("feature_idx").alias("j"), F.col("feature").alias("f2"), F.col("values").alias("v2"))
    return pdf.join(F.broadcast(g1), "i").join(F.broadcast(g2), "j")


def _feature_blocks(values: dict, cells: int) -> list[list[int]]:
    blocks, held = [[]], 0
    for j, (_, v) in values.items():
        if blocks[-1] and held + len(v) > cells:
            blocks.append([])
            held = 0
        blocks[-1].append(j)
        held += len(v)
    return blocks


def tree_pdp_2d(grid: DataFrame, trees: Trees, pairs=None, leaves: DataFrame | None = None) -> DataFrame:
    """Every pair's surface.  Features are dealt to blocks of ``GRID_CELLS``
    grid points; leaves meet every pair of blocks, where the surfaces are one
    matrix product over leaves.  ``leaves`` as in ``tree_pdp_1d``."""
    spark = grid.sparkSession
    values = _grid_values(grid)
    wanted = set(pairs) if pairs is not None else set(itertools.combinations(sorted(values), 2))
    wanted = {(i, j) for i, j in wanted if i in values and j in values}
    blocks = _feature_blocks(values, GRID_CELLS)
    of = {j: b for b, js in enumerate(blocks) for j in js}
    meet = sorted({tuple(sorted((of[i], of[j]))) for i, j in wanted})

    def member(steps: _Steps, j: int):
        """Per grid value and leaf: 1 or 0, and the leaf's weight without j's condition besides the whole."""
        at = np.flatnonzero(steps.feature == j)
        hit = np.ones((len(values[j][1]), steps.n))
        hit[:, steps.leaf[at]] = steps.inside(at, values[j][1])
        extra = np.zeros(steps.n)
        extra[steps.leaf[at]] = steps.extra[at]
        return hit, extra

    def surfaces(steps: _Steps, todo):
        """Yield (i, j, surface) of the pairs in ``todo``."""
        js = sorted({j for ij in todo for j in ij})
        if steps.pair is None:
            # weights factor: divide by j's share where j is tested
            rows, at, start = [], {}, 0
            for j in js:
                hit, _ = member(steps, j)
                e = np.flatnonzero(steps.feature == j)
                hit[:, steps.leaf[e]] /= steps.share[e]
                at[j] = slice(start, start + len(hit))
                start += len(hit)
                rows.append(hit)
            a = np.vstack(rows)
            m = (a * steps.whole) @ a.T
            for i, j in todo:
                yield i, j, m[at[i], at[j]]
            return
        parts = {j: member(steps, j) for j in js}
        places = {}
        tested = np.split(steps.feature, np.cumsum(steps.sizes)[:-1])
        for k, (pair, f) in enumerate(zip(steps.pair, tested)):
            for x, (u, v) in zip(pair, itertools.combinations(f.tolist(), 2)):
                if x:
                    places.setdefault((u, v), []).append((k, x))
        for i, j in todo:
            (a, ea), (b, eb) = parts[i], parts[j]
            out = (a * (steps.whole + ea + eb)) @ b.T
            both = places.get((min(i, j), max(i, j)))
            if both:
                k = np.array([x[0] for x in both])
                out += (a[:, k] * np.array([x[1] for x in both])) @ b[:, k].T
            yield i, j, out

    def run(frames):
        total: dict[tuple[int, int], np.ndarray] = {}
        for pdf in frames:
            for b, part in pdf.groupby("_meet"):
                x, y = meet[b]
                todo = sorted(ij for ij in wanted if tuple(sorted((of[ij[0]], of[ij[1]]))) == (x, y))
                for lo in range(0, len(part), 4096):
                    for i, j, surface in surfaces(_Steps(part.iloc[lo:lo + 4096]), todo):
                        total[i, j] = total[i, j] + surface if (i, j) in total else surface.copy()
        yield pd.DataFrame({"i": [k[0] for k in total], "j": [k[1] for k in total],
                            "pd": [m.ravel() for m in total.values()]})

    src = leaves if leaves is not None else trees.leaves(spark)
    met = src.withColumn("_meet", F.explode(F.sequence(F.lit(0), F.lit(max(0, len(meet) - 1)))))
    if len(meet) > 1:
        met = met.repartition("_meet", "group")
    sums = _summed(met.mapInPandas(run, "i int, j int, pd array<double>"), ["i", "j"])
    pr = feature_pairs(grid, sorted(wanted), trees.n_features).join(sums, ["i", "j"])
    cell = pr.select("f1", "f2", F.posexplode("v1").alias("a", "v1"), "v2", "pd").select(
        "f1", "v1", "f2", F.posexplode("v2").alias("b", "v2x"), F.size("v2").alias("w"), "a", "pd")
    return cell.select("f1", "v1", "f2", F.col("v2x").alias("v2"), F.get("pd", F.col("a") * F.col("w") + F.col("b")).alias("pd"))


def linear_pdp_1d(grid: DataFrame, beta: dict, means: dict, names: Sequence[str]) -> DataFrame:
    """Linear twin: PD_j(g) = b0 + b_j g + sum_{k != j} b_k mean_k."""
    const = beta["Intercept"] + sum(beta[n] * means[n] for n in names)
    b = F.element_at(F.array(*[F.lit(beta[n]) for n in names]), F.col("feature_idx") + 1)
    m = F.element_at(F.array(*[F.lit(means[n]) for n in names]), F.col("feature_idx") + 1)
    return (grid.select("feature", F.explode("values").alias("value"), b.alias("_b"), m.alias("_m"))
                .select("feature", "value", (F.lit(const) + F.col("_b") * (F.col("value") - F.col("_m"))).alias("pd")))


def linear_pdp_2d(grid: DataFrame, beta: dict, means: dict, names: Sequence[str], pairs=None) -> DataFrame:
    const = beta["Intercept"] + sum(beta[n] * means[n] for n in names)
    pr = feature_pairs(grid, pairs, len(names))
    barr = F.array(*[F.lit(beta[n]) for n in names])
    marr = F.array(*[F.lit(means[n]) for n in names])
    e = (pr.select("f1", "f2", F.explode("v1").alias("v1"), "v2",
                   F.element_at(barr, F.col("i") + 1).alias("b1"), F.element_at(marr, F.col("i") + 1).alias("m1"),
                   F.element_at(barr, F.col("j") + 1).alias("b2"), F.element_at(marr, F.col("j") + 1).alias("m2"))
           .select("*", F.explode("v2").alias("v2x")))
    return e.select("f1", "v1", "f2", F.col("v2x").alias("v2"),
                    (F.lit(const) + F.col("b1") * (F.col("v1") - F.col("m1"))
                     + F.col("b2") * (F.col("v2x") - F.col("m2"))).alias("pd"))


def pdp_effect(pdp: DataFrame, by: Sequence[str] = ("feature",)) -> DataFrame:
    """effect = max - min of the PD curve, with min and max."""
    return pdp.groupBy(*by).agg((F.max("pd") - F.min("pd")).alias("effect"),
                                F.min("pd").alias("pd_min"), F.max("pd").alias("pd_max"))


# --------------------------------------------------- permutation importance

_ROUNDS = 6


def _scrambled(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser, elementwise on uint64."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shuffled_index(index: np.ndarray, n: int, seed: int, repeat: np.ndarray) -> np.ndarray:
    """For every ``repeat`` a bijection of 0..n-1, computed entry by entry: a
    Feistel network over the next even number of bits, walked until the value
    is below n (walking a permutation's cycles is a permutation)."""
    half = max(1, -(-max(1, int(n - 1).bit_length()) // 2))
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    key = _scrambled(repeat.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed + 1))
    x = index.astype(np.uint64)
    todo = np.ones(len(x), bool)
    with np.errstate(over="ignore"):
        while todo.any():
            left, right, k = x[todo] >> shift, x[todo] & mask, key[todo]
            for r in range(_ROUNDS):
                left, right = right, left ^ (_scrambled(right + k + np.uint64(r * 0x632BE5AB)) & mask)
            x[todo] = (left << shift) | right
            todo[todo] = x[todo] >= n
    return x.astype(np.int64)


def permutation_pairs(base: DataFrame, n: int, repeats: int, seed: int = 0) -> DataFrame:
    """``base`` once a repeat, with ``repeat`` and the row's donor ``donor_idx``:
    for every repeat a bijection of the row indices 0..n-1 (``row_idx``),
    computed where the row is."""
    @F.pandas_udf("long")
    def donor(index: pd.Series, repeat: pd.Series) -> pd.Series:
        return pd.Series(shuffled_index(index.to_numpy(), n, seed, repeat.to_numpy()))

    every = base.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    return every.withColumn("donor_idx", donor("row_idx", "repeat"))


def permutation_importance(df: DataFrame, names: Sequence[str], label: str, key: Sequence[str],
                           score: Callable[[DataFrame], DataFrame], *, repeats: int = 10,
                           seed: int = 0) -> DataFrame:
    """Drop in R^2 when one feature column is permuted.

    Each row's donor in every repeat is computed from its index (see
    ``permutation_pairs``) and its values come by one join on the index.  A
    variant differs from its row only where the donor's value does, so the
    row's own prediction is kept once and just the differing variants are scored
    by ``score`` (DataFrame -> DataFrame with ``prediction``; e.g. a Spark ML
    model, fitted or re-read), equal ones of a repeat and feature once: sums over
    the labels of their rows give the exact squared error.
    Output: ``feature_idx, feature, repeat, r2_base, r2_perm, importance``.
    """
    names = list(names)
    spark = df.sparkSession
    index, n = stable_index(df.select(*key, label, *names), list(key))
    base = (score(index.select("row_idx", label, *names))
            .select("row_idx", label, *names, F.col("prediction").alias("_f0")).checkpoint(eager=True))
    y = F.col(label).cast("double")
    e0 = y - F.col("_f0")
    st = base.agg(F.avg(y).alias("my"), F.var_pop(y).alias("vy"), F.count(F.lit(1)).alias("n"), F.sum(e0 * e0).alias("sse")).first()
    sst = float(st["vy"]) * float(st["n"])  # same for every permuted variant: y is untouched
    r2_base = 1.0 - st["sse"] / sst
    donors = base.select(F.col("row_idx").alias("donor_idx"), *[F.col(c).alias(f"_d{i}") for i, c in enumerate(names)])
    # scoring, not the size of its input, sets the number of tasks
    joined = permutation_pairs(base, n, repeats, seed).join(donors, "donor_idx")
    differs = F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_d{i}")), F.lit(i)) for i, c in enumerate(names)])
    # rows whose variants are equal share a prediction: with sums over them the squared error
    # of n rows is n f^2 - 2 f sum(y) + sum(y^2), taken about the label's mean to keep digits
    middle = F.lit(float(st["my"]))
    yc = y - middle
    variants = (spread(joined).select("*", F.explode(F.array_compact(differs)).alias("feature_idx"))
                .groupBy("repeat", "feature_idx",
                         *[F.when(F.col("feature_idx") == i, F.col(f"_d{i}")).otherwise(F.col(c)).alias(c)
                           for i, c in enumerate(names)])
                .agg(F.count(y).alias("_n"), F.sum(yc).alias("_y"), F.sum(yc * yc - e0 * e0).alias("_s")))
    # few bytes, but every row walks the whole model: dealt to tasks by number, not by size
    dealt = variants.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    f1 = F.col("prediction") - middle
    delta = (score(dealt).groupBy("repeat", "feature_idx")
             .agg((F.sum(F.col("_n") * f1 * f1 - 2 * f1 * F.col("_y") + F.col("_s")) / F.lit(sst)).alias("_drop")))
    grid = (spark.createDataFrame(list(enumerate(names)), "feature_idx int, feature string")
            .withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))))
    drop = F.coalesce(F.col("_drop"), F.lit(0.0))
    return (grid.join(delta, ["feature_idx", "repeat"], "left")
            .select("feature_idx", "feature", "repeat", F.lit(r2_base).alias("r2_base"),
                    (F.lit(r2_base) - drop).alias("r2_perm"), drop.alias("importance")))


def permutation_summary(perm: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """Mean and population std over repeats; with a features table, also the
    parameter (G9 groups by it via ``rollup``)."""
    s = perm.groupBy("feature_idx", "feature").agg(F.avg("importance").alias("importance_mean"),
                                                   F.stddev_pop("importance").alias("importance_std"))
    if features is not None:
        s = s.join(F.broadcast(features.select("feature", "parameter")), "feature", "left")
    return s
