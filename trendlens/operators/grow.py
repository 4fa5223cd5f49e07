"""Forest training on cells (E5).

A forest cuts every feature at ``max_bins`` - 1 places at most, so rows whose
features lie between the same cuts (a cell) go the same way at every split, and
a tree needs of a cell's rows only three sums under its bootstrap weights:
weights, weighted labels and weighted squares.  One pass over all rows makes
these sums for all trees; tasks then grow a few whole trees each, without another
pass a level.  Cells are at most as many as rows, and few where inputs are
lumped categories and binned numbers; with more than ``MOST_CELLS`` the caller
trains on rows.

Cuts follow Spark ML's rule (all midpoints when they fit, else equal shares of
the rows), over all rows.  Bootstrap weights are Poisson(1), drawn from the row's
rank in key order, so a forest depends on its rows alone.  Trees are written in
Spark ML's own format; its model is read back once something asks for it, for
reading one and sending it to tasks take longer than the training.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendlens.operators.explain import _scrambled
from trendlens.operators.forest import layout_parts
from trendlens.operators.index import stable_index
from trendlens.session import scratch_path

MOST_VALUES = 100_000      # distinct values of all features that the driver reads to choose cuts
MOST_CELLS = 100_000       # cells a growing task holds
MOST_NODES = 2_000_000     # nodes (28 bytes each) that a scoring task holds
GROUP_TREES = 8            # trees that grow in one task
BLOCK_ROWS = 1 << 18       # rows of a cell that one task sums
ROUNDING = 1e-13           # a gain below this share of its terms is rounding, not a gain

_CELL_SCHEMA = "_cell binary, _row long, _y double"
_SUM_SCHEMA = "_group int, _cell binary, _start long, _sums binary"
_NODE_SCHEMA = ("treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, "
                "rawCount: bigint, gain: double, leftChild: int, rightChild: int, "
                "split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>")


def candidate_cuts(values: Sequence[float], counts: Sequence[int], max_cuts: int) -> np.ndarray:
    """Cuts of one feature with these sorted distinct values, as Spark ML chooses them."""
    v, c = np.asarray(values, float), np.asarray(counts, float)
    middle = v[:-1] / 2 + v[1:] / 2 if np.abs(v).max() > 1e300 else (v[:-1] + v[1:]) / 2
    if len(middle) <= max_cuts:
        return middle
    stride = c.sum() / (max_cuts + 1)
    goal, so_far, out = stride, c[0], []
    for i in range(1, len(v)):
        before, so_far = so_far, so_far + c[i]
        if abs(before - goal) < abs(so_far - goal):
            out.append(middle[i - 1])
            goal += stride
    return np.array(out[:max_cuts])


def _poisson_steps() -> list[np.uint32]:
    """Where a uniform 32-bit number passes P(X <= k), X ~ Poisson(1)."""
    out, total = [], 0.0
    for k in range(13):
        total += math.exp(-1.0) / math.factorial(k)
        if round(total * 2**32) < 2**32:
            out.append(np.uint32(round(total * 2**32)))
    return out


_STEPS = _poisson_steps()


def bootstrap_weights(rows: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """Poisson(1) weight of every row (by its rank) in every tree, rows x trees."""
    gold = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        key = _scrambled(rows.astype(np.uint64) * gold + np.uint64((seed + 1) % 2**64))
        bits = _scrambled(key[:, None] + np.arange(1, (trees + 1) // 2 + 1, dtype=np.uint64)[None, :] * gold)
    uniform = np.ascontiguousarray(bits).view(np.uint32)[:, :trees]
    out = np.zeros(uniform.shape, np.uint8)
    for step in _STEPS:
        out += uniform >= step
    return out


def _fixed_binary(values: np.ndarray) -> pa.Array:
    """One binary value a row of a matrix."""
    values = np.ascontiguousarray(values)
    width = values.itemsize * values.shape[1]
    ends = np.arange(len(values) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(ends), pa.py_buffer(values)])


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def _starts(same: np.ndarray) -> np.ndarray:
    """First row of every run of equal rows."""
    return np.flatnonzero(np.append(True, (same[1:] != same[:-1]).any(axis=1)))


def grow_trees(codes: np.ndarray, w: np.ndarray, s: np.ndarray, ss: np.ndarray, bins: Sequence[int],
               max_depth: int, min_instances: int) -> dict[str, np.ndarray]:
    """Trees from the sums of cells: ``codes`` cells x features, ``w``, ``s``, ``ss`` cells x trees
    (weights, weighted labels, weighted squares).  All nodes of a level of all
    trees are split at once, each by the cut of largest variance gain, the first
    of equal ones.  One entry a node, parents before children: ``tree, n, t, tt,
    gain, feature, cut, left, right`` (places of the children, -1 for a leaf)."""
    cell, node = np.nonzero(w)
    iw, it, itt = w[cell, node], s[cell, node], ss[cell, node]
    tree, base, levels = np.arange(w.shape[1]), 0, []
    least = max(float(min_instances), 0.5)
    for depth in range(max_depth + 1):
        k = len(tree)
        n, t, tt = (np.bincount(node, x, k) for x in (iw, it, itt))
        gain, feature, cut = np.zeros(k), np.full(k, -1), np.full(k, -1)
        with np.errstate(divide="ignore", invalid="ignore"):
            whole = t * t / n
            for f, b in enumerate(bins if depth < max_depth else ()):
                if b < 2:
                    continue
                at = node * b + codes[cell, f]
                lw = np.bincount(at, iw, k * b).reshape(k, b).cumsum(axis=1)[:, :-1]
                lt = np.bincount(at, it, k * b).reshape(k, b).cumsum(axis=1)[:, :-1]
                rw, rt = n[:, None] - lw, t[:, None] - lt
                score = np.where((lw >= least) & (rw >= least), lt * lt / lw + rt * rt / rw, -np.inf)
                best = score.argmax(axis=1)
                top = score[np.arange(k), best]
                g = top - whole
                better = (g > gain) & (g > ROUNDING * top)
                gain[better], feature[better], cut[better] = g[better], f, best[better]
        split = feature >= 0
        place = np.cumsum(split) - 1
        left = np.where(split, base + k + 2 * place, -1)
        levels.append((tree, n, t, tt, gain, feature, cut, left, np.where(split, left + 1, -1)))
        if not split.any():
            break
        on = split[node]
        cell, node, iw, it, itt = cell[on], node[on], iw[on], it[on], itt[on]
        node = 2 * place[node] + (codes[cell, feature[node]] > cut[node])
        tree, base = np.repeat(tree[split], 2), base + k
    names = ("tree", "n", "t", "tt", "gain", "feature", "cut", "left", "right")
    return {c: np.concatenate([level[i] for level in levels]) for i, c in enumerate(names)}


def _node_batch(nodes: dict[str, np.ndarray], first_tree: int, cuts: Sequence[np.ndarray], centre: float) -> pa.RecordBatch:
    """Nodes as Spark ML stores them, numbered from 0 in every tree."""
    order = np.argsort(nodes["tree"], kind="stable")
    g = {c: v[order] for c, v in nodes.items()}
    own = np.empty(len(order), np.int64)   # a node's number in its tree, by its place among all
    own[order] = np.arange(len(order)) - np.searchsorted(g["tree"], g["tree"], side="left")
    inner = g["left"] >= 0
    n, t = g["n"], g["t"]
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = np.where(n > 0, t / n, 0.0)
        impurity = np.where(n > 0, np.maximum(g["tt"] / n - mean * mean, 0.0), 0.0)
        gain = np.where(inner, g["gain"] / n, -1.0)
    stats = np.stack([n, t + centre * n, g["tt"] + 2 * centre * t + centre * centre * n], axis=1)
    at = np.array([cuts[f][c] for f, c in zip(g["feature"][inner], g["cut"][inner])], float)
    ends = np.append(0, np.cumsum(inner)).astype(np.int32)
    i32 = lambda x: pa.array(x.astype(np.int32))
    split = pa.StructArray.from_arrays(
        [i32(g["feature"]), pa.ListArray.from_arrays(pa.array(ends), pa.array(at)), i32(np.full(len(n), -1))],
        ["featureIndex", "leftCategoriesOrThreshold", "numCategories"])
    child = {c: i32(np.where(inner, own[np.where(inner, g[c], 0)], -1)) for c in ("left", "right")}
    data = pa.StructArray.from_arrays(
        [i32(own[order]), pa.array(np.where(n > 0, mean + centre, 0.0)), pa.array(impurity),
         pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * np.int32(3)), pa.array(stats.ravel())),
         pa.array(np.round(n).astype(np.int64)), pa.array(gain), child["left"], child["right"], split],
        ["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split"])
    return pa.RecordBatch.from_arrays([i32(g["tree"] + first_tree), data], ["treeID", "nodeData"])


def _write_about(rf, spark, path: str, n_features: int, trees: int) -> None:
    """The parameters beside the nodes, of the forest and of every tree, as Spark ML stores them."""
    given = {p.name: v for p, v in rf._paramMap.items()}
    usual = {p.name: v for p, v in rf._defaultParamMap.items()}
    about = {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version}
    forest_only = ("numTrees", "bootstrap", "featureSubsetStrategy", "subsamplingRate")
    of_tree = [{c: v for c, v in m.items() if c not in forest_only} for m in (given, usual)]
    whole = {"class": "org.apache.spark.ml.regression.RandomForestRegressionModel", **about, "uid": rf.uid,
             "paramMap": given, "defaultParamMap": usual, "numFeatures": n_features, "numTrees": trees}
    rows = [(i, json.dumps({"class": "org.apache.spark.ml.regression.DecisionTreeRegressionModel", **about,
                            "uid": f"dtr_{rf.uid[-12:]}_{i}", "paramMap": of_tree[0], "defaultParamMap": of_tree[1]}), 1.0)
            for i in range(trees)]
    spark.createDataFrame([(json.dumps(whole),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame(rows, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")


class GrownForest:
    """A stored forest.  Attributes other than these are those of Spark ML's model, read when first asked for."""

    def __init__(self, spark, path: str, rf, n_features: int):
        self.stored_at, self.treeWeights = path, [1.0] * rf.getNumTrees()
        self._asked, self._model = (rf, spark, path, n_features, rf.getNumTrees()), None

    def __getattr__(self, name: str):
        if name.startswith("__"):
            raise AttributeError(name)
        if self._model is None:
            from pyspark.ml.regression import RandomForestRegressionModel

            _write_about(*self._asked)
            self._model = RandomForestRegressionModel.load(self.stored_at)
        return getattr(self._model, name)


def scored(model: GrownForest, rows: DataFrame, features: str) -> DataFrame | None:
    """``rows`` with the array column ``features`` replaced by ``prediction``, the mean of all trees;
    equal neighbours are scored once.  None for a forest too large for a task."""
    spark = rows.sparkSession
    nodes = spark.read.parquet(f"{model.stored_at}/data")
    if nodes.count() > MOST_NODES:
        return None
    table = nodes.select(
        "treeID", "nodeData.id", F.col("nodeData.split.featureIndex").alias("feature"),
        F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("cut"), F.col("nodeData.leftChild").alias("left"),
        F.col("nodeData.rightChild").alias("right"), F.col("nodeData.prediction").alias("value")).toArrow()
    got = {c: table.column(c).to_numpy() for c in table.column_names}
    order = np.lexsort((got["id"], got["treeID"]))
    first = np.flatnonzero(got["id"][order] == 0)
    base = np.repeat(first, np.diff(np.append(first, len(order))))
    packed = spark.sparkContext.broadcast([
        first, *[got[c][order].astype(t) for c, t in (("feature", np.int32), ("cut", float), ("value", float))],
        *[(got[c][order] + base).astype(np.int32) for c in ("left", "right")]])
    others = [c for c in rows.columns if c != features]

    def score(batches):
        first, feature, cut, value, left, right = packed.value
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(features).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            run = np.append(True, (x[1:] != x[:-1]).any(axis=1))
            x, total = x[run], np.zeros(run.sum())
            for root in first:
                row, at = np.arange(len(x)), np.full(len(x), root)
                while len(row):
                    done = feature[at] < 0
                    total[row[done]] += value[at[done]]
                    row, at = row[~done], at[~done]
                    at = np.where(x[row, feature[at]] <= cut[at], left[at], right[at])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in others], pa.array((total / len(first))[np.cumsum(run) - 1])],
                                             [*others, "prediction"])

    from pyspark.sql import types as T

    schema = T.StructType([*[rows.schema[c] for c in others], T.StructField("prediction", T.DoubleType())])
    return rows.mapInArrow(score, schema)


def grown_forest(rf, df: DataFrame, key: Sequence[str]):
    """The model that the estimator ``rf`` (all features at every split) asks for, grown from
    cells; None where there are too many values or cells, or values that only Spark ML judges."""
    spark = df.sparkSession
    label, trees, max_depth, least = rf.getLabelCol(), rf.getNumTrees(), rf.getMaxDepth(), rf.getMinInstancesPerNode()
    seed, bootstrap = rf.getSeed(), rf.getBootstrap()
    rows = df.select(*key, F.col(label).cast("double").alias("_y"), vector_to_array(F.col(rf.getFeaturesCol())).alias("_x"))
    idx, n = stable_index(rows, key, out="_row")
    idx = idx.select("_row", "_y", "_x")
    seen = (idx.select("_y", F.posexplode("_x").alias("_f", "_v")).groupBy("_f", "_v")
               .agg(F.count(F.lit(1)).alias("n"), F.count("_y").alias("labels"), F.sum("_y").alias("total"))
               .limit(MOST_VALUES + 1).collect())
    if not seen or len(seen) > MOST_VALUES:
        return None
    if any(r["labels"] < r["n"] or not math.isfinite(r["total"]) or not math.isfinite(r["_v"]) for r in seen):
        return None
    p = 1 + max(r["_f"] for r in seen)
    cuts, bins = [], []
    for f in range(p):
        own = sorted((r["_v"], r["n"]) for r in seen if r["_f"] == f)
        cuts.append(candidate_cuts(*zip(*own), min(rf.getMaxBins(), n) - 1))
        bins.append(len(cuts[-1]) + 1)
    # labels are summed about this; rounded, so that it does not follow the order of summing
    centre = float(f"{sum(r['total'] for r in seen if r['_f'] == 0) / n:.6g}")
    code = np.uint8 if max(bins) <= 256 else np.uint32

    def to_cells(batches):
        for b in batches:
            x = b.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            codes = np.empty(x.shape, code)
            for f in range(p):
                codes[:, f] = np.searchsorted(cuts[f], x[:, f], side="left")
            yield pa.RecordBatch.from_arrays([_fixed_binary(codes), b.column("_row"), b.column("_y")], ["_cell", "_row", "_y"])

    cells_path = scratch_path(spark, "cells")
    idx.mapInArrow(to_cells, _CELL_SCHEMA).write.parquet(cells_path)
    binned = spark.read.schema(_CELL_SCHEMA).parquet(cells_path)
    if binned.select("_cell").distinct().limit(MOST_CELLS + 1).count() > MOST_CELLS:
        return None
    groups = -(-trees // GROUP_TREES)

    def to_sums(batches):
        for b in batches:
            if not b.num_rows:
                continue
            cells = _matrix(b.column("_cell"), np.uint8)
            row = b.column("_row").to_numpy()
            y = b.column("_y").to_numpy() - centre
            starts = _starts(cells)
            w = bootstrap_weights(row, trees, seed) if bootstrap else np.ones((len(row), trees), np.uint8)
            wy = w * y[:, None]
            sums = np.stack([np.add.reduceat(w, starts, axis=0, dtype=float), np.add.reduceat(wy, starts, axis=0),
                             np.add.reduceat(wy * y[:, None], starts, axis=0)], axis=1)
            cell, first = _fixed_binary(cells[starts]), pa.array(row[starts])
            for g in range(groups):
                some = sums[:, :, g * GROUP_TREES:(g + 1) * GROUP_TREES].reshape(len(starts), -1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), g, np.int32)), cell, first, _fixed_binary(some)],
                                                 ["_group", "_cell", "_start", "_sums"])

    def to_trees(batches):
        table = pa.Table.from_batches([b for b in batches if b.num_rows] or [], pa.schema([
            ("_group", pa.int32()), ("_cell", pa.binary()), ("_start", pa.int64()), ("_sums", pa.binary())]))
        group = table.column("_group").to_numpy()
        for g in np.unique(group):
            at = np.flatnonzero(group == g)
            own = table.slice(at[0], len(at))
            raw = _matrix(own.column("_cell"), np.uint8)
            starts = _starts(raw)
            sums = np.add.reduceat(_matrix(own.column("_sums"), float), starts, axis=0).reshape(len(starts), 3, -1)
            codes = np.ascontiguousarray(raw[starts]).view(code).astype(np.intp)
            nodes = grow_trees(codes, sums[:, 0], sums[:, 1], sums[:, 2], bins, max_depth, least)
            yield _node_batch(nodes, int(g) * GROUP_TREES, cuts, centre)

    path = scratch_path(spark, "grown")
    # a cell's rows meet in blocks, in order, so that sums do not depend on the input's partitions
    blocks = binned.repartition(layout_parts(n), "_cell", F.floor(F.col("_row") / BLOCK_ROWS)).sortWithinPartitions("_cell", "_row")
    (blocks.mapInArrow(to_sums, _SUM_SCHEMA).repartitionById(groups, F.col("_group"))
           .sortWithinPartitions("_group", "_cell", "_start").mapInArrow(to_trees, _NODE_SCHEMA).write.parquet(f"{path}/data"))
    return GrownForest(spark, path, rf, p)
