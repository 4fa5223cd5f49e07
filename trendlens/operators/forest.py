"""Random forest regression (E5, E6) and its stored trees.

Training is by histogram splits, on the rows' cells (``operators.grow``) or, where
these are too many, by Spark ML's ``RandomForestRegressor`` on a fixed layout of
the rows, so that the bootstrap does not depend on how the input happened to be
split; the model is Spark ML's either way.  The fitted forest is saved under the
shared checkpoint folder and its node table read back with Spark.  ``tree_tables``
deals the trees to groups of bounded size and stores two tables: the nodes, and
one row a leaf with, for every feature on its path, the interval ``(above, upto]``
that the path allows and the product of the cover shares of its splits on that
feature.  Paths are built tree by tree in tasks; the driver sees one number a
tree.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendlens.operators.index import stable_index
from trendlens.session import scratch_path

TREES = 200
SEED = 42
MAX_DEPTH = 30             # what Spark ML allows; trees stop earlier when no split gains
GROUP_NODES = 100_000      # nodes of one tree group (about 6 MB), unless one tree has more
LAYOUT_ROWS = 4096         # rows of a training partition ...
LAYOUT_PARTS = 16          # ... until there are so many partitions, which then grow ...
LAYOUT_MOST = 300_000      # ... to so many rows before there are more


@dataclass
class Trees:
    """Stored tables of a forest: ``nodes`` and ``leaves``, both with the tree's group."""
    nodes_path: str
    leaves_path: str
    n_features: int
    n_trees: int
    n_groups: int
    n_nodes: int
    base_value: float      # expected output under the training covers
    cuts: list             # sorted thresholds of every feature (max_bins - 1 at most)

    def nodes(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.nodes_path)

    def leaves(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.leaves_path)


def layout_parts(n: int) -> int:
    """Training partitions of ``n`` rows.  In every pass each partition sends the
    split statistics of all open nodes, however few rows it has, so their
    number must not follow the rows: it stays at ``LAYOUT_PARTS`` until a partition
    would hold more than ``LAYOUT_MOST`` rows."""
    return max(1, min(LAYOUT_PARTS, -(-n // LAYOUT_ROWS)), -(-n // LAYOUT_MOST))


def laid_out(df: DataFrame, key: Sequence[str] | None, features_col: str | None = None) -> DataFrame:
    """``df`` in a layout that follows from its rows alone: blocks of the index
    in ``key`` order (all columns without a key), each block in order; with
    ``features_col`` in order of these vectors first, so that neighbours reach
    the same nodes and training finds their statistics in the processor's cache."""
    order = list(key or [c for c, t in df.dtypes if t != "vector"])
    idx, n = stable_index(df, order, out="_row")
    parts = layout_parts(n)
    block = F.floor(F.col("_row") * parts / max(1, n)).cast("int")
    alike = [vector_to_array(F.col(features_col))] if features_col else []
    return idx.repartition(parts, block).sortWithinPartitions(*alike, "_row").drop("_row")


def fit_forest(df: DataFrame, label: str, features_col: str = "features", *, trees: int = TREES,
               max_depth: int = MAX_DEPTH, seed: int = SEED, max_bins: int = 32,
               feature_subset: str = "all", min_instances: int = 1, bootstrap: bool = True,
               key: Sequence[str] | None = None):
    """E5: bootstrap forest, every feature considered at each split (the
    reference's regression forest default), grown until no split gains or
    ``max_depth`` (Spark allows 30).  A column offers at most ``max_bins`` - 1
    cuts (all midpoints when it has no more distinct values);
    ``bootstrap=False`` trains every tree on all rows.  With ``key`` rows are
    laid out in its order first, and the forest does not depend on the input's
    partitions; it is grown from the rows' cells (``operators.grow``) unless these
    are too many, or ``feature_subset`` is not all."""
    from pyspark.ml.regression import RandomForestRegressor

    rf = RandomForestRegressor(featuresCol=features_col, labelCol=label, numTrees=trees,
                               maxDepth=max_depth, seed=seed, maxBins=max_bins,
                               featureSubsetStrategy=feature_subset, bootstrap=bootstrap,
                               subsamplingRate=1.0, minInstancesPerNode=min_instances,
                               # more nodes per pass over the data; node-id cache is
                               # checkpointed to the shared folder, cutting lineage
                               maxMemoryInMB=1024, cacheNodeIds=True, checkpointInterval=10)
    from trendlens.operators.gram import spread
    from trendlens.operators.grow import grown_forest

    if key and feature_subset == "all":
        model = grown_forest(rf, df, key)
        if model is not None:
            return model
    return rf.fit(laid_out(df.select(*dict.fromkeys([label, features_col, *key])), key, features_col) if key else spread(df))


def predictions(model, df: DataFrame, features_col: str = "features") -> DataFrame:
    """The columns of ``df`` but the features, and ``prediction``.  Rows are spread over all
    tasks and lie in order of their features: neighbours pass the same nodes,
    which stay in the processor's cache."""
    from trendlens.operators import grow

    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    others = [c for c in df.columns if c != features_col]
    x = vector_to_array(F.col(features_col))
    if isinstance(model, grow.GrownForest):
        out = grow.scored(model, df.select(*others, x.alias("_x")).repartition(parts).sortWithinPartitions("_x"), "_x")
        if out is not None:
            return out
    return model.transform(df.repartition(parts).sortWithinPartitions(x)).select(*others, "prediction")


def save_model(spark: SparkSession, model, path: str | None = None) -> str:
    """Spark ML persistence under the shared folder."""
    path = path or scratch_path(spark, "forest")
    model.write().overwrite().save(path)
    return path


def load_model(path: str):
    """A model stored by ``save_model``."""
    from pyspark.ml.regression import RandomForestRegressionModel

    return RandomForestRegressionModel.load(path)


def _node_table(spark: SparkSession, path: str, weights: Sequence[float]) -> DataFrame:
    """One row a node: ``low`` is the child for values up to ``cut``.  A 0/1
    category is split at one half."""
    cut = F.col("nodeData.split.leftCategoriesOrThreshold")
    numeric = F.col("nodeData.split.numCategories") < 0
    left, right = F.col("nodeData.leftChild"), F.col("nodeData.rightChild")
    only = F.when(F.size(cut) == 1, cut[0])
    flip = ~numeric & (only == 1.0)
    at = F.when(left < 0, None).when(numeric, cut[0]).when(only.isin(0.0, 1.0), 0.5).otherwise(
        F.raise_error(F.lit("only binary categorical splits are supported")).cast("double"))
    share = F.element_at(F.array(*[F.lit(float(w) / sum(weights)) for w in weights]), F.col("treeID") + 1)
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), F.col("nodeData.id").alias("id"),
        F.when(flip, right).otherwise(left).alias("low"), F.when(flip, left).otherwise(right).alias("high"),
        F.col("nodeData.split.featureIndex").alias("feature"), at.alias("cut"),
        F.element_at("nodeData.impurityStats", 1).alias("cover"),
        F.when(left < 0, F.col("nodeData.prediction") * share).alias("value"))


LEAF_SCHEMA = ("group int, tree int, leaf int, value double, feature array<int>, above array<double>, "
               "upto array<double>, share array<double>")


def _leaf_paths(nodes: pd.DataFrame) -> pd.DataFrame:
    """Leaves of one tree, in order from low to high."""
    nodes = nodes.set_index("id")
    low, high = nodes["low"].to_dict(), nodes["high"].to_dict()
    feature, cut = nodes["feature"].to_dict(), nodes["cut"].to_dict()
    cover, value = nodes["cover"].to_dict(), nodes["value"].to_dict()
    rows, stack = [], [(0, {})]
    while stack:
        at, path = stack.pop()
        if low[at] < 0:
            f = sorted(path)
            rows.append((value[at], f, *[[path[k][i] for k in f] for i in range(3)]))
            continue
        f, c = feature[at], cut[at]
        above, upto, share = path.get(f, (-np.inf, np.inf, 1.0))
        for child, a, u in ((high[at], max(above, c), upto), (low[at], above, min(upto, c))):
            stack.append((child, {**path, f: (a, u, share * cover[child] / cover[at])}))
    out = pd.DataFrame(rows, columns=["value", "feature", "above", "upto", "share"])
    out.insert(0, "leaf", np.arange(len(out), dtype=np.int32))
    out.insert(0, "tree", np.int32(nodes["tree"].iloc[0]))
    out.insert(0, "group", np.int32(nodes["group"].iloc[0]))
    return out


def tree_tables(spark: SparkSession, model, n_features: int, path: str | None = None,
                group_nodes: int = GROUP_NODES) -> Trees:
    """Store the node and leaf tables of a fitted (or re-read) forest.

    Trees are dealt to groups of at most ``group_nodes`` nodes (a larger tree is
    a group of its own): a group is what one explaining task holds.
    """
    path = save_model(spark, model, path) if path or not hasattr(model, "stored_at") else model.stored_at
    weights = list(model.treeWeights)
    nodes = _node_table(spark, path, weights)
    sizes = {r["tree"]: r["n"] for r in nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).collect()}
    group, held, groups = 0, 0, []
    for t in range(len(weights)):
        if held and held + sizes[t] > group_nodes:
            group, held = group + 1, 0
        held += sizes[t]
        groups.append(group)
    of_tree = F.element_at(F.array(*[F.lit(g) for g in groups]), F.col("tree") + 1)
    nodes_path, leaves_path = scratch_path(spark, "nodes"), scratch_path(spark, "leaves")
    nodes.withColumn("group", of_tree).write.parquet(nodes_path)
    stored = spark.read.parquet(nodes_path)
    stored.groupBy("tree").applyInPandas(_leaf_paths, LEAF_SCHEMA).write.parquet(leaves_path)
    whole = F.aggregate("share", F.lit(1.0), lambda a, s: a * s)
    base = spark.read.parquet(leaves_path).agg(F.sum(F.col("value") * whole)).first()[0]
    cuts = [[] for _ in range(n_features)]
    for r in stored.where("low >= 0").groupBy("feature").agg(F.sort_array(F.collect_set("cut")).alias("c")).collect():
        cuts[r["feature"]] = list(r["c"])
    return Trees(nodes_path, leaves_path, n_features, len(weights), group + 1, sum(sizes.values()), float(base), cuts)


def assemble(df: DataFrame, names: Sequence[str], out: str = "features", keep: Sequence[str] = ()) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(names), outputCol=out).transform(df).select(*keep, *names, out)
