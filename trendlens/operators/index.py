"""Stable contiguous row index and k-fold assignment.

A global ``row_number()`` window would pull every row into one partition.
Instead: range-partition by the key, sort inside partitions, number the rows
there, and write that copy to the shared checkpoint folder.  Range bounds are
sampled anew whenever such a plan runs, so counts and rows must come from one
stored copy; offsets are the prefix sum of its per-partition counts (one small
row per partition).  The index is the rank in key order, whatever the bounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendlens.session import scratch_path

_POS_BITS = 33


def stable_index(df: DataFrame, key: Sequence[str], out: str = "row_idx",
                 num_partitions: int | None = None) -> tuple[DataFrame, int]:
    """Add a 0-based contiguous index in ``key`` order; returns (df, n)."""
    spark = df.sparkSession
    n_parts = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # tie-breaker: a hash of the whole row, so a key holding many rows is
    # split across range partitions (identical rows are interchangeable)
    tie = F.xxhash64(*[F.col(c) for c in df.columns]).alias("_tie")
    order = [*key, "_tie"]
    path = scratch_path(spark, "index")
    (df.withColumn("_tie", tie).repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
       .withColumn("_mid", F.monotonically_increasing_id()).drop("_tie").write.parquet(path))
    ordered = spark.read.parquet(path)
    pid = F.shiftright(F.col("_mid"), _POS_BITS)
    counts = ordered.groupBy(pid.alias("_pid")).count().collect()  # one row per partition
    offsets, run = [], 0
    for r in sorted(counts, key=lambda r: r["_pid"]):
        offsets.append((int(r["_pid"]), run))
        run += int(r["count"])
    off = spark.createDataFrame(offsets or [(0, 0)], "_pid long, _off long")
    pos = F.col("_mid") - F.shiftleft(pid, _POS_BITS)
    idx = (ordered.join(F.broadcast(off), pid == off["_pid"], "inner")
                  .withColumn(out, F.col("_off") + pos).drop("_mid", "_pid", "_off"))
    return idx, run


def kfold(df: DataFrame, key: Sequence[str], k: int = 5, out: str = "fold") -> DataFrame:
    """Contiguous unshuffled folds in key order: the first n mod k folds get
    one extra row (same sizes as ``ntile(k)``)."""
    idx, n = stable_index(df, key)
    q, r = divmod(n, k)
    i = F.col("row_idx")
    big = r * (q + 1)
    fold = F.when(i < F.lit(big), F.floor(i / F.lit(q + 1))).otherwise(
        F.lit(r) + F.floor((i - F.lit(big)) / F.lit(max(q, 1))))
    return idx.withColumn(out, fold.cast("int"))
