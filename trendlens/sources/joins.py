"""Extraction joins.

``first_child_left_join`` is the shipped extraction query's shape: every
parent row, its FIRST bridge row (SQL ``LIMIT 1`` without ORDER BY, fixed
here as the minimum bridge id), and each measurement table left-joined on
that bridge id with an extra ``ON`` predicate filtering the right side.
The first-child choice is a ``min`` aggregate (partial aggregation on the
map side, so a parent with a third of all bridge rows costs nothing extra);
join strategy is left to AQE, which broadcasts a side only when its
measured size is under the threshold.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendlens.session import scratch_path

HOT_ROWS = 1_000_000  # a key is hot when its rows alone exceed one task's worth


def hot_keys(right: DataFrame, key: str, min_rows: int = HOT_ROWS) -> DataFrame:
    """``_hot, _buckets``: keys with more than ``min_rows`` rows on the right
    side and the number of salts that brings each below it.

    One exact, key-only aggregate (map-side partial counts).  A null key
    matches nothing and is never hot.
    """
    counts = right.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_hot")).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") > F.lit(min_rows)).select(
        "_hot", F.ceil(F.col("_n") / F.lit(min_rows)).cast("int").alias("_buckets"))


def salted_left_join(left: DataFrame, right: DataFrame, lkey: str, rkey: str,
                     hot: DataFrame | None = None, min_rows: int = HOT_ROWS) -> DataFrame:
    """LEFT JOIN that stays balanced when a few keys hold a large share of
    the right side.

    Rows of hot keys are split: the right side gets a salt below the key's
    ``_buckets`` from a hash of its columns, the (few) left rows of hot keys are
    replicated once per salt, and the two are INNER joined on (key, salt) --
    every right row meets exactly one replica, and a hot key always has a
    match, so no pair is lost or duplicated.  Everything else, null keys
    included, is a plain left join.  Hot keys stay a table, stored once and
    joined.  AQE's skew handling covers the left side; this covers the right
    side, which AQE cannot split for a left outer join.
    """
    spark = left.sparkSession
    path = scratch_path(spark, "hot-keys")
    (hot_keys(right, rkey, min_rows) if hot is None else hot).write.parquet(path)
    hot = spark.read.parquet(path)
    if hot.isEmpty():
        return left.join(right, left[lkey] == right[rkey], "left")
    lw = left.join(hot, left[lkey] == hot["_hot"], "left_anti")
    rw = right.join(hot, right[rkey] == hot["_hot"], "left_anti")
    plain = lw.join(rw, lw[lkey] == rw[rkey], "left")
    salt_r = right.join(hot, right[rkey] == hot["_hot"]).withColumn(
        "_salt_r", F.pmod(F.xxhash64(*[right[c] for c in right.columns]), F.col("_buckets"))).drop("_hot", "_buckets")
    salt_l = left.join(hot, left[lkey] == hot["_hot"]).withColumn(
        "_salt_l", F.explode(F.expr("sequence(0, _buckets - 1)"))).drop("_hot", "_buckets")
    hot_part = salt_l.join(salt_r, (salt_l[lkey] == salt_r[rkey]) & (salt_l["_salt_l"] == salt_r["_salt_r"]),
                           "inner").drop("_salt_l", "_salt_r")
    return plain.union(hot_part)  # same column order: left columns, then right columns


@dataclass
class Measurement:
    table: DataFrame
    key: str                      # bridge-id column in the measurement table
    columns: Sequence[str]        # columns to bring (renamed by ``aliases``)
    keep_when: Column | None = None   # ON-predicate on the right side (e.g. NOT ignore)
    aliases: Sequence[str] | None = None


def first_child(bridge: DataFrame, parent_key: str, child_id: str, out: str = "first_child") -> DataFrame:
    """One bridge id per parent (the minimum)."""
    return bridge.groupBy(parent_key).agg(F.min(child_id).alias(out))


def left_join_flag(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                   keep_when: Column | None = None) -> DataFrame:
    """LEFT JOIN right ON left_key = right_key AND <keep_when on right>.

    The extra predicate filters the right side before the join, which is
    the same as putting it in ``ON`` for a left join (unmatched left rows
    survive with NULLs) and lets it reach the right side's scan.
    """
    r = right.where(keep_when) if keep_when is not None else right
    return salted_left_join(left, r, left_key, right_key)


def first_child_left_join(parent: DataFrame, parent_id: str, bridge: DataFrame, bridge_parent: str,
                          bridge_id: str, measurements: Sequence[Measurement],
                          not_null: Sequence[str] = ()) -> DataFrame:
    """A3: parent <- first bridge row <- measurements (left joins)."""
    fc = first_child(bridge, bridge_parent, bridge_id, "_first")
    out = parent.join(fc, parent[parent_id] == fc[bridge_parent], "left").drop(bridge_parent)
    for i, m in enumerate(measurements):
        names = list(m.aliases or m.columns)
        r = m.table.where(m.keep_when) if m.keep_when is not None else m.table
        r = r.select(F.col(m.key).alias(f"_k{i}"), *[F.col(c).alias(a) for c, a in zip(m.columns, names)])
        out = salted_left_join(out, r, "_first", f"_k{i}").drop(f"_k{i}")
    for c in not_null:
        out = out.where(F.col(c).isNotNull())
    return out.withColumnRenamed("_first", "first_child")
