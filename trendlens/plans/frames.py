"""Analysis frames built from the driver tables (see FIXTURES.md section 3).

L  lineitem joined to orders: flags and priority explain price.
P  part: 25 brands, so top-10 lumping fires.
V  events: skewed ``value``.
W  per-part means of lineitem with a price std column (WLS).
J  first-child left join customer <- first order <- measurements.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendlens.roles import Roles
from trendlens.session import scratch_path

L_ROLES = Roles(categoricals=("l_returnflag", "l_linestatus", "o_orderpriority"),
                numerics=("l_quantity", "l_discount", "l_tax"),
                targets=("l_extendedprice", "net"))
P_ROLES = Roles(categoricals=("p_brand", "p_type"), numerics=("p_size",), targets=("p_retailprice",))

_NET = "l_extendedprice * (1 - l_discount) * (1 + l_tax)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus",
        "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    j = li.join(od, li.l_orderkey == od.o_orderkey, "inner").drop("o_orderkey")
    return j.withColumn("net", F.expr(_NET))


def frame_l_once(spark: SparkSession, sf_dir: str, columns: Sequence[str] | None = None) -> DataFrame:
    """L (or ``columns`` of it) for queries of several passes: joined once and
    stored under the shared folder, instead of shuffling lineitem anew in
    every pass.  ``net`` is worked out on reading."""
    wanted = list(columns) if columns is not None else frame_l(spark, sf_dir).columns
    held = [c for c in wanted if c != "net"]
    if "net" in wanted:
        held += [c for c in ("l_extendedprice", "l_discount", "l_tax") if c not in held]
    joined = frame_l(spark, sf_dir).select(*held)
    path = scratch_path(spark, "frame-l")
    joined.write.parquet(path)
    stored = spark.read.schema(joined.schema).parquet(path)
    return (stored.withColumn("net", F.expr(_NET)) if "net" in wanted else stored).select(*wanted)


def frame_l_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L with missing discounts (``nullif(l_discount, 0)``) for null handling."""
    return frame_l(spark, sf_dir).withColumn("l_discount", F.expr("nullif(l_discount, 0.0D)"))


def frame_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")


def frame_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "event_type", "value", "user_id")


def frame_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-part means; ``avg_priceStd`` makes the WLS rule fire for target
    ``avg_price``.  Parts with a single line have no std and are dropped."""
    li = table(spark, sf_dir, "lineitem")
    return (li.groupBy("l_partkey")
              .agg(F.avg("l_quantity").alias("avg_qty"),
                   F.avg("l_extendedprice").alias("avg_price"),
                   F.stddev_samp("l_extendedprice").alias("avg_priceStd"),
                   F.count(F.lit(1)).alias("n_lines"))
              .where(F.col("n_lines") >= 2))
