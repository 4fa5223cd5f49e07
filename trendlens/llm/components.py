"""Connected components of a link table, entirely as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendlens.llm.common import cut


def _least(edges: DataFrame) -> DataFrame:
    """Each node's least neighbour.  A ``min`` combines on the map side, so a
    node with a third of all links is no hot spot."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    return (both.join(least, "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct())


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    j = down.join(_least(down), "u")
    return (j.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(j.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``id, component`` (least reachable id) for every id in ``links``.

    Alternating large-star and small-star steps (Kiveris et al., 2014) until
    the edge table, now one star per component, no longer changes.  Each
    round is written to shared storage.  Ids are long; null ids and self
    links take no part; an empty link table gives an empty result.
    """
    e = cut(links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
            .where("u <> v").distinct(), "cc")

    def mark(t):
        r = t.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        return r[0], r[1]

    seen = mark(e)
    while seen[0]:
        e = cut(_small_star(_large_star(e)), "cc")
        now = mark(e)
        if now == seen:
            break
        seen = now
    return (e.select(F.col("u").alias("id"), F.col("v").alias("component"))
            .union(e.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct())
