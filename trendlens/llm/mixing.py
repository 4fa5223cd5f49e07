"""Operator 5: mixing sources to target weights by systematic sampling.

DataFrame operations only.  A source's target is its weighted share of all
words, stopped at ``max_repeat`` times its size, with the excess reshared by
weight.  Within a source every document has the same expected number of copies
``c = target / size``; expected copies are prefix-summed in order of document
size, one random offset per source is added, and a document is emitted once
for each integer boundary its interval crosses.  Ordering by size keeps the
words taken within about one long document of the target.

No source is gathered in one task.  The prefix sum is taken over three levels:
sizes within a source, salted slices within a size, rows within a slice; a
slice holds about ``SLICE_ROWS`` rows however many documents share a source and
a size.  The fractional part of ``c`` is held as a 30-bit integer, so intervals
meet exactly and a document gets floor(c) or ceil(c) copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trendlens.llm.common import WORD, cut, prepare

SLICE_ROWS = 20_000
ONE = 1 << 30


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_weights(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Weights dealt in turn to sources by code point, null last.

    Ranks come from range partitions (a stored copy, so partitions stay put)
    plus the number of sources in the partitions before."""
    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("source").isNull(), F.col("source")]
    placed = cut(sources.repartitionByRange(n, *[o.asc() for o in order])
                 .withColumn("_p", F.spark_partition_id()), "sources")
    before = placed.groupBy("_p").count().withColumn(
        "_before", F.sum("count").over(Window.orderBy("_p")) - F.col("count")).drop("count")  # a row a partition
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    nth = F.pmod(F.col("_rank") + F.col("_before"), F.lit(len(weights))).cast("int")
    return (placed.withColumn("_rank", rank).join(before, "_p")
            .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), nth + 1))
            .drop("_p", "_rank", "_before"))


def source_targets(sources: DataFrame, max_repeat: int) -> DataFrame:
    """Adds ``target`` to (source, source_size, weight).

    A target is ``min(max_repeat * size, level * weight)`` with one level for
    all.  The level rises by Newton steps: what the stopped sources leave,
    shared by the weight of the others, until no further source is stopped.
    Each step is one aggregate over the sources.
    """
    cap = F.col("source_size") * max_repeat
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, stopped = 0.0, -1
    while total:
        full = cap <= F.lit(level) * F.col("weight")
        used, weight, n = sources.agg(F.sum(F.when(full, cap).otherwise(0)),
                                      F.sum(F.when(full, 0.0).otherwise(F.col("weight"))),
                                      F.sum(F.when(full, 1).otherwise(0))).first()
        if n == stopped or not weight:
            break
        level, stopped = (total - used) / weight, n
    return sources.withColumn("target", F.least(cap.cast("double"), F.lit(float(level)) * F.col("weight")))


def mix_copies(df: DataFrame, text_col: str, source_col: str, id_col: str, weights: tuple[float, ...] = (5, 2, 1),
               max_repeat: int = 3, seed: int = 5, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of ``df`` (or the columns in ``keep``) plus ``_size``,
    ``_source_size``, ``_target`` and ``_copies``.

    A null text has size 0; sources with no words get target 0 and their
    documents no copies.  Null is a source of its own, ranked last.  Ties in
    size are ordered by a hash of the row; equal rows are interchangeable, so
    reruns agree.  An empty table gives an empty result.  Columns pass
    through; ones named like an output are replaced.
    """
    prepare(df.sparkSession)
    names = [c for c in (df.columns if keep is None else keep) if c not in ("_size", "_source_size", "_target",
                                                                            "_copies")]
    # positional names while working, so that no column can clash
    src = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(names)],
                    F.col(source_col).cast("string").alias("source"), words_in(F.col(text_col)).alias("size"),
                    F.xxhash64(F.lit(seed), id_col, text_col).alias("tie"))
    slices = max(1, -(-df.count() // SLICE_ROWS))
    src = src.withColumn("slice", F.pmod("tie", F.lit(slices)).cast("int"))
    counts = cut(src.groupBy("source", "size", "slice").agg(F.count(F.lit(1)).alias("n")), "cells")
    sizes = counts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    totals = cut(sizes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), "totals")
    targets = cut(source_targets(cut(source_weights(totals, weights), "weights"), max_repeat), "targets")
    before_size = F.sum("n").over(Window.partitionBy("source").orderBy("size")) - F.col("n")
    before_slice = F.sum("n").over(Window.partitionBy("source", "size").orderBy("slice")) - F.col("n")
    sizes = sizes.select("source", "size", before_size.alias("before_size"))
    slots = counts.withColumn("before", before_slice).drop("n").alias("c")
    slots = slots.join(sizes.alias("s"), F.expr("c.source <=> s.source and c.size = s.size")).selectExpr(
        "c.source", "c.size", "c.slice", "c.before + s.before_size as before")
    slots = slots.alias("c").join(targets.alias("t"), F.expr("c.source <=> t.source")).selectExpr(
        "c.*", "t.source_size", "t.target")
    ranked = src.withColumn("rank", F.row_number().over(
        Window.partitionBy("source", "size", "slice").orderBy("tie")) - 1)
    j = ranked.alias("d").join(slots.alias("q"), F.expr(
        "d.source <=> q.source and d.size = q.size and d.slice = q.slice"))
    rate = F.when(F.col("q.source_size") > 0, F.col("q.target") / F.col("q.source_size")).otherwise(0.0)
    whole = F.floor(rate)
    part = F.round((rate - whole) * ONE).cast("long")
    start = F.pmod(F.xxhash64(F.lit(seed), F.col("d.source")), F.lit(ONE))
    at = F.col("d.rank") + F.col("q.before")
    # ONE ranks move the sum by a whole number, so ranks count mod ONE and the product fits a long
    edge = start + F.pmod(at, F.lit(ONE)) * part
    crossed = F.shiftright(edge + part, 30) - F.shiftright(edge, 30)
    return j.select(*[F.col(f"d.k{i}").alias(c) for i, c in enumerate(names)], F.col("d.size").alias("_size"),
                    F.col("q.source_size").alias("_source_size"), F.col("q.target").alias("_target"),
                    (whole + crossed).cast("int").alias("_copies"))


def mix_report(df: DataFrame, id_col: str, text_col: str, source_col: str, **kw) -> DataFrame:
    m = mix_copies(df, text_col, source_col, id_col, keep=(id_col,), **kw)
    return m.select(F.col(id_col).alias("doc_id"), F.col("_size").alias("size"),
                    F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
                    (F.col("_copies") * F.col("_size")).alias("taken"), F.col("_copies").alias("copies"))


def mixed(df: DataFrame, id_col: str, text_col: str, source_col: str, **kw) -> DataFrame:
    """The mix itself: every row as often as it was drawn."""
    m = mix_copies(df, text_col, source_col, id_col, **kw)
    return (m.where("_copies > 0").withColumn("_nth", F.explode(F.expr("sequence(1, _copies)")))
            .select(*[F.col(f"`{c}`") for c in df.columns]))
