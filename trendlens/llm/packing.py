"""Operator 7: best-fit packing of tokenised documents into sequences.

Documents longer than a sequence are cut into full pieces, the shorter rest
first.  What is left to pack has a whole length of at most ``capacity``, so
the packing is worked out on the histogram of lengths: pieces above a third of
the capacity are matched greedily, at most two to a bin; shorter lengths then
go, longest first, into the fullest bins that still hold them.  Bins that look
alike are one group with a count, so the plan's size depends on the capacity
and never on the number of documents.  A piece finds its bin by its rank among
the pieces of its length; ranks are taken in salted slices, as many a length as
it has pieces for.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trendlens.llm.common import cut, prepare
from trendlens.llm.tokens import encoder, vocabulary_path

SLICE_ROWS = 10_000
END = 0


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple], int]:
    """Packing of ``counts[length]`` pieces.

    Returns slots ``(length, first rank, last rank + 1, first sequence, pieces
    a sequence, offset)``: rank ``r`` of a slot is in sequence ``first sequence
    + (r - first rank) // pieces`` at ``offset + ((r - first rank) % pieces) *
    length``; and the number of sequences.
    """
    left = {s: c for s, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)
    slots: list[tuple] = []
    groups: list[tuple[int, int, int]] = []   # (gap, first sequence, sequences)
    total = 0

    def take(size: int, n: int, seq: int, per: int, offset: int) -> None:
        slots.append((size, used[size], used[size] + n, seq, per, offset))
        used[size] += n
        left[size] -= n

    big = sorted((s for s in left if 3 * s > capacity), reverse=True)
    for a in big:
        while left[a]:
            b = next((s for s in big if s <= min(a, capacity - a) and left[s] > (s == a)), None)
            if b is None:
                n, gap = left[a], capacity - a
                take(a, n, total, 1, 0)
            elif b == a:
                n, gap = left[a] // 2, capacity - 2 * a
                take(a, 2 * n, total, 2, 0)
            else:
                n, gap = min(left[a], left[b]), capacity - a - b
                take(a, n, total, 1, 0)
                take(b, n, total, 1, a)
            groups.append((gap, total, n))
            total += n
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        groups.sort()
        rest: list[tuple[int, int, int]] = []
        for gap, seq, n in groups:
            per = gap // s
            if not left[s] or not per:
                rest.append((gap, seq, n))
                continue
            full = min(n, left[s] // per)
            if full:
                take(s, full * per, seq, per, capacity - gap)
                rest.append((gap - per * s, seq, full))
            if full < n and left[s]:
                few = left[s]
                take(s, few, seq + full, few, capacity - gap)
                rest.append((gap - few * s, seq + full, 1))
                full += 1
            if full < n:
                rest.append((gap, seq + full, n - full))
        per = capacity // s
        if left[s]:
            full, few = divmod(left[s], per)
            if full:
                take(s, full * per, total, per, 0)
                rest.append((capacity - per * s, total, full))
                total += full
            if few:
                take(s, few, total, few, 0)
                rest.append((capacity - few * s, total, 1))
                total += 1
        groups = [g for g in rest if g[0] > 0]
    return slots, total


def _pieces(path: str, capacity: int):
    """Token pieces of every document: where each begins, how long it is, and
    the checksum of its ids."""
    def run(batches):
        enc = encoder(path)
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            ids = batch.column(0)
            row, nth, start, length, crc = [], [], [], [], []
            for i, _, b in enc.encode_all(batch.column(1)):
                b += end
                n = len(b) // 4
                at = 0
                for k in range(-(-n // capacity)):
                    size = (n - 1) % capacity + 1 if k == 0 else capacity
                    row.append(i)
                    nth.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(memoryview(b)[4 * at:4 * (at + size)]))
                    at += size
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(row, pa.int64())), pa.array(nth, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def pack(df: DataFrame, id_col: str, text_col: str, capacity: int = 2048, path: str | None = None) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32,
    sequence_id, offset``.

    A null or empty text is the end id alone.  Repeated rows are documents of
    their own (equal rows are interchangeable), a null id stays null, ties in
    length go by a hash of the piece.  An empty table gives an empty result;
    other columns are ignored.
    """
    spark = df.sparkSession
    prepare(spark)
    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shape = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = cut(src.mapInArrow(_pieces(path or vocabulary_path(), capacity), shape), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots, _ = plan(counts, capacity)                   # at most ``capacity`` counts; a few slots each
    slices = spark.createDataFrame([(size, -(-n // SLICE_ROWS)) for size, n in sorted(counts.items())],
                                   "length long, slices long")
    tie = F.xxhash64("doc_id", "piece", "ids_crc32")
    salted = pieces.join(F.broadcast(slices), "length").withColumn("slice", F.pmod(tie, "slices").cast("int")).drop("slices")
    sizes = salted.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("length", "slice", (F.sum("n").over(
        Window.partitionBy("length").orderBy("slice")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "slice").orderBy(
        F.xxhash64("doc_id", "piece", "ids_crc32"), "doc_id", "piece", "ids_crc32")) - 1
    # one row a length and another for every ``SLICE_ROWS`` pieces: sorting both sides for them costs memory
    ranked = (salted.withColumn("rank", rank).join(F.broadcast(before), ["length", "slice"])
              .withColumn("rank", F.col("rank") + F.col("before")))
    table = spark.createDataFrame(slots, "length long, lo long, hi long, seq long, per long, at long")
    p, s = ranked.alias("p"), F.broadcast(table).alias("s")
    j = p.join(s, F.expr("p.length = s.length and p.rank >= s.lo and p.rank < s.hi"))
    return j.select("p.doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32",
                    F.expr("s.seq + (p.rank - s.lo) div s.per").alias("sequence_id"),
                    F.expr("s.at + ((p.rank - s.lo) % s.per) * p.length").alias("offset"))
