"""Shared helpers of the corpus operators: lineage cuts on shared storage and
vectorised work on the bytes of whole texts.

Text kernels read the UTF-8 buffer of an Arrow string column directly and
handle it in chunks of at most ``CHUNK_BYTES`` (a longer text is a chunk of its
own), so a task's memory follows the chunk and the longest text, not its
partition.  Words are maximal runs of bytes other than 0x20 and 0x09-0x0D.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendlens.session import checkpoint_dir, scratch_path, ship_package

CHUNK_BYTES = 1 << 20
WORD = r"[^\x20\x09-\x0D]+"

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def prepare(spark: SparkSession) -> None:
    """Ship the package, know the shared folder, keep Arrow batches small."""
    checkpoint_dir(spark)
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: lineage
    ends in files that outlive any executor, and the shuffle files behind it
    go as soon as it is written."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def bucket_of(id_col: str) -> Column:
    """crc32 of the id written as text (null ids: of the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with ``value`` as column ``name``, computed once a row: a generator
    keeps later filters and lambdas from taking in the expression itself."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (a bijection), elementwise on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_GOLD = 0x9E3779B97F4A7C15
with np.errstate(over="ignore"):
    _BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_GOLD))
_BYTE_LOWER = _BYTE[_LOWER]
_POWER = np.uint64(0xD6E8FEB86659FD93)  # odd, so every power is invertible mod 2^64


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield ``(lo, hi, bytes, offsets)`` for runs of rows of a string column
    (null as empty); offsets are relative to the chunk's bytes."""
    arr = column.cast(pa.large_string())
    n = len(arr)
    if n == 0:
        return
    if arr.null_count:
        arr = arr.fill_null("")
    bufs = arr.buffers()
    off = np.frombuffer(bufs[1], dtype=np.int64)[arr.offset: arr.offset + n + 1]
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + CHUNK_BYTES, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


def word_bounds(buf: np.ndarray, off: np.ndarray):
    """Word starts, word ends (exclusive) and, for each text i, the word range
    ``per[i]:per[i + 1]``."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    inside = ~_SPACE[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    s = off[:-1][off[:-1] < n]
    first[s] = inside[s]
    e = off[1:][off[1:] > 0] - 1
    last[e] = inside[e]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hash of every byte span (spans are in order and do not overlap;
    empty spans hash alike)."""
    out = np.zeros(len(starts), np.uint64)
    size = ends - starts
    full = np.flatnonzero(size > 0)
    if len(full) == 0:
        return mix(out)
    ln = size[full]
    at = np.cumsum(ln) - ln
    pos = np.arange(int(ln.sum()), dtype=np.int64) - np.repeat(at, ln)
    src = pos + np.repeat(starts[full], ln)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(ln.max()), _POWER, np.uint64))
        val = (_BYTE_LOWER if lower else _BYTE)[buf[src]] * power[pos]
        out[full] = np.add.reduceat(val, at) + ln.astype(np.uint64)
        return mix(out)


def window_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive word hashes (order matters)."""
    m = len(words) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.full(m, np.uint64(k), np.uint64)
        for i in range(k):
            h = mix(h * np.uint64(_GOLD) + words[i:i + m])
        return h


def sequence_hash(words: np.ndarray) -> np.uint64:
    """Hash of a whole short sequence of word hashes."""
    return window_hash(words, len(words))[0]


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """A list column from one array per row."""
    off = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=off[1:])
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat, type=kind))
