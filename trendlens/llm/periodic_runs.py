"""Operator 13: periodic runs by Baier's grouping.

A run is a maximal stretch of words with a smallest period.  Every run of
exponent two or more holds a Lyndon root that is the longest Lyndon word at its
place under one of two opposite orders of the words.  ``lyndon_groups`` is the
first phase of Baier's suffix sorter: positions start grouped by their word;
groups are taken from the greatest down, and the Lyndon word of each member is
absorbed by the word that ends in front of it when that one is in a lower
group, which then splits by how often it absorbed.  At the end a position's
length is its entry of the Lyndon array, and equal groups are equal words, so
a root followed by its own copy is seen from the groups alone.  Such roots are
extended to both sides by longest common extensions.

Words are compared by their 64-bit hashes, whose order is the order of words.
A run with exponent ``min_exponent`` or more (at least 2) repeats each of its
short windows, so only stretches covered by windows found twice in their text
are grouped at all; the rest can hold no run that is asked for.  Texts are
worked on in chunks (see ``common``); memory follows a chunk or the longest
text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendlens.llm.common import bucket_of, chunks, prepare, span_hash, word_bounds

RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"
SPACES = r"[\x20\x09-\x0D]+"

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def lyndon_groups(order: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length of the longest Lyndon word at every position, and its group (equal
    groups: equal words).  ``order`` ranks the letters densely from 0; ``opens``
    lists the positions where a new string begins, which no word crosses."""
    n = len(order)
    by_letter = np.argsort(order, kind="stable")
    n_letters = int(order.max()) + 1 if n else 0
    edges = np.searchsorted(order[by_letter], np.arange(n_letters + 1)).tolist()
    placed = by_letter.tolist()
    members = [placed[edges[k]:edges[k + 1]] for k in range(n_letters)]
    below = list(range(-1, n_letters - 1))
    above = list(range(1, n_letters + 1))
    size = [1] * n_letters                      # words in a group's Lyndon word
    group = order.tolist()
    before = list(range(-1, n))                 # the open word that ends in front of a position
    final, wall = bytearray(n), bytearray(n + 1)
    wall[n] = 1
    for i in opens.tolist():
        before[i], wall[i] = -1, 1

    g = n_letters - 1
    while g >= 0:
        here = [i for i in members[g] if group[i] == g]
        members[g] = here
        u = size[g]
        took: dict[int, int] = {}
        for i in here:
            j = before[i]
            if j >= 0 and group[j] != g and not final[j]:
                took[j] = took.get(j, 0) + 1
                if not wall[i + u]:
                    before[i + u] = j
        for i in here:
            final[i] = 1
        split: dict[tuple[int, int], list[int]] = {}
        for j, times in took.items():
            split.setdefault((times, group[j]), []).append(j)
        # a group's splits stand above it, those that absorbed more often higher
        for times, h in sorted(split, reverse=True):
            new, up = len(members), above[h]
            members.append(split[times, h])
            for j in members[new]:
                group[j] = new
            size.append(size[h] + times * u)
            below.append(h)
            above.append(up)
            below[up], above[h] = new, new
        g = below[g]
    return np.array([size[k] for k in group], np.int64), np.array(group, np.int64)


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the longest common prefix of two views."""
    n, done, step = min(len(x), len(y)), 0, 64
    while done < n:
        m = min(step, n - done)
        differ = x[done:done + m] != y[done:done + m]
        k = int(differ.argmax())
        if differ[k]:
            return done + k
        done, step = done + m, step * 4
    return n


def runs_of(words: np.ndarray, opens: np.ndarray, min_length: int, min_exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of several strings laid end to end
    (each begins at one of ``opens``), by start, then period."""
    n = len(words)
    if n == 0:
        return []
    order = np.unique(words, return_inverse=True)[1]
    string = np.zeros(n, np.int64)
    string[opens[1:]] = 1
    string = np.cumsum(string)
    edge = np.append(opens, n)
    found = set()
    for rank in (order, order.max() - order):
        size, group = lyndon_groups(rank, opens)
        after = np.minimum(np.arange(n) + size, n - 1)
        square = (np.arange(n) + size < n) & (group[after] == group) & (string[after] == string)
        root = np.flatnonzero(square)
        root = root[np.argsort(size[root], kind="stable")]
        last, end = 0, 0
        for i, p, s in zip(root.tolist(), size[root].tolist(), string[root].tolist()):
            if p == last and i + 2 * p <= end:
                continue                        # within the run extended before
            lo, hi = int(edge[s]), int(edge[s + 1])
            start = i - _common(words[lo:i][::-1], words[lo:i + p][::-1])
            end = i + 2 * p + _common(words[i + 2 * p:hi], words[i + p:hi])
            last = p
            if end - start >= max(min_length, min_exponent * p):
                found.add((start, end - start, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _window_size(min_length: int, min_exponent: int) -> int:
    """The widest window (8 words at most) of which every run has each twice."""
    least = min(max(min_length, min_exponent * q) - 2 * q + 1 for q in range(1, min_length + 2))
    return max(1, min(len(_ODD), least))


def repeated_stretches(words: np.ndarray, text: np.ndarray, k: int) -> np.ndarray:
    """Positions covered by a window of ``k`` words that is found twice in its text."""
    m = len(words) - k + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        key = text[:m].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
        for i in range(k):
            key += words[i:i + m] * _ODD[i]
    at = np.flatnonzero(text[:m] == text[k - 1:])
    key = key[at]
    s = np.sort(key)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if len(twice) == 0:
        return np.zeros(0, np.int64)
    near = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    first = at[twice[near] == key]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + k, -1)
    return np.flatnonzero(np.cumsum(edge)[:-1] > 0)


def chunk_runs(words: np.ndarray, per: np.ndarray, min_length: int, min_exponent: int) -> list[tuple[int, int, int, int]]:
    """(text, start word, length, period) of every run of a chunk of texts."""
    text = np.repeat(np.arange(len(per) - 1), per[1:] - per[:-1])
    at = repeated_stretches(words, text, _window_size(min_length, min_exponent))
    opens = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (text[at[1:]] != text[at[:-1]])])[:len(at)])
    out = []
    for start, length, p in runs_of(words[at], opens, min_length, min_exponent):
        t = int(text[at[start]])
        out.append((t, int(at[start] - per[t]), length, p))
    return out


def _joined(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray, n: int) -> pa.StringArray:
    """For every text its words (given as spans) joined by one space."""
    size = ends - starts + 1
    at = np.cumsum(size) - size
    total = int(size.sum())
    src = np.repeat(starts - at, size) + np.arange(total, dtype=np.int64)
    out = buf[np.minimum(src, max(0, len(buf) - 1))] if total else np.zeros(0, np.uint8)
    out[at + size - 1] = 0x20
    keep = np.ones(total, bool)
    last = np.flatnonzero(np.append(text[1:] != text[:-1], True)[:len(text)])
    keep[(at + size - 1)[last]] = False
    length = np.bincount(text, weights=size, minlength=n).astype(np.int64)
    length[text[last]] -= 1
    off = np.zeros(n + 1, np.int32)
    np.cumsum(length, out=off[1:])
    return pa.StringArray.from_buffers(n, pa.py_buffer(off.tobytes()), pa.py_buffer(out[keep].tobytes()))


def _find(min_length: int, min_exponent: int):
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches):
        for batch in batches:
            for lo, hi, buf, off in chunks(batch.column(1)):
                starts, ends, per = word_bounds(buf, off)
                found = chunk_runs(span_hash(buf, starts, ends, lower=False), per, min_length, min_exponent)
                rows: list[list] = [[] for _ in range(hi - lo)]
                drop = np.zeros(len(starts) + 1, np.int64)
                for t, start, length, p in found:
                    rows[t].append({"start": start, "length": length, "period": p})
                    drop[per[t] + start + p] += 1
                    drop[per[t] + start + length] -= 1
                kept = np.flatnonzero(np.cumsum(drop)[:-1] == 0)
                text = np.repeat(np.arange(hi - lo), per[1:] - per[:-1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(rows, pa.list_(kind)),
                     _joined(buf, starts[kept], ends[kept], text[kept], hi - lo)], ["doc_id", "runs", "collapsed"])
    return run


def periodic_runs(df: DataFrame, id_col: str, text_col: str, min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """Runs of words and the text without their repeats: ``doc_id``, ``runs``
    (start word from 0, length in words, period; by start, then period) and
    ``collapsed``, the kept words joined by one space.

    A run has at least ``min_length`` words and ``min_exponent`` (3 or more)
    periods.  A word is dropped if a run holds it after that run's first
    period.  A null text is empty; a text without words has no run and an
    empty ``collapsed``.  Every row is worked on by itself, so repeated rows and
    null ids keep their own rows, and an empty table gives an empty result.
    Other columns of ``df`` do not pass through.
    """
    if min_exponent < 3 or min_length < 1:
        raise ValueError("min_exponent must be 3 or more and min_length positive")
    prepare(df.sparkSession)
    src = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(_find(min_length, min_exponent), f"doc_id {kind}, runs {RUN}, collapsed string")


def periodic_report(df: DataFrame, id_col: str, text_col: str, **kw) -> DataFrame:
    """Digest of ``periodic_runs`` by document: number of runs, the run of the
    greatest exponent (ties: smallest start, then period; nulls without a run)
    and hashes of all runs and of the collapsed text."""
    top = F.expr(f"""aggregate(runs, cast(null as struct<start:bigint,length:bigint,period:bigint>),
        (a, r) -> if(a is null or r.length * a.period > a.length * r.period, r, a))""")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    found = periodic_runs(df, id_col, text_col, **kw)
    return found.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def with_periodic_tails(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``df`` with the text of every tenth document (by crc32 of its id) made
    periodic from word ``a`` on: word ``i`` becomes word ``a + (i - a) % p``."""
    h = bucket_of(id_col)
    words = F.filter(F.split(F.col(text_col), SPACES), lambda w: w != "")
    g = F.floor(h / 10)
    some = df.withColumn("_w", F.when(h % 10 == 0, words))
    some = some.withColumn("_n", F.size("_w"))
    some = some.withColumn("_a", F.when(F.col("_n") > 0, F.pmod(g, F.col("_n"))))
    some = some.withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + g % 8)))
    tail = F.expr("transform(slice(_w, cast(_a + 1 as int), _n), (w, i) -> _w[cast(_a + i % _p as int)])")
    text = F.when(F.col("_n") > 0, F.array_join(F.concat(F.expr("slice(_w, 1, cast(_a as int))"), tail), " "))
    return some.withColumn(text_col, F.coalesce(text, F.col(text_col))).drop("_w", "_n", "_a", "_p")
