"""Operator 2: approximate nearest neighbours on a robust-pruned directed graph.

Distinct vectors are dealt by hash over shards of at most about ``SHARD_BYTES``
of vectors, edges and ids, so wider vectors make smaller shards.  Each shard
builds its own graph (after Subramanya et al., 2019): greedy beam
searches propose neighbours for a batch of points, and a candidate is kept
unless a nearer kept one is ``alpha`` times closer to it than the point is, so
edges stay diverse; kept edges are also offered backwards.  Every query is
searched by beam in every shard and the shards' best are merged.

The largest inner product is the nearest point once each vector gets one more
coordinate that makes all norms equal.  Searches run in single precision;
scores are inner products of the original vectors in double precision.

Rows with equal vectors are one point of a graph that carries its ``k + 1``
smallest ids, more than any answer can use.  A task holds the blocks of one
group of queries with their best answers so far, and reads a group of shards
one at a time: vectors are copied once a group of queries, queries once a
group of shards, and what is written is ``k`` rows a query and group of
shards.  No task holds all vectors or all queries.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trendlens.llm.common import cut, prepare

SHARD_BYTES = 16 << 20      # of one shard in a task's memory
BLOCK_ROWS = 512
TASK_BLOCKS = 32            # blocks of queries a task holds at most
TASK_SHARDS = 16            # shards a task reads at most, one at a time
DEGREE = 40
BUILD_BEAM = 80
BEAM = 128
ALPHA = 1.2


def _lift(x: np.ndarray) -> np.ndarray:
    """One more coordinate: all points then have the norm of the longest."""
    sq = (x * x).sum(1)
    return np.column_stack([x, np.sqrt(np.maximum(sq.max() - sq, 0.0))]).astype(np.float32)


def beam_search(points: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, beam: int):
    """Greedy beam search of a block of queries in lock-step.

    Returns the beam, nearest first (ids, squared distances; id -1 where it is
    not full) and the points each query expanded, in order (-1 where fewer)."""
    n, b = len(points), len(queries)
    rows = np.arange(b)
    ids = np.full((b, beam), -1, np.int64)
    dist = np.full((b, beam), np.inf, np.float32)
    ids[:, 0] = entry
    dist[:, 0] = ((queries - points[entry]) ** 2).sum(1)
    done = np.zeros((b, beam), bool)
    seen = np.zeros((b, n + 1), bool)
    seen[:, entry] = True
    seen[:, n] = True                        # where -1 points to
    path = []
    norm = (points * points).sum(1)
    qn = (queries * queries).sum(1)
    while True:
        open_ = ~done & (ids >= 0)
        at = open_.argmax(1)
        act = np.flatnonzero(open_[rows, at])
        if len(act) == 0:
            break
        here = np.full(b, -1, np.int64)
        here[act] = ids[act, at[act]]
        done[act, at[act]] = True
        path.append(here)
        nxt = edges[here[act]]
        old = seen[act[:, None], nxt]
        seen[act[:, None], nxt] = True
        safe = np.where(old, 0, nxt)
        d = norm[safe] + qn[act, None] - 2 * np.matmul(points[safe], queries[act][:, :, None])[:, :, 0]
        d[old] = np.inf
        all_d = np.concatenate([dist[act], d], axis=1)
        all_i = np.concatenate([ids[act], np.where(old, -1, nxt)], axis=1)
        all_f = np.concatenate([done[act], np.zeros(d.shape, bool)], axis=1)
        o = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        dist[act] = np.take_along_axis(all_d, o, 1)
        ids[act] = np.where(np.isinf(dist[act]), -1, np.take_along_axis(all_i, o, 1))
        done[act] = np.take_along_axis(all_f, o, 1)
    return ids, dist, np.stack(path, axis=1)


def robust_prune(points: np.ndarray, at: np.ndarray, cand: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """For each point, at most ``degree`` diverse edges out of its candidates (-1 pads)."""
    x = points[np.maximum(cand, 0)]
    d = ((x - points[at][:, None]) ** 2).sum(2)
    d[(cand < 0) | (cand == at[:, None])] = np.inf
    o = np.argsort(d, axis=1, kind="stable")
    d, cand, x = np.take_along_axis(d, o, 1), np.take_along_axis(cand, o, 1), np.take_along_axis(x, o[:, :, None], 1)
    sq = (x * x).sum(2)
    apart = np.maximum(sq[:, :, None] + sq[:, None, :] - 2 * np.matmul(x, x.transpose(0, 2, 1)), 0)
    alive = np.isfinite(d)
    rows = np.arange(len(at))
    out = np.full((len(at), degree), -1, np.int64)
    for r in range(degree):
        pick = alive.argmax(1)
        ok = alive[rows, pick]
        if not ok.any():
            break
        out[ok, r] = cand[ok, pick[ok]]
        alive &= ~((alpha * alpha * apart[rows, pick] <= d) & ok[:, None])
        alive[rows, pick] = False
    return out


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 2,
                batch: int = 256) -> tuple[np.ndarray, int]:
    """Edges (n x degree, -1 pads) and the entry point: one strict and one relaxed pass."""
    n = len(points)
    entry = int(((points - points.mean(0)) ** 2).sum(1).argmin())
    rng = np.random.default_rng(seed)
    if n <= degree + 1:
        full = np.array([[j for j in range(n) if j != i] for i in range(n)], np.int64).reshape(n, n - 1)
        return np.column_stack([full, np.full((n, degree - n + 1), -1)]), entry
    edges = rng.integers(0, n, (n, degree))
    for relax in (1.0, alpha):
        order = rng.permutation(n)
        for lo in range(0, n, batch):
            p = order[lo:lo + batch]
            ids, _, path = beam_search(points, edges, entry, points[p], beam)
            kept = robust_prune(points, p, np.concatenate([ids, path, edges[p]], axis=1), relax, degree)
            edges[p] = kept
            src, dst = np.repeat(p, degree), kept.reshape(-1)
            src, dst = src[dst >= 0], dst[dst >= 0]
            o = np.argsort(dst, kind="stable")
            src, dst = src[o], dst[o]
            to, first, cnt = np.unique(dst, return_index=True, return_counts=True)
            for b in range(0, len(to), batch):
                t, f, c = to[b:b + batch], first[b:b + batch], cnt[b:b + batch]
                back = np.full((len(t), int(c.max())), -1, np.int64)
                slot = np.arange(back.shape[1])[None, :] < c[:, None]
                back[slot] = np.concatenate([src[i:i + m] for i, m in zip(f, c)])
                edges[t] = robust_prune(points, t, np.concatenate([edges[t], back], axis=1), relax, degree)
    return edges, entry


_SHARD = "dim int, shard int, entry int, vectors binary, edges binary, ids binary, ids_at binary"


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("h", kind="stable")
    x = np.array(pdf["v"].tolist(), np.float64)
    edges, entry = build_graph(_lift(x))
    ids = [np.sort(np.asarray(i, np.int64)) for i in pdf["ids"]]
    at = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int64)
    return pd.DataFrame([{"dim": int(pdf["dim"].iloc[0]), "shard": int(pdf["shard"].iloc[0]), "entry": entry,
                          "vectors": x.tobytes(), "edges": edges.astype(np.int32).tobytes(),
                          "ids": np.concatenate(ids).tobytes(), "ids_at": at.tobytes()}])


def _keep_best(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple:
    """The ``k`` best distinct ids of every query row, best first."""
    o = np.lexsort((-score, ids, row))
    row, ids, score = row[o], ids[o], score[o]
    new = np.ones(len(o), bool)
    new[1:] = (row[1:] != row[:-1]) | (ids[1:] != ids[:-1])
    row, ids, score = row[new], ids[new], score[new]
    o = np.lexsort((ids, -score, row))
    row, ids, score = row[o], ids[o], score[o]
    top = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[top], ids[top], score[top]


class _Block:
    """A block of queries and the best answers found so far."""

    def __init__(self, qid: np.ndarray, q: np.ndarray):
        self.qid, self.q = qid, q
        self.lifted = np.column_stack([q, np.zeros(len(q))]).astype(np.float32)
        self.best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def meet(self, points, x, edges, entry, ids, at, k: int, beam: int) -> None:
        found, _, _ = beam_search(points, edges, entry, self.lifted, max(beam, k + 1))
        row, slot = np.nonzero(found >= 0)
        p = found[row, slot]
        score = np.empty(len(p))
        step = max(1, (1 << 21) // x.shape[1])
        for lo in range(0, len(p), step):
            part = slice(lo, lo + step)
            score[part] = (x[p[part]] * self.q[row[part]]).sum(1)
        size = at[p + 1] - at[p]
        end = np.cumsum(size)
        own = ids[np.arange(int(size.sum())) + np.repeat(at[p] - (end - size), size)]
        row, score = np.repeat(row, size), np.repeat(score, size)
        ok = own != self.qid[row]
        self.best = _keep_best(*(np.concatenate([old, new]) for old, new in
                                 zip(self.best, (row[ok], own[ok], score[ok]))), k)


def _search(k: int, beam: int):
    """Rows of one task come as blocks of queries first, then shards."""
    def answers(blocks):
        for b in blocks:
            row, own, score = b.best
            yield pd.DataFrame({"query_id": b.qid[row], "vec_id": own, "score": score})

    def run(frames):
        task, blocks = None, []
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                if r.task != task:
                    yield from answers(blocks)
                    task, blocks = r.task, []
                if r.part < 0:
                    blocks.append(_Block(np.frombuffer(r.ids, np.int64), np.frombuffer(r.vectors, np.float64).reshape(-1, r.dim)))
                    continue
                x = np.frombuffer(r.vectors, np.float64).reshape(-1, r.dim)
                points, edges = _lift(x), np.frombuffer(r.edges, np.int32).reshape(len(x), -1).astype(np.int64)
                ids, at = np.frombuffer(r.ids, np.int64), np.frombuffer(r.ids_at, np.int64)
                for b in blocks:
                    b.meet(points, x, edges, r.entry, ids, at, k, beam)
        yield from answers(blocks)
    return run


def _pack_block(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("vec_id", kind="stable")
    return pd.DataFrame([{"dim": int(pdf["dim"].iloc[0]), "block": int(pdf["block"].iloc[0]),
                          "ids": pdf["vec_id"].to_numpy(np.int64).tobytes(),
                          "vectors": np.array(pdf["v"].tolist(), np.float64).tobytes()}])


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v`` (doubles) without rows that cannot take part."""
    v = F.col("v")
    return (df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
            .where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)
                   & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
                   & F.exists(v, lambda x: x != 0.0)))


def nearest(df: DataFrame, id_col: str, vector_col: str, queries: DataFrame, k: int = 20,
            beam: int = BEAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` found nearest rows of ``df``
    by inner product for each row of ``queries`` (same columns), nearest first,
    ties to the smaller id, a row of the query's own id left out.

    Rows with a null id or a vector that is null, empty, zero or holds null or
    non-finite components take no part, as row or query.  Vectors meet those of
    their own length.  An id that repeats is answered once, with its best
    score.  Empty tables give an empty result; other columns are ignored.
    What is found depends on ``shard_bytes`` and the rows, not on the cluster.
    """
    spark = df.sparkSession
    prepare(spark)
    rows = valid_vectors(df, id_col, vector_col)
    ranked = rows.distinct().withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id")))
    points = cut(ranked.where(F.col("r") <= k + 1).groupBy("v").agg(F.collect_list("vec_id").alias("ids"))
                 .withColumn("dim", F.size("v")).withColumn("h", F.xxhash64("v")), "points")
    asked = cut(valid_vectors(queries, id_col, vector_col).distinct().withColumn("dim", F.size("v")), "queries")
    held, wanted = ({r["dim"]: r["n"] for r in t.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
                    for t in (points, asked))
    layout = _layout(held, wanted, k, shard_bytes, spark.sparkContext.defaultParallelism)
    sizes = F.broadcast(spark.createDataFrame(layout, _LAYOUT))       # a row a vector length
    n_shards, n_tasks = sum(r[1] for r in layout), sum(r[3] * r[5] for r in layout)
    dealt = points.join(sizes, "dim").withColumn("shard", F.pmod("h", F.col("shards")).cast("int"))
    # a shard a task, by its number: hashes of few numbers would put several in one
    shards = cut(dealt.withColumn("nth", F.col("first_shard") + F.col("shard"))
                 .select("dim", "shard", "nth", "h", "v", "ids").repartitionById(max(1, n_shards), F.col("nth"))
                 .groupBy("nth").applyInPandas(_build, _SHARD), "shards")
    blocks = (asked.join(sizes, "dim").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
              .groupBy("dim", "block").applyInPandas(_pack_block, "dim int, block int, ids binary, vectors binary"))
    group = F.col("first_task") + F.col("s") * F.col("block_groups") + F.col("b")
    empty = F.lit(None).cast("binary")
    sent = blocks.join(sizes, "dim").withColumn("b", F.col("block") % F.col("block_groups")).select(
        "*", F.explode(F.expr("sequence(0, shard_groups - 1)")).alias("s")).select(
        group.cast("int").alias("task"), F.lit(-1).alias("part"), "dim", F.lit(0).alias("entry"), "vectors",
        empty.alias("edges"), "ids", empty.alias("ids_at"))
    met = shards.join(sizes, "dim").withColumn("s", F.col("shard") % F.col("shard_groups")).select(
        "*", F.explode(F.expr("sequence(0, block_groups - 1)")).alias("b")).select(
        group.cast("int").alias("task"), F.col("shard").alias("part"), "dim", "entry", "vectors", "edges", "ids", "ids_at")
    rows_of_tasks = (sent.unionByName(met).repartitionById(max(1, n_tasks), F.col("task"))
                     .sortWithinPartitions("task", "part"))
    found = _row_by_row(rows_of_tasks.mapInPandas(_search(k, beam), "query_id long, vec_id long, score double"), "found")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


_LAYOUT = ("dim int, shards int, blocks int, shard_groups int, first_shard int, block_groups int, first_task int")


def _layout(held: dict, wanted: dict, k: int, shard_bytes: int, slots: int) -> list[tuple]:
    """How many shards, blocks of queries and groups of both each vector
    length has.  Groups of queries shrink until there is a task for every slot
    (or every block); this moves work between tasks and changes no result."""
    out, first_shard, first_task = [], 0, 0
    for dim in sorted(set(held) & set(wanted)):
        row = 8 * dim + 4 * (dim + 1) + 8 * DEGREE + 8 * (k + 1)
        shards = -(-held[dim] * row // shard_bytes)
        blocks = -(-wanted[dim] // BLOCK_ROWS)
        shard_groups = -(-shards // TASK_SHARDS)
        block_groups = min(blocks, max(-(-blocks // TASK_BLOCKS), -(-slots // shard_groups)))
        out.append((dim, shards, blocks, shard_groups, first_shard, block_groups, first_task))
        first_shard += shards
        first_task += shard_groups * block_groups
    return out


def _row_by_row(df: DataFrame, name: str) -> DataFrame:
    """``cut`` of a plan whose Python stage gets one (large) row a batch."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, "1")
    try:
        return cut(df, name)
    finally:
        conf.set(key, before)
