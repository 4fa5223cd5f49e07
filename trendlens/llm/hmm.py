"""Operator 4: scoring texts with a hidden Markov language model.

Counts of all words of all training texts give a unigram base.  The model
emits word classes from latent states: each of the most frequent words is a
class of its own, the end mark is one, and other words fall into classes by
their last two bytes; within such a class a word has its additive-smoothed
unigram share, which also gives unseen words a place.  Baum-Welch runs as one
job an iteration: every task computes expected counts for its texts, a sum by
class joins them, and the driver, which holds one row a class, re-estimates.
Every iteration uses all training texts.  For the expected counts a text is cut
into blocks of ``BLOCK`` tokens; scores come from the scaled forward recursion over
whole texts and are exact for the model.

Words are known to tasks by 64-bit hash.  The ``FREQUENT`` most frequent words
are sent to every task (8 bytes each and a count, a fixed bound); counts of all
other words stay in a table and are joined.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendlens.llm.common import bucket_of, chunks, cut, lists, mix, prepare, span_hash, word_bounds

FREQUENT = 1 << 19
OWN_CLASS = 1 << 14
SUFFIXES = 256
BLOCK = 128
ALPHA = 0.1
END = np.uint64(0x5EED)          # stands for the end mark; no word has this hash but by chance
HELD_OUT = 10


def _suffix(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Class of the last two bytes (A-Z lowered) of every word."""
    low = np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint64)
    last = low[ends - 1]
    before = np.where(ends - starts > 1, low[np.maximum(ends - 2, 0)], 0)
    return (mix(last * np.uint64(257) + before) % np.uint64(SUFFIXES)).astype(np.int32)


def _merge(parts):
    h = np.concatenate([p[0] for p in parts])
    u, first, inv = np.unique(h, return_index=True, return_inverse=True)
    g = np.concatenate([p[1] for p in parts])[first]
    n = np.bincount(inv, weights=np.concatenate([p[2] for p in parts]), minlength=len(u)).astype(np.int64)
    return u, g, n


def _count_words(batches):
    parts, held, texts = [], 0, 0

    def batch_of(u, g, n):
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(g), pa.array(n)], ["h", "g", "n"])

    for batch in batches:
        texts += batch.num_rows
        for _, _, buf, off in chunks(batch.column(0)):
            s, e, _ = word_bounds(buf, off)
            if len(s) == 0:
                continue
            u, first, n = np.unique(span_hash(buf, s, e, lower=True), return_index=True, return_counts=True)
            parts.append((u, _suffix(buf, s[first], e[first]), n))
            held += len(u)
            if held > 1 << 21:
                parts = [_merge(parts)]
                held = len(parts[0][0])
                if held > 1 << 20:
                    yield batch_of(*parts[0])
                    parts, held = [], 0
    if parts:
        yield batch_of(*_merge(parts))
    if texts:
        yield batch_of(np.array([END]), np.array([-1], np.int32), np.array([texts], np.int64))


def _least_count(counts: DataFrame, limit: int) -> int:
    """The least count ``c`` such that at most ``limit`` words occur ``c`` times or more."""
    sizes = counts.groupBy(F.floor(F.log2("n") * 8).alias("s")).agg(
        F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).collect()
    total, least = 0, None
    for r in sorted(sizes, key=lambda r: -r["s"]):
        total += r["k"]
        if total > limit:
            break
        least = r["least"]
    return least if least is not None else 1 << 62


@dataclass(frozen=True)
class Lexicon:
    """What tasks need to encode a text: sorted hashes of frequent words, their
    class and count; log10 of each suffix class's denominator."""

    hashes: np.ndarray
    classes: np.ndarray
    counts: np.ndarray
    own: int                     # classes 0..own-1 are single words (one of them the end mark)
    end_class: int
    log_denom: np.ndarray

    @property
    def n_classes(self) -> int:
        return self.own + SUFFIXES


def _encode(sent):
    def run(batches):
        lex: Lexicon = sent.value
        logs = np.log10(lex.counts + ALPHA)
        for batch in batches:
            seqs, tails, sums = [], [], []
            for _, _, buf, off in chunks(batch.column(2)):
                s, e, per = word_bounds(buf, off)
                h = span_hash(buf, s, e, lower=True)
                at = np.searchsorted(lex.hashes, h)
                at[at == len(lex.hashes)] = 0
                hit = lex.hashes[at] == h if len(lex.hashes) else np.zeros(len(h), bool)
                suffix = _suffix(buf, s, e) if len(s) else np.zeros(0, np.int32)
                cls = np.where(hit, lex.classes[at], -1) if len(lex.hashes) else np.full(len(h), -1)
                single = cls >= 0
                cls = np.where(single, cls, lex.own + suffix).astype(np.uint16)
                log = np.where(hit, logs[at], 0.0) if len(lex.hashes) else np.zeros(len(h))
                own = np.concatenate([[0.0], np.cumsum(log * single)])
                rest = np.concatenate([[0.0], np.cumsum(log * (hit & ~single))])
                den = np.concatenate([[0.0], np.cumsum(np.where(single, 0.0, lex.log_denom[suffix]))])
                known = np.concatenate([[0], np.cumsum(hit)])
                for a, b in zip(per[:-1], per[1:]):
                    seqs.append(np.append(cls[a:b], np.uint16(lex.end_class)).tobytes())
                    tails.append(h[a:b][~hit[a:b]].view(np.int64))
                    sums.append((b - a + 1, known[b] - known[a], own[b] - own[a], rest[b] - rest[a], den[b] - den[a]))
            t = np.array(sums, float).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(seqs, pa.binary()), lists(tails, pa.int64()),
                 pa.array(t[:, 0].astype(np.int64)), pa.array(t[:, 1].astype(np.int64)),
                 pa.array(t[:, 2]), pa.array(t[:, 3]), pa.array(t[:, 4])],
                ["doc_id", "held_out", "seq", "tail", "n_tokens", "known", "own", "rest", "denom"])
    return run


@dataclass(frozen=True)
class Hmm:
    start: np.ndarray            # states
    inner: np.ndarray            # states, at the start of a later block
    move: np.ndarray             # states x states
    emit: np.ndarray             # classes x states: P(class | state)


def _blocks(seqs: list[bytes]):
    """Blocks of BLOCK tokens: (classes, lengths, first of its text)."""
    parts, size, first = [], [], []
    for b in seqs:
        s = np.frombuffer(b, np.uint16)
        for i in range(0, len(s), BLOCK):
            parts.append(s[i:i + BLOCK])
            size.append(len(parts[-1]))
            first.append(i == 0)
    size = np.array(size)
    x = np.zeros((len(parts), BLOCK), np.uint16)
    x[np.arange(BLOCK)[None, :] < size[:, None]] = np.concatenate(parts)
    return x, size, np.array(first)


def expected_counts(model: Hmm, x: np.ndarray, size: np.ndarray, first: np.ndarray):
    """Scaled forward-backward over blocks: expected starts, moves and emissions."""
    order = np.argsort(-size, kind="stable")
    x, size, first = x[order], size[order], first[order]
    steps, k = int(size[0]), len(model.start)
    live = np.searchsorted(-size, -np.arange(1, steps + 1), side="right")   # blocks with a token at t
    alpha = np.zeros((steps, len(x), k), np.float32)
    emit = np.zeros((steps, len(x), k), np.float32)
    scale = np.ones((steps, len(x)), np.float32)
    e32, m32 = model.emit.astype(np.float32), model.move.astype(np.float32)
    begin = np.where(first[:, None], model.start, model.inner).astype(np.float32)
    for t in range(steps):
        n = live[t]
        emit[t, :n] = e32[x[:n, t]]
        a = (begin if t == 0 else alpha[t - 1, :n] @ m32) * emit[t, :n]
        c = a.sum(axis=1)
        scale[t, :n] = c
        alpha[t, :n] = a / c[:, None]
    moves = np.zeros((k, k))
    beta = np.ones((len(x), k), np.float32)
    gamma = alpha                              # overwritten from the end
    for t in range(steps - 1, 0, -1):
        n = live[t]
        w = emit[t, :n] * beta[:n] / scale[t, :n, None]
        moves += model.move * (alpha[t - 1, :n].T @ w)
        gamma[t, :n] = alpha[t, :n] * beta[:n]
        beta[:n] = w @ m32.T
    gamma[0] *= beta
    held = np.arange(steps)[:, None] < size[None, :]
    cls, g = x.T[:steps][held], gamma[held]
    counts = np.stack([np.bincount(cls, weights=g[:, i], minlength=len(model.emit)) for i in range(k)], axis=1)
    return gamma[0][first].sum(0), gamma[0][~first].sum(0), moves, counts


def _e_step(sent):
    def run(batches):
        model: Hmm = sent.value
        k, n = len(model.start), len(model.emit)
        total = np.zeros((n + k + 2, k))       # classes, then moves, then the two starts
        any_rows = False
        for batch in batches:
            seqs = batch.column(0).to_pylist()
            for lo in range(0, len(seqs), 500):
                x, size, first = _blocks(seqs[lo:lo + 500])
                for b in range(0, len(x), 4096):
                    s0, s1, mv, ct = expected_counts(model, x[b:b + 4096], size[b:b + 4096], first[b:b + 4096])
                    total[:n] += ct
                    total[n:n + k] += mv
                    total[n + k] += s0
                    total[n + k + 1] += s1
                any_rows = True
        if any_rows:
            at = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(total[at, i]) for i in range(k)]],
                                             ["cls", *[f"s{i}" for i in range(k)]])
    return run


def _first_model(states: int, unigram: np.ndarray, seed: int) -> Hmm:
    rng = np.random.default_rng(seed)
    emit = unigram[:, None] * rng.gamma(1.0, 1.0, (len(unigram), states))
    move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    even = np.full(states, 1.0 / states)
    return Hmm(even, even, move, emit / emit.sum(0))


def baum_welch(model: Hmm, seqs: DataFrame, prior: np.ndarray) -> Hmm:
    """One iteration over the sequences in column ``seq``."""
    k, n = len(model.start), len(model.emit)
    sent = seqs.sparkSession.sparkContext.broadcast(model)
    cols = [f"s{i}" for i in range(k)]
    got = (seqs.select("seq").mapInArrow(_e_step(sent), "cls long, " + ", ".join(f"{c} double" for c in cols))
           .groupBy("cls").agg(*[F.sum(c).alias(c) for c in cols]).toPandas())
    sent.unpersist()
    total = np.zeros((n + k + 2, k))
    total[got["cls"].to_numpy(int)] = got[cols].to_numpy(float)
    emit = total[:n] + prior[:, None]          # every class stays possible in every state
    move = total[n:n + k] + 1e-3
    s0, s1 = total[n + k] + 1e-3, total[n + k + 1] + 1e-3
    return Hmm(s0 / s0.sum(), s1 / s1.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def forward_log10(model: Hmm, seqs: list[bytes]) -> np.ndarray:
    """log10 probability of every whole class sequence (scaled forward)."""
    parts = [np.frombuffer(b, np.uint16) for b in seqs]
    size = np.array([len(p) for p in parts], np.int64)
    order = np.argsort(-size, kind="stable")
    flat = np.concatenate(parts)
    at = (np.cumsum(size) - size)[order]
    ordered = size[order]
    live = np.searchsorted(-ordered, -np.arange(1, ordered[0] + 1), side="right")
    log = np.zeros(len(parts))
    a = np.broadcast_to(model.start, (len(parts), len(model.start)))
    for t in range(int(ordered[0])):
        n = int(live[t])
        a = (a[:n] if t == 0 else a[:n] @ model.move) * model.emit[flat[at[:n] + t]]
        c = a.sum(axis=1)
        a = a / c[:, None]
        log[:n] += np.log10(c)
    out = np.zeros(len(parts))
    out[order] = log
    return out


def _forward(sent):
    def run(batches):
        model = sent.value
        held, tokens = [], 0

        def flush():
            seqs = [s for b in held for s in b.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([b.column(0).to_numpy() for b in held])), pa.array(forward_log10(model, seqs))],
                ["row", "hmm"])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            held.append(batch)
            tokens += batch.column(1).nbytes // 2
            if tokens > 4_000_000:             # long texts then run beside many others
                yield flush()
                held, tokens = [], 0
        if held:
            yield flush()
    return run


def hmm_scores(df: DataFrame, id_col: str, text_col: str, states: int = 8, search_passes: int = 10,
               full_passes: int = 3, seed: int = 4) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, one row per input row.

    The Baum-Welch passes are ``search_passes`` and ``full_passes`` together;
    each is over all training texts, whatever their number.

    Rows whose crc32 of the id, mod 10, is 0 are held out of learning (a null
    id counts as empty text, whose crc32 is 0).  A null or empty text is its
    end mark alone.  Repeated rows are separate texts.  With no training rows
    every token is unknown and the model is uniform.  An empty table gives an
    empty result; other columns are ignored.
    """
    spark = df.sparkSession
    prepare(spark)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), (bucket_of(id_col) % HELD_OUT == 0).alias("held_out"),
                     F.col(text_col).cast("string").alias("text"))
    counts = cut(docs.where("not held_out").select("text").mapInArrow(_count_words, "h long, g int, n long")
                 .groupBy("h").agg(F.max("g").alias("g"), F.sum("n").alias("n")), "counts")
    n_train, vocab, top = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.max("n")).first()
    least = _least_count(counts, FREQUENT)
    least_own = _least_count(counts, OWN_CLASS - 1)
    end = int(END)
    frequent = counts.where((F.col("n") >= least) | (F.col("h") == end)).toPandas().sort_values("h")
    h = frequent["h"].to_numpy(np.int64).view(np.uint64)
    c = frequent["n"].to_numpy(np.int64)
    single = (c >= least_own) | (h == END)
    classes = np.where(single, np.cumsum(single) - 1, -1)
    own = int(single.sum())
    end_class = int(classes[h == END][0]) if (h == END).any() else 0
    own = max(own, 1)
    order = np.argsort(h, kind="stable")       # unsigned order
    tail_sizes = counts.where((F.col("n") < least_own) & (F.col("h") != end)).groupBy("g").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    size, kinds = np.zeros(SUFFIXES), np.zeros(SUFFIXES)
    for r in tail_sizes:
        size[r["g"]], kinds[r["g"]] = r["n"], r["v"]
    denom = size + ALPHA * (kinds + 1)
    lex = Lexicon(h[order], classes[order], c[order], own, end_class, np.log10(denom))
    shape = ("doc_id long, held_out boolean, seq binary, tail array<long>, n_tokens long, known long, "
             "own double, rest double, denom double")
    coded = cut(docs.mapInArrow(_encode(spark.sparkContext.broadcast(lex)), shape), "coded")

    unigram = np.zeros(lex.n_classes)
    unigram[classes[single]] = c[single]
    unigram[own:] = size
    unigram += ALPHA
    prior = unigram / unigram.sum()
    model = _first_model(states, unigram, seed)
    if n_train:
        train = coded.where("not held_out")
        for _ in range(search_passes + full_passes):
            model = baum_welch(model, train, prior * len(prior))

    # rows get a number from the stored copy, whose partitions do not move
    numbered = cut(coded.withColumn("row", F.monotonically_increasing_id()), "rows")
    forward = numbered.select("row", "seq").mapInArrow(_forward(spark.sparkContext.broadcast(model)),
                                                       "row long, hmm double")
    rare = counts.where((F.col("n") < least) & (F.col("h") != end)).select("h", "n")
    tails = (numbered.select("row", F.explode("tail").alias("h")).join(rare, "h", "left").groupBy("row")
             .agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + ALPHA)).alias("tail_log"), F.count("n").alias("tail_known")))
    end_n = int(c[h == END][0]) if (h == END).any() else 0
    n = F.col("n_tokens")
    tail_log = F.coalesce("tail_log", F.lit(0.0))
    base_den = float(np.log10(n_train + ALPHA * (vocab + 1)))
    end_log = float(np.log10(end_n + ALPHA))
    return (numbered.drop("seq", "tail").join(forward, "row").join(tails, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("tail_known", F.lit(0)) + F.lit(int(end_n > 0))).alias("n_known"),
        F.lit(int(n_train)).cast("long").alias("train_tokens"),
        (F.col("own") + F.col("rest") + tail_log + F.lit(end_log) - n * F.lit(base_den)).alias("base_score"),
        (F.col("hmm") + F.col("rest") + tail_log - F.col("denom")).alias("score")))
