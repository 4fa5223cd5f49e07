"""Operator 9: language identification with a byte convolutional network.

Windows of ``WINDOW`` bytes go through filters of several widths, max pooling
over the window and a softmax layer.  The network is trained in numpy on a
bounded sample of rows of every label (``docs_per_label``, ``max_crops``) and then
applied to fixed-length windows that tile every whole text; a text's
probabilities are the mean over its windows, weighted by the bytes each holds.

A trained filter is linear in the bytes it sees, so scoring folds embedding and
filter into one table per pair of neighbouring bytes: widths 2, 3 and 4 need
one or two table rows per position.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from trendlens.llm.common import bucket_of, chunks, cut, prepare
from trendlens.operators.stats import exact_quantiles

WINDOW = 128
WIDTHS = (2, 3, 4)
BLOCK = 128
UNKNOWN = "und"
LABELS_PER_STEPS = 16
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32


@dataclass(frozen=True)
class Network:
    labels: tuple[str, ...]
    embed: np.ndarray                 # 256 x d; byte 0 pads
    filters: tuple[np.ndarray, ...]   # per width: (width * d) x f
    bias: tuple[np.ndarray, ...]
    out: np.ndarray                   # (widths * f) x labels
    out_bias: np.ndarray

    def tables(self):
        """Per width: the tables added at offset 0 (and 2), on byte pairs or bytes."""
        d = self.embed.shape[1]
        got = []
        for w, k, b in zip(WIDTHS, self.filters, self.bias):
            per = [self.embed @ k[i * d:(i + 1) * d] for i in range(w)]
            pair = ((per[0] + b)[:, None, :] + per[1][None, :, :]).reshape(65536, -1)
            rest = (None if w == 2 else per[2] if w == 3
                    else (per[2][:, None, :] + per[3][None, :, :]).reshape(65536, -1))
            got.append((pair.astype(np.float32), None if rest is None else rest.astype(np.float32)))
        return got


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def train(texts: list[bytes], labels: list[str], *, dim: int = 8, filters: int = 16, steps: int = 400,
          batch: int = 64, rate: float = 0.01, seed: int = 9) -> Network | None:
    """Fit the network with Adam on random windows of ``texts``; labels are
    drawn evenly, so ``steps`` is for up to ``LABELS_PER_STEPS`` labels and grows
    in proportion beyond.  Crops of different lengths teach it short texts."""
    by: dict[str, list[np.ndarray]] = {}
    for t, y in zip(texts, labels):
        if t:
            by.setdefault(y, []).append(_FOLD[np.frombuffer(t, np.uint8)])
    names = tuple(sorted(by))
    texts_of = [by[n] for n in names]
    if not names:
        return None
    steps = -(-steps * max(len(names), LABELS_PER_STEPS) // LABELS_PER_STEPS)
    rng = np.random.default_rng(seed)
    p = {"E": rng.normal(0, 0.5, (256, dim)), "O": rng.normal(0, 0.1, (len(WIDTHS) * filters, len(names))),
         "o": np.zeros(len(names))}
    for w in WIDTHS:
        p[f"K{w}"] = rng.normal(0, (w * dim) ** -0.5, (w * dim, filters))
        p[f"b{w}"] = np.zeros(filters)
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        y = rng.integers(0, len(names), batch)
        x = np.zeros((batch, WINDOW), np.uint8)
        for i, c in enumerate(y):
            t = texts_of[c][rng.integers(0, len(texts_of[c]))]
            size = int(min(len(t), WINDOW if rng.random() < 0.6 else rng.integers(8, WINDOW)))
            at = int(rng.integers(0, len(t) - size + 1))
            x[i, :size] = t[at:at + size]
        e = p["E"][x]
        pooled, where, cols = [], [], []
        for w in WIDTHS:
            n = WINDOW - w + 1
            c = np.concatenate([e[:, i:i + n] for i in range(w)], axis=2)
            a = c @ p[f"K{w}"] + p[f"b{w}"]
            k = a.argmax(axis=1)
            where.append(k)
            cols.append(c)
            pooled.append(np.maximum(np.take_along_axis(a, k[:, None, :], 1)[:, 0], 0))
        h = np.concatenate(pooled, axis=1)
        drop = rng.random(h.shape) < 0.8
        h = h * drop / 0.8
        dz = _softmax(h @ p["O"] + p["o"])
        dz[np.arange(batch), y] -= 1
        dz /= batch
        g = {"O": h.T @ dz, "o": dz.sum(0), "E": np.zeros_like(p["E"])}
        dh = (dz @ p["O"].T) * drop / 0.8 * (h > 0)
        for j, w in enumerate(WIDTHS):
            d = dh[:, j * filters:(j + 1) * filters]
            # only the winning position of each filter gets a gradient
            won = np.take_along_axis(cols[j], where[j][:, :, None], 1)
            g[f"K{w}"] = np.einsum("bfc,bf->cf", won, d)
            g[f"b{w}"] = d.sum(0)
            back = np.einsum("cf,bf->bfc", p[f"K{w}"], d).reshape(batch, filters, w, dim)
            seen = np.stack([np.take_along_axis(x, where[j] + i, 1) for i in range(w)], axis=2)
            np.add.at(g["E"], seen.reshape(-1), back.reshape(-1, dim))
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
            p[k] = p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    return Network(names, p["E"], tuple(p[f"K{w}"] for w in WIDTHS), tuple(p[f"b{w}"] for w in WIDTHS), p["O"], p["o"])


def windows(buf: np.ndarray, off: np.ndarray):
    """Windows tiling every text: (bytes, text of each, bytes it adds).  The
    last one is padded with byte 0."""
    size = off[1:] - off[:-1]
    count = -(-size // WINDOW)
    text = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    begin = off[:-1][text] + nth * WINDOW
    held = np.minimum(WINDOW, off[1:][text] - begin)
    # a short last window starts earlier where the text allows it
    begin = np.maximum(np.minimum(begin, off[1:][text] - WINDOW), off[:-1][text])
    at = begin[:, None] + np.arange(WINDOW)
    inside = at < off[1:][text][:, None]
    x = np.where(inside, _FOLD[buf[np.minimum(at, max(len(buf) - 1, 0))]], 0) if len(buf) else np.zeros((0, WINDOW))
    return x.astype(np.uint8), text, held


def window_probabilities(net: Network, tables, x: np.ndarray) -> np.ndarray:
    """Label probabilities of windows.  Positions come first in memory, so the
    pooling maximum runs over contiguous rows."""
    t = np.ascontiguousarray(x.T).astype(np.int64)
    pair = t[:-1] * 256 + t[1:]
    pooled = []
    for w, (head, tail) in zip(WIDTHS, tables):
        n = WINDOW - w + 1
        a = np.take(head, pair[:n], axis=0, mode="clip")
        if w == 3:
            a += np.take(tail, t[2:], axis=0, mode="clip")
        elif w == 4:
            a += np.take(tail, pair[2:], axis=0, mode="clip")
        pooled.append(np.maximum(a.max(axis=0), 0))
    return _softmax(np.concatenate(pooled, axis=1).astype(np.float64) @ net.out + net.out_bias)


def _score(sent, text_at: int, letter_at: int):
    def run(batches):
        net = sent.value
        tables = net.tables() if net else None
        for batch in batches:
            col = batch.column(text_at)
            k = len(net.labels) if net else 1
            prob = np.zeros((len(col), k))
            if net:
                for lo, hi, buf, off in chunks(col):
                    # a block of texts at a time: tables of window activations stay small
                    n = hi - lo
                    x, text, held = windows(buf, off)
                    total = np.zeros((n, k))
                    for b in range(0, len(x), BLOCK):
                        q = window_probabilities(net, tables, x[b:b + BLOCK]) * held[b:b + BLOCK, None]
                        np.add.at(total, text[b:b + BLOCK], q)
                    prob[lo:hi] = total / np.maximum(1, off[1:] - off[:-1])[:, None]
            ok = pc.fill_null(batch.column(letter_at), False).to_numpy(zero_copy_only=False)
            ok = ok & (prob.sum(axis=1) > 0)
            best = prob.argmax(axis=1)
            lang = [net.labels[i] if good else UNKNOWN for i, good in zip(best, ok)]
            score = np.where(ok, np.minimum(prob[np.arange(len(col)), best], 1.0), 0.0)
            keep = [i for i in range(batch.num_columns) if i != letter_at]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], pa.array(lang), pa.array(score)],
                                             [*[batch.schema.names[i] for i in keep], "_lang", "_score"])
    return run


def labelled_sample(df: DataFrame, id_col: str, text_col: str, label_col: str, docs_per_label: int,
                    max_crops: int, chars: int) -> tuple[list[bytes], list[str]]:
    """At most ``docs_per_label`` crops for every label with a training row, and
    fewer each, but one at least, when that makes more than ``max_crops``; a
    crop begins at a place drawn from the row's hash."""
    h = F.pmod(F.xxhash64(F.lit(9), F.col(id_col), F.col(text_col)), F.lit(1 << 30))
    rows = df.where(F.col(label_col).isNotNull() & F.coalesce(F.col(text_col), F.lit("")).rlike(r"\p{L}"))
    rows = rows.where(bucket_of(id_col) % 4 != 2)
    rows = rows.select(F.col(label_col).cast("string").alias("y"), h.alias("h"), F.col(text_col).alias("text"))
    sizes = rows.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("least")).collect()
    if not sizes:
        return [], []
    each = max(1, min(docs_per_label, max_crops // len(sizes)))
    # about twice the rows wanted, and in any case the one with the least hash
    below = df.sparkSession.createDataFrame(
        [(r["y"], max(r["least"] + 1, int(min(1.0, (2 * each + 20) / r["n"]) * (1 << 30)))) for r in sizes],
        "y string, below long")
    room = F.greatest(F.length("text") - F.lit(chars), F.lit(0)) + 1
    some = rows.join(F.broadcast(below), "y").where(F.col("h") < F.col("below")).select(
        "y", "h", F.col("text").substr((F.pmod("h", room) + 1).cast("int"), F.lit(chars)).alias("t"))
    rank = F.row_number().over(Window.partitionBy("y").orderBy("h", "t"))
    got = some.withColumn("r", rank).where(F.col("r") <= each).orderBy("y", "r").collect()
    return [r["t"].encode() for r in got], [r["y"] for r in got]


def fit(df: DataFrame, id_col: str, text_col: str, label_col: str, docs_per_label: int = 400,
        max_crops: int = 25_600, chars: int = 600, **kw) -> Network | None:
    return train(*labelled_sample(df, id_col, text_col, label_col, docs_per_label, max_crops, chars), **kw)


def identify(df: DataFrame, text_col: str, net: Network | None) -> DataFrame:
    """``df`` plus ``_lang`` and ``_score`` (0 to 1).

    A null text, or one without a letter, is ``und`` with score 0; so is every
    row when nothing was learned.  Rows are judged one by one, so repeated rows
    agree; ties go to the label that sorts first.  An empty table gives an
    empty result.  Columns pass through; ones named like an output are
    replaced.
    """
    prepare(df.sparkSession)
    src = df.drop("_lang", "_score")
    schema = T.StructType([*src.schema.fields, T.StructField("_lang", T.StringType()),
                           T.StructField("_score", T.DoubleType())])
    sent = df.sparkSession.sparkContext.broadcast(net)
    fed = src.withColumn("_letter", F.col(text_col).rlike(r"\p{L}"))
    return fed.mapInArrow(_score(sent, src.columns.index(text_col), len(src.columns)), schema)


def score_floor(df: DataFrame, id_col: str, text_col: str, label_col: str, net: Network | None,
                share: float = 0.005) -> float:
    """The score below which a prediction is not to be trusted: what only
    ``share`` of the right predictions on all held-out labelled rows fall
    below, but at least a tenth above chance, ``1 / labels``.  When fewer than
    five right predictions would fall below, the share can not be told and
    chance decides; 0 when nothing was learned."""
    if net is None:
        return 0.0
    held = df.where((bucket_of(id_col) % 4 == 2) & F.col(label_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("y"))
    # scored once: the quantile takes several passes over the scores
    scored = cut(identify(held, "text", net).select("id", "y", "_lang", "_score"), "held-scores")
    return floor_of(scored, "id", "y", net, share)


def floor_of(scored: DataFrame, id_col: str, label_col: str, net: Network | None, share: float = 0.005) -> float:
    """``score_floor`` from predictions at hand (``_lang``, ``_score``, see ``identify``)."""
    if net is None:
        return 0.0
    chance = min(1.0, 1.1 / len(net.labels))
    right = scored.where((bucket_of(id_col) % 4 == 2) & (F.col("_lang") == F.col(label_col).cast("string"))).select("_score")
    if right.count() * share < 5:
        return chance
    return max(chance, exact_quantiles(right, ["_score"], [share])["_score"][0])


def language_report(df: DataFrame, id_col: str, text_col: str, label_col: str, **kw) -> DataFrame:
    """Predictions by document, and whether the row was kept from training."""
    net = fit(df, id_col, text_col, label_col, **kw)
    src = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return identify(src, "text", net).select(
        "doc_id", (bucket_of("doc_id") % 4 == 2).alias("held_out"),
        F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))
