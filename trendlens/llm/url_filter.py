"""Operator 12: URL filters.

A rule is a host with a path prefix; it decides every URL of that host and its
subdomains below the prefix, the longest rule first.  What no rule decides is
judged by logistic regression on hashed character n-grams of host and path.

The regression is fit on a small labelled URL table.  A bounded sample of it
(``max_labelled`` distinct URLs, half for each label, the ones with the least
hashes) is turned into n-grams in tasks; weights are found by full-batch
gradient steps in numpy.  The 2**16 weights are all that is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendlens.llm.common import chunks, mix, prepare

BITS = 16
GRAMS = (3, 4, 5)
ALLOW, BLOCK = "allow", "block"
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), len(r.host), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def grams(buf: np.ndarray, off: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """String and hashed n-gram (below 2**BITS) of every n-gram within one string."""
    string = np.repeat(np.arange(len(off) - 1), off[1:] - off[:-1])
    rows, ids = [], []
    h = np.zeros(len(buf), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, max(GRAMS) + 1):
            m = len(buf) - n + 1
            if m <= 0:
                break
            h = mix(h[:m] * _GOLD + buf[n - 1:n - 1 + m].astype(np.uint64) + np.uint64(257 * kind + 1))
            if n in GRAMS:
                at = np.flatnonzero(string[:m] == string[n - 1:])
                rows.append(string[at])
                ids.append((h[at] >> np.uint64(64 - BITS)).astype(np.int64))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(ids)


def features(host: pa.Array, path: pa.Array):
    """Yield ``(lo, hi, row, id)`` of the n-grams of hosts and paths, a chunk at a time."""
    for lo, hi, buf, off in chunks(host):
        a, x = grams(buf, off, 0)
        parts = [(a, x)]
        for plo, phi, pbuf, poff in chunks(path.slice(lo, hi - lo)):
            b, y = grams(pbuf, poff, 1)
            parts.append((b + plo, y))
        yield lo, hi, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def logits(weights: np.ndarray, bias: float, row: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Log-odds of ``n`` strings: weights of their n-grams over the root of their number."""
    count = np.bincount(row, minlength=n)
    return np.bincount(row, weights[ids], minlength=n) / np.sqrt(np.maximum(1, count)) + bias


def train(row: np.ndarray, ids: np.ndarray, y: np.ndarray, steps: int = 150, rate: float = 0.5,
          decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch gradient steps, each scaled by the root of its
    past squares; both labels weigh the same in all."""
    n = len(y)
    pull = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, n - y.sum()))
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=n)))
    w, b, past, past_b = np.zeros(1 << BITS), 0.0, np.full(1 << BITS, 1e-8), 1e-8
    for _ in range(steps):
        miss = pull * (1 / (1 + np.exp(-np.clip(logits(w, b, row, ids, n), -30, 30))) - y)
        g = np.bincount(ids, (miss * scale)[row], minlength=1 << BITS) + decay * w
        gb = miss.sum()
        past, past_b = past + g * g, past_b + gb * gb
        w, b = w - rate * g / np.sqrt(past), b - rate * gb / np.sqrt(past_b)
    return w, float(b)


def _bounded(col: Column) -> Column:
    return F.concat(F.lit("^"), col, F.lit("$"))


def fit(labelled: DataFrame, host_col: str, path_col: str, verdict_col: str, max_labelled: int = 8000,
        **kw) -> tuple[np.ndarray, float]:
    """Weights and bias from a table of hosts, paths and verdicts.

    At most ``max_labelled`` distinct (host, path) rows are learned from, half
    for each verdict, those with the least hashes; verdicts other than
    allow and block are left out.  Without rows of both verdicts the one there
    is gets the bias; without any, URLs are allowed.
    """
    each = max_labelled // 2
    rows = labelled.select(F.col(host_col).alias("host"), F.col(path_col).alias("path"), F.col(verdict_col).alias("y"))
    h = F.pmod(F.xxhash64(F.lit(12), "host", "path"), F.lit(1 << 30))
    rows = rows.where(F.col("y").isin(ALLOW, BLOCK)).withColumn("h", h)
    distinct = F.approx_count_distinct(F.xxhash64("host", "path"))
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(distinct.alias("n")).collect()}
    below = {y: int(min(1.0, (2 * each + 20) / max(1, n)) * (1 << 30)) for y, n in sizes.items()}
    rows = rows.where(F.col("h") < F.when(F.col("y") == BLOCK, below.get(BLOCK, 0)).otherwise(below.get(ALLOW, 0)))
    rank = F.row_number().over(Window.partitionBy("y").orderBy("h", "host", "path"))
    got = rows.distinct().withColumn("r", rank).where(F.col("r") <= each).select(
        _bounded(F.col("host")).alias("host"), _bounded(F.col("path")).alias("path"), "y", "r").toArrow()
    y = np.array([v == BLOCK for v in got.column("y").to_pylist()], np.int64)
    if len(y) == 0 or y.min() == y.max():
        return np.zeros(1 << BITS), 1.0 if len(y) and y[0] else -1.0
    order = np.lexsort((got.column("r").to_numpy(), y))
    got, y = got.take(order), y[order]
    parts = [(lo + row, ids) for lo, _, row, ids in
             features(got.column("host").combine_chunks(), got.column("path").combine_chunks())]
    return train(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), y, **kw)


def _score(sent, host_at: int, path_at: int):
    def run(batches):
        w, b = sent.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for lo, hi, row, ids in features(batch.column(host_at), batch.column(path_at)):
                out[lo:hi] = logits(w, b, row, ids, hi - lo)
            keep = [i for i in range(batch.num_columns) if i not in (host_at, path_at)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in keep], pa.array(1 / (1 + np.exp(-np.clip(out, -700, 700))))],
                [*[batch.schema.names[i] for i in keep], "_score"])
    return run


def predict(df: DataFrame, host_col: str, path_col: str, model: tuple[np.ndarray, float]) -> DataFrame:
    """``df`` plus ``_score``, the probability that a URL is to be blocked."""
    src = df.drop("_score")
    sent = df.sparkSession.sparkContext.broadcast(model)
    fed = src.withColumns({"_ngram_host": _bounded(F.col(host_col)), "_ngram_path": _bounded(F.col(path_col))})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields) + ", _score double"
    return fed.mapInArrow(_score(sent, len(src.columns), len(src.columns) + 1), schema)


def filter_urls(df: DataFrame, url_col: str, rules: Sequence[Rule], labelled: DataFrame | None = None,
                threshold: float = 0.5, **kw) -> DataFrame:
    """``df`` plus ``_host``, ``_path``, ``_rule``, ``_score`` and ``_verdict``.

    ``labelled`` has ``url`` and ``verdict`` (allow or block); without it the
    rows that a rule decides are the labelled table.  ``_verdict`` is the rule's,
    else block from ``threshold`` on.  A null URL, or one without ``://``, has an
    empty host and path, fits no rule and is judged by the n-grams of nothing.
    URLs are judged one by one, so repeated rows agree; an empty table gives an
    empty result.  All columns pass through; one named like an output is
    replaced.  Rules cost one expression each, so their list is a short one.
    """
    prepare(df.sparkSession)
    src = df.drop("_host", "_path", "_rule", "_ruled", "_score", "_verdict")
    parts = src.withColumns({"_host": _or_empty(host_of(F.col(url_col))), "_path": _or_empty(path_of(F.col(url_col)))})
    rule, ruled = rule_for(F.col("_host"), F.col("_path"), rules)
    parts = parts.withColumns({"_rule": rule, "_ruled": ruled})
    if labelled is None:
        model = fit(parts, "_host", "_path", "_ruled", **kw)
    else:
        model = fit(labelled.select(_or_empty(host_of(F.col("url"))).alias("h"), _or_empty(path_of(F.col("url"))).alias("p"),
                                    "verdict"), "h", "p", "verdict", **kw)
    verdict = F.coalesce("_ruled", F.when(F.col("_score") >= threshold, BLOCK).otherwise(ALLOW))
    return predict(parts, "_host", "_path", model).withColumn("_verdict", verdict).drop("_ruled")


def _or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def url_report(df: DataFrame, id_col: str, url_col: str, rules: Sequence[Rule], **kw) -> DataFrame:
    """Host, path, rule and verdict by page."""
    src = df.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    return filter_urls(src, "url", rules, **kw).select(
        "page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"),
        F.col("_verdict").alias("verdict"), F.col("_score").alias("score"))
