"""Operator 8: quality rules as a short-circuit cascade.

Each rule says whether it rejects a text.  A bounded random sample is run
through every rule first; a rule's cost is its own CPU time per text (the cut
into words, which most share, is charged to none) and its selectivity the
share it rejects.  The rules then run in order of rejections per cost, and a
text stops at the first rule that rejects it.  A text is kept when no rule
rejects it, so the order decides work, never the verdict.

Counts come from the bytes of whole texts, vectorised over a chunk of texts;
they are computed when a rule (or the caller) first asks for them.  A rule
sees only the texts that all rules before it let pass: the others' bytes,
words and counts are dropped from the chunk first.
"""

from __future__ import annotations

import time
import unicodedata
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendlens.llm.common import chunks, mix, prepare, span_hash, window_hash, word_bounds

SAMPLE_ROWS = 1000   # expected size of the sample that orders the rules
WINDOW = 5

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
_STARTS_CHAR = np.array([(b & 0xC0) != 0x80 for b in range(256)], np.int64)
_UPPER = np.array([65 <= b <= 90 for b in range(256)], np.int64)
_ASCII = np.array([65 <= b <= 90 or 97 <= b <= 122 for b in range(256)], np.int64)
_LEAD = np.array([b & (0x1F if b < 0xE0 else 0x0F if b < 0xF0 else 0x07) for b in range(256)], np.int64)
_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)], np.int64)


def _per_text(marks: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of ``marks`` (one number a position) within ``off[i]:off[i + 1]``."""
    c = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=c[1:])
    return c[off[1:]] - c[off[:-1]]


def _repeats(hashes: np.ndarray, text: np.ndarray):
    """Positions in order of (text, hash), and where a position equals the one before it."""
    with np.errstate(over="ignore"):
        key = mix(hashes ^ (text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(key, kind="stable")
    s = key[order]
    return order, np.concatenate([[False], s[1:] == s[:-1]])[:len(s)]


def _beyond_ascii(buf: np.ndarray):
    """Where each character beyond ASCII starts, and whether it is upper case and a letter."""
    at = np.flatnonzero(buf >= 0xC0)
    code = _LEAD[buf[at]]
    for i, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
        more = buf[at] >= least
        code[more] = code[more] << 6 | buf[np.minimum(at[more] + i, len(buf) - 1)] & 0x3F
    kinds, which = np.unique(code, return_inverse=True)
    chars = [chr(c) if c <= 0x10FFFF else "" for c in kinds]
    upper = np.array([c != "" and unicodedata.category(c) == "Lu" for c in chars], bool)
    return at, upper[which], np.array([c.isalpha() for c in chars], bool)[which]


class Facts:
    """Counts of every text of one chunk, one array entry a text."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, self.off = buf, off
        self.n = len(off) - 1

    def subset(self, rows: np.ndarray) -> Facts:
        """The facts of some texts (row numbers, in order): what is known of them stays known."""
        size = (self.off[1:] - self.off[:-1])[rows]
        off = np.concatenate([[0], np.cumsum(size)])
        moved = off[:-1] - self.off[:-1][rows]
        out = Facts(self.buf[np.repeat(-moved, size) + np.arange(off[-1])], off)
        for name, value in self.__dict__.items():
            if name.startswith("n_") or name == "word_chars":
                out.__dict__[name] = value[rows]
            elif name == "_cases":
                out.__dict__[name] = tuple(v[rows] for v in value)
        if "words" in self.__dict__:
            starts, ends, per = self.words
            n = (per[1:] - per[:-1])[rows]
            first = np.concatenate([[0], np.cumsum(n)])
            at = np.repeat(per[:-1][rows] - first[:-1], n) + np.arange(first[-1])
            shift = np.repeat(moved, n)
            out.__dict__["words"] = starts[at] + shift, ends[at] + shift, first
            if "hashes" in self.__dict__:
                out.__dict__["hashes"] = self.hashes[at]
        return out

    @cached_property
    def words(self):
        return word_bounds(self.buf, self.off)

    @cached_property
    def hashes(self) -> np.ndarray:
        starts, ends, _ = self.words
        return span_hash(self.buf, starts, ends, lower=False)

    @cached_property
    def n_words(self) -> np.ndarray:
        per = self.words[2]
        return per[1:] - per[:-1]

    @cached_property
    def word_chars(self) -> np.ndarray:
        space = np.isin(self.buf, np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
        return _per_text(_STARTS_CHAR[self.buf] * ~space, self.off)

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return _per_text(_SYMBOL[self.buf], self.off)

    @cached_property
    def _lines(self):
        """Text and hash of every line with a word."""
        n = len(self.buf)
        if n == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        after = np.flatnonzero(self.buf == 10) + 1
        begin = np.unique(np.concatenate([self.off[:-1][self.off[1:] > self.off[:-1]], after[after < n]]))
        end = np.append(begin[1:], n)
        end = end - (self.buf[end - 1] == 10)
        starts = self.words[0]
        full = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
        begin, end = begin[full], end[full]
        return np.searchsorted(self.off, begin, side="right") - 1, span_hash(self.buf, begin, end, lower=False)

    @cached_property
    def n_lines(self) -> np.ndarray:
        return np.bincount(self._lines[0], minlength=self.n)[:self.n]

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        text, h = self._lines
        order, same = _repeats(h, text)
        return np.bincount(text[order[same]], minlength=self.n)[:self.n]

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        starts, ends, per = self.words
        h = window_hash(self.hashes, WINDOW)
        if len(h) == 0:
            return np.zeros(self.n, np.int64)
        text = np.repeat(np.arange(self.n), per[1:] - per[:-1])
        at = np.flatnonzero(text[:len(h)] == text[WINDOW - 1:])
        order, same = _repeats(h[at], text[at])
        twice = same.copy()
        twice[:-1] |= same[1:]
        first = at[order[twice]]
        edge = np.zeros(len(starts) + 1, np.int64)
        np.add.at(edge, first, 1)
        np.add.at(edge, first + WINDOW, -1)
        return _per_text(np.cumsum(edge)[:-1] > 0, per)

    @cached_property
    def n_stutters(self) -> np.ndarray:
        """Words equal to the word before them."""
        h, per = self.hashes, self.words[2]
        text = np.repeat(np.arange(self.n), per[1:] - per[:-1])
        again = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
        return np.bincount(text[1:][again], minlength=self.n)[:self.n]

    @cached_property
    def _cases(self):
        """Upper-case letters and all letters, of any script."""
        upper, letter = _UPPER[self.buf], _ASCII[self.buf]
        at, is_upper, is_letter = _beyond_ascii(self.buf)
        upper[at], letter[at] = is_upper, is_letter
        return _per_text(upper, self.off), _per_text(letter, self.off)

    @cached_property
    def n_upper(self) -> np.ndarray:
        return self._cases[0]

    @cached_property
    def n_letters(self) -> np.ndarray:
        return self._cases[1]

    @cached_property
    def n_letter_words(self) -> np.ndarray:
        starts, ends, per = self.words
        c = np.concatenate([[0], np.cumsum(_LETTER[self.buf])])
        return _per_text((c[ends] - c[starts]) > 0, per)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Facts], np.ndarray]


RULES = (
    Rule("few_words", lambda f: f.n_words < 10),
    Rule("repeated_windows", lambda f: 100 * f.n_repeat_words > 20 * f.n_words),
    Rule("symbols", lambda f: 100 * f.n_symbols > 10 * f.n_words),
    Rule("shouting", lambda f: 2 * f.n_upper > f.n_letters),
    Rule("repeated_lines", lambda f: 100 * f.n_dup_lines > 60 * f.n_lines),
    Rule("stutter", lambda f: 100 * f.n_stutters > 20 * f.n_words),
    Rule("word_length", lambda f: (f.word_chars < 2 * f.n_words) | (f.word_chars > 20 * f.n_words)),
    Rule("letterless_words", lambda f: 100 * f.n_letter_words < 60 * f.n_words),
)
BASE = ("few_words", "repeated_windows")


def _measure(rules: Sequence[Rule]):
    def run(batches):
        n, rejected, spent = 0, np.zeros(len(rules)), np.zeros(len(rules))
        for batch in batches:
            for _, _, buf, off in chunks(batch.column(0)):
                n += len(off) - 1
                shared = Facts(buf, off).words
                for i, r in enumerate(rules):
                    facts = Facts(buf, off)
                    facts.__dict__["words"] = shared
                    t = time.thread_time()
                    rejected[i] += int(r.rejects(facts).sum())
                    spent[i] += time.thread_time() - t
        yield pa.RecordBatch.from_pydict({"rule": [r.name for r in rules], "n": [n] * len(rules),
                                          "rejected": rejected.astype(int).tolist(), "spent": spent.tolist()})
    return run


def rule_order(df: DataFrame, text_col: str, rules: Sequence[Rule] = RULES,
               sample_rows: int = SAMPLE_ROWS) -> list[dict]:
    """The rules with cost and selectivity on a sample, best first."""
    total = df.count()
    part = df.select(F.col(text_col).cast("string"))
    part = part.sample(min(1.0, sample_rows / total), seed=8) if total > sample_rows else part
    got = {r["rule"]: r for r in part.mapInArrow(_measure(rules), "rule string, n long, rejected long, spent double")
           .groupBy("rule").agg(F.sum("n").alias("n"), F.sum("rejected").alias("rejected"),
                                F.sum("spent").alias("spent")).collect()}
    out = []
    for r in rules:
        n = max(1, got[r.name]["n"] if r.name in got else 1)
        rej, cost = (got[r.name]["rejected"] / n, got[r.name]["spent"] / n) if r.name in got else (0.0, 0.0)
        out.append({"rule": r.name, "selectivity": rej, "cost": cost, "rank": rej / max(cost, 1e-9)})
    return sorted(out, key=lambda x: (-x["rank"], x["rule"]))


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def run_rules(rules: Sequence[Rule], facts: Facts) -> np.ndarray:
    """Number of the rule that rejects each text (-1: none); every rule sees the
    texts that are left."""
    first = np.full(facts.n, -1, np.int64)
    left = np.arange(facts.n)
    for i, r in enumerate(rules):
        bad = r.rejects(facts)
        if bad.any():
            first[left[bad]] = i
            left = left[~bad]
            if len(left) == 0:
                break
            facts = facts.subset(np.flatnonzero(~bad))
    return first


def _cascade(rules: Sequence[Rule], facts: bool, text_at: int):
    def run(batches):
        for batch in batches:
            col = batch.column(text_at)
            first = np.full(len(col), -1, np.int64)
            count = {c: np.zeros(len(col), np.int64) for c in _COUNTS}
            for lo, hi, buf, off in chunks(col):
                whole = Facts(buf, off)
                if facts:
                    for c in _COUNTS:
                        count[c][lo:hi] = getattr(whole, c)
                first[lo:hi] = run_rules(rules, whole)
            names = pa.array([rules[i].name if i >= 0 else None for i in first], pa.string())
            extra = [pa.array(count[c]) for c in _COUNTS] if facts else []
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(batch.num_columns)], *extra, pa.array(first < 0), names],
                [*batch.schema.names, *([f"_{c}" for c in _COUNTS] if facts else []), "_kept", "_failed"])
    return run


def quality_cascade(df: DataFrame, text_col: str, rules: Sequence[Rule] = RULES, facts: bool = False,
                    order: Sequence[str] | None = None) -> DataFrame:
    """``df`` plus ``_kept`` and ``_failed`` (the rule that rejected the row);
    with ``facts`` also the counts, prefixed with ``_``, of every row.

    A null text counts as empty and a text without words fails ``few_words``.
    ``_failed`` is the first rule in the cascade's order, which follows measured
    CPU times and may differ between runs; give ``order`` to fix it.  ``_kept``
    never differs.  Rows are judged one by one, so repeated rows get the same verdict and an
    empty table gives an empty result.  All columns of ``df`` pass through; a
    column named like an output is replaced.
    """
    prepare(df.sparkSession)
    order = [r["rule"] for r in rule_order(df, text_col, rules)] if order is None else list(order)
    by = {r.name: r for r in rules}
    ranked = tuple(by[n] for n in order)
    new = [T.StructField(f"_{c}", T.LongType()) for c in (_COUNTS if facts else ())]
    new += [T.StructField("_kept", T.BooleanType()), T.StructField("_failed", T.StringType())]
    src = df.drop(*[f.name for f in new])
    return src.mapInArrow(_cascade(ranked, facts, src.columns.index(text_col)),
                          T.StructType(list(src.schema.fields) + new))


def quality_report(df: DataFrame, id_col: str, text_col: str, **kw) -> DataFrame:
    """Counts and verdicts by document."""
    q = quality_cascade(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")),
                        "text", facts=True, **kw)
    n = F.col("_n_words")
    return q.select("doc_id", n.alias("n_words"), *[F.col(f"_{c}").alias(c) for c in _COUNTS[1:]],
                    ((n < 10) | (100 * F.col("_n_repeat_words") > 20 * n)).alias("base_failed"),
                    F.col("_kept").alias("kept"))
