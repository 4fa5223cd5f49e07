"""Operator 3: token counts attributed to fields or sections by offset.

A whole document is encoded once.  Each id's length in bytes gives the
character span of every token; sections are character spans ``[start, end)`` of
the same text and may touch, overlap or leave gaps.  Both sides are sorted, so
the interval join is a binary search per section end.  A token that crosses a
section boundary goes by one rule:

``start``     to the section that holds its first character
``end``       to the section that holds its last character
``majority``  to the section that holds its middle character (the earlier of two)
``split``     to each section by its share of the token's characters

For sections that tile the text each rule's counts add up to the document's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendlens.llm.common import prepare
from trendlens.llm.tokens import encoder, vocabulary_path

RULES = ("start", "end", "majority", "split")


def token_spans(text: str, ids: np.ndarray, size: np.ndarray):
    """First character and end character (exclusive) of every token.  A token
    that holds part of a character spans that character."""
    raw = np.frombuffer(text.encode(), np.uint8)
    stop = np.cumsum(size[ids])
    begin = stop - size[ids]
    if len(raw) == len(text):
        return begin, stop
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    return char[begin], char[stop - 1] + 1


def attribute(begin: np.ndarray, stop: np.ndarray, lo: np.ndarray, hi: np.ndarray, rule: str):
    """Tokens given to every section, and tokens crossing one of its ends."""
    if rule == "split":
        # characters of tokens before x, each character worth 1 / its token's length
        def before(x):
            i = np.searchsorted(begin, x, side="right") - 1
            if len(begin) == 0:
                return np.zeros(len(x))
            j = np.maximum(i, 0)
            part = np.clip((x - begin[j]) / (stop[j] - begin[j]), 0.0, 1.0)
            return np.where(i < 0, 0.0, j + part)
        given = before(hi) - before(lo)
    else:
        at = begin if rule == "start" else stop - 1 if rule == "end" else begin + (stop - begin - 1) // 2
        given = (np.searchsorted(at, hi) - np.searchsorted(at, lo)).astype(float)
    touch = np.searchsorted(begin, hi) - np.searchsorted(stop, lo, side="right")
    inside = np.searchsorted(stop, hi, side="right") - np.searchsorted(begin, lo)
    return np.where(hi > lo, given, 0.0), np.where(hi > lo, np.maximum(touch, 0) - np.maximum(inside, 0), 0)


def line_spans(text: str):
    """Lines, each with its line end; they tile the text."""
    cut = [i + 1 for i, c in enumerate(text) if c == "\n"]
    edge = np.array([0, *cut, len(text)]) if not cut or cut[-1] < len(text) else np.array([0, *cut])
    return edge[:-1], edge[1:]


_OUT = ("section int, name string, start long, `end` long, tokens double, crossing long, doc_tokens long")


def _attribute(path: str, rule: str, spans: bool):
    def run(batches):
        enc = encoder(path)
        size = enc.token_bytes()
        for batch in batches:
            given_spans = batch.column(2).to_pylist() if spans else None
            row, sec, name, lo, hi, got, cross, total = [], [], [], [], [], [], [], []
            for i, text, ids in enc.encode_all(batch.column(1)):
                begin, stop = token_spans(text, np.frombuffer(ids, "<u4"), size)
                if spans:
                    s = [x for x in (given_spans[i] or []) if x and x["start"] is not None and x["end"] is not None]
                    a = np.array([x["start"] for x in s], np.int64)
                    z = np.array([x["end"] for x in s], np.int64)
                    name += [x["name"] for x in s]
                else:
                    a, z = line_spans(text)
                    name += [None] * len(a)
                n, c = attribute(begin, stop, a, z, rule)
                row += [i] * len(a)
                sec += range(len(a))
                lo.append(a)
                hi.append(z)
                got.append(n)
                cross.append(c)
                total += [len(begin)] * len(a)
            if row:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, pa.int64())), pa.array(sec, pa.int32()),
                     pa.array(name, pa.string()), *[pa.array(np.concatenate(x).astype(np.int64)) for x in (lo, hi)],
                     pa.array(np.concatenate(got).astype(float)), pa.array(np.concatenate(cross).astype(np.int64)),
                     pa.array(total, pa.int64())],
                    ["doc_id", "section", "name", "start", "end", "tokens", "crossing", "doc_tokens"])
    return run


def token_counts(df: DataFrame, id_col: str, text_col: str, spans_col: str | None = None, rule: str = "start",
                 path: str | None = None) -> DataFrame:
    """One row per section: ``doc_id, section, name, start, end, tokens, crossing, doc_tokens``.

    ``spans_col`` holds ``array<struct<name string, start, end>>`` in
    characters; without it the lines of the text are the sections.  A null or
    empty text is one empty line, with no tokens; null spans, or spans without
    an end, give no row.  Repeated rows are counted apiece, a null id stays
    null, an empty table gives an empty result, other columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    prepare(df.sparkSession)
    cols = [F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")]
    if spans_col:
        cols.append(F.col(spans_col).cast("array<struct<name:string,start:bigint,end:bigint>>").alias("spans"))
    src = df.select(*cols)
    schema = T.StructType([src.schema["doc_id"], *T.StructType.fromDDL(_OUT).fields])
    return src.mapInArrow(_attribute(path or vocabulary_path(), rule, bool(spans_col)), schema)
