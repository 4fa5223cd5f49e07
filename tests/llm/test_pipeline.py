"""The pipeline against plain Python, stage by stage."""

import collections
import itertools
import math
import re

import numpy as np
import pytest

import corpus_pipeline
from trendlens.llm import byte_cnn

SF001 = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _words(t):
    return WORD.findall(t or "")


def _language(net, text):
    """The network by definition, window by window."""
    data = text.encode()
    x = np.array([32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in data], np.int64)
    total = np.zeros(len(net.labels))
    d = net.embed.shape[1]
    for at in range(0, len(x), byte_cnn.WINDOW):
        held = min(byte_cnn.WINDOW, len(x) - at)
        begin = max(0, min(at, len(x) - byte_cnn.WINDOW))
        w = np.zeros(byte_cnn.WINDOW, np.int64)
        part = x[begin:begin + byte_cnn.WINDOW]
        w[:len(part)] = part
        e = net.embed[w]
        pooled = [np.maximum(max_over(e, k, b, width, d), 0) for width, k, b in zip(byte_cnn.WIDTHS, net.filters, net.bias)]
        z = np.concatenate(pooled) @ net.out + net.out_bias
        p = np.exp(z - z.max())
        total += held * p / p.sum()
    return total / max(1, len(x))


def max_over(e, k, b, width, d):
    n = len(e) - width + 1
    return np.max(sum(e[i:i + n] @ k[i * d:(i + 1) * d] for i in range(width)) + b, axis=0)


def _kept(text):
    """Whether no quality rule rejects a text, rule by rule."""
    w, t = _words(text), text or ""
    n = len(w)
    windows = collections.Counter(tuple(w[i:i + 5]) for i in range(n - 4))
    repeat = {j for i in range(n - 4) if windows[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if _words(x)]
    letters = [c for c in t if c.isalpha()]
    chars = sum(map(len, w))
    return not (n < 10 or 100 * len(repeat) > 20 * n or 100 * len(re.findall("[#*$%&|<>]", t)) > 10 * n
                or 2 * sum(c.isupper() for c in letters) > len(letters)
                or 100 * (len(lines) - len(set(lines))) > 60 * len(lines)
                or 100 * sum(a == b for a, b in zip(w, w[1:])) > 20 * n or chars < 2 * n or chars > 20 * n
                or 100 * sum(bool(re.search("[A-Za-z\x80-\U0010ffff]", x)) for x in w) < 60 * n)


def _survivors(rows):
    """One row of each group of near copies, by comparing all pairs."""
    def shingles(t):
        w = [re.sub("[A-Z]", lambda m: m.group().lower(), x) for x in _words(t)]
        return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [(r["doc_id"], shingles(r["text"])) for r in rows if r["doc_id"] is not None]
    least = {i: i for i, _ in sets}
    links = [(a, b) for (a, x), (b, y) in itertools.combinations(sets, 2) if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    for _ in range(len(least)):
        before = dict(least)
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
        if before == least:
            break
    return {i for i in least if least[i] == i}


def _targets(size):
    """Words every source is to give: weights 5, 2, 1, at most three times its own."""
    names = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = sum(size.values()), set()
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(3 * size[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * size[s]}
        if not over:
            return {**{s: 3 * size[s] for s in full}, **share}
        full |= over


@pytest.fixture(scope="module")
def ran(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").where("length(text) < 12000")
    prose = docs.where("doc_id = 2").first()["text"][:900]
    odd = [(None, prose + " tail of a row without an id", "en", "src1", 9), (5001, None, "en", "src1", None), (5002, "", None, None, 0),
           (5003, prose + " more words at its end", "en", None, 5), (5004, prose + " more words at the end", "en", None, 5),
           (5004, prose + " more words at the end", "en", None, 5), (5005, "\n \t", "de", "src2", 3), (5006, "42 17 !! " * 9, "de", "src2", 3)]
    path = tmp_path_factory.mktemp("pipeline")
    docs.union(spark.createDataFrame(odd, docs.schema)).write.parquet(str(path / "documents.parquet"))
    start = spark.read.parquet(str(path / "documents.parquet"))
    seen, real = {}, corpus_pipeline.cut
    corpus_pipeline.cut = lambda df, name: seen.setdefault(name, real(df, name))
    try:
        packed = corpus_pipeline.run(spark, str(path)).collect()
    finally:
        corpus_pipeline.cut = real
    return start, {n: d.collect() for n, d in seen.items()}, {n: d.columns for n, d in seen.items()}, packed


def _bag(rows):
    return collections.Counter(map(tuple, rows))


def test_language_stage(ran):
    start, stages, columns, _ = ran
    assert all(c == start.columns for c in columns.values())
    net = byte_cnn.fit(start, "doc_id", "text", "lang")
    floor = byte_cnn.score_floor(start, "doc_id", "text", "lang", net)
    want = []
    for r in start.collect():
        if r["text"] and any(c.isalpha() for c in r["text"]):
            p = _language(net, r["text"]).max()
            assert abs(p - floor) > 1e-6
            want += [r] * int(p >= floor)
    assert _bag(stages["language_id"]) == _bag(want)


def test_quality_stage(ran):
    _, stages, _, _ = ran
    assert _bag(stages["quality_rules"]) == _bag([r for r in stages["language_id"] if _kept(r["text"])])


def test_near_duplicate_stage(ran):
    _, stages, _, _ = ran
    before, after = stages["quality_rules"], stages["near_duplicates"]
    stay = _survivors(before)
    assert sorted(r["doc_id"] for r in after if r["doc_id"] is not None) == sorted(stay)
    assert sum(r["doc_id"] is None for r in after) == sum(r["doc_id"] is None for r in before)
    assert not _bag(after) - _bag(before)


def test_mixing_stage(ran):
    _, stages, _, _ = ran
    docs, mixed = stages["near_duplicates"], _bag(stages["source_mix"])
    size, most = collections.Counter(), collections.Counter()
    for r in docs:
        size[r["source"]] += len(_words(r["text"]))
        most[r["source"]] = max(most[r["source"]], len(_words(r["text"])))
    target, taken = _targets(size), collections.Counter()
    assert set(mixed) <= set(map(tuple, docs))
    for r in docs:
        e, n = target[r["source"]] / size[r["source"]], mixed[tuple(r)]
        assert math.floor(e - 1e-9) <= n <= min(3, math.ceil(e + 1e-9))
        taken[r["source"]] += n * len(_words(r["text"]))
    assert all(abs(taken[s] - target[s]) <= most[s] for s in size)


def test_packing_stage(ran):
    from trendlens.llm import packing
    _, stages, _, packed = ran
    assert packing and len(packed) >= len(stages["source_mix"])
    rows = collections.defaultdict(list)
    for r in packed:
        rows[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in rows.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in packed)
    assert -(-total // 2048) <= len(rows) <= 1.1 * total / 2048 + 1
    # every copy is cut into pieces that follow each other
    copies = collections.Counter(r["doc_id"] for r in stages["source_mix"])
    assert collections.Counter(r["doc_id"] for r in packed if r["piece"] == 0) == copies
