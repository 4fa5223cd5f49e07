"""Text operators against plain Python and the tokenizers library."""

import collections
import itertools
import math
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from trendlens.llm import (byte_cnn, catalog, hmm, licences, mixing, ngram_join, packing, quality_cascade, token_counts,
                           tokens)

SF001 = "/root/testdata/sf0.001"


def _norm(rows, cols):
    return sorted(tuple(repr(round(r[c], 9) if isinstance(r[c], float) else r[c]) for c in cols) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF001}/documents.parquet')")
    got = catalog.QUERIES[name](spark, SF001)
    cur = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    cols = sorted(names)
    assert _norm(got.collect(), cols) == _norm([dict(zip(names, r)) for r in cur.fetchall()], cols)


def test_jaccard_join_on_odd_rows(spark, odd):
    r = ngram_join.with_component(ngram_join.jaccard_join(odd, "doc_id", "text")).collect()
    assert len(r) == odd.count()
    comp = {x["doc_id"]: x["component_id"] for x in r}
    assert comp[1] == comp[2] == 1 and comp[8] == comp[9] == 8
    assert comp[None] is None and comp[4] == 4 and comp[5] == 5 and comp[6] == 6
    n = {x["doc_id"]: x["n_shingles"] for x in r}
    assert n[4] == n[5] == n[6] == 0 and n[8] == 1 and n[1] == 9
    assert ngram_join.with_component(ngram_join.jaccard_join(odd.where("false"), "doc_id", "text")).count() == 0


def test_jaccard_join_of_a_large_group_and_shared_passage(spark):
    base = [f"w{i}" for i in range(200)]
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(80):          # near copies of one text, each with its own change
        w = list(base)
        w[(7 * i) % 200] = f"x{i}"
        rows.append((i, " ".join(w)))
    for i in range(80, 160):     # unrelated texts around one passage
        rows.append((i, " ".join([f"u{i}_{k}" for k in range(60)] + passage)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.with_component(
        ngram_join.jaccard_join(df, "doc_id", "text")).collect()}
    sets = {i: {tuple(t.split()[j:j + 4]) for j in range(len(t.split()) - 3)} for i, t in rows}
    best = {i: i for i, _ in rows}
    for _ in range(3):
        for a, b in itertools.combinations(best, 2):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                best[a] = best[b] = min(best[a], best[b])
    assert got == best


def test_all_links_match_brute_force_pairs(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE_ROWS", 16)     # several tiles a bucket
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(40):          # a near-copy group, some texts twice and one in upper case
        w = list(base)
        for j in range(i % 4):
            w[(31 * i + 50 * j) % 200] = f"x{i}_{j}"
        rows.append((i, " ".join(w)))
    rows += [(40, rows[5][1]), (41, rows[6][1].upper()), (42, "alone in this table with its own words"), (43, None), (None, rows[1][1])]
    rows += [(2, "second text of an id that is in the group already"), (44, "second text of an id that is in the group already"),
             (7, rows[8][1]), (0, "tail " + rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    join = ngram_join.jaccard_join(df, "doc_id", "text")
    sets = [(i, frozenset(tuple(t.lower().split()[j:j + 4]) for j in range(len(t.split()) - 3)))
            for i, t in rows if i is not None and t]
    alike = {(a, b) for (a, x), (b, y) in itertools.product(sets, sets) if a != b and 100 * len(x & y) >= 85 * len(x | y)}
    want = {i: sum(a == i for a, _ in alike) for i, _ in rows if i is not None}
    got = join.link_counts.collect()
    assert len(got) == len(want) and {r["doc_id"]: r["n_links"] for r in got} == want
    different = {frozenset((x, y)) for _, x in sets for _, y in sets if x != y and 100 * len(x & y) >= 85 * len(x | y)}
    links = join.links.collect()
    assert len(links) == len({(r["a"], r["ka"], r["b"], r["kb"]) for r in links}) == len(different)
    assert sorted(r["shared"] for r in links) == sorted(len(frozenset.intersection(*p)) for p in different)
    assert join.connecting.count() < len(different)


def test_hmm_base_and_forward(spark, docs):
    got = {r["doc_id"]: r for r in hmm.hmm_scores(docs, "doc_id", "text", search_passes=2, full_passes=1).collect()}
    rows = docs.select("doc_id", "text").collect()
    low = lambda t: (t or "").encode().lower().split() + ["end"]
    c = collections.Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 10 for w in low(t))
    total, vocab = sum(c.values()), len(c)
    for i, t in rows:
        w = low(t)
        base = sum(math.log10((c[x] + 0.1) / (total + 0.1 * (vocab + 1))) for x in w)
        r = got[i]
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["train_tokens"] == total
        assert (r["n_tokens"], r["n_known"]) == (len(w), sum(x in c for x in w))
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_every_hmm_pass_sees_all_training_texts(spark, docs, monkeypatch):
    # four copies: more than the 400,000 training tokens up to which a budget would not show
    many = docs.crossJoin(spark.range(4).select("id")).selectExpr("doc_id * 4 + id as doc_id", "repeat(concat(text, ' '), 10) as text")
    one = hmm.baum_welch
    seen = []
    monkeypatch.setattr(hmm, "baum_welch", lambda m, seqs, prior: (seen.append(seqs.count()), m if len(seen) > 1 else one(m, seqs, prior))[1])
    r = hmm.hmm_scores(many, "doc_id", "text").collect()
    assert r[0]["train_tokens"] > 400_000
    assert seen == [sum(not x["held_out"] for x in r)] * 13


def test_forward_is_exact_and_expected_counts_add_up():
    rng = np.random.default_rng(0)
    k, n = 3, 5
    norm = lambda a, ax: a / a.sum(axis=ax, keepdims=True)
    m = hmm.Hmm(norm(rng.random(k), 0), norm(rng.random(k), 0), norm(rng.random((k, k)), 1), norm(rng.random((n, k)), 0))
    seqs = [rng.integers(0, n, s).astype(np.uint16) for s in (1, 4, 6)]
    got = hmm.forward_log10(m, [s.tobytes() for s in seqs])
    for s, g in zip(seqs, got):
        p = sum(m.start[z[0]] * np.prod([m.move[a, b] for a, b in zip(z, z[1:])]) * np.prod(
            [m.emit[x, y] for x, y in zip(s, z)]) for z in itertools.product(range(k), repeat=len(s)))
        assert math.isclose(g, math.log10(p), rel_tol=1e-9)
    x, size, first = hmm._blocks([s.tobytes() for s in seqs])
    s0, s1, moves, counts = hmm.expected_counts(m, x, size, first)
    assert math.isclose(counts.sum(), 11, rel_tol=1e-4) and math.isclose(moves.sum(), 8, rel_tol=1e-4)
    assert math.isclose(s0.sum(), 3, rel_tol=1e-4) and s1.sum() == 0


def test_hmm_on_odd_rows(spark, odd):
    r = hmm.hmm_scores(odd, "doc_id", "text", search_passes=1, full_passes=1).collect()
    assert len(r) == odd.count() and all(math.isfinite(x["score"]) and math.isfinite(x["base_score"]) for x in r)
    assert {x["doc_id"]: x["n_tokens"] for x in r}[4] == 1
    assert hmm.hmm_scores(odd.where("false"), "doc_id", "text").count() == 0


def test_mix_reaches_targets(spark, docs, odd):
    r = mixing.mix_report(docs, "doc_id", "text", "source").collect()
    src = {x["doc_id"]: x["source"] for x in docs.collect()}
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for x in r:
        s = src[x["doc_id"]]
        size[s] += x["size"]
        taken[s] += x["taken"]
        target[s] = x["target"]
        assert x["taken"] <= 3 * x["size"]
    names = sorted(size)
    want, weight = dict.fromkeys(names, 0.0), {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    free, left = set(names), float(sum(size.values()))
    while free:                  # stop what is over its limit, share the rest again
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= 3 * size[s]}
        for s in over or free:
            want[s] = 3 * size[s] if over else level * weight[s]
        left -= sum(3 * size[s] for s in over)
        free = free - over if over else set()
    assert all(math.isclose(target[s], want[s], rel_tol=1e-9) for s in names)
    longest = max(x["size"] for x in r)
    assert all(abs(taken[s] - target[s]) <= 2 * longest for s in names)
    again = mixing.mix_report(docs, "doc_id", "text", "source").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, r))
    o = mixing.mix_report(odd, "doc_id", "text", "source").collect()
    assert len(o) == odd.count() and all(x["taken"] <= 3 * x["size"] for x in o)
    assert mixing.mixed(odd, "doc_id", "text", "source").columns == odd.columns
    assert mixing.mix_report(odd.where("false"), "doc_id", "text", "source").count() == 0


def test_plan_places_every_piece_once():
    rng = np.random.default_rng(1)
    for _ in range(40):
        cap = int(rng.integers(8, 60))
        counts = {int(s): int(rng.integers(1, 30)) for s in rng.integers(1, cap + 1, 12)}
        slots, total = packing.plan(counts, cap)
        seen, bins = collections.Counter(), collections.defaultdict(list)
        for size, lo, hi, seq, per, at in slots:
            for r in range(lo, hi):
                seen[size, r] += 1
                bins[seq + (r - lo) // per].append((at + (r - lo) % per * size, size))
        assert set(seen) == {(s, r) for s, c in counts.items() for r in range(c)} and set(seen.values()) == {1}
        assert sorted(bins) == list(range(total))
        for b in bins.values():
            b.sort()
            assert all(x + s == y for (x, s), (y, _) in zip(b, b[1:])) and b[0][0] == 0 and sum(s for _, s in b) <= cap


def test_pack_matches_the_tokenizer(spark, docs, odd):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.vocabulary_path())
    for df in (docs, odd):
        texts = df.select("doc_id", "text").collect()
        ids = collections.defaultdict(list)
        for i, t in texts:
            ids[i].append(tok.encode(t or "", add_special_tokens=False).ids + [0])
        got = packing.pack(df, "doc_id", "text").collect()
        at = collections.defaultdict(list)
        for r in got:
            assert any(zlib.crc32(np.array(x[r["start"]:r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
                       for x in ids[r["doc_id"]])
            assert r["length"] == 2048 or r["piece"] == 0
            at[r["sequence_id"]].append((r["offset"], r["length"]))
        assert sum(r["length"] for r in got) == sum(len(x) for v in ids.values() for x in v)
        for b in at.values():
            b.sort()
            assert b[0][0] == 0 and all(x + n == y for (x, n), (y, _) in zip(b, b[1:])) and sum(b[-1]) <= 2048
        assert len(at) <= 1.02 * math.ceil(sum(r["length"] for r in got) / 2048) + 1
    assert packing.pack(odd.where("false"), "doc_id", "text").count() == 0


ODD_TEXTS = ["", " ", "  a  b", "a \n b\n\n c", "don't I'll <|endoftext|> x", "　a b c", "日本 😀😀 é",
             "a\x1c b\x85 c", "\t\t x\r\n y", "12 345!? ...", " lead", "trail ", "a   b    c"]


def test_token_spans_match_the_tokenizer():
    from tokenizers import Tokenizer

    tok, enc = Tokenizer.from_file(tokens.vocabulary_path()), tokens.encoder(tokens.vocabulary_path())
    for t in ODD_TEXTS:
        e = tok.encode(t, add_special_tokens=False)
        ids = np.frombuffer(enc.encode(t), "<u4")
        assert ids.tolist() == e.ids
        a, b = token_counts.token_spans(t, ids, enc.token_bytes())
        assert list(zip(a.tolist(), b.tolist())) == e.offsets


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts_add_up(spark, odd, rule):
    r = token_counts.token_counts(odd, "doc_id", "text", rule=rule).collect()
    total, whole = collections.Counter(), {}
    for x in r:
        total[x["doc_id"]] += x["tokens"]
        whole[x["doc_id"]] = x["doc_tokens"]
    copies = collections.Counter(x["doc_id"] for x in odd.collect())
    assert all(math.isclose(total[i], whole[i] * copies[i], abs_tol=1e-6) for i in whole) and whole[4] == 0


def test_tokens_of_given_spans_by_rule():
    begin, stop = np.array([0, 3, 5]), np.array([3, 5, 9])     # the last token crosses 6
    for rule, want in (("start", [3, 0]), ("end", [2, 1]), ("majority", [2, 1]), ("split", [2.25, 0.75])):
        n, crossing = token_counts.attribute(begin, stop, np.array([0, 6]), np.array([6, 9]), rule)
        assert n.tolist() == want and crossing.tolist() == [1, 1]


def test_quality_order_does_not_change_the_verdict(spark, docs, odd):
    names = [r.name for r in quality_cascade.RULES]
    a = quality_cascade.quality_report(docs, "doc_id", "text", order=names).collect()
    b = quality_cascade.quality_report(docs, "doc_id", "text", order=names[::-1]).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    lazy = quality_cascade.quality_cascade(docs, "text", order=names[::-1]).select("doc_id", "_kept").collect()
    assert sorted(map(tuple, lazy)) == sorted((r["doc_id"], r["kept"]) for r in a)
    o = {r["doc_id"]: r for r in quality_cascade.quality_report(odd, "doc_id", "text").collect()}
    assert o[4]["n_words"] == 0 and o[4]["base_failed"] and not o[4]["kept"] and o[1]["kept"]
    assert quality_cascade.quality_report(odd.where("false"), "doc_id", "text").count() == 0


def test_a_rule_sees_only_the_texts_that_are_left(docs):
    texts = [r["text"] or "" for r in docs.collect()][:200] + ["", "a b c", "WORD " * 50, "# " * 40, "same line\n" * 30]
    data = [t.encode() for t in texts]
    off = np.cumsum([0, *map(len, data)])
    whole = quality_cascade.Facts(np.frombuffer(b"".join(data), np.uint8), off)
    seen = {}

    def counted(rule):
        def rejects(facts):
            seen[rule.name] = facts.n, len(facts.buf)
            return rule.rejects(facts)
        return quality_cascade.Rule(rule.name, rejects)

    for order in (quality_cascade.RULES, quality_cascade.RULES[::-1]):
        bad = np.array([r.rejects(quality_cascade.Facts(whole.buf, off)) for r in order])
        first = quality_cascade.run_rules([counted(r) for r in order], quality_cascade.Facts(whole.buf, off))
        want = np.where(bad.any(axis=0), bad.argmax(axis=0), -1)
        assert first.tolist() == want.tolist()
        size = np.array(list(map(len, data)))
        for i, r in enumerate(order):
            left = (want == -1) | (want >= i)
            assert seen[r.name] == (left.sum(), size[left].sum()), r.name
        assert seen[order[-1].name][0] < len(texts)
    some = np.flatnonzero(np.arange(len(texts)) % 3 > 0)
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stutters", "n_upper", "n_letters",
             "n_letter_words")
    for known in ((), ("words",), ("hashes", "n_upper", "n_words")):
        f = quality_cascade.Facts(whole.buf, off)
        for k in known:
            getattr(f, k)
        for name in names:
            assert getattr(f.subset(some), name).tolist() == getattr(whole, name)[some].tolist(), name


def test_shouting_counts_letters_of_every_script(spark):
    texts = {"ru": "Сегодня утром в городе прошла встреча, где NATO обсуждала новые планы на ближайшие два года",
             "el": "Σήμερα το πρωί στην πόλη έγινε συνάντηση όπου το NATO συζήτησε νέα σχέδια για δύο χρόνια",
             "ar": "عقد هذا الصباح في المدينة اجتماع ناقش فيه NATO خططا جديدة للسنوات القليلة القادمة",
             "odd": "𝒜 少し 漢字 NATO の 文章 です ひとつ ふたつ みっつ よっつ いつつ むっつ ななつ",
             "en": "this morning in the town a meeting of NATO spoke about new plans for the next two years"}
    rows = [(k, t) for k, t in texts.items()] + [(k + "!", texts[k].upper()) for k in ("ru", "el", "en")]
    got = {r["id"]: r["_failed"] for r in quality_cascade.quality_cascade(
        spark.createDataFrame(rows, "id string, text string"), "text", order=[r.name for r in quality_cascade.RULES]).collect()}
    assert got == {**dict.fromkeys(texts), **dict.fromkeys(("ru!", "el!", "en!"), "shouting")}
    buf = np.frombuffer("".join(texts.values()).encode(), np.uint8)
    facts = quality_cascade.Facts(buf, np.cumsum([0, *(len(t.encode()) for t in texts.values())]))
    assert facts.n_upper.tolist() == [sum(c.isupper() for c in t) for t in texts.values()]
    assert facts.n_letters.tolist() == [sum(c.isalpha() for c in t) for t in texts.values()]


def test_language_on_held_out_and_odd_rows(spark, odd):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = byte_cnn.language_report(df, "doc_id", "text", "lang").collect()
    lang = {x["doc_id"]: x["lang"] for x in df.select("doc_id", "lang").collect()}
    held = [x for x in r if x["held_out"]]
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2) for x in r)
    assert sum(x["lang_pred"] == lang[x["doc_id"]] for x in held) >= 0.97 * len(held)
    o = {x["doc_id"]: x for x in byte_cnn.language_report(odd, "doc_id", "text", "lang", steps=5).collect()}
    assert all(o[i]["lang_pred"] == "und" and o[i]["score"] == 0 for i in (4, 5, 6, 10))
    assert 0 <= o[7]["score"] <= 1
    assert byte_cnn.language_report(odd.where("false"), "doc_id", "text", "lang").count() == 0


def test_language_learns_every_label(spark):
    def text(i, j):              # every label has two letters of its own
        return "".join((chr(0x4E00 + 64 * i), chr(0x4E00 + 64 * i + 7), " ")[(j + k * k) % 3] for k in range(120 + j))

    rows = [(100 * i + j, text(i, j), f"l{i:02d}") for i in range(70) for j in range(30 if i < 64 else 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    crops, labels = byte_cnn.labelled_sample(df, "doc_id", "text", "lang", 400, 140, 600)
    assert set(labels) == {y for _, _, y in rows} and set(collections.Counter(labels).values()) <= {1, 2}
    got = byte_cnn.language_report(df, "doc_id", "text", "lang").where("doc_id >= 6400").collect()
    assert len(got) == 18 and sum(r["lang_pred"] == f"l{r['doc_id'] // 100}" for r in got) >= 16


def _best_window(text, template, percent=80):
    """Dice of every window of words, by definition."""
    from collections import Counter

    cut = lambda x: [w for w in re.split("[^a-z0-9]+", x.lower()) if w]
    pairs = lambda w: list(map(" ".join, zip(w, w[1:])))
    words, bag = pairs(cut(text or "")), Counter(pairs(cut(template)))
    t, best = bag.total(), None
    for s in range(len(words)):
        for e in range(s, min(len(words), s + 2 * t + 2)):
            common = (Counter(words[s:e + 1]) & bag).total()
            if 200 * common >= percent * (e - s + 1 + t):
                best = min(best or (0, 0, 0), (-2 * common / (e - s + 1 + t), s, e - s + 2))
    return best and (best[1], best[2], -best[0])


def test_tiles_meet_every_pair_of_linkable_sizes_once(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE_ROWS", 7)
    sizes = [1, 2, 3, 4, 5, 6, 8, 10, 11, 12, 13, 20, 23, 24, 27, 28, 33, 100, 117, 118, 137, 138] * 9
    rows = [("big", i, i, n, len(sizes)) for i, n in enumerate(sizes)] + [("small", 1000 + i, i, 3 + 40 * i, 5) for i in range(5)]
    df = spark.createDataFrame(rows, "h string, id long, k1 long, n long, size long")
    tiles = ngram_join._tiled(df, 85).cache()
    x, y = tiles.alias("x"), tiles.alias("y")
    from pyspark.sql import functions as F

    once = (F.col("x.lo") == F.col("x.hi")) | (F.col("x.place") != F.col("y.place"))
    met = collections.Counter((r["a"], r["b"]) for r in x.join(y, (F.col("x.h") == F.col("y.h")) & (
        F.col("x.lo") == F.col("y.lo")) & (F.col("x.hi") == F.col("y.hi")) & once & (F.col("x.id") < F.col("y.id"))).select(
        F.col("x.id").alias("a"), F.col("y.id").alias("b")).collect())
    linkable = {(a, b) for h, a, _, n, _ in rows for g, b, _, m, _ in rows
                if h == g and a < b and min(n, m) * 100 >= 85 * max(n, m)}
    assert linkable <= set(met) and max(met.values()) == 1
    far = sum(min(sizes[a], sizes[b]) * 2 < max(sizes[a], sizes[b]) for a, b in met if b < len(sizes))
    assert far == 0 and tiles.where("h = 'small'").count() == 5


def test_language_floor_is_above_chance_and_keeps_right_predictions(spark, docs, odd):
    many = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    net = byte_cnn.fit(many, "doc_id", "text", "lang")
    chance = 1.1 / len(net.labels)
    floor = byte_cnn.score_floor(many, "doc_id", "text", "lang", net)
    assert chance < floor < 1
    rows = many.where("doc_id % 7 = 0").union(spark.createDataFrame(
        [(-i, "".join(chr(0x4E00 + (37 * i + 11 * j * j) % 900) for j in range(300)), None, None, None) for i in range(1, 20)], many.schema))
    got = byte_cnn.identify(rows, "text", net).collect()
    right = [r for r in got if r["_lang"] == r["lang"]]
    assert sum(r["_score"] >= floor for r in right) >= 0.98 * len(right)
    assert byte_cnn.score_floor(odd.where("false"), "doc_id", "text", "lang", net) == chance
    assert byte_cnn.score_floor(docs, "doc_id", "text", "lang", net) == chance      # too few rows to tell
    assert byte_cnn.score_floor(docs, "doc_id", "text", "lang", None) == 0


def test_licence_windows_equal_all_windows_by_brute_force(spark):
    import random

    rnd = random.Random(10)
    templates = (("A", "notice", "Licensed under the Apache License, Version 2.0."), ("B", "text", "the code the code of the code is free"),
                 ("C", "notice", "one two"), ("D", "notice", "word"))
    vocab = "licensed under the apache license version 2 0 code of is free one two x".split()
    texts = [rnd.choice([" ", "\n", ", "]).join(rnd.choice(vocab) for _ in range(rnd.randrange(0, 60))) for _ in range(400)]
    texts += [f"before {t[2]} after, {t[2]}" for t in templates] + [None, "", "the code " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    got = {(r["doc_id"], r["licence"]): (r["start"], r["n_words"], r["dice"])
           for r in licences.scan_licences(df, "id", "body", templates).collect()}
    want = {(i, n): _best_window(x, t) for i, x in enumerate(texts) for n, _, t in templates}
    assert got == {k: v for k, v in want.items() if v} and len(got) > 40


def test_licences_on_odd_rows(spark, odd):
    texts = {n: t for n, f, t in licences.TEMPLATES if f == "text"}
    long_one = " ".join(f"word{i}" for i in range(30_000)) + " " + texts["MIT"].replace("SOFTWARE", "PROGRAM") + " tail"
    rows = [(20, "Some prose.\nreleased UNDER the  MIT license\nmore"), (None, "Licensed under CC BY-NC 4.0!"), (21, texts["MIT"]),
            (22, "A text.\nLicensed under the Apache License,\nVersion 2.0. More text follows here."),
            (23, "We say that it is licensed under the Apache License, version 2.0, as all know."), (24, texts["BSD-3-Clause"]),
            (25, long_one), (26, "Released under the MIT License. " * 2), (26, "Released under the MIT License. " * 2)]
    df = odd.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string")).selectExpr(
        "*", "1 as licence", "2 as start", "3 as w", "4 as hits", "5 as k")
    got = sorted(((r["doc_id"] or 0, r["licence"], r["form"], r["start"], r["n_words"], round(r["dice"], 6))
                  for r in licences.scan_licences(df, "doc_id", "text").collect()))
    found = {(d, n, f) for d, n, f, *_ in got}
    assert {(20, "MIT", "notice"), (0, "CC-BY-NC-4.0", "notice"), (21, "MIT", "text"), (22, "Apache-2.0", "notice"),
            (23, "Apache-2.0", "notice"), (24, "BSD-3-Clause", "text"), (25, "MIT", "text")} <= found
    assert got.count((26, "MIT", "notice", 0, 5, 1.0)) == 2
    assert (21, "MIT", "text", 0, licences.Template("", "", texts["MIT"], 80).size + 1, 1.0) in got
    assert (22, "Apache-2.0", "notice", 2, 8, 1.0) in got and (23, "Apache-2.0", "notice", 5, 8, 1.0) in got
    assert licences.scan_licences(df.where("false"), "doc_id", "text").count() == 0


def test_words_are_cut_at_ascii_blanks_only():
    from trendlens.llm.common import chunks, word_bounds

    texts = ["a b", "", None, "é x\ty\x0bz", " lead trail ", "\n"]
    per = []
    for _, _, buf, off in chunks(pa.array(texts)):
        s, e, p = word_bounds(buf, off)
        per += [[bytes(buf[a:b]).decode() for a, b in zip(s[i:j], e[i:j])] for i, j in zip(p, p[1:])]
    assert per == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


def test_language_floor_counts_every_held_out_row(spark):
    from pyspark.sql import functions as F

    net = byte_cnn.train([b"aaaa bbbb", b"cccc dddd"] * 4, ["x", "y"] * 4, steps=20)
    n = 40_000
    scored = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("x").alias("lang"), F.lit("x").alias("_lang"),
                                   (F.lit(0.6) + F.col("id") / (4.0 * n)).alias("_score"))
    held = sorted(0.6 + i / (4.0 * n) for i in range(n) if zlib.crc32(str(i).encode()) % 4 == 2)
    at = (len(held) - 1) * 0.005
    lo = held[int(at)]
    want = lo + (held[int(at) + 1] - lo) * (at - int(at))
    assert len(held) > 4000 and abs(byte_cnn.floor_of(scored, "doc_id", "lang", net) - want) < 1e-12
