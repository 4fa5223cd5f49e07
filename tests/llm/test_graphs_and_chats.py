"""Nearest neighbours, quotation threads, components and the pipeline."""

import numpy as np

import corpus_pipeline
from trendlens.llm import catalog, graph_ann, quote_threads
from trendlens.llm.components import components

SF001 = "/root/testdata/sf0.001"


def test_neighbours_have_high_recall_and_exact_scores(spark):
    df = spark.read.parquet(f"{SF001}/embeddings.parquet")
    got = catalog.QUERIES["op2_graph_neighbours"](spark, SF001).collect()
    p = df.toPandas()
    x, ids = np.array(p["embedding"].tolist(), float), p["vec_id"].to_numpy()
    hit = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:20]])
        mine = sorted((r for r in got if r["query_id"] == ids[q]), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert all(abs(r["score"] - x[q] @ x[np.flatnonzero(ids == r["vec_id"])[0]]) < 1e-12 for r in mine)
        hit += len(best & {r["vec_id"] for r in mine})
        total += 20
    assert hit >= 0.95 * total


def test_neighbours_with_equal_and_invalid_vectors(spark):
    rows = [(i, [1.0, 0.0], 0) for i in range(60)] + [(100, [0.0, 2.0], 0), (120, None, 1), (140, [0.0, 0.0], 1),
                                                     (160, [float("nan"), 1.0], 1), (180, [None, 1.0], 1), (None, [1.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = graph_ann.nearest(df, "vec_id", "embedding", df.where("vec_id % 20 = 0"), k=5).collect()
    of = lambda q: [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])]
    assert of(0) == [1, 2, 3, 4, 5] and of(20) == of(40) == of(100) == [0, 1, 2, 3, 4]
    assert {r["query_id"] for r in got} == {0, 20, 40, 100}
    assert graph_ann.nearest(df.where("false"), "vec_id", "embedding", df.where("false")).count() == 0


def test_neighbours_over_many_shards_and_tasks(spark):
    x = np.random.default_rng(5).normal(size=(4000, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[8].tolist()), (40, x[41].tolist()), (9, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(8)
    size = 4000 * (8 * 16 + 4 * 17 + 8 * graph_ann.DEGREE + 8 * 21) // 20
    layout = graph_ann._layout({16: 4000, 2: 1}, {16: 200, 3: 4}, 20, size, 8)
    assert [r[0] for r in layout] == [16] and layout[0][1] >= 20 and layout[0][3] >= 2      # shards, groups of shards
    got = graph_ann.nearest(df, "vec_id", "embedding", df.where("vec_id % 20 = 0"), shard_bytes=size).collect()
    vec, owner = np.array([v for _, v in rows[:-1]]), np.array([i for i, _ in rows[:-1]])
    hit = total = 0
    for q in range(0, 4000, 20):
        best = {}
        for v in vec[owner == q]:
            for i, s in zip(owner, vec @ v):
                if i != q:
                    best[int(i)] = max(best.get(int(i), -np.inf), s)
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21)) and len({r["vec_id"] for r in mine}) == 20
        assert all(abs(r["score"] - best[r["vec_id"]]) < 1e-9 for r in mine)
        hit += len({r["vec_id"] for r in mine} & set(sorted(best, key=lambda i: (-best[i], i))[:20]))
        total += 20
    assert hit >= 0.95 * total


def test_best_answers_are_kept_by_score_then_id():
    rng = np.random.default_rng(1)
    row, ids, score = rng.integers(0, 9, 500), rng.integers(0, 30, 500), rng.integers(0, 8, 500).astype(float)
    want = []
    for r in range(9):
        top = {}
        for i, s in zip(ids[row == r], score[row == r]):
            top[i] = max(top.get(i, -1.0), s)
        want += [(r, i, top[i]) for i in sorted(top, key=lambda i: (-top[i], i))[:5]]
    assert list(zip(*graph_ann._keep_best(row, ids, score, 5))) == want
    none = np.zeros(0, np.int64)
    assert all(len(a) == 0 for a in graph_ann._keep_best(none, none, np.zeros(0), 5))


def test_quotes_link_replies_and_vanish(spark):
    rows = [(1, 0, "user", "How do I sort?\nUse which call?"), (1, 1, "assistant", "Use sorted."),
            (1, 2, "user", "> How do I  SORT?\n> Use which call?\nSame question here."),
            (1, 3, "user", ">> How do I sort?\n>> Use which call?\n> Use sorted.\nThanks."),
            (1, 4, "user", "> never said\nHm."), (2, 0, "user", None), (None, 3, "user", "> x"), (2, 0, None, "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as depth")
    got = {(r["conv_id"], r["turn"]): r for r in quote_threads.format_chats(df, "conv_id", "turn", "role", "text").collect()}
    parent = {k: r["parent_turn"] for k, r in got.items()}
    assert parent == {(1, 0): None, (1, 1): 0, (1, 2): 0, (1, 3): 1, (1, 4): 3, (2, 0): None, (None, 3): None}
    assert got[1, 2]["text"] == "Same question here." and got[1, 3]["text"] == "Thanks."
    assert got[1, 3]["by_quote"] and not got[1, 4]["by_quote"]
    assert [got[1, t]["depth"] for t in range(5)] == [0, 1, 1, 2, 3] and all(got[1, t]["thread"] == 0 for t in range(5))
    assert quote_threads.format_chats(df.where("false"), "conv_id", "turn", "role", "text").count() == 0


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (None, 3)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


def test_pipeline_stages_keep_their_contracts(spark, docs, odd):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "near_duplicates", "source_mix",
                                                      "best_fit_packing"]
    from trendlens.llm import ngram_join

    before = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, before, SF001).cache()
        assert after.columns == docs.columns
        a, b = {r["doc_id"] for r in after.collect()}, {r["doc_id"] for r in before.collect()}
        assert a <= b and len(a) == after.count()
        if name == "near_duplicates":
            r = ngram_join.with_component(ngram_join.jaccard_join(before, "doc_id", "text", k=5, percent=80)).collect()
            assert a == {x["component_id"] for x in r}
        before = after
    assert corpus_pipeline.run(spark, SF001).count() > 0
    assert corpus_pipeline.mix(spark, odd.select("doc_id", "text", "lang", "source"), SF001).columns == [
        "doc_id", "text", "lang", "source"]


def test_packing_slices_follow_each_length_and_need_no_sorted_join(spark, monkeypatch):
    from trendlens.llm import packing

    monkeypatch.setattr(packing, "SLICE_ROWS", 5)
    rows = [(i, "common" if i < 40 else "a " * i) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = packing.pack(df, "doc_id", "text", capacity=64)
        got = out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64
    counts = {}
    for r in got:
        counts[r["length"]] = counts.get(r["length"], 0) + 1
    assert len(places) == packing.plan(counts, 64)[1]
    assert {r["doc_id"] for r in got} == set(range(60))
