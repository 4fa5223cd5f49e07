"""Conversation repair, URL filter and periodic runs against plain Python."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from trendlens.llm import catalog, chat_repair, periodic_runs, url_filter

SF001 = "/root/testdata/sf0.001"
PATTERN = re.compile(r"(s?(ua)+)?")


# ---- operator 11 -----------------------------------------------------------

def _edits(rows):
    """Cheapest edits, ties ASCII-least, by uniform-cost search over all of them."""
    start = (0, "", 0, "", ())
    heap, seen = [start], set()
    while heap:
        cost, audit, i, initials, out = heapq.heappop(heap)
        if i == len(rows) and PATTERN.fullmatch(initials):
            return cost, audit, list(out)
        if (i, initials) in seen:
            continue
        seen.add((i, initials))
        steps = [(2, "I", i, x, f"{r}:") for r, x in (("user", "u"), ("assistant", "a"))]
        if i < len(rows):
            role, text, fault = rows[i]
            late = 1 if fault == "truncated" else 0
            steps.append((3, "D", i + 1, "", None))
            if fault not in ("blank", "duplicate"):
                steps.append((late, "K", i + 1, role[:1] or "?", f"{role}:{text}"))
                steps += [(2 + late, "R", i + 1, x, f"{r}:{text}") for r, x in (("user", "u"), ("assistant", "a"))]
        for c, e, j, x, line in steps:
            s = initials + x
            if re.fullmatch(r"s?(ua)*u?", s):
                heapq.heappush(heap, (cost + c, audit + e, j, s, (*out, line) if line is not None else out))


def _expected(table, damage=True):
    convs = defaultdict(list)
    for conv, turn, role, text in table:
        convs[conv]
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        how = zlib.crc32(name.encode()) % 20 if damage else 9
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        role = "user" if how == 4 else role
        convs[conv] += [] if how == 0 else [(turn, role, text)] * (2 if how == 3 else 1)
    out = {}
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, judged = set(), []
        for turn, role, text in rows:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            fault = ("blank" if not body else "duplicate" if (role, text) in seen
                     else "truncated" if body[-1] not in ".!?" else "sound")
            seen.add((role, text))
            judged.append((role, text, fault))
        turns = [r[0] for r in rows if r[0] is not None]
        cost, audit, lines = _edits(judged)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                     *[sum(f == x for *_, f in judged) for x in ("blank", "duplicate", "truncated")],
                     sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:])),
                     cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def _got(df):
    rows = df.collect()
    out = {r["conv_id"]: tuple(r[c] for c in (*chat_repair.FACTS, "audit", "repaired_sha256")) for r in rows}
    assert len(out) == len(rows)
    return out


def test_repair_query_matches_a_search_over_all_edits(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{SF001}/conversations.parquet")
             .select("conv_id", "turn", "role", "text").collect()]
    assert _got(catalog.QUERIES["op11_chat_repair"](spark, SF001)) == _expected(table)


def _random_chats(n=150):
    rnd = random.Random(11)
    texts = ["Yes.", "No", "", " \t", "Why?", None, "Is it so\n", "a. "]
    roles = ["user", "assistant", "system", "tool", "", None, "usher"]
    rows = [(rnd.choice([c, None]) if c < 3 else c, rnd.choice([None, *range(9)]), rnd.choice(roles), rnd.choice(texts))
            for c in range(n) for _ in range(rnd.randrange(1, 7))]
    return rows + rows[:9]


@pytest.mark.parametrize("buffer_chars", [chat_repair.BUFFER_CHARS, 150])
def test_repair_of_odd_rows_in_memory_and_spilled(spark, buffer_chars):
    rows = _random_chats()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr(
        "*", "1 as place", "'x' as audit", "2 as kind", "false as fault").repartition(5)
    got = chat_repair.repair_report(df, "conv_id", "turn", "role", "text", buffer_chars=buffer_chars)
    assert _got(got) == _expected(rows, damage=False)
    damaged = chat_repair.damaged(df, "conv_id", "turn", "role", "text")
    got = chat_repair.repair_report(damaged, "conv_id", "turn", "role", "text", "gone", buffer_chars=buffer_chars)
    assert _got(got) == _expected(rows)


def test_a_giant_conversation_streams_and_messages_agree_with_the_digest(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    n = 9000
    df = spark.range(n).selectExpr("7 as conv", "id as turn", "if(id % 3 = 0, 'user', if(id % 3 = 1, 'tool', 'assistant')) as role",
                                   "concat('Line ', id, if(id % 5 = 0, '', '.'), repeat('x', if(id = 5, 200000, 0))) as text")
    small = chat_repair.repair_report(df, "conv", "turn", "role", "text").collect()
    spilled = chat_repair.repair_report(df, "conv", "turn", "role", "text", buffer_chars=20_000).collect()
    assert small == spilled and len(small) == 1 and len(small[0]["audit"]) >= n
    for limit in (20_000, chat_repair.BUFFER_CHARS):
        m = chat_repair.repaired_messages(df, "conv", "turn", "role", "text", buffer_chars=limit).orderBy("place").collect()
        assert [r["place"] for r in m] == list(range(len(m)))
        assert "".join(r["role"][0] for r in m) == "ua" * (len(m) // 2)
        text = "\n".join(f"{r['role']}:{r['text']}" for r in m)
        assert hashlib.sha256(text.encode()).hexdigest() == small[0]["repaired_sha256"]
    empty = chat_repair.repair_report(df.where("false"), "conv", "turn", "role", "text")
    assert empty.count() == 0 and empty.schema["conv_id"].dataType == df.schema["conv"].dataType


# ---- operator 12 -----------------------------------------------------------

RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


def _judged(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    best = None
    for r in RULES:
        h, p = r.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and len(r) > len(best or ""):
            best = r
    return host, path, best


def test_url_query_follows_the_rules(spark):
    got = catalog.QUERIES["op12_url_filter"](spark, SF001).collect()
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF001}/pages.parquet").collect()}
    assert len(got) == len(urls)
    for r in got:
        assert (r["host"], r["path"], r["rule"]) == _judged(urls[r["page_id"]])
        assert r["verdict"] == (RULES[r["rule"]] if r["rule"] else "block" if r["score"] >= 0.5 else "allow")


def test_urls_of_odd_forms(spark):
    urls = ["http://WWW.Example.com/EN/", "http://www.example.com/en/x?y#z", "https://a.example.com/en/1", "http://example.com",
            "http://notcom/", "ftp://x.NET/es/?q", "x.net/es/", "://net/fr/", "", None, "a://b://c.com/d", "http://com/",
            "http://h\u00c9.com?x/y", "http://a.net#/es/", "http://b.org/" + "en/" * 40000, "http://com/", "http://net:80/es/"]
    rows = [(i if i % 5 else None, u) for i, u in enumerate(urls)]
    df = spark.createDataFrame(rows, "id long, url string").selectExpr("*", "1 as _host", "2 as _ruled", "url as _score", "3 as h")
    got = url_filter.filter_urls(df, "url", catalog.URL_RULES).collect()
    assert all((r["_host"], r["_path"], r["_rule"]) == _judged(r["url"]) for r in got)
    assert sorted(r["url"] or "" for r in got) == sorted(u or "" for u in urls)
    assert len(got) == len(urls) and all(r["_verdict"] in ("allow", "block") for r in got)
    assert [r["_verdict"] for r in got if r["url"] == "http://com/"] == ["allow", "allow"]
    assert url_filter.filter_urls(df.where("false"), "url", catalog.URL_RULES).count() == 0
    one = url_filter.filter_urls(df.where("url like 'http://com/'").union(df.where("url is null")), "url", catalog.URL_RULES)
    assert {r["_verdict"] for r in one.collect()} == {"allow"}


def test_url_regression_is_accurate_on_held_out_urls(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    spam = pages.selectExpr("page_id", "url", "if(url rlike 'spam|pills|casino', 'block', 'allow') as verdict")
    model = spam.where("page_id % 2 = 0")
    rest = url_filter.filter_urls(spam.where("page_id % 2 = 1"), "url", (), labelled=model).collect()
    right = sum(r["_verdict"] == r["verdict"] for r in rest)
    blocked = [r for r in rest if r["verdict"] == "block"]
    assert len(blocked) > 10 and right >= 0.97 * len(rest)
    assert sum(r["_verdict"] == "block" for r in blocked) >= 0.95 * len(blocked)
    again = url_filter.filter_urls(spam.where("page_id % 2 = 1").repartition(7), "url", (), labelled=model.repartition(5))
    assert {(r["page_id"], r["_score"]) for r in again.collect()} == {(r["page_id"], r["_score"]) for r in rest}


def test_url_training_sample_is_bounded_and_takes_both_verdicts(spark):
    df = spark.range(4000).selectExpr("concat('h', id % 1000, '.org') as h", "'/' as p", "if(id % 1000 < 900, 'allow', 'block') as v")
    assert url_filter.fit(df, "h", "p", "v", max_labelled=40)[0].any()
    assert url_filter.fit(df.where("v = 'block'"), "h", "p", "v")[1] > 0 > url_filter.fit(df.where("false"), "h", "p", "v")[1]


# ---- operator 13 -----------------------------------------------------------

def _lyndon(s):
    """Length of the longest Lyndon word at each place, by definition."""
    return [max(n for n in range(1, len(s) - i + 1) if all(s[i:i + n] < s[i + k:i + n] for k in range(1, n)))
            for i in range(len(s))]


def test_groups_are_the_lyndon_array():
    rnd = random.Random(3)
    for _ in range(600):
        strings = [[rnd.randrange(rnd.choice([1, 2, 3, 5])) for _ in range(rnd.randrange(1, 14))] for _ in range(rnd.randrange(1, 4))]
        flat, opens = sum(strings, []), np.cumsum([0] + [len(x) for x in strings])[:-1]
        size, group = periodic_runs.lyndon_groups(np.unique(flat, return_inverse=True)[1], opens)
        assert size.tolist() == sum([_lyndon(x) for x in strings], [])
        words = [tuple(flat[i:i + n]) for i, n in enumerate(size.tolist())]
        assert len(set(words)) == len(set(group.tolist())) == len(set(zip(words, group.tolist())))


def _runs(s, min_length=6, min_exponent=4):
    out = []
    for p in range(1, len(s) // min_exponent + 1):
        i = 0
        while i < len(s) - p:
            j = i
            while j < len(s) - p and s[j] == s[j + p]:
                j += 1
            n = j - i + p
            if j > i and n >= max(min_length, min_exponent * p) and not any(
                    s[i:i + n - q] == s[i + q:i + n] for q in range(1, p)):
                out.append((i, n, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def _digest(words):
    runs = _runs(words)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    top = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(runs), *(top or (None,) * 3), top and 1000 * top[1] // top[2],
            sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(kept))


def _tail(doc_id, words):
    h = zlib.crc32(str("" if doc_id is None else doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or n == 0:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


COLUMNS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def _split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_runs_query_matches_plain_python(spark):
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in catalog.QUERIES["op13_periodic_runs"](spark, SF001).collect()}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    short = {k: t for k, t in docs.items() if len(_split(t)) < 1500}
    assert len(got) == len(docs) and len(short) > 150
    want = {k: _digest(_tail(k, _split(t))) for k, t in short.items()}
    assert {k: got[k] for k in short} == want and sum(w[0] > 0 for w in want.values()) >= 5


def test_runs_of_odd_and_periodic_texts(spark, odd):
    rnd = random.Random(5)
    texts = ["a " * 6, "a " * 5, "ab\u00a0c " * 40, "", None, " \n ", "x" * 70_000 + " " + "é ü\t" * 9000]
    for _ in range(150):
        s: list[str] = []
        for _ in range(rnd.randrange(0, 6)):
            s += [rnd.choice("abc") for _ in range(rnd.randrange(1, 5))] * rnd.randrange(1, 9)
        texts.append(rnd.choice([" ", "\n", " \t "]).join(s))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, body string").selectExpr("*", "1 as runs", "2 as doc_id")
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in periodic_runs.periodic_report(df, "id", "body").collect()}
    assert {i: got[i] for i in got if i != 6} == {i: _digest(_split(t)) for i, t in enumerate(texts) if i != 6}
    assert got[6][:5] == (1, 1, 18_000, 2, 9_000_000)
    rows = periodic_runs.periodic_runs(odd, "doc_id", "text").collect()
    assert len(rows) == odd.count() and sum(r["doc_id"] is None for r in rows) == 1
    assert periodic_runs.periodic_report(odd.where("false"), "doc_id", "text").count() == 0
    tailed = periodic_runs.with_periodic_tails(odd, "doc_id", "text")
    assert tailed.columns == odd.columns
    want = sorted((r["doc_id"] or 0, _tail(r["doc_id"], _split(r["text"]))) for r in odd.collect())
    assert sorted((r["doc_id"] or 0, _split(r["text"])) for r in tailed.collect()) == want


def test_a_period_of_many_words(spark):
    text = " ".join(f"w{i % 700}" for i in range(700 * 9 + 13))
    r = periodic_runs.periodic_runs(spark.createDataFrame([(1, f"lead in {text} w3 end")], "id long, t string"), "id", "t").first()
    assert [tuple(x) for x in r["runs"]] == [(2, 700 * 9 + 13, 700)]
    assert r["collapsed"] == "lead in " + " ".join(f"w{i}" for i in range(700)) + " w3 end"
