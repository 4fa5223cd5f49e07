"""Quotation threads against plain Python."""

import collections
import random
import re

from trendlens.llm import quote_threads

MARKS = re.compile(r"(\s?>)+")


def _line(x):
    m = MARKS.match(x)
    rest = x[m.end():] if m else x
    norm = re.sub(r"[ \t\n\x0b\f\r]+", " ", rest).strip(" ").lower()
    return (m.group().count(">") if m else 0), (rest[1:] if m and rest.startswith(" ") else rest), norm


def _units(text):
    """(level, normalised, weight) of every passage and line."""
    lines = [_line(x) for x in (text or "").split("\n")]
    runs, out = [], [(lv, n, 1) for lv, _, n in lines]
    for lv, _, n in lines:
        if not runs or runs[-1][0] != lv:
            runs.append((lv, []))
        runs[-1][1].append(n)
    out += [(lv, " ".join(n for n in ns if n), quote_threads.PASSAGE_WEIGHT) for lv, ns in runs]
    return [u for u in out if u[1]]


def _threads(rows):
    """(conv, turn) -> parent, by_quote, thread, depth."""
    said, nodes = {}, collections.defaultdict(list)
    for conv, turn, _, text in rows:
        if conv is None or turn is None:
            continue
        nodes[conv, turn] += _units(text)
        for lv, n, _ in _units(text):
            if lv == 0:
                said[conv, n] = min(said.get((conv, n), turn), turn)
    parent, quoted = {}, {}
    for (conv, turn), units in nodes.items():
        votes = collections.Counter()
        for lv, n, w in units:
            if lv == 1 and said.get((conv, n), turn) < turn:
                votes[said[conv, n]] += w
        quoted[conv, turn] = bool(votes)
        parent[conv, turn] = (max(votes, key=lambda o: (votes[o], o)) if votes
                              else turn - 1 if (conv, turn - 1) in nodes else None)
    out = {}
    for conv, turn in nodes:
        at, depth = turn, 0
        while parent[conv, at] is not None:
            at, depth = parent[conv, at], depth + 1
        out[conv, turn] = (parent[conv, turn], quoted[conv, turn], at, depth)
    return out


def _chats():
    rnd = random.Random(6)
    words = "sort list call queue tree map fold scan Use the of".split()
    rows = []
    for conv in range(60):
        said = []
        for turn in range(rnd.randrange(1, 12)):
            lines = []
            for _ in range(rnd.randrange(0, 3)):             # quotes: whole, in part, nested, of nobody, twice
                if not said:
                    break
                source = rnd.choice(said).split("\n")
                part = source if rnd.random() < 0.5 else source[:1]
                mark = rnd.choice(["> ", ">", " > ", ">> ", "> > "])
                lines += [mark + (x.upper() if rnd.random() < 0.3 else x.replace(" ", "  ")) for x in part]
            own = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 4))) for _ in range(rnd.randrange(0, 3))]
            text = "\n".join(lines + own) if rnd.random() < 0.7 else "\n".join(own + lines)
            rows.append((conv, turn if rnd.random() < 0.9 else turn + 1, rnd.choice(["user", "assistant", None]), text))
            said.append(text)
    long_text = "\n".join(f"line {i} of a very long message" for i in range(3000))
    rows += [(100, 0, "user", long_text), (100, 1, "assistant", "no quote"), (100, 2, "user", "\n".join(f"> {x}" for x in long_text.split("\n"))),
             (101, 0, "u", "one"), (101, 1, "u", "two"), (101, 2, "u", "> one\nx\n> two"), (102, 5, "u", None), (None, 1, "u", "> one"),
             (103, None, "u", "one"), (104, 0, "u", "same"), (104, 0, "u", "same"), (104, 1, "u", "> same")]
    return rows


def test_threads_of_generated_quotes_match_plain_python(spark):
    rows = _chats()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr(
        "*", "1 as depth", "2 as thread", "3 as conv", "'x' as h", "5 as origin").repartition(4)
    got = quote_threads.format_chats(df, "conv_id", "turn", "role", "text").collect()
    want = _threads(rows)
    assert len(got) == len(rows)
    for r in got:
        if r["conv_id"] is None or r["turn"] is None:
            assert r["thread"] is None and r["depth"] is None and r["parent_turn"] is None
        else:
            assert (r["parent_turn"], r["by_quote"], r["thread"], r["depth"]) == want[r["conv_id"], r["turn"]]
    texts = collections.Counter((c, t, "\n".join(b for lv, b, _ in map(_line, (x or "").split("\n")) if lv == 0).strip(" ")) for c, t, _, x in rows)
    assert collections.Counter((r["conv_id"], r["turn"], r["text"]) for r in got) == texts
    assert sum(q for _, q, _, _ in want.values()) > 60 and max(d for *_, d in want.values()) > 4
    assert want[101, 2][0] == 1 and want[100, 2][0] == 0          # a tie goes to the latest; a very long quote links
