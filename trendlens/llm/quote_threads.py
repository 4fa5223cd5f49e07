"""Operator 6: chat formatting by quotation linking.

DataFrame operations only.  A message's lines carry a quote level (the ``>``
marks they begin with).  Runs of lines of one level are passages.  Passages and
their lines are normalised (marks off, blanks folded, lower case) and hashed;
the original of a quoted passage is the first message of the conversation whose
own words (level 0) have that hash.  A message replies to the original of most
of its level-1 quotes (a whole passage weighs more than a line; ties to the
latest), or, with no quote that links, to the message one turn before.  Threads
come from pointer doubling over these replies, and conversations are returned
in reply order, without the quotes.

Originals are one row per conversation and hash (a ``min``), so a line that
thousands of messages share joins linearly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendlens.llm.common import cut, prepare, settled

MARKS = r"^(\s?>)+"
PASSAGE_WEIGHT = 1000


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", ""))


def _normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(text, MARKS, ""), r"\s+", " ")))


def quote_lines(text: Column) -> Column:
    """Lines as (level, raw without marks, normalised)."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.struct(
        _level(x).alias("level"), F.regexp_replace(x, MARKS + " ?", "").alias("body"), _normal(x).alias("norm")))


def passages(lines: Column) -> Column:
    """Runs of lines of one level: (level, normalised text of the run)."""
    n = F.size(lines)
    at = lambda i: F.element_at(lines, i.cast("int"))
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (
        at(i)["level"] != at(F.greatest(i - 1, F.lit(1)))["level"]))
    ends = F.concat(F.slice(starts, 2, n), F.array(n + 1))
    return F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda r: F.struct(
        at(r["s"])["level"].alias("level"),
        F.array_join(F.filter(F.transform(F.slice(lines, r["s"], r["e"] - r["s"]), lambda x: x["norm"]),
                              lambda x: x != ""), " ").alias("norm")))


def link_replies(df: DataFrame, conv_col: str, turn_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, links): each (conv, turn) with its parent turn, and every quoted
    unit's original: ``conv, turn, level, origin, weight``."""
    msgs = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                     F.col(text_col).cast("string").alias("text")).where("conv is not null and turn is not null")
    runs = settled(settled(msgs, "lines", quote_lines(F.col("text"))), "runs", passages(F.col("lines")))
    one = lambda c, w: F.transform(c, lambda x: F.struct(x["level"].alias("level"), x["norm"].alias("norm"),
                                                         F.lit(w).alias("weight")))
    units = (runs.select("conv", "turn", F.explode_outer(F.concat(one(F.col("runs"), PASSAGE_WEIGHT),
                                                            one(F.col("lines"), 1))).alias("u"))
             .where("u.norm <> ''")
             .select("conv", "turn", "u.level", "u.weight", F.xxhash64("u.norm").alias("h"),
                     F.hash("u.norm").alias("h2")))
    own = units.where("level = 0").groupBy("conv", "h", "h2").agg(F.min("turn").alias("origin"))
    links = cut(units.where("level > 0").join(own, ["conv", "h", "h2"]).where("origin < turn")
                .select("conv", "turn", "level", "origin", "weight"), "quotes")
    votes = links.where("level = 1").groupBy("conv", "turn", "origin").agg(F.sum("weight").alias("votes"))
    quoted = votes.groupBy("conv", "turn").agg(F.max(F.struct("votes", "origin")).alias("b")).select(
        "conv", "turn", F.col("b.origin").alias("quoted"))
    nodes = msgs.select("conv", "turn").distinct()
    prior = nodes.select("conv", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("prior"))
    nodes = (nodes.join(quoted, ["conv", "turn"], "left").join(prior, ["conv", "turn"], "left")
             .select("conv", "turn", F.coalesce("quoted", "prior").alias("parent"),
                     F.col("quoted").isNotNull().alias("by_quote")))
    return cut(nodes, "replies"), links


def threads(nodes: DataFrame) -> DataFrame:
    """``conv, turn, parent, by_quote, thread, depth``: the root turn of each
    message and its distance, by pointer doubling.  A doubling joins only the
    messages whose pointer has not reached its root yet."""
    t = cut(nodes.select("conv", "turn", "parent", "by_quote", F.coalesce("parent", "turn").alias("up"),
                         F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"),
                         F.col("parent").isNull().alias("done")), "threads")
    done, rest = t.where("done"), t.where("not done")
    while rest.limit(1).count():
        at = done.unionByName(rest).select("conv", F.col("turn").alias("up"), F.col("up").alias("up2"),
                                           F.col("depth").alias("d2"), F.col("done").alias("done2"))
        t = cut(rest.join(at, ["conv", "up"]).select(
            "conv", "turn", "parent", "by_quote", F.col("up2").alias("up"), (F.col("depth") + F.col("d2")).alias("depth"),
            F.col("done2").alias("done")), "threads")
        done, rest = done.unionByName(t.where("done")), t.where("not done")
    return done.drop("done").withColumnRenamed("up", "thread")


def format_chats(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``conv_id, thread, depth, turn, parent_turn, by_quote, role, text``.

    Sorted by ``thread, turn`` within a conversation every reply follows what it
    answers; ``text`` has no quoted lines.  A null text is empty.  A message
    without conversation or turn stays alone, with null thread, depth and
    parent.  Messages that repeat a turn are one node and keep a row each.  An
    empty table gives an empty result; other columns are ignored.
    """
    prepare(df.sparkSession)
    nodes, _ = link_replies(df, conv_col, turn_col, text_col)
    tree = threads(nodes).alias("t")
    plain = F.array_join(F.transform(F.filter(quote_lines(F.col(text_col).cast("string")), lambda x: x["level"] == 0),
                                     lambda x: x["body"]), "\n")
    rows = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                     F.col(role_col).alias("role"), F.trim(plain).alias("text")).alias("m")
    return rows.join(tree, F.expr("m.conv_id = t.conv and m.turn = t.turn"), "left").select(
        "m.conv_id", "t.thread", "t.depth", "m.turn", F.col("t.parent").alias("parent_turn"), "t.by_quote", "m.role",
        "m.text")
