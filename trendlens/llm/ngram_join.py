"""Operator 1: n-gram Jaccard join.

Every text is a set of hashed word shingles.  Two texts link when
``100 * |intersection| >= percent * |union|``.  The join is exact:

* Texts with equal sets form a class; one representative goes on.
* Linked sets must share one of the first ``n - ceil(p*n) + 1`` shingles of any
  fixed order.  The order puts shingles that are common among those prefixes
  last, so shared passages do not make candidates of unrelated texts.
* A bucket (texts sharing a prefix shingle) of more than ``TILE_ROWS`` texts is
  cut by bands of set size, each as wide as two linked sizes can be apart, and
  bands into blocks by the hash of the id.  A block meets the blocks of its own
  band and of the two next to it, and no others; every such pair is a tile.
  Inside a tile, each pair is bounded by its two sizes and by a 512-bit parity bitmap of the set: each differing bit is one
  differing shingle, so bit counts bound the overlap from above.
* What survives is settled by intersecting the exact shingle arrays.

For components, candidates are tried in two rounds.  First each text against
the least of its buckets' least ids that the bounds admit; after joining these
links into components, only pairs of different components go through the tiles,
and buckets of one component are dropped before any row of them is copied.
A group of thousands of near copies therefore costs a star, not a square, and
no link between components is lost.  These connecting links are a part of all
links.  ``JaccardJoin.links`` is all of them: every pair of a bucket goes
through the tiles and is settled, so its work and size grow with the number of
links.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendlens.llm.common import (chunks, cut, lists, mix, prepare, sequence_hash, span_hash, window_hash,
                                  word_bounds)
from trendlens.llm.components import components

BITMAP_WORDS = 8
WIDE_WORDS = 256          # for sets too large for the short bitmap to tell apart
WIDE_FROM = 1000
TILE_ROWS = 1000
HOT_MIN = 32
HOT_LIMIT = 1 << 20       # common shingles sent to tasks: 8 MB at most
SCREEN_WORDS = 1 << 18    # the id screen sent to tasks: 2 MB


@dataclass(frozen=True)
class JaccardJoin:
    """``sets``: one row per input row (id, n); ``connecting``: links that join
    the components, not all links; ``members``: id, representative, component
    and ``set``, which tells apart representatives with several texts.

    Representatives stand for the texts with their set, so texts with equal
    sets link without a row in ``links``."""

    sets: DataFrame
    connecting: DataFrame
    members: DataFrame
    search: _Search

    @cached_property
    def links(self) -> DataFrame:
        """Every link between different sets: a, ka, b, kb (``representative``
        and ``set`` of either side), shared, n_a, n_b; computed when first asked for."""
        s = self.search
        tiles = _tiled(s.shared.select("h", "id", "k1", "size").join(s.slim, ["id", "k1"]), s.percent)
        pairs = _tile_pairs(tiles, F.struct("x.id", "x.k1") < F.struct("y.id", "y.k1"), s.percent)
        return cut(_verify(cut(_narrowed(pairs, s.wide, s.percent), "pairs"), s.docs, s.k, s.percent), "all-links")

    @cached_property
    def link_counts(self) -> DataFrame:
        """``doc_id, n_links``: with how many other ids a text of the id links;
        one row per id that is not null."""
        rows = self.members.select("id", F.struct("representative", "set").alias("c")).distinct()
        several = rows.groupBy("id").count().where("count > 1").select("id")
        # texts of one set have the same neighbours: count once a set, but by id where an id has several sets
        many = cut(rows.join(several, "id", "left_semi"), "several")
        lone = cut(rows.join(several, "id", "left_anti"), "lone")
        a, b = F.struct(F.col("a").alias("representative"), F.col("ka").alias("set")), \
            F.struct(F.col("b").alias("representative"), F.col("kb").alias("set"))
        sets = rows.select("c").distinct()
        near = self.links.select(a.alias("c"), b.alias("other"))
        near = cut(near.union(near.select("other", "c")).union(sets.select("c", F.col("c").alias("other"))).distinct(), "near-sets")
        ones = lone.groupBy("c").agg(F.count(F.lit(1)).alias("m")).withColumnRenamed("c", "other")
        other = many.select(F.col("c").alias("other"), F.col("id").alias("with"))

        def reached(units: DataFrame, by: str) -> DataFrame:
            left = units.join(near, "c").select(by, "other").distinct()
            one = left.join(ones, "other").groupBy(by).agg(F.sum("m").alias("m"))
            more = left.join(other, "other").select(by, "with").distinct().groupBy(by).agg(F.count(F.lit(1)).alias("w"))
            return (units.select(by).distinct().join(one, by, "left").join(more, by, "left")
                    .select(by, (F.coalesce("m", F.lit(0)) + F.coalesce("w", F.lit(0)) - 1).alias("n_links")))

        single = lone.join(reached(lone.select("c").distinct(), "c"), "c").select("id", "n_links")
        got = single.union(reached(many, "id"))
        ids = self.sets.where("id is not null").select("id").distinct()
        return ids.join(got, "id", "left").select(F.col("id").alias("doc_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


@dataclass(frozen=True)
class _Search:
    """What the tiles of all links are made of; tables in shared storage."""

    docs: DataFrame
    shared: DataFrame
    slim: DataFrame
    wide: DataFrame
    k: int
    percent: int


def shingle_sets(column: pa.Array, k: int):
    """Sorted distinct shingle hashes of every text of an Arrow column."""
    for _, _, buf, off in chunks(column):
        s, e, per = word_bounds(buf, off)
        w = span_hash(buf, s, e, lower=True)
        grams = window_hash(w, k)
        for i in range(len(off) - 1):
            a, b = per[i], per[i + 1]
            if b - a >= k:
                yield np.unique(grams[a:b - k + 1])
            elif b > a:
                yield np.array([sequence_hash(w[a:b])], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def _prefix_len(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1 if n else 0


def _prefix_tokens(k: int, percent: int):
    def run(batches):
        for batch in batches:
            out = [s[:_prefix_len(len(s), percent)] for s in shingle_sets(batch.column(0), k)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64))], ["h"])
    return run


def _set_key(s: np.ndarray) -> np.uint64:
    with np.errstate(over="ignore"):
        return mix(s + np.uint64(1)).sum(dtype=np.uint64)


def _parity(s: np.ndarray, words: int) -> np.ndarray:
    """Bitmap with a bit set where an odd number of the set's shingles falls."""
    slot = np.bincount((s >> np.uint64(3)).astype(np.int64) & (64 * words - 1), minlength=64 * words) & 1
    return np.packbits(slot.astype(np.uint8), bitorder="little").view(np.int64)


def _describe(k: int, percent: int, hot):
    """Per text: size, set key, parity bitmap and prefix (common shingles last)."""
    def run(batches):
        common = hot.value
        for batch in batches:
            n, k1, k2, bits, prefix, wide = [], [], [], [], [], []
            for s in shingle_sets(batch.column(1), k):
                n.append(len(s))
                k1.append(_set_key(s))
                k2.append(np.bitwise_xor.reduce(mix(s + np.uint64(2))) if len(s) else np.uint64(0))
                bits.append(_parity(s, BITMAP_WORDS))
                wide.append(_parity(s, WIDE_WORDS) if len(s) >= WIDE_FROM else np.zeros(0, np.int64))
                if len(common):
                    is_hot = np.isin(s, common, assume_unique=True)
                    s = np.concatenate([s[~is_hot], s[is_hot]])
                prefix.append(s[:_prefix_len(n[-1], percent)].view(np.int64))
            b = np.array(bits, np.int64).reshape(-1, BITMAP_WORDS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(n, np.int64)), pa.array(np.array(k1, np.uint64).view(np.int64)),
                 pa.array(np.array(k2, np.uint64).view(np.int64)),
                 *[pa.array(b[:, i].copy()) for i in range(BITMAP_WORDS)], lists(prefix, pa.int64()),
                 lists(wide, pa.int64())],
                ["id", "n", "k1", "k2", *_BITS, "prefix", "wide"])
    return run


_BITS = [f"b{i}" for i in range(BITMAP_WORDS)]


def _screened_sets(k: int, screen):
    """Exact shingle arrays of the texts whose id passes the screen."""
    def run(batches):
        bits = screen.value
        for batch in batches:
            slot = batch.column(1).to_numpy()
            keep = np.flatnonzero((bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1))
            if len(keep) == 0:
                continue
            part = batch.take(pa.array(keep))
            sets = list(shingle_sets(part.column(2), k))
            key = np.array([_set_key(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(key), lists([s.view(np.int64) for s in sets], pa.int64())], ["id", "k1", "s"])
    return run


def _common_shingles(docs: DataFrame, k: int, percent: int) -> np.ndarray:
    """Shingles that more than ``HOT_MIN`` prefixes hold, counted over all texts.

    Any set of shingles may be put last without changing the result, so the
    list is bounded by raising the count it takes until ``HOT_LIMIT`` fit.
    """
    counts = cut(docs.select("text").mapInArrow(_prefix_tokens(k, percent), "h long")
                 .groupBy("h").count().where(F.col("count") > HOT_MIN), "hot")
    sizes = counts.groupBy(F.floor(F.log2("count") * 4).alias("size")).agg(
        F.count(F.lit(1)).alias("n"), F.min("count").alias("least")).collect()
    total, least = 0, None
    for r in sorted(sizes, key=lambda r: -r["size"]):
        total += r["n"]
        if total > HOT_LIMIT:
            break
        least = r["least"]
    if least is None:
        return np.zeros(0, np.uint64)
    got = counts.where(F.col("count") >= least).select("h").toPandas()["h"].to_numpy(np.int64)
    return np.sort(got.view(np.uint64))


def _differing_bits(x: str, y: str) -> Column:
    total = F.lit(0)
    for b in _BITS:
        total = total + F.bit_count(F.col(f"{x}.{b}").bitwiseXOR(F.col(f"{y}.{b}")))
    return total


def _may_link(x: str, y: str, percent: int) -> Column:
    """Upper bounds on the overlap: by sizes, and by differing bitmap bits."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    return ((F.least(nx, ny) * 100 >= F.greatest(nx, ny) * percent)
            & (_differing_bits(x, y) * (100 + percent) <= (nx + ny) * (100 - percent)))


def _narrowed(pairs: DataFrame, wide: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, ka, b, kb) without those that the wide bitmaps rule out."""
    x, y = (wide.select(F.col("id").alias(c), F.col("k1").alias(f"k{c}"), F.struct("n", "wide").alias(f"w{c}"))
            for c in "ab")
    both = pairs.join(x, ["a", "ka"], "left").join(y, ["b", "kb"], "left")
    bits = F.aggregate(F.zip_with("wa.wide", "wb.wide", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0),
                       lambda t, v: t + v)
    apart = bits * (100 + percent) > (F.col("wa.n") + F.col("wb.n")) * (100 - percent)
    return both.where(~F.coalesce(apart, F.lit(False))).select(*_PAIR)


_PAIR = ["a", "ka", "b", "kb"]


def _size_band(percent: int) -> Column:
    """Band of a set size: sizes that can link are in one band or in neighbours.
    A band is a little wider than the size ratio, so rounding does not matter."""
    return F.floor(F.log("n") / F.lit(np.log(100 / min(percent, 99)) * 1.0001)).cast("long")


def _tiled(rows: DataFrame, percent: int) -> DataFrame:
    """``rows`` of buckets (h, size, n) once for every tile they are in."""
    one = F.lit(0).cast("long")
    small = rows.where(F.col("size") <= TILE_ROWS).withColumns({"place": one, "lo": one, "hi": one}).drop("size")
    big = rows.where(F.col("size") > TILE_ROWS).withColumn("band", _size_band(percent))
    bands = (big.groupBy("h", "band").agg(F.count(F.lit(1)).alias("rows"))
             .groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct("band", "rows"))).alias("bands")))
    big = big.join(bands, "h")

    def places(band):
        """Numbers of the blocks of a band."""
        n = F.ceil(F.coalesce(F.try_element_at("bands", band), F.lit(0)) / TILE_ROWS)
        some = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(1)) - 1), lambda i: F.shiftleft(band, 32) + i)
        return n, F.when(n > 0, some).otherwise(F.array().cast("array<long>"))

    n_blocks, own = places(F.col("band"))
    place = F.shiftleft("band", 32) + F.pmod(F.xxhash64("id"), n_blocks)
    met = F.concat(own, places(F.col("band") + 1)[1], places(F.col("band") - 1)[1])
    big = (big.withColumn("place", place).withColumn("other", F.explode(met))
           .withColumn("lo", F.least("place", "other")).withColumn("hi", F.greatest("place", "other")))
    return small.unionByName(big.select(*small.columns))


def _tile_pairs(tiles: DataFrame, wanted: Column, percent: int) -> DataFrame:
    """Pairs of a tile (x, y) that are ``wanted`` and may link."""
    x, y = tiles.alias("x"), tiles.alias("y")
    once = (F.col("x.lo") == F.col("x.hi")) | (F.col("x.place") != F.col("y.place"))
    near = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.lo") == F.col("y.lo"))
                  & (F.col("x.hi") == F.col("y.hi")) & wanted & once & _may_link("x", "y", percent))
    return near.select(F.col("x.id").alias("a"), F.col("x.k1").alias("ka"), F.col("y.id").alias("b"),
                       F.col("y.k1").alias("kb")).distinct()


def _verify(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Exact overlap of ``pairs`` (a, ka, b, kb); keeps those that link."""
    spark = pairs.sparkSession
    slots = 64 * SCREEN_WORDS
    slot = F.pmod(F.xxhash64("id"), F.lit(slots))
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))
    words = (ids.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("w"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toPandas())
    screen = np.zeros(SCREEN_WORDS, np.int64)
    screen[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    sent = spark.sparkContext.broadcast(screen.view(np.uint64))
    sets = cut(docs.select(F.col("id"), slot.alias("slot"), "text")
               .mapInArrow(_screened_sets(k, sent), "id long, k1 long, s array<long>"), "sets")
    x, y = (sets.select(F.col("id").alias(c), F.col("k1").alias(f"k{c}"), F.col("s").alias(f"s{c}")) for c in "ab")
    two = pairs.join(x, ["a", "ka"]).join(y, ["b", "kb"])
    got = two.select(*_PAIR, F.size(F.array_intersect("sa", "sb")).cast("long").alias("shared"),
                     F.size("sa").cast("long").alias("n_a"), F.size("sb").cast("long").alias("n_b"))
    return got.where(F.col("shared") * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent).distinct()


def jaccard_join(df: DataFrame, id_col: str, text_col: str, k: int = 4, percent: int = 85) -> JaccardJoin:
    """Exact Jaccard join of the texts of ``df`` on ``k``-word shingles.

    Words are lower-cased in A-Z only.  A text with fewer than ``k`` words is
    one shingle; a null or wordless text has the empty set and links with
    nothing.  Rows without an id are counted in ``sets`` but link with
    nothing.  Rows that repeat an id are one node that carries the links of
    all its rows.  Other columns, whatever their names, are ignored; an empty
    table gives empty results.
    """
    prepare(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    hot = df.sparkSession.sparkContext.broadcast(_common_shingles(docs, k, percent))
    shape = "id long, n long, k1 long, k2 long, " + ", ".join(f"{b} long" for b in _BITS) + ", prefix array<long>, wide array<long>"
    described = cut(docs.mapInArrow(_describe(k, percent, hot), shape), "described")
    key = ["k1", "k2", "n"]
    full = described.where("id is not null and n > 0")
    # equal sets: any row of a class has the same bitmap and prefix
    reps = cut(full.groupBy(*key).agg(F.min("id").alias("id"), *[F.first(b).alias(b) for b in _BITS],
                                      F.first("prefix").alias("prefix"), F.first("wide").alias("wide")), "reps")
    wide = reps.where(F.size("wide") > 0).select("id", "k1", "n", "wide")
    rows = reps.select("id", "k1", F.explode("prefix").alias("h"))
    buckets = (rows.groupBy("h").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("id", "k1")).alias("head"))
               .where("size > 1"))
    shared = cut(rows.join(buckets, "h").select("h", "id", "k1", "head", "size"), "buckets")
    slim = reps.select("id", "k1", "n", *_BITS)

    # round one: every text against one bucket's least id
    star = (shared.where("id <> head.id").select(F.col("head.id").alias("a"), F.col("head.k1").alias("ka"),
                                                 F.col("id").alias("b"), F.col("k1").alias("kb")).distinct())
    x, y = (slim.select(F.col("id").alias(c), F.col("k1").alias(f"k{c}"), F.struct("n", *_BITS).alias(f"s{c}"))
            for c in "ab")
    star = star.join(x, ["a", "ka"]).join(y, ["b", "kb"]).where(_may_link("sa", "sb", percent)).select(*_PAIR)
    star = (_narrowed(star, wide, percent).groupBy("b", "kb").agg(F.min(F.struct("a", "ka")).alias("least"))
            .select("least.a", "least.ka", "b", "kb"))
    first = cut(_verify(cut(star, "star"), docs, k, percent), "links1")
    comp = cut(components(first, "a", "b"), "comp1")

    # round two: pairs of different components, tile by tile
    tagged = (shared.select("h", "id", "k1", "size").join(slim, ["id", "k1"])
              .join(comp, "id", "left").withColumn("component", F.coalesce("component", "id")))
    apart = (F.col("x.id") < F.col("y.id")) & (F.col("x.component") != F.col("y.component"))
    mixed = tagged.groupBy("h").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most")
    near = _tile_pairs(_tiled(tagged.join(mixed.select("h"), "h", "left_semi"), percent), apart, percent)
    second = _verify(cut(_narrowed(near, wide, percent), "near"), docs, k, percent)
    links = cut(first.union(second).distinct(), "links")

    comp = cut(components(links, "a", "b"), "comp")
    rep_of = reps.select(*key, F.col("id").alias("representative"))
    members = (full.select("id", *key).join(rep_of, key)
               .join(comp.withColumnRenamed("id", "representative"), "representative", "left")
               .select("id", "representative", F.col("k1").alias("set"),
                       F.coalesce("component", "representative").alias("component")))
    # an id with several texts is one node
    several = members.groupBy("id").agg(F.min("component").alias("component"), F.max("component").alias("most"))
    ties = several.where("component <> most")
    again = components(members.select(F.col("id").alias("x"), F.col("component").alias("y"))
                       .join(ties.select(F.col("id").alias("x")), "x", "left_semi"), "x", "y")
    members = (members.join(again.select(F.col("id").alias("component"), F.col("component").alias("joined")),
                            "component", "left")
               .select("id", "representative", "set", F.coalesce("joined", "component").alias("component")))
    return JaccardJoin(described.select("id", "n"), links, cut(members.distinct(), "members"),
                       _Search(docs, shared, slim, wide, k, percent))


def with_component(join: JaccardJoin) -> DataFrame:
    """``doc_id, n_shingles, component_id``, one row per input row; a row that
    links with nothing is its own component (null id: null component)."""
    comp = join.members.groupBy("id").agg(F.min("component").alias("component_id"))
    return (join.sets.join(comp, "id", "left")
            .select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
                    F.coalesce("component_id", "id").alias("component_id")))


def keep_one(df: DataFrame, id_col: str, join: JaccardJoin) -> DataFrame:
    """The rows of ``df`` without those that another row of their group stands
    for: the one whose id is the group's least stays.  Rows without an id
    stay, and of rows that repeat an id one stays."""
    gone = join.members.where("id <> component").select(F.col("id").alias(id_col)).distinct()
    left = df.join(gone, id_col, "left_anti").select(*df.columns)
    row = F.struct(*df.columns)
    first = left.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min_by(row, F.xxhash64(row)).alias("_row"))
    return first.select("_row.*").union(left.where(F.col(id_col).isNull()))
