"""Registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trendlens.llm import (byte_cnn, chat_repair, graph_ann, hmm, licences, mixing, ngram_join, packing, periodic_runs,
                           quality_cascade, quote_threads, token_counts, url_filter)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return ngram_join.with_component(ngram_join.jaccard_join(docs, "doc_id", "text", k=4, percent=85))


def op2_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return graph_ann.nearest(rows, "vec_id", "embedding", rows.where("vec_id % 20 = 0"), k=20)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), "doc_id", "text", rule="start")


def op4_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.hmm_scores(_table(spark, sf_dir, "documents"), "doc_id", "text")


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents"), "doc_id", "text", "source")


def op6_quote_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_threads.format_chats(_table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), "doc_id", "text", capacity=2048)


def op8_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cascade.quality_report(_table(spark, sf_dir, "documents"), "doc_id", "text")


def op9_byte_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_cnn.language_report(_table(spark, sf_dir, "documents"), "doc_id", "text", "lang")


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(_table(spark, sf_dir, "documents"), "doc_id", "text")


def op11_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat_repair.damaged(_table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return chat_repair.repair_report(rows, "conv_id", "turn", "role", "text", "gone")


# fixed values: the rules of the contract
URL_RULES = (url_filter.Rule("allow", "com", "/"), url_filter.Rule("block", "example.com", "/en/"),
             url_filter.Rule("allow", "www.example.com", "/en/"), url_filter.Rule("block", "net", "/es/"),
             url_filter.Rule("block", "net", "/fr/"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_report(_table(spark, sf_dir, "pages"), "page_id", "url", URL_RULES)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_periodic_tails(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return periodic_runs.periodic_report(docs, "doc_id", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_ngram_jaccard, op2_graph_neighbours, op3_token_counts, op4_hmm_scores, op5_source_mix,
                            op6_quote_threads, op7_best_fit_packing, op8_quality_cascade, op9_byte_language,
                            op10_licence_scan, op11_chat_repair, op12_url_filter, op13_periodic_runs)}

_WORD = r"'[^\x20\x09-\x0D]+'"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard": rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM documents),
grams AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g FROM words),
flat AS (SELECT doc_id, len(g) AS n, unnest(g) AS s FROM grams),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS c
  FROM flat a JOIN flat b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared WHERE 100 * c >= 85 * (nx + ny - c)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, edges.y FROM reach JOIN edges ON reach.b = edges.x)
SELECT g.doc_id, CAST(len(g.g) AS BIGINT) AS n_shingles, c.component_id
FROM grams g JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON g.doc_id = c.a""",
    # every pair of template bigrams within the longest window is a window; all are compared
    "op10_licence_scan": r"""
WITH templates(licence, form, t) AS (VALUES """ + ", ".join(
        "('{}', '{}', '{}')".format(n, f, t.replace("'", "''")) for n, f, t in licences.TEMPLATES) + r"""),
tw AS (SELECT licence, form, list_filter(regexp_split_to_array(lower(t), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM templates),
tg AS (SELECT licence, form, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM tw),
tb AS (SELECT licence, form, g, count(*) AS m FROM tg GROUP BY ALL),
ts AS (SELECT licence, form, sum(m) AS t FROM tb GROUP BY ALL),
dw AS (SELECT row_number() OVER () AS r, doc_id,
       list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents),
dg AS (SELECT r, doc_id, unnest(range(0, len(w) - 1)) AS pos,
       unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM dw WHERE len(w) > 1),
h AS (SELECT r, doc_id, licence, form, pos, g, m, t FROM dg JOIN tb USING (g) JOIN ts USING (licence, form)),
enough AS (SELECT r, licence, form FROM h GROUP BY ALL HAVING 3 * count(*) >= 2 * any_value(t)),
hh AS (SELECT h.* FROM h JOIN enough USING (r, licence, form)),
ends AS (SELECT a.r, a.doc_id, a.licence, a.form, a.t, a.pos AS s, b.pos AS e FROM hh a JOIN hh b
  ON a.r = b.r AND a.licence = b.licence AND a.form = b.form AND b.pos >= a.pos AND 2 * (b.pos - a.pos + 1) <= 3 * a.t
     AND 3 * (b.pos - a.pos + 1) >= 2 * a.t),
c AS (SELECT x.r, x.doc_id, x.licence, x.form, x.t, s, e, x.g, least(count(*), any_value(m)) AS c FROM
  (SELECT ends.*, hh.g, hh.m FROM ends JOIN hh ON ends.r = hh.r AND ends.licence = hh.licence AND ends.form = hh.form
   AND hh.pos BETWEEN s AND e) x GROUP BY ALL),
d AS (SELECT r, doc_id, licence, form, s, e, 2.0::DOUBLE * sum(c) / (e - s + 1 + t) AS dice FROM c GROUP BY r, doc_id, licence, form, t, s, e
      HAVING 200 * sum(c) >= 80 * (e - s + 1 + t))
SELECT doc_id, licence, form, CAST(s AS INTEGER) AS start, CAST(e - s + 2 AS INTEGER) AS n_words, dice FROM d
QUALIFY row_number() OVER (PARTITION BY r, licence, form ORDER BY dice DESC, s, e) = 1""",
    "op8_quality_cascade": rf"""
WITH w AS (SELECT doc_id, text, regexp_extract_all(text, {_WORD}) AS w, string_split(text, chr(10)) AS l,
    list_distinct(string_split(text, chr(10))) AS dl FROM documents),
n AS (SELECT doc_id, text, w, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    len(list_filter(l, lambda x: regexp_matches(x, {_WORD}))) AS n_lines,
    len(list_filter(l, lambda x: regexp_matches(x, {_WORD}))) - len(list_filter(dl, lambda x: regexp_matches(x, {_WORD}))) AS n_dup_lines,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutters,
    len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z\x80-\x{{10FFFF}}]'))) AS n_letter_words,
    len(regexp_extract_all(text, '\p{{Lu}}')) AS n_upper, len(regexp_extract_all(text, '\p{{L}}')) AS n_letters FROM w),
win AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3),
    lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM n WHERE len(w) >= 5),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cover AS (SELECT doc_id, count(DISTINCT p) AS c FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
r AS (SELECT n.*, coalesce(c, 0) AS n_repeat_words FROM n LEFT JOIN cover USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM r)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 10 * n_words OR 2 * n_upper > n_letters OR 100 * n_dup_lines > 60 * n_lines
    OR 100 * n_stutters > 20 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR 100 * n_letter_words < 60 * n_words) AS kept FROM f""",
}
