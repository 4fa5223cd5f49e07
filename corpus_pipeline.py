"""A corpus pipeline of the operators in ``trendlens.llm``.

``STAGES`` lists (name, function) in order.  Each function takes ``(spark, docs,
sf_dir)`` and returns a DataFrame; the caller writes it as Parquet and hands
what it reads back to the next.  All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendlens.llm import byte_cnn, mixing, ngram_join, packing, quality_cascade
from trendlens.llm.common import cut, prepare


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the network knows (labels: ``lang``), as surely as
    right predictions on all held-out documents are (``byte_cnn.score_floor``).
    Null and letterless texts go, repeated rows share their verdict, and where
    nothing can be learned, or the table is empty, nothing stays."""
    prepare(spark)
    net = byte_cnn.fit(docs, "doc_id", "text", "lang")
    floor = byte_cnn.score_floor(docs, "doc_id", "text", "lang", net)
    got = byte_cnn.identify(docs, "text", net)
    return got.where((F.col("_lang") != byte_cnn.UNKNOWN) & (F.col("_score") >= floor)).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects.  Null and empty texts have too few
    words and go; repeated rows share their verdict; empty tables stay empty."""
    prepare(spark)
    return quality_cascade.quality_cascade(docs, "text").where("_kept").select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 80 %), the one with
    the least id.  Texts without words are copies of nothing; of rows that
    repeat an id one stays, rows without an id all stay."""
    prepare(spark)
    return ngram_join.keep_one(docs, "doc_id", ngram_join.jaccard_join(docs, "doc_id", "text", k=5, percent=80))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources draws them; a null source is a
    source, a text without words is never drawn."""
    prepare(spark)
    return mixing.mixed(docs, "doc_id", "text", "source")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in the training sequences; a
    null or empty text is its end token alone."""
    prepare(spark)
    return packing.pack(docs, "doc_id", "text")


STAGES = [("language_id", language), ("quality_rules", quality), ("near_duplicates", deduplicate),
          ("source_mix", mix), ("best_fit_packing", packed)]

ORACLE_SQL = None  # a trained network and hashed draws are beyond SQL; tests/llm/test_pipeline.py compares with plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
