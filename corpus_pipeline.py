"""Corpus pipeline: language ID, near copies, decontamination, source mix, token shards.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all
but the last return the columns of documents.  Each stage says what it does with nulls,
empty and very long texts, ties, repeated rows and empty tables; columns beyond those of
documents pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from polyglint.llm import decontaminate, jaccard, language_id, mixing, registry, wavelet
from polyglint.llm.shared import written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language could not be told are dropped.

    Those are null and empty texts, texts without letters, and ties and near ties of two
    languages.  Long texts are judged whole, repeated rows each; an empty table stays empty.
    """
    return language_id.keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar texts stays, the one of smallest doc_id.

    Rows without doc_id or without words stay; rows of one doc_id stay or go together; an
    empty table stays empty.
    """
    return jaccard.drop_near_copies(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage near a benchmark item are dropped, wherever in the text it is.

    Null and empty texts hold none and stay, and so do rows without doc_id; rows of one
    doc_id stay or go together; an empty table stays empty, an empty benchmark drops nothing.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in fair order of their sources up to the token budget.

    They aren't sorted yet: readers of files don't keep an order, so the next stage sorts
    them, and texts are shuffled once.  A null source is one of its own, null and empty
    texts cost nothing, ties follow the shuffle key and then the text, repeated rows count
    each; an empty table stays empty.
    """
    return mixing.mixed_documents(docs, weights=registry.WEIGHTS, budget_share=registry.BUDGET_SHARE, ordered=False)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards as wavelet matrices, documents in fair order within a shard and over shards by name.

    Null and empty texts are documents without tokens; repeated rows are kept; a very long
    text is never split; an empty table gives no shards.
    """
    return wavelet.shards(mixing.in_fair_order(docs, weights=registry.WEIGHTS), registry.VOCABULARY)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", decontaminate_benchmark),
    ("mixing", mix_sources),
    ("token_shards", write_tokens),
]

#: Compression and edit distance have no SQL; the tests rebuild the result by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
