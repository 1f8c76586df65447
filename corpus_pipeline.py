"""A training-corpus pipeline: drop toxic documents, exact copies and near copies, mix sources, tokenize.

Every stage takes all rows that the one before kept. Null texts count as empty; a null doc_id is an id of its own, after all
others; texts are taken whole, however long; of rows equal in doc_id and text one stays from the second stage on; an
empty table gives an empty one; columns besides those of documents are carried along, whatever their names, up to the last
stage. Stages decide on ids and digests; of the texts, those that may be dropped meet the decisions, and the mix shuffles all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bpe, common, exact_dedup, mixing, near_copies, toxicity
from quarry.llm.common import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold stay, empty ones among them. The model learns from all labelled rows of
    the table; without labels of both classes nothing goes."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; all empty texts are equal."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word Jaccard of 0.8 or more) the row with the smallest doc_id stays. Fingerprints
    and vantage-point trees of op5 find the first links, a join of shingle sets those beyond their radius."""
    return near_copies.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; a null source is a source."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, decoded again for a check: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.round_trip_digests(docs, "byte_bpe_multi_50k.tiktoken")


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("simhash_near_dedup", drop_near_copies), ("mix_sources", mix_sources), ("byte_bpe", encode)]
#: Scores, fingerprints by bits and merges of byte pairs are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage is written; what it needed besides is deleted then."""
    docs, since = table(spark, sf_dir, "documents"), common.written()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        common.release(since, last=1)
    return STAGES[-1][1](spark, docs, sf_dir)
