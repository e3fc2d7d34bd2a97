"""The corpus pipeline: quality, toxicity, near duplicates, packing.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import common, minhash, packing, quality, toxicity
from leafmill.llm.queries import split_pattern, tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.3; the classifier learns from the labelled documents among docs.

    Null, empty and very long texts are scored whole as any other; equal texts go or stay together; rows keep their order of columns, also
    further ones; without labels of both classes all documents have the share of good ones as their score; no documents give none."""
    return quality.keep(docs, quality.fit(docs, common.read(spark, sf_dir, "labels")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5; the classifier learns from the labelled documents among docs.

    Null, empty and very long texts are scored whole as any other; equal texts go or stay together; without labels of both classes all
    documents have the share of toxic ones as their score; no documents give none; further columns stay."""
    return toxicity.keep(docs, toxicity.fit(docs, common.read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (shingles of five words, similarity 0.8): that with the smallest id.
    Documents without an id can't be grouped and stay; rows that repeat an id are one document, and stay or go together; null and empty
    texts have no shingles and stay; no documents give none; further columns stay."""
    gone = minhash.near_duplicates(docs).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of 2048 tokens, a row each: null texts are empty, long ones several pieces, repeated rows are packed
    as often as they occur, no documents give no rows; further columns are not part of the result."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), split_pattern(), 2048, 0)


STAGES = [("quality", keep_quality), ("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("packing", pack)]

#: Trained models, signatures and packing are beyond SQL; tests/llm compares operators and stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; what only one stage needs goes with it."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with common.passing(spark) as keep:
            made = common.materialize(stage(spark, docs, sf_dir), name)
            keep(made)
        common.release(docs)
        docs = made
    return docs
