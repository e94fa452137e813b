"""The corpus pipeline: toxicity, quality rules, near-dedup by shingles, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
reread as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillframe.llm import near_copies, packing, quality, toxicity
from quillframe.llm.common import cut
from quillframe.llm.queries import WORD_BPE, table, vocabulary


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine, fitted on the labelled rows, takes for toxic go."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the cascade rejects go."""
    return quality.keep_good(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the document with the smallest id stays.

    Candidates come from SimHash fingerprints, compared bit-sliced as in op2; what no radius of 64 bits finds, from the
    shingle sets themselves. Every link is confirmed on whole sets.
    """
    return near_copies.keep_one(docs, words=5)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, vocabulary(WORD_BPE), end_id=2, capacity=4096).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", clean),
    ("quality_rules", good),
    ("simhash_near_dedup", distinct),
    ("packing", packed),
]

#: Training, fingerprints and token ids are not SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage-{name}")
    return docs
