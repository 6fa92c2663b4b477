"""The corpus pipeline: five stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import decontaminate, huffman, mixing, quality, similar
from siltstone.llm.common import table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labels of the documents that it is given.

    Null texts are judged as empty ones, repeated rows each by itself; without labels of
    both kinds all documents get the only kind's verdict, and stay if there is none.
    """
    return quality.good(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id. Links are texts whose 5-word shingles have a Jaccard similarity of 0.8 at least.

    Null and empty texts are one group; of rows that repeat an id one stays, and of a
    group without any id one row.
    """
    return similar.one_of_each(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go, with all rows of their id; rows with a null id by their own text. Null and empty texts, and all if there are no items, stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, at most three times; one that it doesn't take goes.

    A null source is a source, last in order. Null and empty texts have no words and
    aren't taken. An id in several sources is a document of each.
    """
    return mixing.mixed(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of all texts, written and read back: doc_id, start, n_tokens, ids_crc32, a row for each document given. Null ids come first, null texts have the end id alone."""
    return huffman.token_output(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontaminate_stage),
    ("mix_to_target_weights", mix_stage),
    ("token_id_output", token_stage),
]

#: SQL expresses none of classifier, SimHash, BM25, budget fitting and tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. An empty table of documents gives none."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
