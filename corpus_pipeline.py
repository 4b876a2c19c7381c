"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

All stages take rows (doc_id, text, lang, source, n_chars) and more columns, whatever their names; null, empty and very long
texts, nulls in any column, repeated rows and tables without rows have the results that the stages state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievespark.llm import language, mixing, passages, pieces, simhash
from sievespark.llm._shared import drop, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; the network learns from the labels of those that are not held out.

    Texts that are null, empty or without a letter go; so do those that no language fits. A null lang is no label and
    rejects nothing; without any label all documents stay. Repeated rows stay or go together.
    """
    return language.only_known(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies, that of the least doc_id.

    Texts without words are copies of one another. Rows without doc_id stay; rows repeated with their doc_id stay or go together.
    """
    return simhash.without_near_copies(docs)


def no_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document holds; documents of which nothing is left go.

    n_chars is set anew for texts that lose words. Texts null or of fewer than fifty words, and rows without doc_id, stay as
    they are; repeated rows are cut alike.
    """
    return passages.without_repeats(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as their source's target asks, repeated rows each for itself.

    A null source is a source of its own. Texts without words count nothing towards a target and come with the passes before its cut.
    """
    return mixing.mix_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text (null: empty), with what decoding them gives.

    The ids are those of the best-scoring segmentation into the model's pieces. As the model is of type BPE, they are not
    the ids of the library's merges.
    """
    import public_tokenizers

    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), ["doc_id", "lang", "source"], with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", known_language),
    ("SimHash near-dedup", no_near_copies),
    ("substring dedup", no_repeated_passages),
    ("mixing", mixed_sources),
    ("SentencePiece encoding", encoded),
]

#: The stages decide by a trained network and by learned pieces, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages in turn to ``documents``. A stage's table is deleted once the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = written(stage(spark, docs, sf_dir), f"stage{k}")
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
