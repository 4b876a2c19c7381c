"""Token counts with a cache by digests of content and tokenizer."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import new_path, small_batches, text_or_empty, written
from ._tokens import PieceCounts, chunks, once

LIMIT = 4096


def version(path: str) -> str:
    """Digest of the tokenizer's file and of its library's version: another of either has counts of its own."""
    import sentencepiece

    return hashlib.sha256(Path(path).read_bytes() + sentencepiece.__version__.encode()).hexdigest()[:32]


def digest(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = once(PieceCounts, path)
        for batch in batches:
            counts: list[int] = []
            for some in chunks(t or "" for t in batch.column("text").to_pylist()):
                counts += model.count(some)
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return run


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        found = spark.read.schema("digest binary, n_tokens long").parquet(path)
        found.take(1)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return found


def count_tokens(docs: DataFrame, model: str, cache: str, text: str = "text") -> DataFrame:
    """``docs`` without other columns named so, with digest, n_bytes (UTF-8) and n_tokens of the whole text.

    Content is normalised by what cannot change a count: null is the empty text. Its SHA-256 and the tokenizer's version
    digest are the key. Contents that the cache at ``cache`` (a folder that all executors reach) lacks are reduced to
    one text each before the shuffle, encoded, and appended to the cache; all documents then take their counts from it.
    A run that is lost before its append has changed nothing; one repeated after it finds everything there.
    Texts may be empty or of any length; repeated rows take the same count; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    path = f"{cache}/tokenizer={version(model)}"
    content = text_or_empty(text)
    keyed = small_batches(docs).select(digest(content).alias("digest"), content.alias("text"))
    known, misses = _read(spark, path), keyed.groupBy("digest").agg(F.first("text").alias("text"))
    if known is not None:
        misses = misses.join(known, "digest", "left_anti")
    misses.mapInArrow(_counted(model), "digest binary, n_tokens long").write.mode("append").parquet(path)
    # of the cache only what these documents need; two runs may have appended the same
    asked = docs.select(digest(content).alias("digest")).distinct()
    known = _read(spark, path).join(asked, "digest", "left_semi").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    known = written(known, "counts")  # a join of two plain shuffles: a group of copies can be split
    rest = [c for c in docs.columns if c.lower() not in ("digest", "n_bytes", "n_tokens")]
    out = docs.select(*rest, digest(content).alias("digest"), F.octet_length(content).cast("long").alias("n_bytes"))
    return out.join(known, "digest").select(*rest, "digest", "n_bytes", "n_tokens")


#: The query counts the documents whose id has this remainder first, so that its second call finds their counts in the cache.
FIRST_OF = 16


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two calls on one cache: a first part of the documents, then all of them, whose counts are partly there."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model, cache = public_tokenizers.path("piece_bpe_32k.model"), new_path(spark, "token-counts")
    count_tokens(docs.where(F.col("doc_id") % FIRST_OF == 0), model, cache)
    out = count_tokens(docs, model, cache)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
