"""Words of sets from a stream of ids."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import from_predicates, to_words
from ..sources.storage import new_folder


def stream_words(stream: DataFrame, id_: Column, predicates: dict[str, Column]) -> DataFrame:
    """The words of a stream's sets: the state is a word each, and repeated ids change nothing."""
    return to_words(from_predicates(stream, id_, predicates))


def drained(words: DataFrame) -> DataFrame:
    """Runs a streaming aggregate over all that is there and returns its final words.

    Each epoch writes the words that it changed, into a folder of its own, so that a repeated epoch writes the same. Bits of
    a word are only ever added: the final words are all epochs' joined by OR.
    """
    spark: SparkSession = words.sparkSession
    folder = new_folder(spark, "stream")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/words/epoch={epoch}")

    query = words.writeStream.outputMode("update").queryName(f"words_{uuid.uuid4().hex}").option("checkpointLocation", f"{folder}/state").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    try:
        found = spark.read.schema(words.schema).parquet(f"{folder}/words")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], words.schema)
    return found.groupBy("filter_id", "word_idx").agg(F.bit_or("word").alias("word"))
