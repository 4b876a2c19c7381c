"""Probes: whether ids are in sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bits import has, key_of, low_of, word_of
from .containers import PAGE, holds, pages


def contains(probes: DataFrame, words: DataFrame, universe: int, negated: bool = False) -> DataFrame:
    """``probes`` (id, ...) with ``hit``: whether the set (word_idx, word) has the id. A word that is not there has no id.

    ``negated``: the set is the complement of the words within the universe. Ids outside of the universe are in neither.
    """
    rows = probes.withColumn("word_idx", word_of(F.col("id"))).join(words.select("word_idx", "word"), "word_idx", "left")
    inside = (F.col("id") >= 0) & (F.col("id") < universe)
    hit = F.coalesce(has(F.col("word"), F.col("id")), F.lit(False))
    return rows.withColumn("hit", F.coalesce(inside & ((~hit) if negated else hit), F.lit(False))).drop("word_idx", "word")


def contains_each(probes: DataFrame, words: DataFrame) -> DataFrame:
    """``probes`` (filter_id, id, ...) with ``hit``: each row asks its own set; one that is not there has no id."""
    rows = probes.withColumn("word_idx", word_of(F.col("id"))).join(words, ["filter_id", "word_idx"], "left")
    return rows.withColumn("hit", F.coalesce(has(F.col("word"), F.col("id")), F.lit(False))).drop("word_idx", "word")


def contains_in_containers(probes: DataFrame, containers: DataFrame) -> DataFrame:
    """The same by containers: the key and a page of 256 positions by join, the position by the container's encoding. A probe looks
    through its page alone, not through all of a container."""
    page = F.floor(low_of(F.col("id")) / PAGE).cast("int")
    rows = probes.withColumns({"key": key_of(F.col("id")), "page": page}).join(pages(containers), ["filter_id", "key", "page"], "left")
    return rows.withColumn("hit", F.col("ctype").isNotNull() & holds(low_of(F.col("id")))).select(*probes.columns, "hit")


def contains_packed(asked: DataFrame, words: DataFrame) -> DataFrame:
    """(filter_id, word_idx, word, found): asked words (filter_id, word_idx, word), each id a probe of its own set, and which of their bits
    the set has."""
    held = words.select("filter_id", "word_idx", F.col("word").alias("held"))
    rows = asked.select("filter_id", "word_idx", "word").join(held, ["filter_id", "word_idx"], "left")
    return rows.select("filter_id", "word_idx", "word", F.col("word").bitwiseAND(F.coalesce("held", F.lit(0).cast("long"))).alias("found"))


def packed_hits(packed: DataFrame) -> DataFrame:
    """``hits`` of packed probes."""
    rows = packed.groupBy("filter_id").agg(F.sum(F.bit_count("word")).cast("long").alias("n"), F.sum(F.bit_count("found")).cast("long").alias("hits"))
    return rows.select("filter_id", "n", "hits", (F.col("hits") / F.col("n")).alias("rate"))


def hits(probes: DataFrame) -> DataFrame:
    """(filter_id, n, hits, rate) of answered probes."""
    hit = F.sum(F.col("hit").cast("long"))
    return probes.groupBy("filter_id").agg(F.count(F.lit(1)).alias("n"), hit.alias("hits"), (hit / F.count(F.lit(1))).alias("rate"))


def mismatches(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """How many probes two methods answer differently."""
    both = a.select(*on, F.col("hit").alias("x")).join(b.select(*on, F.col("hit").alias("y")), on, "full")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("x").eqNullSafe(F.col("y"))).alias("mismatches"))


def answers(by_words: DataFrame, by_containers: DataFrame, on: list[str]) -> DataFrame:
    """Both methods' answers to each probe, and whether they differ."""
    both = by_words.select(*on, F.col("hit").alias("by_words")).join(by_containers.select(*on, F.col("hit").alias("by_containers")), on, "full")
    return both.withColumn("differs", ~F.col("by_words").eqNullSafe(F.col("by_containers")))
