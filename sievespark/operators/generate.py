"""Deterministic sets and probes, by arithmetic on ids: the same everywhere, in any order, on any number of tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.bits import FULL, WORDS_PER_CONTAINER, bit_of, popcount
from .export import enumerate_ids
from .ingest import to_words

#: A multiplicative hash of 32 bits.
FACTOR, MODULUS = 2654435761, 1 << 32


def spread(id_: Column, seed: int) -> Column:
    """A number from 0 to 2**32 - 1 for an id below 2**31."""
    mixed = F.pmod(id_ * FACTOR + seed * 40503, F.lit(MODULUS))
    return F.pmod(mixed.bitwiseXOR(F.shiftright(mixed, 15)) * 31 + F.shiftright(mixed, 7), F.lit(MODULUS))


def bernoulli(spark: SparkSession, universe: int, density: float, seed: int) -> DataFrame:
    """(id): every id of the universe with the given chance."""
    return spark.range(universe).where(spread(F.col("id"), seed) < int(density * MODULUS))


def clustered(spark: SparkSession, universe: int, clusters: int, length: int, background: float, seed: int) -> DataFrame:
    """(id): runs of ``length`` at scattered places, and a sparse background."""
    start = F.pmod(spread(F.col("id"), seed), F.lit(max(1, universe - length)))
    runs = spark.range(clusters).select(F.explode(F.sequence(start, start + length - 1)).alias("id"))
    return runs.where(F.col("id") < universe).union(bernoulli(spark, universe, background, seed + 1)).distinct()


def draws(spark: SparkSession, universe: int, n: int, seed: int) -> DataFrame:
    """(id): ``n`` draws with replacement, as a set."""
    return spark.range(n).select(F.pmod(spread(F.col("id"), seed), F.lit(universe)).alias("id")).distinct()


def probes(spark: SparkSession, universe: int, n: int, pattern: str, seed: int) -> DataFrame:
    """(probe_id, id): at random; in runs of 32; or strided through a window of a hundredth of the universe."""
    rows = spark.range(n).select(F.col("id").alias("probe_id"))
    if pattern == "random":
        at = F.pmod(spread(F.col("probe_id"), seed), F.lit(universe))
    elif pattern == "clustered":
        at = F.pmod(spread(F.shiftright("probe_id", 5), seed) + F.col("probe_id").bitwiseAND(31), F.lit(universe))
    elif pattern == "strided":
        window = max(1, universe // 100)
        at = F.pmod(F.lit(seed * 97) + F.pmod(F.col("probe_id") * 7, F.lit(window)), F.lit(universe))
    else:
        raise ValueError(f"unknown pattern {pattern!r}")
    return rows.select("probe_id", at.cast("long").alias("id"))


def reordered(members: DataFrame, universe_sizes: DataFrame) -> DataFrame:
    """(filter_id, id, new_id): ids renumbered by their rarest set, so that rare sets lie together; ``universe_sizes`` is (filter_id, n)."""
    return word_reordered(to_words(members), universe_sizes)


def word_reordered(words: DataFrame, universe_sizes: DataFrame) -> DataFrame:
    """The same of words.

    A new id is the base of its rarity group, and of its container within the group, and of its word within the container, by running
    sums of counts, and the bits below it: no task orders more than a container's words, or one row a container.
    """
    rank = universe_sizes.withColumn("rank", F.row_number().over(Window.orderBy("n", "filter_id"))).select("filter_id", "rank")
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    rarer = F.coalesce(F.bit_or("word").over(before("word_idx").orderBy("rank")), F.lit(0).cast("long"))
    key = F.floor(F.col("word_idx") / WORDS_PER_CONTAINER).cast("long").alias("key")
    own = words.join(rank, "filter_id").withColumn("first", F.col("word").bitwiseAND(rarer.bitwiseXOR(FULL))).where("first <> 0").select("rank", key, "word_idx", "first")
    cards = own.groupBy("rank", "key").agg(F.sum(popcount(F.col("first"))).alias("n"))
    sizes = cards.groupBy("rank").agg(F.sum("n").alias("size"))
    zero = F.lit(0).cast("long")
    base = sizes.select("rank", F.coalesce(F.sum("size").over(before().orderBy("rank")), zero).alias("base"))
    begins = cards.select("rank", "key", F.coalesce(F.sum("n").over(before("rank").orderBy("key")), zero).alias("begin")).join(base, "rank")
    inside = F.coalesce(F.sum(popcount(F.col("first"))).over(before("rank", "key").orderBy("word_idx")), zero)
    placed = own.withColumn("inside", inside).join(begins, ["rank", "key"]).select("word_idx", "first", (F.col("base") + F.col("begin") + F.col("inside")).alias("start"))
    # a word's groups share no bit, so a word meets 32 of them at most
    both = words.join(placed, "word_idx").select("filter_id", "word_idx", F.col("word").bitwiseAND(F.col("first")).alias("word"), "first", "start").where("word <> 0")
    below = F.col("first").bitwiseAND(bit_of(F.col("id")) - 1)
    return enumerate_ids(both).select("filter_id", "id", (F.col("start") + popcount(below)).alias("new_id"))
