"""Ids, predicates and words into sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import CONTAINER, FULL, WORDS_PER_CONTAINER, bit_of, key_of, mask_of, popcount, word_of
from ..functions.policy import is_dense


def from_ids(df: DataFrame, filter_id: Column, id_: Column, universe: int | None = None) -> DataFrame:
    """Membership of unsorted ids with repetitions; nulls are dropped. With a universe, an id outside of it is an error."""
    rows = df.select(filter_id.cast("string").alias("filter_id"), id_.cast("long").alias("id")).where("filter_id IS NOT NULL AND id IS NOT NULL")
    if universe is not None:
        bad = (F.col("id") < 0) | (F.col("id") >= universe)
        rows = rows.select("filter_id", F.when(bad, F.raise_error(F.concat(F.lit("id outside the universe: "), F.col("id")))).otherwise(F.col("id")).alias("id"))
    return rows.distinct()


def from_predicates(df: DataFrame, id_: Column, predicates: dict[str, Column]) -> DataFrame:
    """Rows (filter_id, id) of all predicates in one scan; ids may repeat. For words, ``predicate_words`` is less."""
    named = F.array(*[F.when(p, F.lit(name)) for name, p in predicates.items()])
    return df.select(id_.cast("long").alias("id"), F.explode(named).alias("filter_id")).where("id IS NOT NULL AND filter_id IS NOT NULL").select("filter_id", "id")


def to_words(members: DataFrame) -> DataFrame:
    """Membership, repetitions allowed, to words: one aggregation, combined before the shuffle."""
    return members.groupBy("filter_id", word_of(F.col("id")).alias("word_idx")).agg(F.bit_or(bit_of(F.col("id"))).alias("word"))


def wide_words(df: DataFrame, id_: Column, predicates: dict[str, Column]) -> DataFrame:
    """(word_idx, one word a predicate): many filters of one table side by side, in one scan and one shuffle.

    A row's answers travel as bits of a number. Rows are shuffled before they are combined: ids in no order hardly meet before, and a
    task that reads many would hold most words of the universe; after it, each task holds its share.
    """
    names, per = list(predicates), 60
    mask = lambda some: reduce(lambda a, b: a.bitwiseOR(b), [F.when(predicates[n], F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")) for k, n in enumerate(some)])
    masks = {f"m{a // per}": mask(names[a : a + per]) for a in range(0, len(names), per)}
    rows = df.select(id_.cast("long").alias("id"), *[m.alias(c) for c, m in masks.items()]).where("id IS NOT NULL AND (" + " OR ".join(f"{c} <> 0" for c in masks) + ")")
    rows = rows.select(word_of(F.col("id")).alias("word_idx"), bit_of(F.col("id")).alias("bit"), *masks).repartition("word_idx")
    own = lambda k: F.bit_or(F.when(F.call_function("getbit", F.col(f"m{k // per}"), F.lit(k % per)) == 1, F.col("bit")))
    return rows.groupBy("word_idx").agg(*[F.coalesce(own(k), F.lit(0)).cast("long").alias(n) for k, n in enumerate(names)])


def predicate_words(df: DataFrame, id_: Column, predicates: dict[str, Column]) -> DataFrame:
    """(filter_id, word_idx, word) of all predicates: ``wide_words``, a row a set. Ids are never rows a set."""
    each = F.array(*[F.struct(F.lit(n).alias("filter_id"), F.col(n).alias("word")) for n in predicates])
    rows = wide_words(df, id_, predicates).select("word_idx", F.explode(each).alias("s"))
    return rows.select("s.filter_id", "word_idx", "s.word").where("word <> 0")


def catalog(members: DataFrame, universe: int) -> DataFrame:
    """One row a set: universe, cardinality, whether it is stored as its complement, and how many ids that stores."""
    return word_catalog(to_words(members), universe)


def word_catalog(words: DataFrame, universe: int) -> DataFrame:
    """The same of words."""
    counts = words.groupBy("filter_id").agg(F.sum(popcount(F.col("word"))).alias("cardinality")).withColumn("universe", F.lit(universe).cast("long"))
    negated = is_dense(F.col("cardinality"), F.col("universe"))
    stored = F.when(negated, F.col("universe") - F.col("cardinality")).otherwise(F.col("cardinality"))
    return counts.select("filter_id", "universe", negated.alias("negated"), "cardinality", stored.alias("stored"))


def inferred_universe(members: DataFrame) -> DataFrame:
    """Without a universe: the end of the last container (as a long, so key 65535 is no overflow)."""
    return members.groupBy("filter_id").agg(((F.max(key_of(F.col("id"))) + 1).cast("long") * CONTAINER).alias("universe"))


def chunks(words: DataFrame) -> DataFrame:
    """Set bits of each container's span of words; spans without any have no row."""
    found = words.groupBy("filter_id", F.floor(F.col("word_idx") / WORDS_PER_CONTAINER).cast("int").alias("key")).agg(F.sum(popcount(F.col("word"))).alias("card"))
    return found.where("card > 0")


def from_words(words: DataFrame, universe: int) -> DataFrame:
    """Canonical words: bits outside of a word or the universe cleared, empty words dropped."""
    kept = F.col("word").bitwiseAND(FULL).bitwiseAND(mask_of(F.col("word_idx"), F.lit(universe).cast("long")))
    return words.select("filter_id", "word_idx", kept.alias("word")).where("word <> 0")
