"""Boolean algebra on words and membership."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import FULL, mask_of, words_in

OPS = ("and", "or", "andnot", "xor")


def combine(op: str, a: Column, b: Column) -> Column:
    """One word of each side."""
    if op == "and":
        return a.bitwiseAND(b)
    if op == "or":
        return a.bitwiseOR(b)
    if op == "andnot":
        return a.bitwiseAND(b.bitwiseXOR(FULL))
    if op == "xor":
        return a.bitwiseXOR(b)
    raise ValueError(f"unknown operation {op!r}")


def pairwise(op: str, a: DataFrame, b: DataFrame) -> DataFrame:
    """(word_idx, word) of two sets (word_idx, word): an equi-join as wide as the operation needs."""
    how = {"and": "inner", "or": "full", "andnot": "left", "xor": "full"}.get(op)
    if how is None:
        raise ValueError(f"unknown operation {op!r}")
    left, right = a.select("word_idx", F.col("word").alias("x")), b.select("word_idx", F.col("word").alias("y"))
    x, y = F.coalesce("x", F.lit(0).cast("long")), F.coalesce("y", F.lit(0).cast("long"))
    return left.join(right, "word_idx", how).select("word_idx", combine(op, x, y).alias("word")).where("word <> 0")


def pairwise_ids(op: str, a: DataFrame, b: DataFrame) -> DataFrame:
    """The same on ids (id): Spark's own set operations, which drop repetitions."""
    if op == "and":
        return a.intersect(b)
    if op == "or":
        return a.union(b).distinct()
    if op == "andnot":
        return a.subtract(b)
    if op == "xor":
        sides = a.select("id", F.lit(1).alias("side")).union(b.select("id", F.lit(2).alias("side")))
        return sides.groupBy("id").agg(F.bit_or("side").alias("sides")).where("sides <> 3").select("id")
    raise ValueError(f"unknown operation {op!r}")


def wanted(filters: Iterable[str]) -> list[str]:
    """The requested sets, each once; none at all is an error."""
    out = list(dict.fromkeys(filters))
    if not out:
        raise ValueError("at least one filter is needed")
    return out


def multi_and(words: DataFrame, filters: Iterable[str]) -> DataFrame:
    """(word_idx, word) of all sets' intersection. Words are one row a filter, so a word that a set lacks shows in the count.

    One shuffle by word, with partial sums, however many sets; an empty or absent set empties the result.
    """
    names = wanted(filters)
    rows = words.where(F.col("filter_id").isin(names))
    found = rows.groupBy("word_idx").agg(F.bit_and("word").alias("word"), F.count(F.lit(1)).alias("n"))
    return found.where((F.col("n") == len(names)) & (F.col("word") != 0)).select("word_idx", "word")


def multi_or(words: DataFrame, filters: Iterable[str]) -> DataFrame:
    rows = words.where(F.col("filter_id").isin(wanted(filters)))
    return rows.groupBy("word_idx").agg(F.bit_or("word").alias("word"))


def multi_and_negated(words: DataFrame, positive: Iterable[str], negated: Iterable[str], universe: int) -> DataFrame:
    """The intersection of sets and of other sets' complements within ``universe``.

    With a positive set: its words without those of the negated ones, in the same aggregation. With none: the dense range
    of words without the union.
    """
    plus, minus = list(dict.fromkeys(positive)), list(dict.fromkeys(negated))
    if not plus and not minus:
        raise ValueError("at least one filter is needed")
    if not plus:
        return complement(multi_or(words, minus), universe)
    rows = words.where(F.col("filter_id").isin(plus + minus))
    own = F.col("filter_id").isin(plus)
    found = rows.groupBy("word_idx").agg(
        F.bit_and(F.when(own, F.col("word"))).alias("a"), F.coalesce(F.bit_or(F.when(~own, F.col("word"))), F.lit(0)).alias("b"), F.count(F.when(own, F.lit(1))).alias("n")
    )
    word = combine("andnot", F.col("a"), F.col("b")).bitwiseAND(mask_of(F.col("word_idx"), F.lit(universe).cast("long")))
    return found.where(F.col("n") == len(plus)).select("word_idx", word.alias("word")).where("word <> 0")


def multi_and_chain(words: DataFrame, filters: Iterable[str]) -> DataFrame:
    """The same as ``multi_and`` by one join after another; for comparison."""
    out = None
    for name in wanted(filters):
        own = words.where(F.col("filter_id") == name).select("word_idx", "word")
        out = own if out is None else pairwise("and", out, own)
    return out


def request_classes(requests: DataFrame, filter_id: str = "filter_id") -> tuple[DataFrame, DataFrame]:
    """Requests (query_id, filter_id) as classes (class_id, filter_id, wanted) and membership (query_id, class_id).

    Requests for the same sets are one class, named by its least query, with ``wanted`` sets; repeated ones count once.
    """
    asked = requests.groupBy("query_id").agg(F.sort_array(F.collect_set(filter_id)).alias("wants"))
    asked = asked.withColumn("signature", F.to_json("wants"))
    classes = asked.groupBy("signature").agg(F.min("query_id").alias("class_id"), F.any_value("wants").alias("wants"))
    members = asked.select("query_id", "signature").join(classes.select("signature", "class_id"), "signature").select("query_id", "class_id")
    return classes.select("class_id", F.size("wants").alias("wanted"), F.explode("wants").alias(filter_id)), members


def multi_and_classes(words: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Many requests (query_id, filter_id) at once: words (class_id, word_idx, word) of each different one, and
    membership (query_id, class_id).

    Each class is evaluated once, however many queries ask for it, in one join with its sets and one aggregation by word.
    """
    classes, members = request_classes(requests)
    rows = words.join(classes, "filter_id").groupBy("class_id", "word_idx")
    found = rows.agg(F.bit_and("word").alias("word"), F.count(F.lit(1)).alias("n"), F.any_value("wanted").alias("wanted"))
    return found.where("n = wanted AND word <> 0").select("class_id", "word_idx", "word"), members


def multi_and_grouped(words: DataFrame, requests: DataFrame) -> DataFrame:
    """(query_id, word_idx, word) of each request: the classes' words given out to their queries. ``multi_and_classes`` is less."""
    found, members = multi_and_classes(words, requests)
    return members.join(found, "class_id").select("query_id", "word_idx", "word")


def named(filters: list[str], places: Iterable[int]) -> list[str]:
    """The sets at ``places`` of a batch; a place that it has not is an error."""
    places = list(places)
    bad = [k for k in places if not 0 <= k < len(filters)]
    if bad:
        raise IndexError(f"no set at {bad} in a batch of {len(filters)}")
    return [filters[k] for k in places]


def known(catalog: DataFrame, filters: Iterable[str]) -> list[str]:
    """The requested sets, each once, all of which the catalogue (filter_id, ...) has; any other one is an error.

    Without this check a set that is not there is an empty one.
    """
    names = wanted(filters)
    held = {r[0] for r in catalog.where(F.col("filter_id").isin(names)).select("filter_id").distinct().collect()}
    missing = [n for n in names if n not in held]
    if missing:
        raise KeyError(f"unknown filters: {missing}")
    return names


def checked(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Requests (..., filter_id) with ``known``: whether the catalogue (filter_id, ...) has the set."""
    held = catalog.select("filter_id").distinct().withColumn("known", F.lit(True))
    return requests.join(held, "filter_id", "left").select(*requests.columns, F.coalesce("known", F.lit(False)).alias("known"))


def dense(spark, universe: int) -> DataFrame:
    """(word_idx) of every word of the universe."""
    return spark.range(words_in(universe)).select(F.col("id").alias("word_idx"))


def complement(words: DataFrame, universe: int) -> DataFrame:
    """(word_idx, word) of the ids of 0 to ``universe`` - 1 that are not in (word_idx, word)."""
    every = dense(words.sparkSession, universe).join(words.select("word_idx", "word"), "word_idx", "left")
    word = F.coalesce("word", F.lit(0).cast("long")).bitwiseXOR(FULL).bitwiseAND(mask_of(F.col("word_idx"), F.lit(universe).cast("long")))
    return every.select("word_idx", word.alias("word")).where("word <> 0")


def complement_ids(ids: DataFrame, universe: int) -> DataFrame:
    """The same on ids, as an anti join with the range."""
    return ids.sparkSession.range(universe).join(ids.select("id"), "id", "left_anti")


def complement_gaps(ids: DataFrame, universe: int) -> DataFrame:
    """The same by gaps: between neighbouring ids, before the first and after the last.

    Gaps are found within containers, whose ends stand in for neighbours, so that no task sees the whole set; containers
    without an id are whole gaps.
    """
    from pyspark.sql.window import Window

    from ..functions.bits import CONTAINER, key_of

    spark = ids.sparkSession
    ends = spark.range(-(-universe // CONTAINER)).select(F.least((F.col("id") + 1) * CONTAINER, F.lit(universe)).alias("id"), F.col("id").cast("int").alias("key"), F.lit(1).alias("end"))
    rows = ids.distinct().select("id", key_of(F.col("id")).alias("key"), F.lit(0).alias("end")).unionByName(ends)
    before = F.coalesce(F.lag("id").over(Window.partitionBy("key").orderBy("id", "end")), F.col("key").cast("long") * CONTAINER - 1)
    gaps = rows.withColumn("before", before).where("id - before > 1")
    return gaps.select(F.explode(F.sequence(F.col("before") + 1, F.col("id") - 1)).alias("id"))
