"""Sets out of their packed forms: ids in order, CSR arrays, dense bitsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.bits import CONTAINER, FULL, WORD, key_of, mask_of, popcount, words_in
from .ingest import to_words


def enumerate_ids(words: DataFrame) -> DataFrame:
    """The ids of words (word_idx, word, ...), one row each, with the other columns. Order is the reader's affair."""
    rest = [c for c in words.columns if c not in ("word_idx", "word")]
    rows = words.select(*rest, "word_idx", "word", F.explode(F.array(*[F.lit(b) for b in range(WORD)])).alias("bit"))
    return rows.where(F.call_function("getbit", F.col("word"), F.col("bit")) == 1).select(*rest, (F.col("word_idx") * WORD + F.col("bit")).alias("id"))


def indptr(words: DataFrame) -> DataFrame:
    """(filter_id, key, card, start): where each container's ids begin in the set's ordered ids.

    The running sum is over containers, one row in 65,536 ids, and by set.
    """
    cards = words.groupBy("filter_id", F.floor(F.col("word_idx") * WORD / CONTAINER).cast("int").alias("key")).agg(F.sum(popcount(F.col("word"))).alias("card"))
    before = Window.partitionBy("filter_id").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    return cards.select("filter_id", "key", "card", F.coalesce(F.sum("card").over(before), F.lit(0)).cast("long").alias("start"))


def csr(members: DataFrame) -> DataFrame:
    """(filter_id, key, ids, start, stop): each container's ids in order, and their place in all sets' ids laid end to end by filter_id.

    A list is at most 65,536 ids, whatever the set. Where sets begin is a running sum over one count a set.
    """
    ranges = indptr(to_words(members))
    sets = ranges.groupBy("filter_id").agg(F.sum("card").alias("n"))
    earlier = Window.orderBy("filter_id").rowsBetween(Window.unboundedPreceding, -1)
    bases = sets.select("filter_id", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    lists = members.groupBy("filter_id", key_of(F.col("id")).alias("key")).agg(F.sort_array(F.collect_set("id")).alias("ids"))
    begin = F.col("base") + F.col("start")
    return lists.join(ranges, ["filter_id", "key"]).join(bases, "filter_id").select("filter_id", "key", "ids", begin.alias("start"), (begin + F.col("card")).alias("stop"))


def decompress(words: DataFrame, universe: int, negated: bool = False, limit: int | None = None) -> DataFrame:
    """(word_idx, word) of every word of the universe, zeros included, bits beyond it clear; or of a buffer of ``limit`` words.

    A buffer is filled whole: words beyond the universe are 0, and those of the set beyond the buffer are not written.
    """
    n = words_in(universe) if limit is None else limit
    every = words.sparkSession.range(n).select(F.col("id").alias("word_idx")).join(words.select("word_idx", "word"), "word_idx", "left")
    word = F.coalesce("word", F.lit(0).cast("long"))
    word = word.bitwiseXOR(FULL) if negated else word
    return every.select("word_idx", word.bitwiseAND(mask_of(F.col("word_idx"), F.lit(universe).cast("long"))).alias("word"))


#: Pairs of words of a stretch that is generated at once.
STRETCH = 65536


def decompress_batch(words: DataFrame, universes: DataFrame) -> DataFrame:
    """(filter_id, pair_idx, low, high): dense 64-bit words of several sets as two halves; ``universes`` (filter_id, universe).

    A set's range of words is generated from its own universe, stretch by stretch, so that no row holds more than one, and no
    set is paired with another's words.
    """
    pairs, step = F.floor((F.col("universe") + 63) / 64), F.lit(STRETCH).cast("long")
    begins = universes.where("universe > 0").select("filter_id", pairs.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), pairs - 1, step)).alias("begin"))
    begins = begins.repartition("filter_id", "begin")
    every = begins.select("filter_id", F.explode(F.sequence(F.col("begin"), F.least(F.col("begin") + STRETCH, F.col("n")) - 1)).alias("pair_idx"))
    halves = words.groupBy("filter_id", F.shiftright("word_idx", 1).alias("pair_idx")).agg(
        *[F.coalesce(F.max(F.when(F.col("word_idx").bitwiseAND(1) == k, F.col("word"))), F.lit(0)).cast("long").alias(c) for k, c in enumerate(("low", "high"))]
    )
    zero = F.lit(0).cast("long")
    return every.join(halves, ["filter_id", "pair_idx"], "left").select("filter_id", "pair_idx", F.coalesce("low", zero).alias("low"), F.coalesce("high", zero).alias("high"))


def to_bitmaps(members: DataFrame) -> DataFrame:
    """(filter_id, bucket, bm) in Spark's own bitmap form: 32,768 ids a bucket. Its positions begin at 1, hence the shift."""
    at = F.col("id") + 1
    return members.groupBy("filter_id", (F.bitmap_bucket_number(at) - 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bm"))


def bitmaps_and(bitmaps: DataFrame, filters: list[str]) -> DataFrame:
    """(bucket, card) of the sets' intersection by Spark's bitmap aggregates; a bucket that a set lacks shows in the count."""
    names = list(dict.fromkeys(filters))
    rows = bitmaps.where(F.col("filter_id").isin(names)).groupBy("bucket").agg(F.bitmap_and_agg("bm").alias("bm"), F.count(F.lit(1)).alias("n"))
    return rows.where(F.col("n") == len(names)).select("bucket", F.bitmap_count("bm").alias("card")).where("card > 0")


def bitmaps_or(bitmaps: DataFrame, filters: list[str]) -> DataFrame:
    rows = bitmaps.where(F.col("filter_id").isin(filters)).groupBy("bucket").agg(F.bitmap_or_agg("bm").alias("bm"))
    return rows.select("bucket", F.bitmap_count("bm").alias("card"))


def container_keys(words: DataFrame, filters: list[str]) -> DataFrame:
    """Keys of containers that all sets have: what an intersection has to look at."""
    names = list(dict.fromkeys(filters))
    keys = words.where(F.col("filter_id").isin(names)).select("filter_id", key_of(F.col("word_idx") * WORD).alias("key")).distinct()
    return keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(names)).select("key")
