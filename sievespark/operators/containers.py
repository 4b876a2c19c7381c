"""Containers: a set's slices of 65,536 ids, each as a list, as runs or as words, with the sizes these take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.bits import CONTAINER, FULL, WORD, WORDS_PER_CONTAINER
from ..functions.policy import ALL, ARRAY, BITMAP, CACHE_BYTES, ENTRY_BYTES, KEEP, RUN, auto_threshold, encoding, payload_bytes, promotes
from .ingest import to_words

SCHEMA = "filter_id string, key int, ctype string, card int, n_runs int, arr array<int>, runs array<struct<start:int,length:int>>, words array<struct<pos:int,word:bigint>>"


def _edges(words: DataFrame) -> DataFrame:
    """Words with their container's ``key`` and the bits at which runs start (``first``) and end (``last``) within it.

    A bit starts a run if the one below it is clear, which for the lowest is the neighbouring word's; windows run over
    the words of one container, 2,048 at most.
    """
    key = F.floor(F.col("word_idx") / WORDS_PER_CONTAINER).cast("int")
    order = Window.partitionBy("filter_id", "key").orderBy("word_idx")
    beside = lambda f, step: F.when(f("word_idx").over(order) == F.col("word_idx") + step, f("word").over(order)).otherwise(F.lit(0).cast("long"))
    word = F.col("word")
    below = F.shiftleft(word, 1).bitwiseOR(F.shiftright(beside(F.lag, -1), WORD - 1)).bitwiseAND(FULL)
    above = F.shiftright(word, 1).bitwiseOR(F.shiftleft(beside(F.lead, 1).bitwiseAND(1), WORD - 1))
    rows = words.select("filter_id", "word_idx", "word", key.alias("key"))
    return rows.withColumns({"first": word.bitwiseAND(below.bitwiseXOR(FULL)), "last": word.bitwiseAND(above.bitwiseXOR(FULL))})


def runs(members: DataFrame) -> DataFrame:
    """(filter_id, key, start, length): maximal runs within containers; ``length`` is one less than the run's ids."""
    return word_runs(to_words(members))


def word_runs(words: DataFrame) -> DataFrame:
    """The same of words: the k-th start of a container belongs to its k-th end."""
    earlier = Window.partitionBy("filter_id", "key").orderBy("word_idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = _edges(words)
    for side in ("first", "last"):
        rows = rows.withColumn(f"n_{side}", F.coalesce(F.sum(F.bit_count(side)).over(earlier), F.lit(0)))
    base = F.col("word_idx").bitwiseAND(WORDS_PER_CONTAINER - 1) * WORD
    places = lambda c: F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda b: F.call_function("getbit", F.col(c), b) == 1)
    parts = [rows.where(F.col(c) != 0).select("filter_id", "key", F.col(f"n_{c}").alias("before"), base.alias("base"), F.posexplode(places(c)).alias("k", "bit"), F.lit(c).alias("side")) for c in ("first", "last")]
    edges = parts[0].unionByName(parts[1]).select("filter_id", "key", (F.col("before") + F.col("k")).alias("k"), (F.col("base") + F.col("bit")).cast("int").alias("low"), "side")
    found = edges.groupBy("filter_id", "key", "k").agg(F.max(F.when(F.col("side") == "first", F.col("low"))).alias("start"), F.max(F.when(F.col("side") == "last", F.col("low"))).alias("stop"))
    return found.select("filter_id", "key", "start", (F.col("stop") - F.col("start")).alias("length"))


def sizes(members: DataFrame) -> DataFrame:
    """(filter_id, key, card, n_runs, n_words): a full container has 65,536 ids and one run."""
    return word_sizes(to_words(members))


def word_sizes(words: DataFrame) -> DataFrame:
    """The same of words."""
    found = _edges(words).groupBy("filter_id", "key")
    return found.agg(F.sum(F.bit_count("word")).cast("int").alias("card"), F.sum(F.bit_count("first")).cast("int").alias("n_runs"), F.count(F.lit(1)).cast("int").alias("n_words"))


def build(members: DataFrame, threshold: int = KEEP, with_runs: bool | None = None) -> DataFrame:
    """Containers with their payload. A container is at most 65,536 ids, so a payload is bounded whatever the set."""
    return build_words(to_words(members), threshold, with_runs)


def build_words(words: DataFrame, threshold: int = KEEP, with_runs: bool | None = None) -> DataFrame:
    """The same of words."""
    if threshold < 0:
        raise ValueError("an automatic threshold has to be resolved for a universe: build_auto, promote_auto")
    found = word_runs(words)
    each = found.groupBy("filter_id", "key").agg(
        F.sum(F.col("length") + 1).cast("int").alias("card"), F.count(F.lit(1)).cast("int").alias("n_runs"), F.sort_array(F.collect_list(F.struct("start", "length"))).alias("runs")
    )
    lows = F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["start"] + r["length"])))
    each = each.withColumn("ctype", encoding(F.col("card"), F.col("n_runs"), threshold, with_runs)).withColumn("lows", F.when(F.col("ctype") != RUN, lows))
    key, pos = F.floor(F.col("word_idx") / WORDS_PER_CONTAINER).cast("int"), F.col("word_idx").bitwiseAND(WORDS_PER_CONTAINER - 1).cast("int")
    bits = words.groupBy("filter_id", key.alias("key")).agg(F.sort_array(F.collect_list(F.struct(pos.alias("pos"), "word"))).alias("words"))
    out = each.join(bits, ["filter_id", "key"])
    keep = {"arr": (ARRAY, "lows"), "runs": (RUN, "runs"), "words": (BITMAP, "words")}
    return out.select("filter_id", "key", "ctype", "card", "n_runs", *[F.when(F.col("ctype") == kind, F.col(c)).alias(name) for name, (kind, c) in keep.items()])


def members(containers: DataFrame) -> DataFrame:
    """Containers of any encoding back to (filter_id, id)."""
    bits = F.transform("words", lambda w: F.transform(F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda b: F.call_function("getbit", w["word"], b) == 1), lambda b: w["pos"] * WORD + b))
    spread = F.transform("runs", lambda r: F.sequence(r["start"], r["start"] + r["length"]))
    lows = F.when(F.col("ctype") == ARRAY, F.col("arr")).when(F.col("ctype") == RUN, F.flatten(spread)).otherwise(F.flatten(bits))
    return containers.select("filter_id", "key", F.explode(lows).alias("low")).select("filter_id", (F.col("key").cast("long") * CONTAINER + F.col("low")).alias("id"))


def promote(containers: DataFrame, threshold: int = 0) -> DataFrame:
    """Re-encodes: containers of more ids than ``threshold`` become bitmaps, the others stay. The sets stay the same."""
    if threshold < 0:
        raise ValueError("an automatic threshold has to be resolved for a universe: build_auto, promote_auto")
    low = containers.where((F.col("ctype") != BITMAP) & (F.col("card") > threshold))
    bitmaps = build(members(low), threshold, with_runs=False)
    kept = containers.where((F.col("ctype") == BITMAP) | (F.col("card") <= threshold))
    return kept.unionByName(bitmaps)


def promote_auto(containers: DataFrame, universe: int, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """Re-encodes at the threshold that suits the universe: all containers become bitmaps where a flat bitset would not stay in the
    cache, and none do where it would."""
    return containers if auto_threshold(universe, cache_bytes) == KEEP else promote(containers, ALL)


def build_auto(members: DataFrame, universe: int, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """Containers at the threshold that suits the universe. A set whose bitmaps would take half of the flat bitset or more is not
    promoted all the same: that would give up its compression."""
    held = build(members)
    if auto_threshold(universe, cache_bytes) == KEEP:
        return held
    counts = held.groupBy("filter_id").agg(F.count(F.lit(1)).alias("n"))
    small = counts.where(promotes(F.col("n"), F.lit(universe).cast("long"))).select("filter_id")
    return held.join(small, "filter_id", "left_anti").unionByName(promote(held.join(small, "filter_id", "left_semi"), ALL))


def meta(containers: DataFrame, *more: Column) -> DataFrame:
    """One row a set: containers of each kind, ids, and bytes of the compressed form; and ``more`` aggregates."""
    kind = lambda k: F.count_if(F.col("ctype") == k).alias(f"n_{k.lower()}")
    size = F.sum(payload_bytes(F.col("ctype"), F.col("card"), F.col("n_runs")) + ENTRY_BYTES)
    return containers.groupBy("filter_id").agg(F.count(F.lit(1)).alias("n_containers"), kind(ARRAY), kind(BITMAP), kind(RUN), F.sum("card").alias("cardinality"), size.alias("bytes"), *more)


def typed(members_: DataFrame, threshold: int = KEEP) -> DataFrame:
    """(filter_id, key, card, n_runs, ctype): sizes with the encoding, without payloads."""
    return typed_words(to_words(members_), threshold).drop("n_words")


def typed_words(words: DataFrame, threshold: int = KEEP) -> DataFrame:
    """The same of words, with the number of words."""
    return word_sizes(words).withColumn("ctype", encoding(F.col("card"), F.col("n_runs"), threshold))


#: Positions of a page: what a probe of a container looks through.
PAGE = 256


def pages(containers: DataFrame) -> DataFrame:
    """(filter_id, key, page, ctype, arr, runs, words): containers cut into pages, each with its part of the payload; runs end at a
    page's end. Pages without an id have no row."""
    own, at = containers.select("filter_id", "key", "ctype", "arr", "runs", "words"), lambda c: F.floor(c / PAGE).cast("int")
    part = lambda page, a, b: [page.cast("int").alias("page"), a.cast("int").alias("a"), b.cast("long").alias("b")]
    lists = own.where(F.col("ctype") == ARRAY).select("filter_id", "key", "ctype", F.explode("arr").alias("x"))
    lists = lists.select("filter_id", "key", "ctype", *part(at(F.col("x")), F.col("x"), F.lit(0)))
    spans = own.where(F.col("ctype") == RUN).select("filter_id", "key", "ctype", F.explode("runs").alias("r"))
    spans = spans.select("filter_id", "key", "ctype", F.col("r.start").alias("s"), (F.col("r.start") + F.col("r.length")).alias("e"))
    spans = spans.select("filter_id", "key", "ctype", "s", "e", F.explode(F.sequence(at(F.col("s")), at(F.col("e")))).alias("p"))
    begin = F.greatest(F.col("s"), F.col("p") * PAGE)
    spans = spans.select("filter_id", "key", "ctype", *part(F.col("p"), begin, F.least(F.col("e"), (F.col("p") + 1) * PAGE - 1) - begin))
    bits = own.where(F.col("ctype") == BITMAP).select("filter_id", "key", "ctype", F.explode("words").alias("w"))
    bits = bits.select("filter_id", "key", "ctype", *part(at(F.col("w.pos") * WORD), F.col("w.pos"), F.col("w.word")))
    held = lists.unionByName(spans).unionByName(bits).groupBy("filter_id", "key", "page", "ctype").agg(F.collect_list(F.struct("a", "b")).alias("x"))
    kinds = {
        "arr": (ARRAY, F.transform("x", lambda x: x["a"])), "runs": (RUN, F.transform("x", lambda x: F.struct(x["a"].alias("start"), x["b"].cast("int").alias("length")))),
        "words": (BITMAP, F.transform("x", lambda x: F.struct(x["a"].alias("pos"), x["b"].alias("word")))),
    }
    return held.select("filter_id", "key", "page", "ctype", *[F.when(F.col("ctype") == kind, c).alias(name) for name, (kind, c) in kinds.items()])


def holds(low: Column) -> Column:
    """Whether a container (ctype, arr, runs, words) holds a position: by list, by range or by bit."""
    in_runs = F.exists("runs", lambda r: (low >= r["start"]) & (low <= r["start"] + r["length"]))
    in_words = F.exists("words", lambda w: (w["pos"] == F.shiftright(low, 5)) & (F.call_function("getbit", w["word"], low.bitwiseAND(WORD - 1)) == 1))
    return F.coalesce(F.when(F.col("ctype") == ARRAY, F.array_contains("arr", low)).when(F.col("ctype") == RUN, in_runs).otherwise(in_words), F.lit(False))


def arrays_and(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, low) of two sets' list containers, intersected as lists."""
    both = a.where(F.col("ctype") == ARRAY).select("key", F.col("arr").alias("x")).join(b.where(F.col("ctype") == ARRAY).select("key", F.col("arr").alias("y")), "key")
    return both.select("key", F.explode(F.array_intersect("x", "y")).alias("low"))


def array_with(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, low) of a set's list containers that the other set's container of the key holds, whatever its encoding."""
    lows = a.where(F.col("ctype") == ARRAY).select("key", F.explode("arr").alias("low"))
    return lows.join(b.select("key", "ctype", "arr", "runs", "words"), "key").where(holds(F.col("low"))).select("key", "low")


def runs_and(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, start, length): where two sets' runs (key, start, length) overlap, as runs: a range join within the key."""
    x = a.select("key", F.col("start").alias("s"), (F.col("start") + F.col("length")).alias("e"))
    y = b.select("key", F.col("start").alias("s2"), (F.col("start") + F.col("length")).alias("e2"))
    start, end = F.greatest("s", "s2"), F.least("e", "e2")
    return x.join(y, "key").where("s <= e2 AND s2 <= e").select("key", start.alias("start"), (end - start).alias("length"))
