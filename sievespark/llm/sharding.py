"""Sharding by jump consistent hashing (Lamping and Veach, "A Fast, Minimal Memory, Consistent Hash Algorithm", 2014)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import text_or_empty

#: Fixed value: the multiplier of the published algorithm's 64-bit linear congruential generator.
MULTIPLIER = 2862933555777941757
SHARDS = 24
#: Slots are numbered in this many buckets a shard, so that no task orders a whole shard. Bounds the table of bases.
BUCKETS = 1024


def jump(key: str, shards: int) -> Column:
    """Struct (shard, grown_shard): the key's shard of ``shards`` and of one more, as SQL on longs only.

    The jumps of a key do not depend on the number of shards, so one walk gives both: the last position below
    ``shards`` and the last one below ``shards + 1``. The generator's 64-bit product is taken modulo 2**64 from 16-bit
    limbs, as a plain product would overflow. State: two 32-bit halves. A walk has about ln(shards) jumps; first so many
    are made as nearly all keys need, and only a key that is not through goes on to as many as there can be.
    """
    low, high = MULTIPLIER & 0xFFFFFFFF, MULTIPLIER >> 32
    c0, c1, h0, h1 = low & 0xFFFF, low >> 16, high & 0xFFFF, high >> 16
    mask = 0xFFFFFFFF
    first = f"(a.lo * {c0}L + shiftleft((a.lo * {c1}L) & 65535L, 16) + 1L)"
    new_lo = f"({first} & {mask}L)"
    new_hi = (
        f"((shiftright({first}, 32) + shiftright(a.lo * {c1}L, 16) + a.lo * {h0}L + shiftleft((a.lo * {h1}L) & 65535L, 16)"
        f" + a.hi * {c0}L + shiftleft((a.hi * {c1}L) & 65535L, 16)) & {mask}L)"
    )
    step = (
        f"(a, i) -> CASE WHEN a.j > {shards}L THEN a ELSE named_struct('hi', {new_hi}, 'lo', {new_lo},"
        f" 'j', cast((a.j + 1L) * (2147483648D / cast(shiftright({new_hi}, 1) + 1L AS double)) AS bigint),"
        f" 's', CASE WHEN a.j < {shards}L THEN a.j ELSE a.s END, 'g', a.j) END"
    )
    first = min(shards + 1, 4 * shards.bit_length() + 16)
    begin = f"named_struct('hi', shiftrightunsigned({key}, 32), 'lo', {key} & {mask}L, 'j', 0L, 's', 0L, 'g', 0L)"
    walked = f"array(aggregate(sequence(1, {first}), {begin}, {step}))"
    if first <= shards:
        walked = f"transform({walked}, w -> CASE WHEN w.j > {shards}L THEN w ELSE aggregate(sequence(1, {shards + 1}), w, {step}) END)"
    return F.expr(f"transform({walked}, a -> named_struct('shard', cast(a.s AS int), 'grown_shard', cast(a.g AS int)))[0]")


def shard(df: DataFrame, key: str = "doc_id", shards: int = SHARDS, buckets: int = BUCKETS, ties: list[str] | None = None) -> DataFrame:
    """Adds shard, slot and grown_shard to the rows of ``df``.

    The key and the number of shards alone decide the shard: integers are their own key, other types hash to one
    (XXH64). With one shard more, rows move only into the new one. ``slot`` numbers a shard's rows from 0 without
    gaps, by bucket, key and ``ties``: bucket counts, with partial sums per task, give each bucket's base, and only
    the rows of one bucket are ordered together. A row's bucket is (key + the first of ``ties``) modulo ``buckets``, so that
    rows of one key, null ones among them, are in many. ``ties`` are columns of numbers that tell rows of one
    key apart; by default a hash of all other columns that can be hashed. Rows equal in all of them take
    neighbouring slots, in any order.

    Null keys count as key 0, null ties as 0. An empty table gives an empty result. Texts may be empty, null or of any length.
    Columns of ``df`` named like a result column are replaced.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    kind = df.schema[key].dataType.typeName()
    number = F.col(key).cast("long") if kind in ("byte", "short", "integer", "long") else F.xxhash64(F.col(key).cast("string"))
    rows = df.drop(*[c for c in df.columns if c.lower() in ("shard", "slot", "grown_shard", "__key", "__to", "__bucket", "__base", "__tie")])
    own = rows.columns
    if ties is None:
        others = [c for c in own if c != key and not any(t in rows.schema[c].dataType.simpleString() for t in ("map<", "variant"))]
        rows, ties = rows.withColumn("__tie", F.xxhash64(*others) if others else F.lit(0).cast("long")), ["__tie"]
    first = F.coalesce(F.col(ties[0]).cast("long"), F.lit(0).cast("long"))
    rows = rows.withColumn("__key", F.coalesce(number, F.lit(0).cast("long"))).withColumn("__to", jump("__key", shards))
    bucket = F.pmod(F.pmod("__key", F.lit(buckets)) + F.pmod(first, F.lit(buckets)), F.lit(buckets)).cast("int")
    rows = rows.select("*", F.col("__to.shard").alias("shard"), F.col("__to.grown_shard").alias("grown_shard"), bucket.alias("__bucket")).drop("__to")
    counts = rows.groupBy("shard", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy("shard", "__bucket").orderBy("__key", *ties)
    placed = rows.withColumn("__at", F.row_number().over(within)).join(bases, ["shard", "__bucket"])
    return placed.select(*own, "shard", (F.col("__base") + F.col("__at") - 1).cast("long").alias("slot"), "grown_shard")


def op4_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = text_or_empty().cast("binary")
    sized = docs.select("doc_id", (F.octet_length(text_or_empty()) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = shard(sized, ties=["text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
