"""Storage policies: when a set is stored as its complement, and how a container is encoded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ARRAY, BITMAP, RUN = "ARRAY", "BITMAP", "RUN"
#: Containers of more ids than the threshold become bitmaps. KEEP is the format's own rule, ALL makes all bitmaps.
KEEP, ALL, AUTO = 4096, 0, -1
#: Cache assumed where its size is not known.
CACHE_BYTES = 4 << 20
#: Bytes of a bitmap payload; of a container's key, type, offset and size.
BITMAP_BYTES, ENTRY_BYTES = 8192, 2 + 1 + 4 + 2


def is_dense(cardinality: Column, universe: Column) -> Column:
    """Whether the complement is smaller: more than half of the universe, exactly half not."""
    return cardinality > F.floor(universe / 2)


def auto_threshold(universe: int, cache_bytes: int = CACHE_BYTES) -> int:
    """ALL where twice a flat bitset of the universe outgrows the cache, else KEEP; KEEP for the empty universe."""
    return ALL if universe and -(-universe // 8) * 2 > cache_bytes else KEEP


def auto_threshold_of(universe: Column, cache_bytes: Column) -> Column:
    """``auto_threshold`` as an expression."""
    return F.when((universe > 0) & (F.floor((universe + 7) / 8) * 2 > cache_bytes), F.lit(ALL)).otherwise(F.lit(KEEP)).cast("int")


def promotes(containers: Column, universe: Column) -> Column:
    """The guard on automatic promotion: not where twice the bitmaps would outgrow the flat bitset."""
    return containers * BITMAP_BYTES * 2 < F.floor((universe + 7) / 8)


def encoding(card: Column, runs: Column, threshold: int = KEEP, with_runs: bool | None = None) -> Column:
    """RUN where runs take fewer bytes than the other two encodings, else BITMAP above the threshold, else ARRAY.

    Without runs, which is the rule for a threshold other than KEEP, containers above it are bitmaps whatever their runs.
    """
    plain = F.when(card > threshold, F.lit(BITMAP)).otherwise(F.lit(ARRAY))
    if not (threshold == KEEP if with_runs is None else with_runs):
        return plain
    return F.when(2 + 4 * runs < F.least(F.lit(BITMAP_BYTES), 2 * card + 2), F.lit(RUN)).otherwise(plain)


def payload_bytes(ctype: Column, card: Column, runs: Column) -> Column:
    return F.when(ctype == BITMAP, F.lit(BITMAP_BYTES)).when(ctype == ARRAY, 2 * card).otherwise(4 * runs).cast("long")
