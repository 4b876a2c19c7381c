"""Ids, words and containers: a word holds 32 ids, a container 65,536.

Ids are longs from 0 to 2**32 - 1. Words are longs too, of which the lower 32 bits count: a 64-bit word would need the sign.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD, CONTAINER = 32, 65536
WORDS_PER_CONTAINER = CONTAINER // WORD
FULL = (1 << WORD) - 1


def word_of(id_: Column) -> Column:
    return F.shiftright(id_, 5)


def bit_of(id_: Column) -> Column:
    """The id's bit within its word."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), id_.bitwiseAND(WORD - 1).cast("int"))


def key_of(id_: Column) -> Column:
    """The container's key: the upper 16 bits."""
    return F.shiftright(id_, 16).cast("int")


def low_of(id_: Column) -> Column:
    return id_.bitwiseAND(CONTAINER - 1).cast("int")


def mask_of(word_idx: Column, universe: Column) -> Column:
    """The bits of a word that lie within a universe of ids 0 to ``universe`` - 1; 0 beyond it."""
    left = universe - word_idx * WORD
    part = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.least(left, F.lit(WORD)), F.lit(0)).cast("int")) - 1
    return F.when(left >= WORD, F.lit(FULL)).otherwise(part).cast("long")


def words_in(universe: int) -> int:
    return -(-universe // WORD)


def popcount(word: Column) -> Column:
    return F.bit_count(word).cast("long")


def lowest(word: Column) -> Column:
    """Place of the lowest set bit, from 1; 0 for the empty word."""
    return F.when(word == 0, F.lit(0)).otherwise(F.bit_count(word.bitwiseXOR(word - 1))).cast("long")


def has(word: Column, id_: Column) -> Column:
    return F.call_function("shiftright", word, id_.bitwiseAND(WORD - 1).cast("int")).bitwiseAND(1) == 1
