"""Filter expressions: a tree of sets, its rewriting without inner complements, and one plan for all of it.

    (Filter("red") & Filter("cheap")) - ~Filter("stock")

Complements are relative to the universe and are pushed outwards by De Morgan's laws, so that stored sets are combined as
they are and at most the result is complemented.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import FULL, mask_of
from ..operators.algebra import combine, complement


class Expr:
    def __and__(self, other: Expr) -> Expr:
        return Op("and", self, other)

    def __or__(self, other: Expr) -> Expr:
        return Op("or", self, other)

    def __sub__(self, other: Expr) -> Expr:
        return Op("andnot", self, other)

    def __xor__(self, other: Expr) -> Expr:
        return Op("xor", self, other)

    def __invert__(self) -> Expr:
        return Not(self)


@dataclass(frozen=True)
class Filter(Expr):
    name: str


@dataclass(frozen=True)
class Not(Expr):
    of: Expr


@dataclass(frozen=True)
class Op(Expr):
    op: str
    left: Expr
    right: Expr


def rewrite(op: str, left_negated: bool, right_negated: bool) -> tuple[str, bool, bool]:
    """(operation, sides swapped, result negated) on the stored sets that gives ``op`` on the logical ones.

    As a truth function of the stored sides: each of the eight functions that the four operations and their
    complements reach is recognised by its values, and one that is true where neither side has the id is a complement.
    """

    def value(o: str, a: bool, b: bool) -> bool:
        return {"and": a and b, "or": a or b, "andnot": a and not b, "xor": a != b}[o]

    points = [(a, b) for a in (False, True) for b in (False, True)]
    goal = [value(op, a != left_negated, b != right_negated) for a, b in points]
    negated = goal[0]
    for found in ("and", "or", "andnot", "xor"):
        for swap in (False, True):
            if [value(found, *((b, a) if swap else (a, b))) != negated for a, b in points] == goal:
                return found, swap, negated
    raise AssertionError("every combination has a form")


def normalise(expr: Expr) -> tuple[Expr, bool]:
    """(an expression without complements, whether its result is to be complemented)."""
    if isinstance(expr, Filter):
        return expr, False
    if isinstance(expr, Not):
        inner, negated = normalise(expr.of)
        return inner, not negated
    left, a = normalise(expr.left)
    right, b = normalise(expr.right)
    op, swap, negated = rewrite(expr.op, a, b)
    return Op(op, *((right, left) if swap else (left, right))), negated


def names(expr: Expr) -> list[str]:
    if isinstance(expr, Filter):
        return [expr.name]
    parts = [expr.of] if isinstance(expr, Not) else [expr.left, expr.right]
    return list(dict.fromkeys(n for p in parts for n in names(p)))


def _word(expr: Expr, column: dict[str, Column]) -> Column:
    if isinstance(expr, Filter):
        return column[expr.name]
    return combine(expr.op, _word(expr.left, column), _word(expr.right, column))


def evaluate(words: DataFrame, expr: Expr, universe: int) -> DataFrame:
    """(word_idx, word) of an expression over the sets of ``words``: one shuffle by word for any number of sets.

    Only a result that is a complement needs the dense range of words.
    """
    stored, negated = normalise(expr)
    own = names(stored)
    rows = words.where(F.col("filter_id").isin(own)).groupBy("word_idx")
    wide = rows.agg(*[F.coalesce(F.bit_or(F.when(F.col("filter_id") == n, F.col("word"))), F.lit(0)).cast("long").alias(f"w{k}") for k, n in enumerate(own)])
    word = _word(stored, {n: F.col(f"w{k}") for k, n in enumerate(own)}).bitwiseAND(FULL)
    found = wide.select("word_idx", word.bitwiseAND(mask_of(F.col("word_idx"), F.lit(universe).cast("long"))).alias("word")).where("word <> 0")
    return complement(found, universe) if negated else found
