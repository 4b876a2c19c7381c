"""Indices of the (23, 12, 7) Golay code near a word: words at most two bits apart always share one."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: Fixed value: the code's generator polynomial, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
LENGTH, CHECK = 23, 11


def _rest(word: int) -> int:
    for bit in range(LENGTH - 1, CHECK - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECK)
    return word


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the upper 12 bits; for each remainder six error patterns, and which of them count.

    The code is perfect: one codeword is within three bits of any word. A word three bits from it is four bits from
    exactly five others, and those six together are its neighbourhood; a nearer word has the one.
    """
    upper = np.array([_rest(k << CHECK) for k in range(1 << (LENGTH - CHECK))], np.uint32)
    single = [_rest(1 << b) for b in range(LENGTH)]
    errors, real = np.zeros((1 << CHECK, 6), np.uint32), np.zeros((1 << CHECK, 6), bool)
    count = np.zeros(1 << CHECK, int)
    near = set()
    for weight in range(5):
        for bits in combinations(range(LENGTH), weight):
            rest = 0
            for b in bits:
                rest ^= single[b]
            if weight == 4 and rest in near:
                continue
            if weight < 3:
                near.add(rest)
            errors[rest, count[rest]] = sum(1 << b for b in bits)
            real[rest, count[rest]] = True
            count[rest] += 1
    return upper, errors, real


def indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word of at most 23 bits the 12-bit indices of its codewords, six columns, and which columns count.

    Two words at most two bits apart share an index: take the word between them. Its own codeword is within three
    bits, hence within four bits of both, and a word four bits from a codeword is three bits from its nearest, so
    that the codeword is in both neighbourhoods.
    """
    upper, errors, real = _tables()
    words = words.astype(np.uint32)
    rest = upper[words >> CHECK] ^ (words & ((1 << CHECK) - 1))
    return ((words[:, None] ^ errors[rest]) >> CHECK).astype(np.int64), real[rest]
