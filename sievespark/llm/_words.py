"""Words of many texts as 64-bit hashes, and hashes of runs of them, in numpy: no Python object a word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of texts that are hashed at once; a longer text is hashed alone.
CHUNK = 1 << 20
#: Odd multipliers of the hashes.
STEP, GOLDEN = 0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15

_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every bit of the result depends on every bit of ``x``."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _weights(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(GOLDEN))


_short = _weights(4096)


def words_of(raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie end to end in ``raw`` from ``offsets`` on, and where each text's words begin.

    A-Z are lower-cased; a word is a run of bytes other than ASCII white space, and ends with its text. A word's hash is a
    sum of its bytes, each times the random weight of its place, mixed with its length.
    """
    data = np.frombuffer(raw.lower(), np.uint8)
    held = ~_space[data]
    first, last = held.copy(), held.copy()
    first[1:] &= ~held[:-1]
    last[:-1] &= ~held[1:]
    begins, ends = offsets[:-1][offsets[:-1] < offsets[1:]], offsets[1:][offsets[:-1] < offsets[1:]]
    first[begins] |= held[begins]
    last[ends - 1] |= held[ends - 1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    sizes = np.flatnonzero(last) + 1 - starts
    at = np.cumsum(sizes) - sizes
    place = np.arange(at[-1] + sizes[-1]) - np.repeat(at, sizes)
    weights = _short if sizes.max() <= len(_short) else _weights(int(sizes.max()))
    with np.errstate(over="ignore"):
        sums = np.add.reduceat((data[held].astype(np.uint64) + np.uint64(1)) * weights[place], at)
        return mix(sums + sizes.astype(np.uint64) * np.uint64(STEP)), np.searchsorted(starts, offsets)


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes, offsets) of stretches of rows of about CHUNK bytes; null texts have no words."""
    column = texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data, at = column.buffers()[2], 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        low, high = int(offsets[at]), int(offsets[stop])
        raw = data[low:high].to_pybytes() if high > low else b""
        yield (at, *words_of(raw, offsets[at : stop + 1] - low))
        at = stop


def powers(n: int) -> np.ndarray:
    """STEP to the powers 0 to n - 1."""
    out = np.full(n, STEP, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_steps = powers(64)


def five(hashes: np.ndarray) -> np.ndarray:
    """Hashes of every five words in a row (over the ends of texts too): unmixed, so that they can be put together."""
    n = max(0, len(hashes) - 4)
    with np.errstate(over="ignore"):
        return sum((hashes[k : k + n] * _steps[k] for k in range(1, 5)), hashes[:n].copy())


class Runs:
    """Hashes of any run of words, of which prefix sums are kept."""

    def __init__(self, hashes: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            self.up = powers(len(hashes) + 1)
            inverse = np.full(len(hashes) + 1, pow(STEP, -1, 1 << 64), np.uint64)
            inverse[0] = 1
            self.down = np.multiply.accumulate(inverse)
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * self.up[:-1], dtype=np.uint64)])

    def at(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[start + size] - self.sums[start]) * self.down[start]

    def joined(self, start: np.ndarray, size: np.ndarray, then: np.ndarray, more: np.ndarray) -> np.ndarray:
        """Of a run and another one right behind it, wherever the two stand."""
        with np.errstate(over="ignore"):
            return self.at(start, size) + self.at(then, more) * self.up[size]


def whole(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of all words of each text, in their order."""
    words = np.diff(offsets)
    with np.errstate(over="ignore"):
        place = mix((np.arange(len(hashes)) - np.repeat(offsets[:-1], words)).astype(np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes + place), dtype=np.uint64)])
        return mix(sums[offsets[1:]] - sums[offsets[:-1]] + words.astype(np.uint64))


def shingles(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the five-word shingles of texts, repeats included, and where each text's begin; fewer words are one shingle."""
    words = np.diff(offsets)
    counts = np.where(words >= 5, words - 4, (words > 0).astype(np.int64))
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
    out = np.zeros(int(ends[-1]), np.uint64)
    long, short = words >= 5, np.flatnonzero((words > 0) & (words < 5))
    if long.any():
        rows = np.repeat(np.arange(len(words)), words)
        base = five(hashes)
        inside = rows[: len(base)] == rows[4:]
        out[np.repeat(long, counts)] = mix(base[inside])
    out[ends[short]] = whole(hashes, offsets)[short]
    return out, ends
