"""The nearest vectors of each query of a block, in numpy: exact, by a matrix product that leaves out what cannot be among them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Vectors that meet a block of queries at once, and pairs whose distances are computed at once.
CHUNK, PAIRS = 1024, 1 << 18
#: Components above this go the way that cannot overflow in between.
LARGE = 1e100


def dense(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A matrix of doubles as wide as the longest list, and which of its components are there (not null, within the list)."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes, values = np.diff(lists.offsets.to_numpy()), lists.flatten()
    held = np.ones(len(values), bool) if not values.null_count else values.is_valid().to_numpy(zero_copy_only=False)
    flat = values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width), held.reshape(len(sizes), width)
    there = np.arange(width) < sizes[:, None]
    out, present = np.zeros(there.shape), np.zeros(there.shape, bool)
    out[there], present[there] = flat, held
    return out, present


def plain(rows: np.ndarray, present: np.ndarray, width: int) -> np.ndarray:
    """Which rows have all ``width`` components, finite and not huge."""
    if rows.shape[1] < width or not width:
        return np.zeros(len(rows), bool)
    with np.errstate(invalid="ignore"):
        return present[:, :width].all(axis=1) & ~present[:, width:].any(axis=1) & (np.abs(rows) < LARGE).all(axis=1)


class Nearest:
    """The ``k`` nearest so far of each of some queries; ties to the smaller id, NaN after numbers, null (no component in common) last."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, present: np.ndarray, k: int, simple: bool):
        self.ids, self.rows, self.present, self.k, self.simple = ids, rows, present, k, simple
        self.best = np.full(len(ids), np.inf)  # the k-th distance; what is farther is left out
        self.at, self.id, self.dist, self.none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool)
        self.norm = (rows * rows).sum(axis=1) if simple else None

    def merge(self, at: np.ndarray, id_: np.ndarray, dist: np.ndarray, none: np.ndarray) -> None:
        at, id_, dist, none = (np.concatenate(x) for x in ((self.at, at), (self.id, id_), (self.dist, dist), (self.none, none)))
        order = np.lexsort((id_, dist, none, at))
        place = at[order]
        first = np.searchsorted(place, place)  # where each query's rows begin
        kept = order[np.arange(len(order)) - first < self.k]
        self.at, self.id, self.dist, self.none = at[kept], id_[kept], dist[kept], none[kept]
        counts = np.bincount(self.at, minlength=len(self.ids))
        last = np.cumsum(counts) - 1
        full = np.flatnonzero(counts == self.k)
        end = last[full]
        self.best[full] = np.where(self.none[end] | np.isnan(self.dist[end]), np.inf, self.dist[end])

    def near(self, ids: np.ndarray, rows: np.ndarray) -> None:
        """Plain vectors against plain queries. The product's distances are off by less than ``slack``, so a pair is left out
        only if its own distance is above the k-th; the others' are summed from the first component on."""
        if not len(ids):
            return
        norm = (rows * rows).sum(axis=1)
        slack = 16 * (rows.shape[1] + 8) * np.finfo(float).eps * (self.norm + norm.max())
        far = self.norm[:, None] + norm - 2 * (self.rows @ rows.T)
        order = np.argsort(ids, kind="stable")
        low, high = np.searchsorted(ids, self.ids, "left", sorter=order), np.searchsorted(ids, self.ids, "right", sorter=order)
        for q in np.flatnonzero(high > low):
            far[q, order[low[q] : high[q]]] = np.inf
        bound = self.best + slack
        if np.isinf(self.best).any() and len(ids) > self.k:
            bound = np.minimum(bound, np.partition(far, self.k - 1, axis=1)[:, self.k - 1] + 2 * slack)
        at, v = np.nonzero((far <= bound[:, None]) & np.isfinite(far))
        for a in range(0, len(at), PAIRS):
            q, r = at[a : a + PAIRS], v[a : a + PAIRS]
            total = np.zeros(len(q))
            for c in range(rows.shape[1]):
                d = self.rows[q, c] - rows[r, c]
                total += d * d
            self.merge(q, ids[r], total, np.zeros(len(q), bool))

    def odd(self, ids: np.ndarray, rows: np.ndarray, present: np.ndarray) -> None:
        """Any vectors and queries: components that one side lacks do not count."""
        width, step = min(rows.shape[1], self.rows.shape[1]), max(1, PAIRS // max(1, len(self.ids)))
        for a in range(0, len(ids), step):
            some, there, own = rows[a : a + step], present[a : a + step], ids[a : a + step]
            total, any_ = np.zeros((len(self.ids), len(own))), np.zeros((len(self.ids), len(own)), bool)
            with np.errstate(invalid="ignore", over="ignore"):
                for c in range(width):
                    both = self.present[:, c, None] & there[None, :, c]
                    d = self.rows[:, c, None] - some[None, :, c]
                    total += np.where(both, d * d, 0.0)
                    any_ |= both
            at, v = np.nonzero(self.ids[:, None] != own)
            self.merge(at, own[v], np.where(any_, total, 0.0)[at, v], ~any_[at, v])


class Block:
    """A block of queries of one value: plain ones and others, each against plain and other vectors."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, present: np.ndarray, k: int):
        self.width = rows.shape[1]
        simple = plain(rows, present, self.width)
        self.parts = [Nearest(ids[m], rows[m], present[m], k, s) for m, s in ((simple, True), (~simple, False)) if m.any()]

    def add(self, ids: np.ndarray, rows: np.ndarray, present: np.ndarray) -> None:
        for a in range(0, len(ids), CHUNK):
            own, some, there = ids[a : a + CHUNK], rows[a : a + CHUNK], present[a : a + CHUNK]
            simple = plain(some, there, self.width)
            for part in self.parts:
                if part.simple:
                    part.near(own[simple], some[simple][:, : self.width])
                    if not simple.all():
                        part.odd(own[~simple], some[~simple], there[~simple])
                else:
                    part.odd(own, some, there)

    def found(self) -> pa.RecordBatch:
        joined = [np.concatenate(x) for x in zip(*((p.ids[p.at], p.id, p.dist, p.none) for p in self.parts), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(joined[0]), pa.array(joined[1]), pa.array(joined[2], mask=joined[3])], names=["query_id", "id", "dist"])


def search_blocks(k: int):
    """For mapInArrow over rows (block, kind, id, embedding) sorted by block and kind: a block's queries (kind 0), then its vectors (1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked, block = None, [], None

        def opened() -> Block | None:
            table = pa.Table.from_batches(asked) if asked else None
            return Block(table.column("id").to_numpy(), *dense(table.column("embedding")), k) if asked else None

        for batch in batches:
            names, kinds = batch.column("block").to_numpy(zero_copy_only=False), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((names[1:] != names[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(names)], strict=True):
                if a == b:
                    continue
                if names[a] != now:
                    if block is not None:
                        yield block.found()
                    now, asked, block = names[a], [], None
                part = batch.slice(a, b - a)
                if kinds[a] == 0:
                    asked.append(part)
                    continue
                if block is None and asked:
                    block, asked = opened(), []
                if block is not None:
                    block.add(part.column("id").to_numpy(), *dense(part.column("embedding")))
        if block is not None:
            yield block.found()

    return run
