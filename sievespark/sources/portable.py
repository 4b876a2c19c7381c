"""The public portable serialisation of Roaring bitmaps, from and to containers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.policy import ARRAY, BITMAP, RUN
from ..operators.containers import SCHEMA

# Fixed values of the format: cookies, and the number of containers from which one with runs has offsets.
PLAIN, WITH_RUNS, OFFSETS_FROM = 12346, 12347, 4
KINDS = (ARRAY, BITMAP, RUN)


def _bodies(ctype: pa.Array, arr: pa.Array, runs: pa.Array, words: pa.Array) -> list[bytes]:
    """Payloads of containers in the format's bytes, from columns."""
    out = []
    for k, kind in enumerate(ctype.to_pylist()):
        if kind == ARRAY:
            out.append(arr[k].values.to_numpy(zero_copy_only=False).astype("<u2").tobytes())
        elif kind == RUN:
            own = runs[k].values
            pairs = np.stack([own.field(c).to_numpy(zero_copy_only=False) for c in (0, 1)], axis=1)
            out.append(np.concatenate([[len(pairs)], pairs.ravel()]).astype("<u2").tobytes())
        else:
            table, own = np.zeros(2048, "<u4"), words[k].values
            table[own.field(0).to_numpy(zero_copy_only=False)] = own.field(1).to_numpy(zero_copy_only=False)
            out.append(table.tobytes())
    return out


def dump(table: pa.Table) -> bytes:
    """Containers of one set (key, ctype, card, arr, runs, words)."""
    table = table.sort_by("key").combine_chunks()
    column = lambda c: table.column(c).chunk(0) if table.num_rows else pa.array([], table.schema.field(c).type)
    ctype, keys, cards = column("ctype"), column("key").to_numpy(), column("card").to_numpy()
    bodies = _bodies(ctype, column("arr"), column("runs"), column("words"))
    n, is_run = len(keys), np.array([c == RUN for c in ctype.to_pylist()], bool)
    if is_run.any():
        head = np.array([WITH_RUNS | (n - 1) << 16], "<u4").tobytes() + np.packbits(is_run, bitorder="little").tobytes()
    else:
        head = np.array([PLAIN, n], "<u4").tobytes()
    head += np.stack([keys, cards - 1], axis=1).astype("<u2").tobytes()
    if not is_run.any() or n >= OFFSETS_FROM:
        sizes = np.array([0, *(len(b) for b in bodies)], np.int64)
        head += (len(head) + 4 * n + np.cumsum(sizes)[:-1]).astype("<u4").tobytes()
    return head + b"".join(bodies)


def load(data: bytes) -> list[dict]:
    """Containers of a serialised set; an unknown cookie is an error."""
    first = int(np.frombuffer(data, "<u4", 1)[0])
    if first & 0xFFFF == WITH_RUNS:
        n, at = (first >> 16) + 1, 4
        runs = np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, at), bitorder="little")[:n].astype(bool)
        at += (n + 7) // 8
    elif first == PLAIN:
        n, at = int(np.frombuffer(data, "<u4", 1, 4)[0]), 8
        runs = np.zeros(n, bool)
    else:
        raise ValueError(f"unknown cookie {first}")
    heads = np.frombuffer(data, "<u2", 2 * n, at).astype(int).reshape(n, 2)
    at += 4 * n
    if not runs.any() or n >= OFFSETS_FROM:
        at += 4 * n
    out = []
    for (key, less), is_run in zip(heads.tolist(), runs.tolist(), strict=True):
        row = {"key": key, "card": less + 1, "arr": None, "runs": None, "words": None}
        if is_run:
            k = int(np.frombuffer(data, "<u2", 1, at)[0])
            pairs = np.frombuffer(data, "<u2", 2 * k, at + 2).astype(int).reshape(k, 2)
            row |= {"ctype": RUN, "n_runs": k, "runs": [{"start": s, "length": n_} for s, n_ in pairs.tolist()]}
            at += 2 + 4 * k
        elif less + 1 <= 4096:
            lows = np.frombuffer(data, "<u2", less + 1, at).astype(int)
            row |= {"ctype": ARRAY, "arr": lows.tolist(), "n_runs": int((np.diff(lows) > 1).sum()) + 1}
            at += 2 * (less + 1)
        else:
            words = np.frombuffer(data, "<u4", 2048, at)
            bits = np.unpackbits(words.view(np.uint8), bitorder="little").astype(np.int8)
            row |= {"ctype": BITMAP, "words": [{"pos": p, "word": int(words[p])} for p in np.flatnonzero(words).tolist()], "n_runs": int((np.diff(bits, prepend=0) == 1).sum())}
            at += 8192
        out.append(row)
    return out


def serialise(containers: DataFrame) -> DataFrame:
    """(filter_id, data) from containers in the format's own encoding (threshold KEEP). A set has at most 65,536 containers."""

    def run(table: pa.Table) -> pa.Table:
        return pa.table({"filter_id": [table.column("filter_id")[0].as_py()], "data": pa.array([dump(table)], pa.binary())})

    return containers.groupBy("filter_id").applyInArrow(run, "filter_id string, data binary")


def parse(sets: DataFrame) -> DataFrame:
    """Containers from (filter_id, data)."""
    kinds = pa.schema(
        [("filter_id", pa.string()), ("key", pa.int32()), ("ctype", pa.string()), ("card", pa.int32()), ("n_runs", pa.int32()), ("arr", pa.list_(pa.int32())),
         ("runs", pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))), ("words", pa.list_(pa.struct([("pos", pa.int32()), ("word", pa.int64())])))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("filter_id").to_pylist(), batch.column("data").to_pylist(), strict=True):
                yield pa.RecordBatch.from_pylist([{"filter_id": name} | r for r in load(data)], schema=kinds)

    return sets.select("filter_id", "data").mapInArrow(run, SCHEMA)
