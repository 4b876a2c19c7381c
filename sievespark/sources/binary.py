"""Binary layouts, little-endian, as Spark data sources that split files by rows.

    tag_<id>.bin     u32 n, u32 tag, u32[n]
    queries.bin      u32 queries, then for each u32 n, u32[n]
    groundtruth.bin  u32 queries, u32 k, u32[queries * k]
    *.u8bin *.ibin *.fbin   i32 rows, i32 width, then rows of u8, i32 or f32
    *.spmat          i64 rows, columns, entries; i64[rows + 1] starts; i32[entries] columns; f32[entries] values
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Items of a partition, and of a batch.
SPLIT, BATCH = 1 << 20, 1 << 16


@dataclass
class Rows(InputPartition):
    path: str
    start: int
    stop: int

    def __post_init__(self):
        self.value = None


class _Reader(DataSourceReader):
    def __init__(self, uri: str):
        self.uri = uri

    def files(self) -> tuple[pyarrow.fs.FileSystem, list[str]]:
        fs, root = pyarrow.fs.FileSystem.from_uri(self.uri)
        info = fs.get_file_info(root)
        if info.is_file:
            return fs, [root]
        if info.type == pyarrow.fs.FileType.NotFound:
            raise FileNotFoundError(self.uri)
        return fs, sorted(f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(root)) if f.is_file and self.mine(f.base_name))

    def mine(self, name: str) -> bool:
        return True

    def rows(self, f) -> int:
        raise NotImplementedError

    def partitions(self) -> list[Rows]:
        fs, paths = self.files()
        found = []
        for path in paths:
            with fs.open_input_file(path) as f:
                n = self.rows(f)
            found += [Rows(path, k, min(k + SPLIT, n)) for k in range(0, n, SPLIT)]
        return found or [Rows("", 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if partition.start == partition.stop:
            return
        fs, _ = pyarrow.fs.FileSystem.from_uri(self.uri)
        with fs.open_input_file(partition.path) as f:
            for k in range(partition.start, partition.stop, BATCH):
                yield self.batch(f, k, min(k + BATCH, partition.stop))

    def batch(self, f, start: int, stop: int) -> pa.RecordBatch:
        raise NotImplementedError


def _numbers(f, kind: str, count: int, offset: int) -> np.ndarray:
    kind = np.dtype(kind)
    return np.frombuffer(f.read_at(count * kind.itemsize, offset), kind)


class TagReader(_Reader):
    def mine(self, name: str) -> bool:
        return name.startswith("tag_") and name.endswith(".bin")

    def rows(self, f) -> int:
        return int(_numbers(f, "<u4", 1, 0)[0])

    def batch(self, f, start, stop):
        tag, ids = _numbers(f, "<u4", 2, 0)[1], _numbers(f, "<u4", stop - start, 8 + 4 * start)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), tag, np.int64)), pa.array(ids.astype(np.int64))], names=["tag_id", "id"])


@dataclass
class Records(Rows):
    """Words ``start`` to ``stop`` of a file of records, which begin with the record of query ``first``."""

    first: int = 0


class QueryReader(_Reader):
    """Records have no fixed size: planning walks the file block by block, hopping from size to size, and cuts it between records."""

    def partitions(self) -> list[Rows]:
        fs, paths = self.files()
        found = []
        for path in paths:
            with fs.open_input_file(path) as f:
                found += self.cuts(f, path)
        return found or [Rows("", 0, 0)]

    def cuts(self, f, path: str) -> list[Records]:
        queries, size = int(_numbers(f, "<u4", 1, 0)[0]), f.size() // 4
        found, at, q, start, first = [], 1, 0, 1, 0
        while q < queries:
            if at >= size:
                raise ValueError(f"{path} ends before its last query")
            words = _numbers(f, "<u4", min(SPLIT, size - at), 4 * at).tolist()
            k, n = 0, len(words)
            while k < n and q < queries:
                k += words[k] + 1
                q += 1
            at += k
            if at - start >= SPLIT or q == queries:
                found.append(Records(path, start, at, first))
                start, first = at, q
        if at > size:
            raise ValueError(f"{path} ends within a query")
        return found

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if partition.start == partition.stop:
            return
        fs, _ = pyarrow.fs.FileSystem.from_uri(self.uri)
        with fs.open_input_file(partition.path) as f:
            words = _numbers(f, "<u4", partition.stop - partition.start, 4 * partition.start)
        sizes_at, k = [], 0
        hops = words.tolist()
        while k < len(hops):
            sizes_at.append(k)
            k += hops[k] + 1
        tags = np.ones(len(words), bool)
        tags[sizes_at] = False
        names, values = np.repeat(partition.first + np.arange(len(sizes_at)), words[sizes_at]), words[tags]
        for a in range(0, len(values), BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(names[a : a + BATCH].astype(np.int64)), pa.array(values[a : a + BATCH].astype(np.int64))], names=["query_id", "tag_id"])


class TruthReader(_Reader):
    def rows(self, f) -> int:
        n, k = _numbers(f, "<u4", 2, 0)
        return int(n) * int(k)

    def batch(self, f, start, stop):
        k = int(_numbers(f, "<u4", 2, 0)[1])
        at = np.arange(start, stop)
        return pa.RecordBatch.from_arrays([pa.array(at // k), pa.array((at % k + 1).astype(np.int32)), pa.array(_numbers(f, "<u4", stop - start, 8 + 4 * start).astype(np.int64))], names=["query_id", "rank", "id"])


class VectorReader(_Reader):
    def __init__(self, uri: str, kind: str):
        super().__init__(uri)
        self.kind = kind

    def rows(self, f) -> int:
        return int(_numbers(f, "<i4", 1, 0)[0])

    def batch(self, f, start, stop):
        width, kind = int(_numbers(f, "<i4", 2, 0)[1]), np.dtype(self.kind)
        values = _numbers(f, self.kind, (stop - start) * width, 8 + start * width * kind.itemsize).astype(np.float32)
        offsets = np.arange(0, (stop - start + 1) * width, max(width, 1), dtype=np.int32) if width else np.zeros(stop - start + 1, np.int32)
        return pa.RecordBatch.from_arrays([pa.array(np.arange(start, stop)), pa.ListArray.from_arrays(offsets, pa.array(values))], names=["id", "vector"])


class SparseReader(_Reader):
    """Split by entries; a split finds its first row by bisection, and reads the starts from there on as it goes."""

    def rows(self, f) -> int:
        return int(_numbers(f, "<i8", 3, 0)[2])

    def first_row(self, f, rows: int, entry: int) -> int:
        """The row that holds an entry: the last one that begins at or before it."""
        low, high = 0, rows
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if int(_numbers(f, "<i8", 1, 24 + 8 * mid)[0]) <= entry else (low, mid - 1)
        return low

    def batch(self, f, start, stop):
        rows, _, entries = (int(x) for x in _numbers(f, "<i8", 3, 0))
        base, first, parts = 24 + 8 * (rows + 1), self.first_row(f, rows, start), []
        at = first
        while at <= rows and (not parts or parts[-1][-1] < stop):
            n = min(BATCH, rows + 1 - at)
            parts.append(_numbers(f, "<i8", n, 24 + 8 * at))
            at += n
        row = first + np.searchsorted(np.concatenate(parts), np.arange(start, stop), side="right") - 1
        columns, values = _numbers(f, "<i4", stop - start, base + 4 * start), _numbers(f, "<f4", stop - start, base + 4 * entries + 4 * start)
        return pa.RecordBatch.from_arrays([pa.array(row.astype(np.int64)), pa.array(columns.astype(np.int64)), pa.array(values)], names=["row", "col", "value"])


class BinarySource(DataSource):
    """``spark.read.format("sieve_binary").option("layout", ...).load(path)``; layouts: tags, queries, truth, u8, i32, f32, sparse."""

    SCHEMAS = {"tags": "tag_id long, id long", "queries": "query_id long, tag_id long", "truth": "query_id long, rank int, id long", "sparse": "row long, col long, value float"}
    KINDS = {"u8": "<u1", "i32": "<i4", "f32": "<f4"}

    @classmethod
    def name(cls) -> str:
        return "sieve_binary"

    @property
    def layout(self) -> str:
        found = self.options.get("layout", "")
        if found not in self.SCHEMAS and found not in self.KINDS:
            raise ValueError(f"unknown layout {found!r}")
        return found

    def schema(self) -> str:
        return self.SCHEMAS.get(self.layout, "id long, vector array<float>")

    def reader(self, schema) -> _Reader:
        path = self.options["path"]
        if self.layout in self.KINDS:
            return VectorReader(path, self.KINDS[self.layout])
        return {"tags": TagReader, "queries": QueryReader, "truth": TruthReader, "sparse": SparseReader}[self.layout](path)


def read(spark: SparkSession, layout: str, path: str) -> DataFrame:
    spark.dataSource.register(BinarySource)
    return spark.read.format("sieve_binary").option("layout", layout).load(path)


def _open(folder: str, name: str):
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    return fs, f"{root}/{name}"


def write_tags(tags: DataFrame, folder: str) -> int:
    """One file a tag from (tag_id, id), ids in order; tags are spread over tasks and streamed. Returns how many files.

    A file gets its name when it is whole, and holds the same at each attempt.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, fs, path, done = None, None, None, "", 0

        def close():
            out.close()
            fs.move(path + ".part", path)

        for batch in batches:
            ids, names = batch.column("id").to_numpy(), batch.column("tag_id").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(names)) + 1).tolist(), len(names)] if len(names) else [0]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if names[a] != now:
                    if out is not None:
                        close()
                    now, done = names[a], done + 1
                    fs, path = _open(folder, f"tag_{now}.bin")
                    out = fs.open_output_stream(path + ".part")
                    out.write(np.array([batch.column("n")[a].as_py(), now], "<u4").tobytes())
                out.write(ids[a:b].astype("<u4").tobytes())
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], names=["files"])

    _open(folder, "")
    rows = tags.select(F.col("tag_id").cast("long").alias("tag_id"), F.col("id").cast("long").alias("id")).distinct()
    sizes = rows.groupBy("tag_id").agg(F.count(F.lit(1)).alias("n"))
    # by a hash: were it the join's own key, Spark would drop this shuffle and might then read a tag's rows in several tasks
    laid = rows.join(sizes, "tag_id").repartition(F.xxhash64("tag_id")).sortWithinPartitions("tag_id", "id")
    return laid.mapInArrow(run, "files long").agg(F.sum("files")).first()[0] or 0


#: Bytes copied at a time when parts are put together.
COPY = 8 << 20


def _write_parts(rows: DataFrame, order: list[str], folder: str, name: str, encode, head) -> str:
    """A file that its layout wants whole, from rows in ``order``: tasks encode ranges of rows into parts, which are then copied
    end to end behind ``head(notes)``.

    ``encode(table)`` gives a batch's bytes, a list of one block a section of the file, and a note (a tuple of numbers); sections of
    all parts follow one another. The driver sees one row of names, sizes and notes a part, and copies bytes only. A
    part that a lost attempt left is never read; the file gets its name when it is whole.
    """
    fs, path = _open(folder, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(folder)
        part, own, outs, notes = TaskContext.get().partitionId(), uuid.uuid4().hex, [], []
        for batch in batches:
            if batch.num_rows:
                blocks, note = encode(batch)
                outs = outs or [fs.open_output_stream(f"{path}.{own}.{k}") for k in range(len(blocks))]
                for out, block in zip(outs, blocks, strict=True):
                    out.write(block)
                notes.append(note)
        for out in outs:
            out.close()
        if outs:
            total = [sum(n) for n in zip(*notes, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([own]), pa.array([len(outs)]), pa.array([total], pa.list_(pa.int64()))], names=["part", "own", "sections", "note"])

    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = sorted(tuple(r) for r in laid.mapInArrow(run, "part long, own string, sections long, note array<long>").collect())
    with fs.open_output_stream(path + ".part") as out:
        out.write(head([list(p[3]) for p in parts]))
        for k in range(parts[0][2] if parts else 0):
            for _, own, _, _ in parts:
                with fs.open_input_stream(f"{path}.{own}.{k}") as part:
                    while block := part.read(COPY):
                        out.write(block)
    for _, own, sections, _ in parts:
        for k in range(sections):
            fs.delete_file(f"{path}.{own}.{k}")
    fs.move(path + ".part", path)
    return f"{folder}/{name}"


def _flat(lists: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of an array of lists, and the lists' lengths."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(kind), np.diff(lists.offsets.to_numpy())


def write_queries(requests: DataFrame, folder: str) -> str:
    """queries.bin from (query_id, tag_id); queries are renumbered from 0 in the order of their ids."""

    def encode(batch):
        values, sizes = _flat(batch.column("tags"), "<u4")
        return [np.insert(values, np.cumsum(sizes) - sizes, sizes).astype("<u4").tobytes()], (len(sizes),)

    lists = requests.groupBy("query_id").agg(F.sort_array(F.collect_set("tag_id")).alias("tags"))
    return _write_parts(lists, ["query_id"], folder, "queries.bin", encode, lambda notes: np.array([sum(n for (n,) in notes)], "<u4").tobytes())


def write_truth(found: DataFrame, folder: str, k: int) -> str:
    """groundtruth.bin from (query_id, rank, id); queries are renumbered from 0, places not filled hold 2**32 - 1."""

    def encode(batch):
        values, sizes = _flat(batch.column("ids"), "<u4")
        table = np.full((len(sizes), k), 2**32 - 1, "<u4")
        table[np.arange(k) < sizes[:, None]] = values
        return [table.tobytes()], (len(sizes),)

    lists = found.where(F.col("rank") <= k).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("ids"))
    return _write_parts(lists, ["query_id"], folder, "groundtruth.bin", encode, lambda notes: np.array([sum(n for (n,) in notes), k], "<u4").tobytes())


def write_vectors(vectors: DataFrame, folder: str, name: str, layout: str) -> str:
    """A dense file from (id, vector) of one width, in the order of the ids; vectors of different widths are an error."""
    kind = BinarySource.KINDS[layout]

    def encode(batch):
        values, sizes = _flat(batch.column("vector"), kind)
        return [values.tobytes()], (len(sizes), int(sizes.sum()))

    def head(notes):
        n, total = sum(a for a, _ in notes), sum(b for _, b in notes)
        if any(b * n != total * a for a, b in notes):
            raise ValueError("vectors are not of one width")
        return np.array([n, total // n if n else 0], "<i4").tobytes()

    return _write_parts(vectors.select("id", "vector"), ["id"], folder, name, encode, head)


def write_sparse(cells: DataFrame, folder: str, name: str, rows: int, columns: int) -> str:
    """A sparse file from (row, col, value): the rows' starts, from counts by row, then all columns, then all values."""
    fs, path = _open(folder, name)
    counts = cells.groupBy("row").agg(F.count(F.lit(1)).alias("n"))
    every = cells.sparkSession.range(rows).select(F.col("id").alias("row")).join(counts, "row", "left").select("row", F.coalesce("n", F.lit(0)).alias("n"))
    sizes = _write_parts(every, ["row"], folder, name + ".sizes", lambda b: ([b.column("n").to_numpy().astype("<i8").tobytes()], (int(b.column("n").to_numpy().sum()),)), lambda notes: b"")
    body = _write_parts(
        cells.select("row", "col", "value"), ["row", "col"], folder, name + ".cells",
        lambda b: ([b.column("col").to_numpy().astype("<i4").tobytes(), b.column("value").to_numpy().astype("<f4").tobytes()], (b.num_rows,)), lambda notes: b"",
    )
    with fs.open_output_stream(path + ".part") as out:
        total = fs.get_file_info(f"{path}.cells").size // 8
        out.write(np.array([rows, columns, total], "<i8").tobytes())
        out.write(np.zeros(1, "<i8").tobytes())
        at = 0
        with fs.open_input_stream(f"{path}.sizes") as f:
            while block := f.read(COPY):
                starts = at + np.cumsum(np.frombuffer(block, "<i8"))
                at = int(starts[-1])
                out.write(starts.astype("<i8").tobytes())
        with fs.open_input_stream(f"{path}.cells") as f:
            while block := f.read(COPY):
                out.write(block)
    for gone in (sizes, body):
        fs.delete_file(f"{path}{gone[len(folder) + 1 + len(name):]}")
    fs.move(path + ".part", path)
    return f"{folder}/{name}"
