"""Media columns: texts as lossless images in ZIP archives, and a data source that reads archives by byte ranges."""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ._shared import new_path, small_batches

WIDTH = 192
#: An archive ends at so many members or bytes: both stay within plain ZIP.
MEMBERS, ARCHIVE = 60_000, 256 << 20
FORMAT = "sievespark_archives"
SCHEMA = "archive string, member string, offset long, size long, media binary, error string"

# The signatures of PNG and of ZIP's records.
PNG = b"\x89PNG\r\n\x1a\n"
LOCAL, ENTRY, END = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06"
_local, _entry, _end = struct.Struct("<4s5H3L2H"), struct.Struct("<4s6H3L5H2L"), struct.Struct("<4s4H2LH")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(raw: bytes) -> bytes:
    """An 8-bit grey image, 192 samples wide, of ``raw`` and as many spaces as fill the last row (one row at least).

    A private chunk holds the length without the spaces. Every row has filter 0, so the samples are the bytes.
    """
    rows = max(1, -(-len(raw) // WIDTH))
    lines = np.zeros((rows, WIDTH + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(raw.ljust(rows * WIDTH, b" "), np.uint8).reshape(rows, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"byTe", struct.pack(">Q", len(raw))) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> tuple[bytes, int]:
    """The samples of an image that ``to_png`` made, and the length without padding; any damage is an error."""
    if data[:8] != PNG:
        raise ValueError("not a PNG")
    at, parts = 8, {}
    while at < len(data):
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError(f"damaged chunk {kind!r}")
        parts[kind] = parts.get(kind, b"") + body
        at += 12 + n
    width, rows = struct.unpack_from(">II", parts[b"IHDR"])
    lines = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(rows, width + 1)
    if lines[:, 0].any():
        raise ValueError("only filter 0 is read")
    return lines[:, 1:].tobytes(), struct.unpack(">Q", parts[b"byTe"])[0]


def feature(payload: bytes) -> str:
    """Rows, mean in thousandths, and which of 64 equal stretches lie above the mean: integers all, hence the same anywhere."""
    samples = np.frombuffer(payload, np.uint8)
    n = len(samples)
    cuts = np.arange(65) * n // 64
    sums, total = np.add.reduceat(samples, cuts[:-1], dtype=np.int64), int(samples.sum(dtype=np.int64))
    above = np.packbits(sums * n > total * np.diff(cuts)).tobytes().hex()
    return f"rows={n // WIDTH};mean={total * 1000 // n};above={above}"


def member_name(doc_id: int | None) -> str:
    """Names are equally long, so an archive's directory can be cut anywhere by arithmetic."""
    return f"n{0:020d}.png" if doc_id is None else f"d{doc_id:+020d}.png"


#: Bytes of a directory record.
RECORD = _entry.size + len(member_name(0))


class _Archive:
    def __init__(self, fs, path: str):
        self.out, self.path, self.at, self.entries = fs.open_output_stream(path), path, 0, []

    def add(self, name: bytes, data: bytes) -> None:
        crc, n = zlib.crc32(data), len(data)
        self.entries.append(_entry.pack(ENTRY, 20, 20, 0, 0, 0, 33, crc, n, n, len(name), 0, 0, 0, 0, 0, self.at) + name)
        self.out.write(_local.pack(LOCAL, 20, 0, 0, 0, 33, crc, n, n, len(name), 0) + name)
        self.out.write(data)
        self.at += _local.size + len(name) + n

    def close(self) -> None:
        table = b"".join(self.entries)
        self.out.write(table)
        self.out.write(_end.pack(END, 0, 0, len(self.entries), len(self.entries), len(table), self.at, 0))
        self.out.close()


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        now, done = None, []
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                data = to_png((text.as_py() or "").encode())
                if now is not None and (len(now.entries) >= MEMBERS or now.at + len(data) > ARCHIVE):
                    now.close()
                    done.append(now)
                    now = None
                if now is None:
                    now = _Archive(fs, f"{root}/{uuid.uuid4().hex}.zip")
                now.add(member_name(doc_id).encode(), data)
        if now is not None:
            now.close()
            done.append(now)
        rows = [(a.path.rpartition("/")[2], len(a.entries), a.at) for a in done]
        names, counts, ends = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(ends, pa.int64())], names=["archive", "members", "directory"])

    return run


def write_archives(docs: DataFrame, folder: str) -> int:
    """Writes every text (null: empty) of (doc_id, text) as a member of archives in ``folder``; returns how many archives.

    Tasks stream members into archives of their own. The folder's list names only the archives of attempts that
    counted, with their members and where their directories begin; what a lost attempt left is never read. The driver sees
    one such row an archive of some 256 MB, and no archive.

    doc_id is of an integer type, else it is an error; null ids have a name of their own. Repeated rows are members of
    their own; texts may be empty or of any length below an archive's 4 GB; a table without rows gives an empty list; other
    columns are not read.
    """
    if docs.schema["doc_id"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError("doc_id has to be of an integer type")
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    rows = small_batches(docs).select("doc_id", "text").mapInArrow(_writer(folder), "archive string, members long, directory long")
    found = sorted(tuple(r) for r in rows.collect())
    with fs.open_output_stream(f"{root}/archives.json") as f:
        f.write(json.dumps(found).encode())
    return len(found)


@dataclass
class ByteRange(InputPartition):
    archive: str
    start: int
    stop: int
    record: int

    def __post_init__(self):
        self.value = None


class ArchiveReader(DataSourceReader):
    """Plans from the folder's list alone; directories and members are read by the tasks."""

    def __init__(self, options: dict):
        self.folder = options["path"].rstrip("/")
        self.split = int(options.get("splitbytes", 16 << 20))
        self.batch = int(options.get("batchbytes", 4 << 20))
        self.retries = int(options.get("retries", 3))
        self.strict = options.get("onerror", "fail") == "fail"

    def partitions(self) -> list[ByteRange]:
        """Stretches of whole directory records, each for about ``splitBytes`` of members."""
        fs, root = pyarrow.fs.FileSystem.from_uri(self.folder)
        with fs.open_input_stream(f"{root}/archives.json") as f:
            listed = json.loads(f.read())
        found = []
        for name, count, at in listed:
            pieces = min(count, max(1, -(-at // self.split)))
            cuts = [at + RECORD * (count * k // pieces) for k in range(pieces + 1)]
            found += [ByteRange(name, a, b, RECORD) for a, b in zip(cuts, cuts[1:], strict=False)]
        return found or [ByteRange("", 0, 0, 1)]

    def member(self, fs, path: str, entry: tuple, name: bytes) -> bytes:
        """One member by its offset, with a handle of its own."""
        with fs.open_input_file(path) as f:
            return self.checked(f.read_at(_local.size + len(name) + entry[8], entry[16]), entry, name)

    @staticmethod
    def checked(block: bytes, entry: tuple, name: bytes) -> bytes:
        start = _local.size + len(name)
        data = bytes(block[start : start + entry[8]])
        if block[:4] != LOCAL or bytes(block[_local.size : start]) != name or len(data) != entry[8] or zlib.crc32(data) != entry[7]:
            raise OSError("member is damaged")
        return data

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if partition.start == partition.stop:
            return
        fs, root = pyarrow.fs.FileSystem.from_uri(self.folder)
        path = f"{root}/{partition.archive}"
        with fs.open_input_file(path) as f:
            table = f.read_at(partition.stop - partition.start, partition.start)
            entries = [(_entry.unpack_from(table, k), bytes(table[k + _entry.size : k + partition.record])) for k in range(0, len(table), partition.record)]
            while entries:
                first, n, size = entries[0][0][16], 0, 0
                while n < len(entries) and (n == 0 or size < self.batch):
                    entry, name = entries[n]
                    size, n = entry[16] + _local.size + len(name) + entry[8] - first, n + 1
                some, entries = entries[:n], entries[n:]
                try:
                    block = memoryview(f.read_at(size, first))
                except OSError:
                    block = memoryview(b"")
                yield self.batch_of(fs, path, partition.archive, some, block, first)

    def batch_of(self, fs, path: str, archive: str, some: list, block: memoryview, first: int) -> pa.RecordBatch:
        media, errors = [], []
        for entry, name in some:
            try:
                data, error = self.checked(block[entry[16] - first :], entry, name), None
            except OSError:
                data, error = None, "member is damaged"
                for k in range(self.retries):
                    try:
                        data, error = self.member(fs, path, entry, name), None
                        break
                    except OSError as e:
                        error = str(e)
                        time.sleep(0.1 * 2**k)
            if error and self.strict:
                raise OSError(f"{archive}, {name.decode()} at {entry[16]}: {error}")
            media.append(data)
            errors.append(error)
        return pa.RecordBatch.from_arrays(
            [pa.array([archive] * len(some)), pa.array([n.decode() for _, n in some]), pa.array([e[16] for e, _ in some], pa.int64()), pa.array([e[8] for e, _ in some], pa.int64()), pa.array(media, pa.binary()), pa.array(errors, pa.string())],
            names=["archive", "member", "offset", "size", "media", "error"],
        )


class ArchiveSource(DataSource):
    """``spark.read.format("sievespark_archives").load(folder)``: one row a member of the folder's archives.

    Options: ``splitBytes`` and ``batchBytes`` bound a task's and a batch's bytes; a member that cannot be read or whose
    checksum fails is read again alone, by its offset, up to ``retries`` times. Then the task fails, or, with
    ``onError`` other than "fail", the row has null media and the reason in ``error``.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader({k.lower(): v for k, v in self.options.items()})


def read_archives(spark: SparkSession, folder: str, **options) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format(FORMAT).options(**options).load(folder)


_FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for name, data in zip(batch.column("member").to_pylist(), batch.column("media"), strict=True):
            data = data.as_py()
            payload, n = from_png(data)
            rows.append((None if name[0] == "n" else int(name[1:-4]), n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload)))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split(" ")[0] for f in _FEATURES.split(", ")])


def features(media: DataFrame) -> DataFrame:
    """Sizes, digests and features of the members' payloads, all from the stored bytes."""
    return media.where("media IS NOT NULL").select("member", "media").mapInArrow(_features, _FEATURES)


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "media")
    write_archives(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return features(read_archives(spark, folder))
