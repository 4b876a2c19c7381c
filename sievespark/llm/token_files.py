"""Token ids as flat binary files with 64-bit offsets, written in parallel and read back through memory maps."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import new_path, small_batches
from ._tokens import WIDE, WordIds, chunks, once

END = 1
_MANIFEST = "part int, name string, width int, id_type string, n_docs long, n_ids long"


def _writer(model: str, folder: str, end: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        name, part = uuid.uuid4().hex, TaskContext.get().partitionId()
        out, marks, at, width = None, [np.zeros(1, "<u8")], 0, 0
        keys: list[pa.Array] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if out is None:
                coder = once(WordIds, model)
                width, last = coder.dtype.itemsize, np.array([end], coder.dtype).tobytes()
                out = fs.open_output_stream(f"{root}/{name}.ids")
            keys.append(batch.column("doc_id"))
            lengths: list[int] = []
            for some in chunks((t or "" for t in batch.column("text").to_pylist()), WIDE):
                for code in coder.encode(some):
                    out.write(code + last)
                    lengths.append(len(code) // width + 1)
            ends = at + np.cumsum(lengths, dtype="<u8")
            marks.append(ends)
            at = int(ends[-1])
        if out is None:
            return
        out.close()
        with fs.open_output_stream(f"{root}/{name}.offsets") as f:
            f.write(np.concatenate(marks).astype("<u8").tobytes())
        docs = pa.concat_arrays(keys)
        with fs.open_output_stream(f"{root}/{name}.docs") as f, pa.ipc.new_file(f, pa.schema([("doc_id", id_type)])) as w:
            w.write_batch(pa.record_batch([docs], names=["doc_id"]))
        row = {"part": part, "name": name, "width": width, "id_type": "long" if id_type == pa.int64() else "string", "n_docs": len(docs), "n_ids": at}
        kinds = [pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_pylist([row], schema=pa.schema(list(zip(row, kinds, strict=True))))

    return run


def write_ids(docs: DataFrame, model: str, folder: str, end: int = END) -> DataFrame:
    """Encodes the whole ``text`` of every document, appends ``end``, and writes the ids into ``folder`` by ascending doc_id.

    The documents are range-partitioned and sorted by doc_id; each task streams its ids into a flat file of unsigned
    little-endian integers (16 bits where the vocabulary allows, else 32), with a file of 64-bit offsets and one of
    document ids. A task names its files anew at each attempt, and the manifest lists those of the attempts that
    counted, so a lost executor leaves at most files that nothing names. Returns the manifest: one row a file, with
    ``base``, the ids before it, as prefix sum over the files.

    Ids of integer types are kept and ordered as longs, all others as strings. Text null is empty, and an empty one has
    the end alone; texts of any length are encoded whole; doc_id null comes first; repeated rows are documents of their own,
    in any order; a table without rows gives no file; other columns are not read.
    """
    spark = docs.sparkSession
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    whole = docs.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long")
    kind = pa.int64() if whole else pa.string()
    ids = F.col("doc_id").cast("long" if whole else "string").alias("doc_id")
    rows = small_batches(docs).select(ids, "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    rows.mapInArrow(_writer(model, folder, end, kind), _MANIFEST).write.parquet(f"{folder}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    found = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")
    return found.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def _mapped(fs, path: str, dtype: str) -> np.ndarray:
    if isinstance(fs, pyarrow.fs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), dtype)


def _reader(folder: str, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                at = f"{root}/{row['name']}"
                ids, marks = _mapped(fs, f"{at}.ids", f"<u{row['width']}"), _mapped(fs, f"{at}.offsets", "<u8")
                with fs.open_input_file(f"{at}.docs") as f:
                    docs = pa.ipc.open_file(f).read_all().column("doc_id").combine_chunks()
                for k in range(0, row["n_docs"], 4096):
                    stop = min(k + 4096, row["n_docs"])
                    cut = marks[k : stop + 1].tolist()
                    sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(cut, cut[1:], strict=False)]
                    starts = np.array(cut[:-1], np.int64) + row["base"]
                    yield pa.RecordBatch.from_arrays(
                        [docs.slice(k, stop - k), pa.array(starts), pa.array(np.diff(np.array(cut, np.int64))), pa.array(sums, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return run


def read_ids(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files: ``start`` counts the ids before it in all files."""
    files = manifest.agg(F.count(F.lit(1)).alias("n"), F.first("id_type").alias("id_type")).first()
    n, id_type = max(1, files["n"]), files["id_type"] or "long"
    kind = pa.int64() if id_type == "long" else pa.string()
    return manifest.repartition(n).mapInArrow(_reader(folder, kind), f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_path(spark, "ids")
    return read_ids(write_ids(docs, public_tokenizers.path("word_bpe_49k.json"), folder), folder)
