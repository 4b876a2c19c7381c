"""Near copies by SimHash fingerprints that are joined under Golay-code keys."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import golay
from ._shared import components, drop, fresh, small_batches, written
from ._words import chunks, mix, whole
from ._words import shingles as word_shingles

SEED = 42
WORDS, DISTANCE = 3, 2


def shingles(text: str | None, words: int) -> bytes:
    """XXH64 digests, 8 bytes each, of a text's word shingles, repeats included; fewer words: of the whole sequence.

    A-Z are lower-cased, and ASCII white space parts words: just what ``bytes.lower`` and ``bytes.split`` do.
    """
    parts = (text or "").encode().lower().split()
    if not parts:
        return b""
    line, digest = b" ".join(parts), xxhash.xxh64_digest
    if len(parts) < words:
        return digest(line, SEED)
    ends = list(accumulate(len(p) + 1 for p in parts))
    starts = [0, *ends[: len(ends) - words]]
    return b"".join([digest(line[a : b - 1], SEED) for a, b in zip(starts, ends[words - 1 :], strict=True)])


def majority(hashes: np.ndarray) -> np.ndarray:
    """(n, k) bytes to the k * 8 bits that are set in over half of the rows."""
    ones = np.zeros(hashes.shape[1] * 8, np.int64)
    for k in range(0, len(hashes), 255):  # sums of 255 bits fit a byte
        ones += np.unpackbits(hashes[k : k + 255], axis=1).sum(axis=0, dtype=np.uint8)
    return 2 * ones > len(hashes)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64 bits; 0 for a text without words."""
    found = np.frombuffer(shingles(text, words), np.uint8).reshape(-1, 8)
    return int.from_bytes(np.packbits(majority(found)).tobytes(), "big") if len(found) else 0


def _prints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "print"])

    return run


#: A key of so many fingerprints is verified pair by pair; their pairs are then fewer than the rows of points of one each.
CROWD = 64


def _segments(bits: np.ndarray) -> list[np.ndarray]:
    return [bits & np.uint64((1 << 22) - 1), bits >> np.uint64(22) & np.uint64((1 << 21) - 1), bits >> np.uint64(43)]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every key of a fingerprint: one segment as it is, and a codeword index of the next segment."""
    for batch in batches:
        signed = batch.column("print").to_numpy(zero_copy_only=False)
        parts = _segments(signed.view(np.uint64))
        for k in range(3):
            near, real = golay.indices(parts[(k + 1) % 3])
            key = (np.int64(k) << 60) | (parts[k].astype(np.int64)[:, None] << 12) | near
            yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(signed[:, None], key.shape)[real]), pa.array(key[real])], names=["print", "key"])


def _split_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (print, key) with the key split by the codeword indices of the segment that it lacks."""
    for batch in batches:
        signed, key = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("print", "key"))
        parts = np.stack(_segments(signed.view(np.uint64)))
        near, real = golay.indices(parts[((key >> 60) + 2) % 3, np.arange(len(key))])
        split = mixed(key.view(np.uint64)[:, None] ^ mixed(near.astype(np.uint64), 300), 301).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(signed[:, None], split.shape)[real]), pa.array(split[real])], names=["print", "key"])


def _verified(keys: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs (a, b) at most DISTANCE bits apart under the keys of two to CROWD fingerprints."""
    held = keys.join(sizes.where(f"n <= {CROWD}").select("key"), "key")
    pairs = held.withColumnRenamed("print", "a").join(held.withColumnRenamed("print", "b"), "key").where("a < b")
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE).select("a", "b")


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column print) that join all at most two bits apart, and no others.

    Of three segments, two errors leave one clean, and the others have at most two, which Golay indices forgive: so
    linked fingerprints share a key of a clean segment and a codeword near the next. The members of a key are joined and verified;
    a crowded one is first split by the codewords near its third segment. What is crowded even so, some hundreds
    of fingerprints all of whose segments are alike, is not paired out: its members emit all points at most one bit away, and
    fingerprints that share a point are within two bits by the triangle inequality (and any two within two bits share
    one), so a star to the least of each point is exact, with 65 rows a fingerprint however large the group.
    """
    keys = written(prints.select("print").mapInArrow(_keys, "print long, key long"), "keys")

    def sized(of: DataFrame) -> DataFrame:
        return written(of.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sized")

    sizes = sized(keys)
    crowded = keys.join(sizes.where(f"n > {CROWD}").select("key"), "key", "left_semi")
    split = written(crowded.select("print", "key").mapInArrow(_split_keys, "print long, key long"), "split")
    parts = sized(split)
    members = split.join(parts.where(f"n > {CROWD}").select("key"), "key", "left_semi").select("print").distinct()
    flips = F.array(F.col("print"), *[F.col("print").bitwiseXOR(F.lit(v - (1 << 64) if v >> 63 else v).cast("long")) for v in (1 << b for b in range(64))])
    points = written(members.select("print", F.explode(flips).alias("point")), "points")
    least = written(points.groupBy("point").agg(F.min("print").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("point", "b"), "least")
    stars = points.join(least, "point").where("print <> b").select(F.col("print").alias("a"), "b")
    out = written(_verified(keys, sizes).unionByName(_verified(split, parts)).unionByName(stars).distinct(), "links")
    for gone in (keys, sizes, split, parts, points, least):
        drop(gone)
    return out


def groups(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, print, component_id) for every row: fingerprints two or fewer bits apart are linked.

    Copies share a fingerprint and are one node, counted with partial sums, so a group of copies costs one row from
    there on. ``component_id`` is the least doc_id reachable. Texts that are null or have no word have fingerprint zero
    and are linked like any other; whole texts are read, however long; doc_id null never names a group that has another id;
    repeated rows stay; a table without rows gives none; other columns are not read.
    """
    prints = written(small_batches(docs).select("doc_id", "text").mapInArrow(_prints(words), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, print long"), "prints")
    nodes = written(prints.groupBy("print").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes)).withColumnRenamed("node", "print")
    rooted = written(nodes.join(roots, "print", "left").select("print", "least", F.coalesce("root", "print").alias("root")), "rooted")
    named = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "named")
    ids = written(rooted.select("print", "root").join(named, "root").select("print", "component_id"), "ids")
    for gone in (nodes, rooted, named):
        drop(gone)
    return prints.join(ids, "print")


def op5_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


#: Near copies of whole documents: five-word shingles, exact similarity, segments of a 256-bit fingerprint.
SIMILARITY, SEGMENTS, LANES = 0.8, 11, 4
#: Members of a key that meet as many in one task.
BLOCK = 2048


def mixed(hashes: np.ndarray, turn: int) -> np.ndarray:
    """Another hash of 64-bit hashes for each turn."""
    with np.errstate(over="ignore"):
        return mix(hashes + np.uint64((0x9E3779B97F4A7C15 * (turn + 1)) & 0xFFFFFFFFFFFFFFFF))


def anchored_keys(found: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Keys of each text by the hashes of its shingles, which lie end to end.

    23-bit segments of a 256-bit fingerprint are decoded to the codeword indices nearby, one to six each. Twelve
    bits alone would gather a 4096th of all documents under a key, so each segment's keys also hold a MinHash of the
    document: a key then gathers near copies and hardly anything else, however many documents there are.
    """
    starts, held = ends[:-1], np.flatnonzero(np.diff(ends))
    if not len(held):
        return [np.zeros(0, np.int64)] * len(starts)
    lanes = np.stack([found, *(mixed(found, 99 + k) for k in range(1, LANES))], axis=1).view(np.uint8).reshape(len(found), 8 * LANES)
    bits = np.stack([majority(lanes[ends[k] : ends[k + 1]]) for k in held])[:, : 23 * SEGMENTS].reshape(-1, 23)
    near, real = golay.indices(bits @ (1 << np.arange(23)))
    near, real = near.reshape(len(held), SEGMENTS, -1), real.reshape(len(held), SEGMENTS, -1)
    least = np.stack([np.minimum.reduceat(mixed(found, s), starts[held]) for s in range(SEGMENTS)], axis=1)
    with np.errstate(over="ignore"):
        keys = mixed(least[:, :, None] + near.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 200) + np.arange(SEGMENTS, dtype=np.uint64)[:, None]
    out = [np.zeros(0, np.int64)] * len(starts)
    for k, text in enumerate(held):
        out[text] = np.unique(keys[k][real[k]].view(np.int64))
    return out


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, hashes, offsets in chunks(batch.column("text")):
            found, ends = word_shingles(hashes, offsets)
            keys = pa.array(anchored_keys(found, ends), pa.list_(pa.int64()))
            names = pa.array(whole(hashes, offsets).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(begin, len(offsets) - 1), names, keys], names=["doc_id", "name", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, texts) to the distinct shingles of an id's texts, of which there is mostly one."""
    for batch in batches:
        sets: list[np.ndarray] = []
        for _, hashes, offsets in chunks(batch.column("texts").flatten()):
            found, ends = word_shingles(hashes, offsets)
            codes = found.astype(np.uint32).view(np.int32)
            sets += [np.unique(codes[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
        cuts = batch.column("texts").offsets.to_numpy() - batch.column("texts").offsets[0].as_py()
        none = np.zeros(0, np.int32)
        own = [sets[a] if b == a + 1 else np.unique(np.concatenate([none, *sets[a:b]])) for a, b in zip(cuts, cuts[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(own, pa.list_(pa.int32()))], names=["id", "shingles"])


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets of shingles have at least the Jaccard similarity."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")).hint("merge"), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")).hint("merge"), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common >= F.lit(similarity) * (F.size("x") + F.size("y") - common)).select("a", "b").distinct()


class _Members:
    """Sets of shingles of some documents, so that one more can be compared with all of them at once.

    Shingles that more than half of them hold are listed by the documents that lack them, the others by those that hold them:
    among near copies both lists are short.
    """

    def __init__(self, ids: list[int], roots: list[int], sets: list[np.ndarray]) -> None:
        order = np.argsort(ids)
        self.ids, self.roots = np.array(ids)[order], np.array(roots)[order]
        self.into: dict[int, int] = {}
        sets = [sets[k] for k in order]
        self.sizes = np.array([len(s) for s in sets])
        row = np.repeat(np.arange(len(sets)), self.sizes)
        values, place = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.int32), return_inverse=True)
        often = np.bincount(place, minlength=len(values)) * 2 > len(sets)
        self.values, self.often = values, often
        common = np.cumsum(often) - 1
        table = np.ones((int(often.sum()), len(sets)), bool)
        pick = often[place]
        table[common[place[pick]], row[pick]] = False
        lack_value, lack_row = np.nonzero(table)
        lists = np.concatenate([np.flatnonzero(often)[lack_value], place[~pick]])
        rows = np.concatenate([lack_row, row[~pick]])
        by = np.argsort(lists, kind="stable")
        self.rows, self.starts = rows[by], np.searchsorted(lists[by], np.arange(len(values) + 1))

    def alike(self, own: np.ndarray, root: int, similarity: float) -> list[int]:
        """The least id of each other component (root) that has a document alike; from then on they are one component."""
        while root in self.into:
            root = self.into[root]
        if (self.roots == root).all():
            return []
        at = np.searchsorted(self.values, own)
        inside = at < len(self.values)
        at = at[inside][self.values[at[inside]] == own[inside]]
        signs = np.where(self.often[at], -1, 1)
        counts = self.starts[at + 1] - self.starts[at]
        where = np.repeat(self.starts[at] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        common = np.bincount(self.rows[where], np.repeat(signs, counts), len(self.ids)) + int(self.often[at].sum())
        good = np.flatnonzero((common >= similarity * (len(own) + self.sizes - common)) & (self.roots != root))
        met, first = np.unique(self.roots[good], return_index=True)
        if len(met):
            self.into.update(dict.fromkeys(met.tolist(), root))
            self.roots[np.isin(self.roots, met)] = root
        return self.ids[good[first]].tolist()


#: What a row is in its cell: a member, a document that is compared with the members, or both.
MEMBER, OUTER, BOTH = 0, 1, 2


def _met(similarity: float):
    """Rows in order of (key, i, j, kind): a cell's members come before the documents that are compared with them.

    A cell whose documents are in both places holds each of them once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, roots, sets, both, members = None, [], [], [], [], None
        a, b = [], []

        def link(id_: int, others: list[int]) -> None:
            a.extend(min(id_, other) for other in others)
            b.extend(max(id_, other) for other in others)

        def close() -> None:
            if both and len(ids) > 1:
                every = _Members(ids, roots, sets)
                for k in both:
                    link(ids[k], every.alike(sets[k], roots[k], similarity))

        def found() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            cells = list(zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j")), strict=True))
            for k, (cell, kind, id_, root) in enumerate(zip(cells, *(batch.column(c).to_pylist() for c in ("kind", "id", "root")), strict=True)):
                if cell != now:
                    close()
                    now, ids, roots, sets, both, members = cell, [], [], [], [], None
                own = batch.column("shingles")[k].values.to_numpy()
                if kind == OUTER:
                    if ids:
                        members = members or _Members(ids, roots, sets)
                        link(id_, members.alike(own, root, similarity))
                    continue
                if kind == BOTH:
                    both.append(len(ids))
                ids.append(id_)
                roots.append(root)
                sets.append(own)
            yield found()
            a, b = [], []
        close()
        yield found()

    return run


def _across(shared: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between documents that share a key (rows id, key) and are of different components (node, root).

    Members of a key's largest component need no comparison with one another, so each pair has a member outside of it. Those
    are met with all members block by block, by lists of shingles within a task. What a link joins is one component from
    then on, so a block gives fewer links than it holds components, even if all its documents are alike and none is linked yet. A group of
    up to BLOCK members is one cell, in which each has one row; only larger groups have more. Keys with the same members count once.
    """
    placed = written(shared.select("id", "key").join(roots.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("root")), "placed")
    parts = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("who"))
    main = parts.groupBy("key").agg(F.max(F.struct("n", "root")).alias("most"), F.count(F.lit(1)).alias("parts"), F.sum("n").alias("all"), F.bit_xor("who").alias("who")).where("parts > 1")
    main = main.groupBy("who", "all", F.col("most.root").alias("main"), (F.col("all") - F.col("most.n")).alias("outer")).agg(F.min("key").alias("key"))
    size = lambda c: F.greatest(F.ceil(F.col(c) / BLOCK), F.lit(1)).cast("int")
    main = written(main.select("key", "main", size("outer").alias("p"), size("all").alias("q")), "main")
    placed = written(placed.join(main, "key"), "crowds")
    block = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    kind = F.when(F.expr("p = 1 AND q = 1 AND root <> main"), BOTH).otherwise(MEMBER)
    members = placed.select("key", "id", "root", every("p").alias("i"), block("q").alias("j"), kind.alias("kind"))
    outer = placed.where("root <> main AND (p > 1 OR q > 1)").select("key", "id", "root", block("p").alias("i"), every("q").alias("j"), F.lit(OUTER).alias("kind"))
    rows = members.unionByName(outer).join(sets.hint("merge"), "id")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "kind")
    out = written(rows.mapInArrow(_met(similarity), "a long, b long").distinct(), "across")
    drop(main)
    return out


def _central(shared: DataFrame) -> DataFrame:
    """Pairs (a, b) of each document with the most central one that it shares a key with (rows id, key, n: members of the key).

    The most central document is the one whose keys gather most. However many keys a group's members share, each gives
    one pair, and members of one group mostly name the same document.
    """
    weight = shared.groupBy("id").agg(F.sum("n").alias("weight"))
    tops = written(shared.join(weight, "id").groupBy("key").agg(F.max(F.struct("weight", (-F.col("id")).alias("minus"))).alias("top")), "tops")
    pairs = shared.join(tops, "key").groupBy("id").agg((-F.max("top")["minus"]).alias("top")).where("id <> top")
    out = written(pairs.select(F.least("id", "top").alias("a"), F.greatest("id", "top").alias("b")).distinct(), "pairs")
    drop(tops)
    return out


def near_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, kept_id) of the documents that are copies or near copies of another one, which is kept.

    Texts of equal words are one node, named by the least doc_id. Nodes that share a key of ``anchored_keys`` are
    candidates: each is first compared with the most central node that it shares a key with (``_central``), one pair a node;
    then every two of a key that those links leave in different components are compared (``_across``), so
    all that share a key are compared or linked. A link stands if the exact Jaccard similarity of the sets of five-word shingles is at least
    ``similarity``; shingles are told apart by 32 bits of their hashes. Of each component of links the least
    doc_id is kept. Two texts at 0.8 share a segment's key with a chance of about one half, hence some key of
    the eleven nearly always: of 2000 drawn pairs at 0.8, 4 shared none with 100 shingles each, none failed to with 400.

    Texts without words (null and empty ones) are copies of one another; texts of fewer than five words are one shingle; whole
    texts are read, however long. doc_id null takes no part; rows repeated with their doc_id, with the same text or
    another, stay or go together; a table without rows gives none; other columns are not read.
    """
    docs = small_batches(docs).where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = written(docs.mapInArrow(_described, "doc_id long, name long, keys array<long>"), "described")
    names = written(base.groupBy("name").agg(F.min("doc_id").alias("id")), "names")
    copies = written(base.select("doc_id", "name").join(names, "name").select("doc_id", "id"), "copies")
    leaders = base.join(names.withColumnRenamed("id", "doc_id").hint("merge"), ["name", "doc_id"], "left_semi")
    keyed = written(leaders.select(F.col("doc_id").alias("id"), F.explode("keys").alias("key")), "keyed")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("key", "n")
    sizes = written(sizes, "sizes")
    shared = written(keyed.join(sizes, "key").distinct(), "shared")
    for gone in (base, names, keyed, sizes):
        drop(gone)
    pairs = _central(shared)
    texts = docs.withColumnRenamed("doc_id", "id").join(shared.select("id").distinct().hint("merge"), "id", "left_semi").groupBy("id").agg(F.collect_set("text").alias("texts"))
    sets = written(texts.mapInArrow(_sets, "id long, shingles array<int>"), "sets")
    links = written(_alike(pairs, sets, similarity), "links")
    links = links.unionByName(_across(shared.select("id", "key"), components(links), sets, similarity))
    roots = components(written(links, "links")).withColumnRenamed("node", "id")
    for gone in (shared, pairs, sets):
        drop(gone)
    return copies.join(roots, "id", "left").select("doc_id", F.coalesce("root", "id").alias("kept_id")).where("doc_id <> kept_id").distinct()


def without_near_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each group of copies and near copies; rows without doc_id stay."""
    gone = fresh(docs.columns, "__gone")
    ids = written(near_copies(docs, similarity).select(F.col("doc_id").alias(gone)), "gone")
    return docs.join(ids.hint("merge"), docs["doc_id"] == ids[gone], "left_anti")
