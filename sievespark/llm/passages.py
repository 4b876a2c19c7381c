"""Repeated passages: paragraphs under MinHash bands, exact edit distance, and removals clustered by components.

A paragraph is any LEAST words in a row of a text. Two paragraphs are alike if the Jaccard similarity of their five-word
shingles, taken in order, is 0.8 or more: of the 46 shingles of fifty words 41 have to be common. One changed word costs
five, one word more or less costs four in one and five in the other, so that paragraphs are alike just if 45 words in a row are
equal in both, or 49 are but for one word replaced, inserted or deleted among them. That is what is verified here, exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import components, drop, fresh, small_batches, written
from ._words import Runs, chunks, five, mix, powers, whole

#: Words of a shingle and of a paragraph; the similarity of paragraphs.
WORDS, LEAST, SIMILARITY = 5, 50, 0.8
#: Shingles of a paragraph that have to be common, and the words in a row, or with one edit among them, that have them.
COMMON = next(c for c in range(LEAST) if c >= SIMILARITY * (2 * (LEAST - WORDS + 1) - c))
RUN = COMMON + WORDS - 1
EDITED = RUN + WORDS - 1
#: Half a paragraph, which one edit leaves whole; on the side of the edit that has less there are at least WORDS words.
HALF = LEAST // 2
#: Shingles under one MinHash. Two neighbouring windows of them whose MinHashes are of different shingles are a band, keyed
#: by the words of both: tuned so that HALF equal words always hold one.
SPAN = (HALF - WORDS + 1) // 2
KEY = SPAN + WORDS
#: Longest period of words that repeat on and on (a word, a short line), whose bands are given at both ends only.
PERIOD = 10
#: Words around a collision that are compared, and that are kept for paragraphs that this does not settle.
REACH = 40
MARGIN = 60

_steps = powers(KEY)
_word = re.compile(r"[^\x20\x09-\x0D]+")


def _periodic(found: np.ndarray, rows: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, stop, period) of runs of RUN words or more that repeat their first PERIOD words or fewer.

    ``found`` are shingles, ``rows`` the text of each word. Such a run has equal shingles a period apart at more places
    in a row than are left out between those looked at first.
    """
    out, taken = [], np.zeros(len(found), bool)
    for p in range(1, PERIOD + 1):
        n = len(found) - p
        if n <= 0 or not (found[:n:16] == found[p::16]).any():
            continue
        same = (found[:n] == found[p:]) & (rows[:n] == rows[p + WORDS - 1 :][:n])
        edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
        starts, stops = edges[::2], edges[1::2] + p + WORDS - 1
        for k in np.flatnonzero(stops - starts >= RUN):
            if not taken[(starts[k] + stops[k]) // 2]:
                taken[starts[k] : stops[k]] = True
                out.append((int(starts[k]), int(stops[k]), p))
    return out


def marks(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, key, size) of the bands of texts whose words' hashes lie end to end.

    The MinHash of each SPAN shingles in a row stands at the last place of the least hash. Where it is another place than
    in the window before, the KEY words of both windows are a band: about two in SPAN + 1 words, of size 0. Words
    repeated in short periods have many equal bands; those further than a period from the run's ends are left out, and
    the run itself is one band of its size, whose key is that of its least rotation.
    """
    n = len(hashes) - KEY + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    base = five(hashes)
    found = mix(base)
    place = np.uint64((1 << 24) - 1) - (np.arange(len(found), dtype=np.uint64) & np.uint64((1 << 24) - 1))
    least = (found >> np.uint64(24) << np.uint64(24)) | place
    done = 1
    while done < SPAN:
        step = min(done, SPAN - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    change = (least[1 : n + 1] != least[:n]) & (rows[:n] == rows[KEY - 1 :])
    inner, runs = np.zeros(n + 1, np.int32), _periodic(found, rows)
    row, at, key, size = [], [], [], []
    with np.errstate(over="ignore"):
        for start, stop, p in runs:
            inner[min(n, start + p)] += 1
            inner[min(n, max(start + p, stop - KEY - p + 1))] -= 1
            once = Runs(np.tile(hashes[start : start + p], 2)).at(np.arange(p), p)
            row.append(rows[start])
            at.append(start)
            key.append(mix(once + np.uint64(1000 + p)).min())
            size.append(stop - start)
        i = np.flatnonzero(change & (np.cumsum(inner)[:n] == 0))
        words = sum((base[i + k] * _steps[k] for k in range(WORDS, KEY - WORDS + 1, WORDS)), base[i])
    row, at = np.concatenate([rows[i], np.array(row, np.int64)]), np.concatenate([i, np.array(at, np.int64)])
    keys = np.concatenate([mix(words + np.uint64(KEY)), np.array(key, np.uint64)]).view(np.int64)
    return row, at - offsets[row], keys, np.concatenate([np.zeros(len(i), np.int64), np.array(size, np.int64)])


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, key, place, first, size) of every band; place -1 for a text itself, keyed by all its words."""
    names = ["node", "key", "place", "first", "size"]
    for batch in batches:
        nodes = batch.column("node").to_numpy(zero_copy_only=False)
        for begin, hashes, offsets in chunks(batch.column("text")):
            words = np.diff(offsets)
            long = words >= LEAST
            row, place, key, size = marks(hashes, offsets)
            keep = long[row]
            row, place, key, size = row[keep], place[keep], key[keep], size[keep]
            first = np.zeros(len(row), bool)
            first[np.unique(mix(key.view(np.uint64) + mix(row.astype(np.uint64))), return_index=True)[1]] = True
            at = offsets[:-1][long]
            if len(at):
                texts = whole(hashes, offsets)[long].view(np.int64)
                row, place = np.concatenate([row, np.flatnonzero(long)]), np.concatenate([place, np.full(len(at), -1)])
                key, first, size = np.concatenate([key, texts]), np.concatenate([first, np.zeros(len(at), bool)]), np.concatenate([size, words[long]])
            columns = [nodes[begin + row], key, place.astype(np.int32), first, size.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


#: What is asked of a text: the words around a stretch of its collisions, around another text's stretch in it, all those
#: around a band that more than two rows have.
OWN, OTHER, MORE = 0, 1, 2
_PARTS = "kind int, node long, other long, a int, b int, shift int, x binary, y binary"


def _sides(codes: np.ndarray, low: np.ndarray, high: np.ndarray, first: np.ndarray, last: np.ndarray, beyond: int) -> tuple[list[bytes], list[bytes]]:
    """The REACH words before ``first``, nearest first, and after ``last`` + KEY; ``beyond`` the texts' ends (low, high)."""
    steps = np.arange(REACH)
    out = []
    for at in (first[:, None] - 1 - steps, last[:, None] + KEY + steps):
        inside = (at >= low[:, None]) & (at < high[:, None])
        table = np.where(inside, codes[np.where(inside, at, 0)], np.uint32(beyond)).astype(np.uint32)
        out.append([r.tobytes() for r in table])
    return out[0], out[1]


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, text, asks) to what is asked of them; words as 32 bits of their hashes, never 0 or 1."""
    names = [c.split()[0] for c in _PARTS.split(", ")]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    for batch in batches:
        nodes, asks = batch.column("node").to_numpy(zero_copy_only=False), batch.column("asks")
        ends = asks.offsets.to_numpy()
        fields = {f.name: asks.values.field(k).to_numpy(zero_copy_only=False) for k, f in enumerate(asks.values.type)}
        for begin, hashes, offsets in chunks(batch.column("text")):
            codes = (hashes >> np.uint64(32)).astype(np.uint32) | np.uint32(2)
            part = slice(ends[begin], ends[begin + len(offsets) - 1])
            row = np.repeat(np.arange(len(offsets) - 1), np.diff(ends[begin : begin + len(offsets)]))
            kind, other, a, b, shift = (fields[c][part] for c in ("kind", "other", "a", "b", "shift"))
            for k in (OWN, OTHER):
                pick = np.flatnonzero(kind == k)
                low, high = offsets[row[pick]], offsets[row[pick] + 1]
                x, y = _sides(codes, low, high, low + a[pick], low + b[pick], k)
                columns = [kind[pick], nodes[begin + row[pick]], other[pick], a[pick], b[pick], shift[pick], x, y]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
            pick = np.flatnonzero(kind == MORE)
            if not len(pick):
                continue
            held = set(zip(row[pick].tolist(), a[pick].tolist(), strict=True))
            mark_row, mark_place, _, mark_size = marks(hashes, offsets)
            alone: dict[int, list[int]] = {}
            for r, p, s in zip(mark_row.tolist(), mark_place.tolist(), mark_size.tolist(), strict=True):
                if not s and (r, p) not in held:
                    alone.setdefault(r, []).append(p)
            rows: list[tuple] = []
            for r in np.unique(row[pick[b[pick] > 0]]).tolist():
                size = int(offsets[r + 1] - offsets[r])
                places = np.sort(a[pick[(row[pick] == r) & (b[pick] > 0)]])
                lonely = np.array(alone.get(r, []), np.int32)
                for group in np.split(places, np.flatnonzero(np.diff(places) > 2 * MARGIN) + 1):
                    low, high = max(0, int(group[0]) - MARGIN), min(size, int(group[-1]) + KEY + MARGIN)
                    near = lonely[(lonely >= low) & (lonely < high)] - low
                    rows.append((MORE, int(nodes[begin + r]), 0, low, high, 0, codes[offsets[r] + low : offsets[r] + high].tobytes(), near.astype("<i4").tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _equal(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words are equal from column i of each row of ``x`` and column j of ``y`` on."""
    steps = np.arange(REACH)
    at, to = i[:, None] + steps, j[:, None] + steps
    inside = (at < REACH) & (to < REACH)
    rows = np.arange(len(x))[:, None]
    same = inside & (x[rows, np.minimum(at, REACH - 1)] == y[rows, np.minimum(to, REACH - 1)])
    return np.where(same.all(axis=1), REACH, same.argmin(axis=1))


def repeated(middle: np.ndarray, x: np.ndarray, u: np.ndarray, y: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(alike, left, right): whether ``middle`` equal words and those around them repeat a paragraph, and how far to both sides.

    ``x`` and ``u`` are the words before, nearest first, of one and the other text, ``y`` and ``v`` those after. Equal words are
    taken on; beyond them one edit is, if the words to its two sides make EDITED.
    """
    zero = np.zeros(len(x), np.int64)
    equal = [_equal(p, q, zero, zero) for p, q in ((x, u), (y, v))]
    run = middle + equal[0] + equal[1]
    alike, reach = run >= RUN, []
    for (p, q), own in zip(((x, u), (y, v)), equal, strict=True):
        best, taken = zero, zero
        for i, j in ((1, 1), (1, 0), (0, 1)):  # replaced, one more here, one less here
            more = _equal(p, q, own + i, own + j)
            best, taken = np.where(more > best, more, best), np.where(more > best, own + i + more, taken)
        over = (best >= WORDS) & (run + best >= EDITED)
        alike = alike | over
        reach.append(np.where(over, taken, own))
    return alike, reach[0], reach[1]


_SPANS = "node long, kept long, start int, stop int"


def _spans(node: np.ndarray, kept: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(node, pa.int64()), pa.array(kept, pa.int64()), pa.array(start, pa.int32()), pa.array(stop, pa.int32())]
    return pa.RecordBatch.from_arrays(columns, names=["node", "kept", "start", "stop"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        node, other, a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "other", "a", "b"))
        tables = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, REACH) for c in ("x", "u", "y", "v")]
        alike, left, right = repeated(b + KEY - a, *tables)
        yield _spans(node[alike], other[alike], (a - left)[alike], (b + KEY + right)[alike])


class _Region:
    """A stretch of a text (node, a, x: words, y: its bands that no other text has), for runs without such bands."""

    def __init__(self, words: bytes, alone: bytes) -> None:
        codes = np.frombuffer(words, np.uint32)
        self.codes = np.concatenate([codes, np.zeros(1, np.uint32)])
        self.size = len(codes)
        with np.errstate(over="ignore"):
            self.runs = Runs(mix(codes.astype(np.uint64) + np.uint64(1 << 40)))
        counts = np.zeros(self.size + 1, np.int64)
        counts[np.frombuffer(alone, "<i4") + 1] = 1
        self.alone = np.cumsum(counts)

    def shared(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Whether other texts have all bands of each run: one that has a band of its own is not repeated."""
        last = np.maximum(start + size - KEY + 1, start)
        return self.alone[np.minimum(last, self.size)] == self.alone[start]


_RUNS = "key long, node long, start int, size int, before long, after long, open boolean"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, a, x, y, places) to all runs of RUN and of HALF words around the places, with the words beside the latter."""
    names = [c.split()[0] for c in _RUNS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
    for batch in batches:
        for node, a, x, y, places in zip(*(batch.column(c).to_pylist() for c in ("node", "a", "x", "y", "places")), strict=True):
            region = _Region(x, y)
            at, is_open = (np.array([p[c] for p in places]) for c in ("place", "open"))
            inside = (at >= a) & (at + KEY <= a + region.size)
            at, is_open = at[inside] - a, is_open[inside]
            for size in (RUN, HALF):
                n = region.size - size + 1
                if n <= 0:
                    continue
                counts = np.zeros((2, n + 1), np.int64)
                for k, some in enumerate((at, at[is_open])):
                    np.add.at(counts[k], np.clip(some - (size - KEY), 0, n), 1)
                    np.add.at(counts[k], np.clip(some + 1, 0, n), -1)
                near = np.cumsum(counts, axis=1)[:, :n] > 0
                start = np.flatnonzero(near[0])
                start = start[region.shared(start, size)]
                keys = mix(region.runs.at(start, size) + np.uint64(size)).view(np.int64)
                beside = [np.zeros(len(start), np.int64)] * 2 if size == RUN else [region.codes[start - 1].astype(np.int64), region.codes[start + size].astype(np.int64)]
                columns = [keys, np.full(len(start), node), start + a, np.full(len(start), size), *beside, near[1][start]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


_VARIANTS = "key long, node long, start int, stop int"


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, a, x, y, places) to all EDITED words with and without one between, that stands beside a run of HALF.

    Two paragraphs that differ by one word replaced have such words in common without it, by one inserted or deleted where
    the one has it between and the other has not.
    """
    less = np.arange(WORDS, EDITED - HALF + 1)
    for batch in batches:
        for node, a, x, y, places in zip(*(batch.column(c).to_pylist() for c in ("node", "a", "x", "y", "places")), strict=True):
            region = _Region(x, y)
            keys, starts, stops = [], [], []
            for left, side in ((True, "left"), (False, "right")):
                at = np.array([p["start"] for p in places if p[side]], np.int64) - a
                at = at[(at >= 0) & (at + HALF <= region.size)]
                edit = at - 1 if left else at + HALF  # the word that differs
                for skip in (0, 1):
                    e, some = (c.ravel() for c in np.meshgrid(edit, less, indexing="ij"))
                    if left:
                        then, more = e + 1, EDITED - some
                        first, size = then - skip - some, some
                    else:
                        first, size = e - (EDITED - some), EDITED - some
                        then, more = e + skip, some
                    ok = (first >= 0) & (then + more <= region.size) & (e >= 0) & (e < region.size)
                    first, size, then, more = (c[ok] for c in (first, size, then, more))
                    ok = region.shared(first, size) & region.shared(then, more)
                    first, size, then, more = (c[ok] for c in (first, size, then, more))
                    keys.append(mix(region.runs.joined(first, size, then, more) + np.uint64(EDITED)))
                    starts.append(first + a)
                    stops.append(then + more + a)
            keys, starts, stops = np.concatenate(keys).view(np.int64), np.concatenate(starts), np.concatenate(stops)
            columns = [pa.array(keys), pa.array(np.full(len(keys), node), pa.int64()), pa.array(starts, pa.int32()), pa.array(stops, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "node", "start", "stop"])


def _star(rows: DataFrame, name: str) -> DataFrame:
    """Spans (node, kept, start, stop) of rows (key, node, start, stop) whose key an earlier node has."""
    least = written(rows.groupBy("key").agg(F.min("node").alias("kept"), F.max("node").alias("last")).where("kept < last").select("key", "kept"), name)
    return rows.join(least, "key").where("node <> kept").select("node", "kept", "start", "stop")


def _left_open(hits: DataFrame, found: DataFrame, regions: DataFrame) -> DataFrame:
    """Spans of paragraphs whose bands the first text of each band's group does not settle.

    That text may share less than a paragraph, say a common line, with others that share one with one another. Bands
    outside of what was found are open, and all rows of a band with an open one are taken on: their paragraphs
    are grouped by hash, those of RUN equal words as they are, and those with an edit by their words without it. So all
    texts that share one are found by an aggregate, however many there are, and no two texts are paired.
    """
    gone = found.groupBy("node").agg(F.collect_list(F.struct("start", "stop")).alias("gone"))
    inside = F.exists("gone", lambda s: (F.col("place") >= s["start"]) & (F.col("place") + KEY <= s["stop"]))
    is_open = (F.col("node") != F.col("kept")) & ~F.coalesce(inside, F.lit(False))
    marked = written(hits.where("more AND size = 0").join(gone, "node", "left").select("key", "node", "place", is_open.alias("open")), "marked")
    asked = written(marked.groupBy("key").agg(F.max("open").alias("any")).where("any").select("key"), "asked")
    places = marked.join(asked, "key").groupBy("node").agg(F.collect_set(F.struct("place", "open")).alias("places"))
    runs = written(regions.join(places, "node").select("node", "a", "x", "y", "places").mapInArrow(_runs, _RUNS), "runs")
    groups = runs.groupBy("key").agg(
        F.min("node").alias("kept"), F.max("node").alias("last"), F.max("open").alias("any"),
        (F.min("before") < F.max("before")).alias("left"), (F.min("after") < F.max("after")).alias("right"), F.max("size").alias("run"),
    )
    groups = written(groups.where(f"kept < last AND any AND (run = {RUN} OR left OR right)").select("key", "kept", "left", "right"), "groups")
    both = runs.join(groups, "key")
    equal = both.where(f"size = {RUN} AND node <> kept").select("node", "kept", "start", (F.col("start") + RUN).alias("stop"))
    beside = both.where(f"size = {HALF}").groupBy("node", "start").agg(F.max("left").alias("left"), F.max("right").alias("right"))
    beside = beside.groupBy("node").agg(F.collect_list(F.struct("start", "left", "right")).alias("places"))
    edited = written(regions.join(beside, "node").select("node", "a", "x", "y", "places").mapInArrow(_variants, _VARIANTS), "variants")
    out = written(equal.unionByName(_star(edited, "alike")).distinct(), "open")
    for done in (marked, asked, runs, groups, edited):
        drop(done)
    return out


def _joined(spans: DataFrame) -> DataFrame:
    """Overlapping or touching spans (node, kept, start, stop) of a text as one with the least ``kept``."""
    order = Window.partitionBy("node").orderBy("start", "stop")
    opens = F.coalesce(F.col("start") > F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int")
    parted = spans.distinct().withColumn("opens", opens).withColumn("part", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return parted.groupBy("node", "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("kept").alias("kept")).drop("part")


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, start, stop, kept_id, component_id): word spans that an earlier document has too, to be removed.

    Words are parted by ASCII white space and compared with A-Z lower-cased, by hashes of 64 bits, and of 32 around
    collisions; spans count them from 0. Texts all of whose words equal an earlier document's are one span. For the others,
    paragraphs collide under MinHash bands (``marks``); each stretch of collisions with the first document of their bands is compared
    by words (``repeated``), and what that leaves open is grouped by exact hashes of paragraphs (``_left_open``).
    Overlapping spans are joined; ``kept_id`` is the least document that holds a part. ``component_id`` is the least
    document in the component of documents that such spans link; its passages stay.

    A paragraph that is alike one of an earlier document always shares a band with it. Up to ten words may stay at
    an end of a removal where a third document repeats that little more. A passage repeated within one document only is left
    alone, and so are texts of fewer than fifty words and null ones. Words that repeat in periods of ten or fewer over a paragraph
    count as one passage, whatever word it begins with. doc_id null takes no part; rows repeated
    with doc_id and text count once; several texts under one doc_id are documents of their own, told apart by
    ``text_hash`` (xxhash64 of the text), in an order of their own. Tables without rows give none; other columns are not read.
    Texts may have any length: memory grows with the longest.
    """
    docs = small_batches(docs).where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    clash = docs.groupBy("doc_id").agg(F.min("text_hash").alias("a"), F.max("text_hash").alias("b")).where("a <> b").select("doc_id", F.lit(True).alias("clash"))
    clash = written(clash, "clash")
    node = F.when(F.col("clash"), F.xxhash64("doc_id", "text_hash")).otherwise(F.col("doc_id"))
    several = written(docs.join(clash, "doc_id").select("doc_id", "text_hash", node.alias("node")).distinct(), "several")
    docs = docs.join(clash, "doc_id", "left").select(node.alias("node"), "text", "text_hash")
    base = written(docs.select("node", "text").mapInArrow(_marked, "node long, key long, place int, first boolean, size int"), "marks")

    heads = base.where("place = -1").select("node", F.col("key").alias("name"), F.col("size").alias("words")).distinct()
    names = written(heads.groupBy("name").agg(F.min("node").alias("kept"), F.max("node").alias("last")).where("kept < last").select("name", "kept"), "names")
    twins = written(heads.join(names, "name").where("node <> kept").select("node", "kept", F.lit(0).alias("start"), F.col("words").alias("stop")), "twins")
    body = base.where("place >= 0").join(twins.select("node"), "node", "left_anti")
    own = F.when(F.col("first"), F.col("node"))
    shared = body.groupBy("key").agg(
        F.min("node").alias("kept"), F.max("node").alias("last"), F.min_by(F.when(F.col("first"), F.col("place")), own).alias("origin"), F.count(F.lit(1)).alias("rows")
    )
    shared = written(shared.where("kept < last").select("key", "kept", "origin", (F.col("rows") > 2).alias("more")), "shared")
    hits = written(body.join(shared, "key").select("key", "node", "place", "first", "size", "kept", "origin", "more"), "hits")
    drop(base)
    drop(shared)
    periods = hits.where("size > 0 AND node <> kept").select("node", "kept", F.col("place").alias("start"), (F.col("place") + F.col("size")).alias("stop"))

    # bands at most KEY words apart that have the same shift prove all words between equal: one stretch
    places = hits.where("size = 0 AND first AND node <> kept").select("node", "kept", "place", (F.col("place") - F.col("origin")).alias("shift"))
    order = Window.partitionBy("node", "kept", "shift").orderBy("place")
    opens = F.coalesce(F.col("place") - F.lag("place").over(order) > KEY, F.lit(True)).cast("int")
    stretch = places.withColumn("opens", opens).withColumn("part", F.sum("opens").over(order)).groupBy("node", "kept", "shift", "part")
    stretch = written(stretch.agg(F.min("place").alias("a"), F.max("place").alias("b")), "stretches")

    zero = F.lit(0)
    asks = stretch.select("node", F.lit(OWN).alias("kind"), F.col("kept").alias("other"), "a", "b", "shift")
    theirs = stretch.select(F.col("kept").alias("node"), F.lit(OTHER).alias("kind"), zero.cast("long").alias("other"), (F.col("a") - F.col("shift")).alias("a"), (F.col("b") - F.col("shift")).alias("b"), zero.alias("shift"))
    all_ = hits.where("size = 0").select("node", F.lit(MORE).alias("kind"), zero.cast("long").alias("other"), F.col("place").alias("a"), F.col("more").cast("int").alias("b"), zero.alias("shift"))
    asks = asks.unionByName(theirs.unionByName(all_).distinct()).groupBy("node").agg(F.collect_list(F.struct("kind", "other", "a", "b", "shift")).alias("asks"))
    texts = docs.join(asks.hint("merge"), "node").select("node", "text", "asks")
    parts = written(texts.mapInArrow(_fetched, _PARTS), "parts")
    theirs = parts.where(f"kind = {OTHER}").select(F.col("node").alias("other"), F.col("a").alias("c"), F.col("b").alias("d"), F.col("x").alias("u"), F.col("y").alias("v")).dropDuplicates(["other", "c", "d"])
    theirs = written(theirs, "theirs")
    pairs = parts.where(f"kind = {OWN}").withColumn("c", F.col("a") - F.col("shift")).withColumn("d", F.col("b") - F.col("shift")).join(theirs, ["other", "c", "d"])
    near = pairs.select("node", "other", "a", "b", "x", "u", "y", "v").mapInArrow(_compared, _SPANS)

    found = written(near.unionByName(periods).unionByName(twins).distinct(), "found")
    regions = parts.where(f"kind = {MORE}").select("node", "a", "x", "y").distinct()
    more = _left_open(hits, found, regions)
    spans = written(_joined(found.unionByName(more)), "spans")
    for done in (hits, stretch, parts, theirs, found, more, names, twins):
        drop(done)
    roots = components(spans.select(F.col("node").alias("a"), F.col("kept").alias("b"))).withColumnRenamed("node", "id")
    out = spans.join(roots, spans["node"] == roots["id"]).select("node", "start", "stop", "kept", "root")
    return _named(out, several)


def _named(spans: DataFrame, several: DataFrame) -> DataFrame:
    """Nodes back to document ids; ``several`` (node, doc_id, text_hash) holds those that are not their own id."""
    out = spans
    for column, name in (("node", "doc_id"), ("kept", "kept_id"), ("root", "component_id")):
        ids = several.select(F.col("node").alias("__node"), F.col("doc_id").alias("__id"), *([F.col("text_hash")] if column == "node" else []))
        out = out.join(ids, out[column] == ids["__node"], "left").withColumn(name, F.coalesce("__id", column)).drop("__node", "__id")
    return out.select("doc_id", "text_hash", "start", "stop", "kept_id", "component_id")


def cut(text: str, gone: list[tuple[int, int]]) -> str:
    """``text`` without the words of the spans and the white space after them."""
    words = [m.span() for m in _word.finditer(text)]
    parts, at = [], 0
    for start, stop in sorted(gone):
        if start < len(words):
            parts.append(text[at : words[start][0]])
            at = words[stop][0] if stop < len(words) else len(text)
    return "".join([*parts, text[at:]])


def _cut(names: list[str], cuts: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch.column(c) for c in names}
            hit = [k for k, gone in enumerate(batch.column(cuts)) if gone.is_valid and columns["text"][k].is_valid]
            if hit:
                texts = {k: cut(columns["text"][k].as_py(), [(s["start"], s["stop"]) for s in batch.column(cuts)[k].as_py()]) for k in hit}
                columns["text"] = pa.array([texts[k] if k in texts else t.as_py() for k, t in enumerate(columns["text"])], pa.string())
                if "n_chars" in columns:
                    kind = columns["n_chars"].type
                    columns["n_chars"] = pa.array([len(texts[k]) if k in texts else n.as_py() for k, n in enumerate(columns["n_chars"])], kind)
                stay = pa.array([k not in texts or bool(_word.search(texts[k])) for k in range(batch.num_rows)])
                columns = {c: v.filter(stay) for c, v in columns.items()}
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    return run


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans of ``repeats`` cut out of their texts; documents of which no word is left go.

    Documents that lose nothing, null and empty texts among them, stay as they are. Where a column n_chars counts
    characters, it is set anew for those cut; other columns stay, whatever their names.
    """
    id_, hash_, cuts = (fresh(docs.columns, name) for name in ("__id", "__hash", "__gone"))
    gone = repeats(docs).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "stop")).alias(cuts))
    gone = written(gone.withColumnsRenamed({"doc_id": id_, "text_hash": hash_}), "gone")
    same = (docs["doc_id"].cast("long") == gone[id_]) & (gone[hash_].isNull() | (F.xxhash64(docs["text"]) == gone[hash_]))
    rows = docs.join(gone.hint("merge"), same, "left").select(*[docs[c] for c in docs.columns], cuts)
    return rows.mapInArrow(_cut(docs.columns, cuts), docs.schema)


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removals with their size in words; documents that lose nothing have no row."""
    out = repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "start", "stop", (F.col("stop") - F.col("start")).alias("n_words"), "kept_id", "component_id")
