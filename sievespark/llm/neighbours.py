"""Approximate nearest neighbours: stable projections, kd-trees over them, and a chi-square stopping test.

After Sun et al., "SRS: Solving c-Approximate Nearest Neighbor Queries in High Dimensional Euclidean Space with a Tiny
Index" (2014): the squared distance of two projected points over the squared distance of the points follows a
chi-square law, so projected neighbours are verified in order of distance until no unseen point is likely to be nearer.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import written

#: Projected dimensions (even: the chi-square law then has a closed form) and the certainty at which a search stops.
DIMS, CERTAINTY, SEED = 8, 0.98, 11
#: Rows from which cells are learned, rows aimed at in a cell, cells at most, rows of a block, points of a leaf.
SAMPLE, CELL, CELLS, BLOCK, LEAF = 20_000, 20_000, 1024, 40_000, 64


def chi_square(x: float, dims: int) -> float:
    """The distribution function for an even number of degrees of freedom."""
    half = x / 2
    return 1 - math.exp(-half) * sum(half**i / math.factorial(i) for i in range(dims // 2))


def quantile(certainty: float, dims: int) -> float:
    low, high = 0.0, 1.0
    while chi_square(high, dims) < certainty:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, dims) < certainty else (low, mid)
    return high


@dataclass
class Tree:
    """A kd-tree of projected points; nodes know their points' bounding boxes."""

    order: np.ndarray
    low: np.ndarray
    high: np.ndarray
    spans: list[tuple[int, int]]
    children: list[tuple[int, int] | None]

    @classmethod
    def build(cls, points: np.ndarray, leaf: int = LEAF) -> Tree:
        order, low, high, spans, children = np.arange(len(points)), [], [], [(0, len(points))], [None]
        k = 0
        while k < len(spans):
            a, b = spans[k]
            box = points[order[a:b]]
            low.append(box.min(axis=0))
            high.append(box.max(axis=0))
            if b - a > leaf:
                axis, mid = int((high[k] - low[k]).argmax()), (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(box[:, axis], mid)]
                children[k] = (len(spans), len(spans) + 1)
                spans += [(a, a + mid), (a + mid, b)]
                children += [None, None]
            k += 1
        return cls(order, np.array(low), np.array(high), spans, children)

    def nearest(self, point: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
        """Leaves as (least squared projected distance, rows), in the order of that distance."""
        gaps = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        least = (gaps * gaps).sum(axis=1)
        heap = [(least[0], 0)]
        while heap:
            d, k = heapq.heappop(heap)
            if self.children[k] is None:
                a, b = self.spans[k]
                yield d, self.order[a:b]
            else:
                for child in self.children[k]:
                    heapq.heappush(heap, (least[child], child))


def projection(width: int, dims: int = DIMS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((width, dims))


@dataclass
class Cells:
    """Median splits of the projected space: node k has the children 2k + 1 and 2k + 2, and leaves are cells."""

    depth: int
    axes: np.ndarray
    cuts: np.ndarray

    @classmethod
    def learn(cls, points: np.ndarray, cells: int) -> Cells:
        depth = max(0, math.ceil(math.log2(max(1, cells))))
        axes, cuts = np.zeros((1 << depth) - 1, int), np.zeros((1 << depth) - 1)
        parts = {0: points}
        for k in range(len(axes)):
            own = parts.pop(k)
            if len(own):
                axes[k] = int(np.ptp(own, axis=0).argmax())
                cuts[k] = np.median(own[:, axes[k]])
            right = own[:, axes[k]] > cuts[k]
            parts[2 * k + 1], parts[2 * k + 2] = own[~right], own[right]
        return cls(depth, axes, cuts)

    def of(self, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), int)
        for _ in range(self.depth):
            at = 2 * at + 1 + (points[np.arange(len(points)), self.axes[at]] > self.cuts[at])
        return at - len(self.axes)

    def boxes(self, dims: int) -> tuple[np.ndarray, np.ndarray]:
        low, high = [np.full(dims, -np.inf)], [np.full(dims, np.inf)]
        for k, (axis, cut) in enumerate(zip(self.axes, self.cuts, strict=True)):
            left, right = high[k].copy(), low[k].copy()
            left[axis], right[axis] = cut, cut
            low += [low[k], right]
            high += [left, high[k]]
        n = len(self.axes)
        return np.array(low[n:]), np.array(high[n:])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _placed(cells: Cells, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = projection(width)
        for batch in batches:
            if batch.num_rows:
                at = cells.of(_matrix(batch.column("v"), width) @ base)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], names=[*batch.schema.names, "cell"])

    return run


def _reach(cells: Cells, width: int, limit: float):
    """The other cells a query has to visit: those whose nearest point the stopping test does not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = projection(width)
        low, high = cells.boxes(DIMS)
        for batch in batches:
            points = _matrix(batch.column("v"), width) @ base if batch.num_rows else []
            rows, places = [], []
            for k, (point, bound, home) in enumerate(zip(points, batch.column("bound").to_pylist(), batch.column("cell").to_pylist(), strict=True)):
                gaps = np.maximum(np.maximum(low - point, point - high), 0)
                near = (gaps * gaps).sum(axis=1) < limit * bound * bound
                near[home] = False
                found = np.flatnonzero(near)
                rows += [k] * len(found)
                places += found.tolist()
            some = batch.drop_columns(["cell"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(places, pa.int32())], names=[*some.schema.names, "cell"])

    return run


def _search(width: int, k: int, limit: float):
    """Blocks come in order, each with its points before its queries: the tree is built once and queries stream past."""

    def found(tree: Tree, points: np.ndarray, ids: list[list[int]], query: np.ndarray, place: np.ndarray, bound: float) -> list[tuple[float, int]]:
        best: list[tuple[float, int]] = []
        for d, rows in tree.nearest(place):
            if d >= limit * bound * bound:
                break
            gap = points[rows] - query
            far = np.sqrt((gap * gap).sum(axis=1))
            hits = np.flatnonzero(far <= bound)
            if len(hits):
                best += [(float(far[h]), i) for h in hits for i in ids[rows[h]]]
                best.sort()
                del best[k:]
                if len(best) == k:
                    bound = min(bound, best[-1][0])
        return best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = projection(width)
        now, parts, ids, tree, points = None, [], [], None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            blocks = batch.column("block").to_pylist()
            kinds = batch.column("kind").to_numpy()
            vectors = _matrix(batch.column("v"), width)
            names, bounds, groups = batch.column("qid").to_pylist(), batch.column("bound").to_pylist(), batch.column("ids")
            out: list[tuple[int, int, float]] = []
            for n, block in enumerate(blocks):
                if block != now:
                    now, parts, ids, tree = block, [], [], None
                if kinds[n] == 0:
                    parts.append(vectors[n])
                    ids.append(groups[n].as_py())
                elif parts:
                    if tree is None:
                        points = np.array(parts)
                        tree = Tree.build(points @ base)
                    out += [(names[n], i, d) for d, i in found(tree, points, ids, vectors[n], vectors[n] @ base, bounds[n])]
            q, i, d = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(d, pa.float64())], names=["qid", "vec_id", "score"])

    return run


def usable(v: str) -> Column:
    """Vectors that take part: not null, not empty, all components present and finite, one of them not zero."""
    bad = f"exists({v}, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity'))"
    return F.expr(f"coalesce({v} IS NOT NULL AND size({v}) > 0 AND NOT {bad} AND exists({v}, x -> x <> 0), false)")


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, certainty: float = CERTAINTY, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found of each query among all rows with another vec_id.

    ``vectors`` has vec_id (long) and embedding (an array of numbers). Equal vectors are indexed once with their k + 1
    least ids, which is all that a query can need of them, so copies of one vector cost one point; queries with equal
    vectors are answered once. Every distinct vector is indexed: median splits of the projected space, learned from at
    most SAMPLE vectors, give cells, and cells of many rows are salted into blocks. A query first searches its own
    cell; with the distance found there, the stopping test says which other cells it has to visit. A task holds
    one block; queries stream.

    Vectors null, zero, empty or with null or non-finite components take no part, nor do vectors of another length than
    the most frequent one (the shorter, on a tie). Ties of distance go to the smaller vec_id. Rows repeated with their
    vec_id count once; of different vectors under one vec_id the one with the least hash counts. Fewer candidates than ``k``: all of them.
    """
    spark = vectors.sparkSession
    limit = quantile(certainty, DIMS)
    rows = vectors.where(usable("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), is_query.alias("q")).where("vec_id IS NOT NULL")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    common = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").first()
    if common is None:
        return empty
    width = common["n"]
    rows = rows.where(F.size("v") == width).withColumn("h", F.xxhash64("v"))
    several = written(rows.groupBy("vec_id").agg(F.min("h").alias("one"), F.max("h").alias("other")).where("one <> other").select("vec_id", "one"), "several")
    rows = rows.join(several, "vec_id", "left").where("one IS NULL OR one = h").drop("h", "one")
    place = F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))
    points = written(rows.withColumn("p", place).where(F.col("p") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")), "points")
    asked = written(rows.where("q").select("vec_id", "v"), "asked")
    n = points.count()
    some = points.orderBy(F.xxhash64("v")).limit(SAMPLE).select("v").toArrow() if n > cell else None
    places = Cells.learn(_matrix(some.column("v").combine_chunks(), width) @ projection(width) if some is not None else np.zeros((0, DIMS)), min(CELLS, -(-n // cell)))
    kind = points.schema["v"].dataType.simpleString()
    points = written(points.mapInArrow(_placed(places, width), f"v {kind}, ids array<long>, cell int"), "placed")
    # one row a cell, at most CELLS
    counts = points.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("salts"))
    counts = F.broadcast(counts)
    name = F.col("cell").cast("long") * (1 << 32)
    held = points.join(counts, "cell").select((name + F.pmod(F.xxhash64("v"), "salts")).alias("block"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("qid"), "v", "ids", F.lit(None).cast("double").alias("bound"))
    queries = asked.groupBy("v").agg(F.min("vec_id").alias("qid")).select("qid", "v", F.lit(float("inf")).alias("bound"))
    queries = written(queries.mapInArrow(_placed(places, width), f"qid long, v {kind}, bound double, cell int"), "queries")

    def visit(of: DataFrame) -> DataFrame:
        sent = of.join(counts, "cell").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        sent = sent.select((name + F.col("salt")).alias("block"), F.lit(1).alias("kind"), "qid", "v", F.lit(None).cast("array<long>").alias("ids"), "bound")
        both = held.unionByName(sent).repartition("block").sortWithinPartitions("block", "kind")
        return both.mapInArrow(_search(width, k + 1, limit), "qid long, vec_id long, score double")

    at_home = written(visit(queries), "home")
    by_rank = Window.partitionBy("qid").orderBy("score", "vec_id")
    kth = at_home.withColumn("r", F.row_number().over(by_rank)).where(F.col("r") == k + 1).select("qid", F.col("score").alias("known"))
    bound = queries.join(kth, "qid", "left").select("qid", "v", F.coalesce("known", "bound").alias("bound"), "cell")
    away = visit(bound.mapInArrow(_reach(places, width, limit), f"qid long, v {kind}, bound double, cell int"))
    best = at_home.unionByName(away).withColumn("r", F.row_number().over(by_rank)).where(F.col("r") <= k + 1).drop("r")
    found = asked.withColumnRenamed("vec_id", "query_id").join(queries.select("qid", "v"), "v").join(best, "qid").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
