"""Filtered nearest-neighbour search, exactly, and its evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.bits import has, word_of
from ._nearest import search_blocks
from .algebra import request_classes

#: Queries that a task holds, and vectors that stream past them; each block of the ones meets each of the others.
BLOCK_QUERIES, BLOCK_VECTORS = 4096, 32768


def top(rows: DataFrame, k: int, rank: str = "rank") -> DataFrame:
    """The ``k`` nearest rows (query_id, id, dist) of each query, ties to the smaller id, null distances last; cut within tasks before the shuffle."""
    at = F.row_number().over(Window.partitionBy("query_id").orderBy(F.asc_nulls_last("dist"), "id"))
    return rows.withColumn(rank, at).where(F.col(rank) <= k)


def _blocks(column: str, n: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


def _every(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _in_blocks(queries: DataFrame, vectors: DataFrame, on: list[str], k: int) -> DataFrame:
    """(query_id, rank, id, dist) over queries (query_id, embedding) and vectors (id, embedding) that agree in ``on``.

    Each block of vectors meets each block of queries once. A task holds the queries of one block and value, the vectors stream past
    them, and a matrix product tells which pairs may be among the nearest; only their distances are summed, in double precision and
    from the first component on. A query's shuffled candidates are k a block. Components that are null or missing on one
    side do not count.
    """
    n, m = (max(1, -(-rows.count() // size)) for rows, size in ((vectors, BLOCK_VECTORS), (queries, BLOCK_QUERIES)))
    same = " AND ".join(f"`{c}` IS NOT NULL" for c in [*on, "embedding"])
    block = F.to_json(F.struct(*on, "i", "j")).alias("block")
    held = vectors.where(same).select("id", *on, "embedding", _blocks("id", n).alias("i"), _every(m).alias("j"))
    asked = queries.where(same).select(F.col("query_id").alias("id"), *on, "embedding", _every(n).alias("i"), _blocks("query_id", m).alias("j"))
    sides = [rows.select(block, F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id"), "embedding") for kind, rows in ((0, asked), (1, held))]
    laid = sides[0].unionByName(sides[1]).repartition("block").sortWithinPartitions("block", "kind", "id")
    return top(laid.mapInArrow(search_blocks(k), "query_id long, id long, dist double"), k).select("query_id", "rank", "id", "dist")


def search_within(queries: DataFrame, vectors: DataFrame, on: str, k: int) -> DataFrame:
    """(query_id, rank, id, dist): nearest vectors that share the query's value of ``on``; in blocks within each value."""
    return _in_blocks(queries, vectors, [on], k)


def search_all(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, dist): nearest of all vectors, in blocks."""
    return _in_blocks(queries, vectors, [], k)


def search_filtered(queries: DataFrame, vectors: DataFrame, allowed: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, dist): nearest of the vectors that are in the query's computed set.

    ``allowed`` (class_id, word_idx, word) holds the sets' words and ``members`` (query_id, class_id) says whose they are, as
    ``multi_and_classes`` gives them. Vectors are filtered before the search: each class takes its vectors once, by word
    and bit, and its queries meet just those. A query without a set, or with an empty one, has no neighbour.
    """
    rows = vectors.withColumn("word_idx", word_of(F.col("id"))).join(allowed, "word_idx").where(has(F.col("word"), F.col("id")))
    asked = queries.join(members, "query_id").select("query_id", "class_id", "embedding")
    return _in_blocks(asked, rows.select("class_id", "id", "embedding"), ["class_id"], k)


def search_after(queries: DataFrame, vectors: DataFrame, passing: DataFrame | str, k: int, factor: int) -> DataFrame:
    """Over-retrieval: the k * factor nearest of all, of which the first k that pass remain.

    What passes is given as pairs (query_id, id), or as a column in which both have to agree: then it is looked up for the near rows
    only, and no query is paired with all vectors of its value.
    """
    near = search_all(queries, vectors, k * factor).select("query_id", "id", "dist")
    if isinstance(passing, str):
        own = near.join(queries.select("query_id", F.col(passing).alias("own")).distinct(), "query_id")
        kept = own.join(vectors.select("id", F.col(passing).alias("own")), ["id", "own"], "left_semi")
    else:
        kept = near.join(passing.select("query_id", "id"), ["query_id", "id"], "left_semi")
    return top(kept.select("query_id", "id", "dist"), k).select("query_id", "rank", "id", "dist")


def recall(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(queries, recall): the mean over all queries of truth of the share of their neighbours that were found.

    Truth has a row (query_id, id) each; ids that are null or negative stand for no neighbour. A query with none adds
    nothing, and still counts as a query.
    """
    real = truth.select("query_id", F.when(F.col("id") >= 0, F.col("id")).alias("id"))
    hit = found.select("query_id", "id").distinct().withColumn("hit", F.lit(1))
    each = real.join(hit, ["query_id", "id"], "left").groupBy("query_id").agg(F.count("id").alias("n"), F.count(F.when(F.col("id").isNotNull(), F.col("hit"))).alias("hits"))
    return each.agg(F.count(F.lit(1)).alias("queries"), (F.sum(F.when(F.col("n") > 0, F.col("hits") / F.col("n")).otherwise(0.0)) / F.count(F.lit(1))).alias("recall"))


def division(requests: DataFrame, tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids that have all of a query's tags: rows (class_id, id) and membership (query_id, class_id).

    ``requests`` (query_id, tag_id), ``tags`` (tag_id, id). Queries that ask for the same tags are one class and are answered once.
    """
    classes, members = request_classes(requests, "tag_id")
    rows = tags.distinct().join(classes, "tag_id").groupBy("class_id", "id").agg(F.count(F.lit(1)).alias("n"), F.any_value("wanted").alias("wanted"))
    return rows.where("n = wanted").select("class_id", "id"), members


def selectivity_bins(requests: DataFrame, tag_sizes: DataFrame, total: Column, bins: list[tuple[str, float, float]]) -> DataFrame:
    """(query_id, bound, bin): a query passes at most its rarest tag's share; the first bin that holds it, in their order."""
    low = requests.join(tag_sizes, "tag_id").groupBy("query_id").agg(F.min("n").alias("n")).select("query_id", (F.col("n") / total).alias("bound"))
    label = F.coalesce(*[F.when((F.col("bound") >= a) & (F.col("bound") < b), F.lit(name)) for name, a, b in bins])
    return low.withColumn("bin", label)


def pareto(curves: DataFrame, by: list[str]) -> DataFrame:
    """Points that no point of at least their recall outruns: the qps is above that of all points before."""
    order = Window.partitionBy(*by).orderBy(F.desc("recall"), F.desc("qps")).rowsBetween(Window.unboundedPreceding, -1)
    return curves.withColumn("best", F.max("qps").over(order)).where("best IS NULL OR qps > best").drop("best")


def _front(curves: DataFrame, by: list[str]) -> DataFrame:
    pairs = Window.partitionBy(*by).orderBy("recall", F.desc("qps"))
    front = pareto(curves, by)
    return front.select(*by, "recall", "qps", F.lead("recall").over(pairs).alias("recall2"), F.lead("qps").over(pairs).alias("qps2"))


def qps_table(curves: DataFrame, by: list[str], recalls: list[float], slack: float = 0.01) -> DataFrame:
    """(*by, target, qps) at several recalls on each front: between neighbours by the logarithm of qps; at an end less than
    ``slack`` away; else null."""
    goal = F.col("target")
    rows = _front(curves, by).withColumn("target", F.explode(F.array(*[F.lit(float(r)) for r in recalls])))
    share = (goal - F.col("recall")) / (F.col("recall2") - F.col("recall"))
    between = F.when((F.col("recall") <= goal) & (F.col("recall2") >= goal), F.when(F.col("recall2") == F.col("recall"), F.greatest("qps", "qps2")).otherwise(F.exp(F.log("qps") + share * (F.log("qps2") - F.log("qps")))))
    out = rows.groupBy(*by, "target").agg(
        F.max(between).alias("inner"), F.min("recall").alias("low"), F.max("recall").alias("high"), F.max_by("qps", "recall").alias("at_high"), F.min_by("qps", "recall").alias("at_low")
    )
    edge = F.when(F.abs(F.col("high") - goal) < slack, F.col("at_high")).when(F.abs(F.col("low") - goal) < slack, F.col("at_low"))
    return out.select(*by, "target", F.coalesce("inner", edge).alias("qps"))


def qps_at(curves: DataFrame, by: list[str], recall_: float, slack: float = 0.01) -> DataFrame:
    """``qps_table`` of one recall."""
    return qps_table(curves, by, [recall_], slack).drop("target")


def side_by_side(curves: DataFrame, systems: list[str], recall_: float) -> DataFrame:
    """(bin, a column of QPS at the recall for each of ``systems``) of curves (system, bin, recall, qps)."""
    return qps_at(curves.where(F.col("system").isin(systems)), ["system", "bin"], recall_).groupBy("bin").pivot("system", systems).agg(F.max("qps"))


def recall_at(curves: DataFrame, by: list[str], qps_: float) -> DataFrame:
    """Recall at a QPS on each front, linearly between neighbours; null outside of it."""
    share = (F.lit(qps_) - F.col("qps")) / (F.col("qps2") - F.col("qps"))
    between = F.when((F.col("qps") >= qps_) & (F.col("qps2") <= qps_), F.when(F.col("qps2") == F.col("qps"), F.greatest("recall", "recall2")).otherwise(F.col("recall") + share * (F.col("recall2") - F.col("recall"))))
    return _front(curves, by).groupBy(*by).agg(F.max(between).alias("recall"))
