"""Mixing sources to target weights: hash-random keys, a range sort within each source, prefix sums, an exact cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import WORD, fresh, text_or_empty, written

WEIGHTS = (1, 2, 3)
CAP = 3.0
SEED = 17
#: Hex digits of the key that make a range: 16**3 ranges a source, each a few hundred thousand rows at 10 billion.
DIGITS = 3


def targets(sizes: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """(sk, source_size) with one row a source to (sk, source_size, weight, target).

    Sources in the order of ``sk`` weigh ``weights``, repeating, and share the sum of all sizes. A target stops at
    ``cap`` times its source's size and the excess is shared again by weight until none is above: the level is the
    largest that stays at or below the ratio of cap to weight from some source on, in the order of those ratios.
    The windows without a partition run over one row a source, after aggregation.
    """
    turn = F.array(*[F.lit(float(w)) for w in weights])
    whole = Window.partitionBy()
    listed = sizes.withColumn("weight", F.element_at(turn, ((F.row_number().over(Window.orderBy("sk")) - 1) % len(weights) + 1).cast("int")))
    listed = listed.withColumn("cap", F.col("source_size") * F.lit(cap)).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", "sk")
    capped = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    listed = listed.withColumn("level", (F.sum("source_size").over(whole) - capped) / left)
    listed = listed.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(whole))
    # no source is at its cap's edge only where all sizes are zero or the caps do not reach the sum
    return listed.select("sk", "source_size", "weight", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def mix(rows: DataFrame, weights=WEIGHTS, cap: float = CAP, seed: int = SEED, digits: int = DIGITS) -> DataFrame:
    """Rows (doc_id, source, size) to (doc_id, source, key, tie, size, source_size, target, taken, epochs, whole).

    ``taken``: the words that the mix takes of the document, repeats counted. A source's target, rounded to whole words,
    is its budget: each full epoch takes all of its documents, and the last one goes through them in the order of
    their keys, md5(seed:doc_id), and cuts inside the document where the budget ends, so that a source's sum is
    exactly its budget. ``epochs``: full passes; ``whole``: passes that begin in the document (it is taken so often by
    those who keep documents whole).

    Prefix sums are distributed: ranges of the key give bounded groups within each source, sums of ranges (partial sums
    per task) give each range's base, and only the rows of one range are ordered together. A source of a third of all
    rows so spreads over 16**digits groups. Size null or negative counts as 0, source null is a source of its own
    and comes last, repeated rows are documents of their own, and doc_id null has the key of an empty id. Rows of one key
    are ordered by a column ``tie`` (long), where there is one, and by size. A table without rows gives none; other columns
    are not read.
    """
    sk = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    size = F.greatest(F.coalesce(F.col("size").cast("long"), F.lit(0)), F.lit(0)).cast("long")
    tie = F.col("tie").cast("long") if "tie" in rows.columns else F.lit(0).cast("long")
    narrow = written(rows.select("doc_id", "source", sk.alias("sk"), key.alias("key"), tie.alias("tie"), size.alias("size")), "mix")
    # rows of one key, as those without doc_id, are parted by their ties
    narrow = narrow.withColumn("part", F.concat(F.substring("key", 1, digits), F.when(F.col("doc_id").isNull(), F.lpad(F.hex(F.col("tie").bitwiseXOR(F.lit(-(2**63)))), 16, "0").substr(1, digits)).otherwise(F.lit(""))))
    sums = narrow.groupBy("sk", "part").agg(F.sum("size").alias("part_size"))
    shares = targets(sums.groupBy("sk").agg(F.sum("part_size").alias("source_size")), weights, cap)
    earlier = Window.partitionBy("sk").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("sk", "part", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)).alias("base"))
    bases = bases.join(shares, "sk")
    within = Window.partitionBy("sk", "part").orderBy("key", "tie", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = narrow.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).join(bases, ["sk", "part"])
    budget, total = F.round("target").cast("long"), F.greatest(F.col("source_size"), F.lit(1))
    out = out.withColumn("before", F.col("base") + F.col("inside")).withColumn("epochs", F.expr("cast(round(target) AS bigint) div greatest(source_size, 1L)")).withColumn("rest", budget % total)
    last = F.least(F.greatest(F.col("rest") - F.col("before"), F.lit(0)), F.col("size"))
    return out.select(
        "doc_id", "source", "key", "tie", "size", F.col("source_size").cast("long").alias("source_size"), "target",
        (F.col("epochs") * F.col("size") + last).cast("long").alias("taken"), "epochs",
        (F.col("epochs") + (F.col("before") < F.col("rest")).cast("long")).alias("whole"),
    )


def mix_documents(docs: DataFrame, weights=WEIGHTS, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """The mixed documents themselves, whole: each as often as passes begin in it, with the columns of ``docs``.

    Only narrow rows are ordered. Texts stay where they are: one row a source says up to which key, and among rows of one
    doc_id up to which hash of the row, its last pass goes. Rows equal in all of their columns are interchangeable:
    of those that the cut falls on, as many are given as the pass begins in.

    Text null or empty has size 0 and is taken with the full passes and before the cut; source null is a source of its
    own; doc_id null has the key of an empty id; a table without rows gives none. Columns keep their names and values.
    """
    plain = [c for c in docs.columns if not any(t in docs.schema[c].dataType.simpleString() for t in ("map<", "variant"))]
    tie = F.xxhash64(*plain)
    size = F.regexp_count(text_or_empty(), F.lit(WORD))
    plan = mix(docs.select("doc_id", "source", size.alias("size"), tie.alias("tie")), weights, cap, seed)
    epochs, most, at, tied, begun, rows, source = (fresh(docs.columns, f"__{c}") for c in ("epochs", "most", "at", "tied", "begun", "rows", "source"))
    groups = plan.groupBy("source", "key", "tie").agg(F.max("epochs").alias("epochs"), F.sum(F.col("whole") - F.col("epochs")).alias("begun"), F.count(F.lit(1)).alias("rows"))
    cuts = groups.groupBy("source").agg(F.max("epochs").alias(epochs), F.max(F.when(F.col("begun") > 0, F.struct("key", "tie", "begun", "rows"))).alias("c"))
    cuts = cuts.select(F.col("source").alias(source), epochs, F.col("c.key").alias(at), F.col("c.tie").alias(tied), F.col("c.begun").alias(begun), F.col("c.rows").alias(rows))
    cuts = written(cuts, "cuts")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    # one row a source; adaptive execution sends it round where it is small and joins by shuffle where it is not
    out = docs.join(cuts, docs["source"].eqNullSafe(cuts[source]))
    on_cut = F.coalesce((key == F.col(at)) & (tie == F.col(tied)), F.lit(False))
    before = F.coalesce((key < F.col(at)) | ((key == F.col(at)) & (tie < F.col(tied))), F.lit(False))

    def repeated(some: DataFrame, times: Column) -> DataFrame:
        some = some.withColumn(most, times).where(F.col(most) > 0)
        return some.withColumn(most, F.explode(F.sequence(F.lit(1).cast("long"), F.col(most)))).select(*docs.columns)

    split = repeated(out.where(~on_cut | (F.col(begun) == F.col(rows))), F.col(epochs) + (before | on_cut).cast("long"))
    whole = F.any_value(F.struct(*[F.col(c) for c in docs.columns])).alias(most)
    last = out.where(on_cut & (F.col(begun) < F.col(rows))).groupBy(source).agg(whole, F.any_value(epochs).alias(epochs), F.any_value(begun).alias(begun), F.any_value(rows).alias(rows))
    times = F.col(epochs) * F.col(rows) + F.col(begun)
    copies = last.select(F.col(f"{most}.*"), times.alias(epochs)).where(F.col(epochs) > 0)
    return split.unionByName(copies.withColumn(epochs, F.explode(F.sequence(F.lit(1).cast("long"), F.col(epochs)))).select(*docs.columns))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "source", F.regexp_count(text_or_empty(), F.lit(WORD)).alias("size"))
    return mix(rows).select("doc_id", "size", "source_size", "target", "taken")
