"""Helpers that the operators of this package share: the cluster's shared folder, written tables, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A temporary folder stands in where that is unset and the master is local, as in tests; on a cluster it is an error,
    as each machine would have a folder of its own.
    """
    global _own_dir
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="sievespark-")
    return _own_dir


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/sievespark-{name}-{uuid.uuid4().hex}"


#: Bytes of a batch of texts on its way to Python.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches are bounded: by BATCH_BYTES where the user has set no bound.

    Ten thousand long texts would else be one batch, several copies of which are in memory on both sides. The bound is
    read when a lazy result runs, so it stays with the session; a user's own setting is left as it is.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not df.sparkSession._jsparkSession.sessionState().conf().contains(key):
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df


def fresh(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read from there: the lineage ends here, a lost executor costs nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sieve_path = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes the table that ``written`` made, once nothing reads it any more."""
    path = getattr(df, "_sieve_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b: long): rows (node, root), root the smallest node reachable.

    Alternates large-star and small-star (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014) until
    nothing changes, which takes rounds by the logarithm of the nodes. Each step is an aggregate, whose partial sums keep
    a node of many edges out of a single task; it is written before the join with it, so that adaptive execution
    can split that node's edges there too. Every round is written, so lineage stays short. Nothing is collected but two numbers
    a round. Self loops and repeated edges do no harm; nodes without an edge to another node get no row.
    """
    big, small = F.greatest("a", "b"), F.least("a", "b")
    now = written(edges.where("a <> b").select(big.alias("u"), small.alias("v")).distinct(), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = written(both.where("v > u").join(first, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        second = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        star = large.join(second, "u")
        new = star.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(star.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = written(new, "edges")
        seen = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for gone in (now, first, large, second):
            drop(gone)
        now = new
        if tuple(seen) == state:
            break
        state = tuple(seen)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
