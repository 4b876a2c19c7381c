"""Queries that write files of each layout and read them back, and one that drains a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import containers, ingest, search
from ..sources import binary, portable, results
from ..sources.storage import new_folder
from ..streaming.words import drained, stream_words
from .catalogue import query
from .queries_use import _PAIRS, _asked, _ranked, _vectors
from .tables import EVENTS, REQUESTS, TAGS, WORDS, event_members, events_sql, part_tags, tag_requests


@query("source_tags", f"WITH {TAGS} SELECT tag_id, id FROM t")
def source_tags(spark, d):
    folder = new_folder(spark, "tags")
    binary.write_tags(part_tags(spark, d), folder)
    return binary.read(spark, "tags", folder)


@query("source_queries", f"WITH {REQUESTS} SELECT (dense_rank() OVER (ORDER BY query_id) - 1)::BIGINT AS query_id, tag_id FROM (SELECT DISTINCT * FROM q)")
def source_queries(spark, d):
    return binary.read(spark, "queries", binary.write_queries(tag_requests(spark, d), new_folder(spark, "queries")))


@query("source_sparse", f"WITH {TAGS} SELECT id AS row, tag_id AS col, (tag_id % 7)::FLOAT AS value FROM t")
def source_sparse(spark, d):
    cells = part_tags(spark, d).select(F.col("id").alias("row"), F.col("tag_id").alias("col"), (F.col("tag_id") % 7).cast("float").alias("value"))
    rows = cells.agg(F.max("row")).first()[0] + 1
    return binary.read(spark, "sparse", binary.write_sparse(cells, new_folder(spark, "sparse"), "parts.spmat", rows, 1000))


@query("source_vectors", "SELECT (row_number() OVER (ORDER BY vec_id) - 1)::BIGINT AS id, array_to_string(list_transform(embedding, lambda x: (floor(x * 1000)::BIGINT)::VARCHAR), ',') AS vector FROM embeddings")
def source_vectors(spark, d):
    rows = _vectors(spark, d).select("id", F.col("embedding").alias("vector"))
    found = binary.read(spark, "f32", binary.write_vectors(rows, new_folder(spark, "vectors"), "all.fbin", "f32"))
    return found.select("id", F.array_join(F.transform("vector", lambda x: F.floor(x * F.lit(1000).cast("float")).cast("string")), ",").alias("vector"))


@query("source_truth", f"WITH {_PAIRS}, {_ranked('p WHERE same', 10, 'x')} SELECT (dense_rank() OVER (ORDER BY query_id) - 1)::BIGINT AS query_id, rank, id FROM x")
def source_truth(spark, d):
    found = search.search_within(_asked(spark, d), _vectors(spark, d), "label", 10)
    return binary.read(spark, "truth", binary.write_truth(found, new_folder(spark, "truth"), 10)).where(F.col("id") < 2**32 - 1)


@query("source_portable", f"WITH {events_sql()} SELECT DISTINCT filter_id, id FROM m")
def source_portable(spark, d):
    return containers.members(portable.parse(portable.serialise(containers.build(event_members(spark, d)))))


@query("stream_words", f"WITH {events_sql()}, {WORDS} SELECT * FROM w")
def stream_of_events(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return drained(stream_words(stream, F.col("event_id"), {n: F.expr(p) for n, p in EVENTS.items()}))


@query("stream_matches_batch", f"WITH {events_sql()}, {WORDS} SELECT filter_id, word_idx, word AS by_batch, word AS by_stream FROM w")
def stream_matches_batch(spark, d):
    batch = ingest.to_words(event_members(spark, d)).withColumnRenamed("word", "by_batch")
    return batch.join(stream_of_events(spark, d).withColumnRenamed("word", "by_stream"), ["filter_id", "word_idx"], "full")


_RESULTS = "SELECT c_custkey AS run, c_mktsegment AS system, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS qps, CASE WHEN c_custkey % 5 = 0 THEN 'a, \"b\"' ELSE c_name END AS note FROM customer"


def _results(spark, d):
    note = F.when(F.col("c_custkey") % 5 == 0, F.lit('a, "b"')).otherwise(F.col("c_name"))
    rows = spark.read.parquet(f"{d}/customer.parquet")
    return rows.select(F.col("c_custkey").alias("run"), F.col("c_mktsegment").alias("system"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("qps"), note.alias("note"))


for _kind in results.FORMATS:

    @query(f"source_results_{_kind}", _RESULTS)
    def source_results(spark, d, kind=_kind):
        rows = _results(spark, d)
        return results.read_results(spark, results.write_results(rows, new_folder(spark, "results"), kind), rows._jdf.schema().toDDL(), kind)
