"""The sets that the registered queries use, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest

#: Predicates on lines; the same text serves both engines.
LINES = {
    "R": "l_returnflag = 'R'", "A": "l_returnflag = 'A'", "N": "l_returnflag = 'N'", "O": "l_linestatus = 'O'", "cheap": "l_extendedprice < 30000",
    "few": "l_quantity < 25", "cut": "l_discount > 0.05", "tax": "l_tax < 0.04", "late": "l_shipdate >= TIMESTAMP '1996-01-01'", "most": "l_linenumber < 7",
    "none": "l_quantity < 0",
}
LINE_ID = "l_orderkey * 8 + l_linenumber"
#: Predicates on events: dense and sparse ids, one of them nearly all.
EVENTS = {"click": "event_type = 'click'", "other": "event_type <> 'click'", "high": "value > 50", "early": "event_id < 2000", "third": "event_id % 3 = 0", "all": "event_id >= 0"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _expr(sql: str) -> Column:
    return F.expr(sql.replace("TIMESTAMP '", "TIMESTAMP_NTZ '"))


def line_predicates(*names: str) -> dict[str, Column]:
    return {n: _expr(LINES[n]) for n in names or LINES}


def line_members(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """(filter_id, id), ids repeated as in the table: orders hold several lines of a number."""
    return ingest.from_predicates(table(spark, sf_dir, "lineitem"), F.expr(LINE_ID), line_predicates(*names))


def line_words(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    return ingest.predicate_words(table(spark, sf_dir, "lineitem"), F.expr(LINE_ID), line_predicates(*names))


def line_universe(spark: SparkSession, sf_dir: str) -> int:
    return ((table(spark, sf_dir, "lineitem").agg(F.max("l_orderkey")).first()[0] or 0) + 1) * 8


def event_members(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    return ingest.from_predicates(table(spark, sf_dir, "events"), F.col("event_id"), {n: F.expr(EVENTS[n]) for n in names or EVENTS})


def event_words(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    return ingest.predicate_words(table(spark, sf_dir, "events"), F.col("event_id"), {n: F.expr(EVENTS[n]) for n in names or EVENTS})


def event_universe(spark: SparkSession, sf_dir: str) -> int:
    return (table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] or 0) + 1


def part_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tag_id, id): parts by brand, type and size, as numbers."""
    parts = table(spark, sf_dir, "part")
    tag = F.expr("array(cast(regexp_extract(p_brand, '([0-9]+)', 1) AS bigint), 100 + length(p_type), 200 + cast(p_size AS bigint))")
    return parts.select(F.explode(tag).alias("tag_id"), F.col("p_partkey").alias("id")).distinct()


def tag_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, tag_id): an order line asks for its part's brand and, for every other order, its size."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_custkey").alias("k"))
    tag = F.expr("filter(array(11 + (k % 5) * 10 + (k div 5) % 5, CASE WHEN k % 2 = 0 THEN 201 + k % 50 END), x -> x IS NOT NULL)")
    return orders.select("query_id", F.explode(tag).alias("tag_id"))


def _members(table_: str, id_: str, predicates: dict[str, str], names: tuple[str, ...]) -> str:
    cases = ", ".join(f"CASE WHEN {predicates[n]} THEN '{n}' END" for n in names or predicates)
    return f"m AS (SELECT filter_id, id FROM (SELECT ({id_})::BIGINT AS id, unnest([{cases}]) AS filter_id FROM {table_}) WHERE filter_id IS NOT NULL)"


def lines_sql(*names: str) -> str:
    """CTE m (filter_id, id)."""
    return _members("lineitem", LINE_ID, LINES, names)


def events_sql(*names: str) -> str:
    return _members("events", "event_id", EVENTS, names)


#: CTEs over m: words, sizes of containers with their runs and their encoding, the universes.
WORDS = "w AS (SELECT filter_id, id // 32 AS word_idx, bit_or(1::BIGINT << (id % 32)::INTEGER) AS word FROM m GROUP BY ALL)"
RUNS = """r AS (SELECT filter_id, key, min(low) AS start, count(*) - 1 AS length FROM (
  SELECT filter_id, id >> 16 AS key, id & 65535 AS low, (id & 65535) - row_number() OVER (PARTITION BY filter_id, id >> 16 ORDER BY id) AS island
  FROM (SELECT DISTINCT filter_id, id FROM m)) GROUP BY filter_id, key, island)"""
SIZES = """c AS (SELECT filter_id, key, card, n_runs, CASE WHEN 2 + 4 * n_runs < least(8192, 2 * card + 2) THEN 'RUN' WHEN card > 4096 THEN 'BITMAP' ELSE 'ARRAY' END AS ctype
  FROM (SELECT filter_id, key, sum(length + 1)::BIGINT AS card, count(*) AS n_runs FROM r GROUP BY ALL))"""
LINE_U = "u AS (SELECT ((max(l_orderkey) + 1) * 8)::BIGINT AS u FROM lineitem)"
EVENT_U = "u AS (SELECT (max(event_id) + 1)::BIGINT AS u FROM events)"
TAGS = """t AS (SELECT DISTINCT unnest([regexp_extract(p_brand, '([0-9]+)', 1)::BIGINT, 100 + length(p_type), 200 + p_size]) AS tag_id, p_partkey AS id FROM part)"""
REQUESTS = """q AS (SELECT query_id, tag_id FROM (SELECT o_orderkey AS query_id, unnest([11 + (o_custkey % 5) * 10 + (o_custkey // 5) % 5, CASE WHEN o_custkey % 2 = 0 THEN 201 + o_custkey % 50 END]) AS tag_id FROM orders) WHERE tag_id IS NOT NULL)"""
