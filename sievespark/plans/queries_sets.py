"""Queries on building, combining and complementing sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import policy
from ..operators import algebra, containers, export, ingest
from .catalogue import query
from .expr import Filter, evaluate, rewrite
from .tables import EVENT_U, LINE_ID, LINE_U, RUNS, SIZES, WORDS, event_members, event_universe, event_words, events_sql, line_members, line_predicates, line_universe, line_words, lines_sql, table

# -- building


@query("upload_ids_distinct", f"WITH {lines_sql('R', 'A', 'N')} SELECT DISTINCT filter_id, id FROM m")
def upload_ids_distinct(spark, d):
    lines = table(spark, d, "lineitem")
    return ingest.from_ids(lines, F.col("l_returnflag"), F.expr(LINE_ID), line_universe(spark, d))


@query("upload_words", f"WITH {lines_sql('R')}, {WORDS} SELECT word_idx, word FROM w")
def upload_words(spark, d):
    return line_words(spark, d, "R").select("word_idx", "word")


@query("upload_batch_words", f"WITH {lines_sql()}, {WORDS} SELECT * FROM w")
def upload_batch_words(spark, d):
    return line_words(spark, d)


@query(
    "upload_catalog",
    f"""WITH {lines_sql()}, {LINE_U}, n AS (SELECT filter_id, count(DISTINCT id) AS cardinality FROM m GROUP BY 1)
SELECT filter_id, u AS universe, cardinality > u // 2 AS negated, cardinality, CASE WHEN cardinality > u // 2 THEN u - cardinality ELSE cardinality END AS stored FROM n, u""",
)
def upload_catalog(spark, d):
    return ingest.word_catalog(line_words(spark, d), line_universe(spark, d))


@query("density_decision", f"WITH {events_sql()}, {EVENT_U} SELECT filter_id, count(DISTINCT id) > any_value(u) // 2 AS negated FROM m, u GROUP BY 1")
def density_decision(spark, d):
    return ingest.word_catalog(event_words(spark, d), event_universe(spark, d)).select("filter_id", "negated")


@query("upload_inferred_universe", f"WITH {lines_sql()} SELECT filter_id, ((max(id >> 16) + 1) << 16)::BIGINT AS universe FROM m GROUP BY 1")
def upload_inferred_universe(spark, d):
    return ingest.inferred_universe(line_members(spark, d))


@query("upload_from_words", f"WITH {lines_sql('O', 'few')} SELECT filter_id, (id >> 16)::INTEGER AS key, count(DISTINCT id) AS card FROM m GROUP BY ALL")
def upload_from_words(spark, d):
    return ingest.chunks(ingest.from_words(line_words(spark, d, "O", "few"), line_universe(spark, d)))


# -- containers


@query("container_types", f"WITH {lines_sql()}, {RUNS}, {SIZES} SELECT filter_id, key::INTEGER AS key, card::INTEGER AS card, n_runs::INTEGER AS n_runs, ctype FROM c")
def container_types(spark, d):
    return containers.typed_words(line_words(spark, d)).drop("n_words")


@query("container_runs", f"WITH {events_sql()}, {RUNS} SELECT filter_id, key::INTEGER AS key, start::INTEGER AS start, length::INTEGER AS length FROM r")
def container_runs(spark, d):
    return containers.word_runs(event_words(spark, d))


@query(
    "container_arrays",
    f"""WITH {events_sql('click', 'early', 'third')}, {RUNS}, {SIZES}
SELECT c.filter_id, c.key::INTEGER AS key, string_agg((id & 65535)::VARCHAR, ',' ORDER BY id) AS lows
FROM c JOIN (SELECT DISTINCT filter_id, id FROM m) m ON c.filter_id = m.filter_id AND c.key = m.id >> 16 WHERE ctype = 'ARRAY' GROUP BY ALL""",
)
def container_arrays(spark, d):
    held = containers.build_words(event_words(spark, d, "click", "early", "third")).where("ctype = 'ARRAY'")
    return held.select("filter_id", "key", F.array_join("arr", ",").alias("lows"))


@query(
    "container_thresholds",
    f"""WITH {lines_sql()}, {RUNS}, {SIZES} SELECT t::INTEGER AS threshold, CASE WHEN t = 4096 THEN ctype WHEN card > t THEN 'BITMAP' ELSE 'ARRAY' END AS kind, count(*) AS n
FROM c, (SELECT unnest([0, 100, 4096, 8000]) AS t) GROUP BY ALL""",
)
def container_thresholds(spark, d):
    found = containers.word_sizes(line_words(spark, d))
    kinds = [F.struct(F.lit(t).alias("threshold"), policy.encoding(F.col("card"), F.col("n_runs"), t).alias("kind")) for t in (0, 100, 4096, 8000)]
    return found.select(F.explode(F.array(*kinds)).alias("k")).groupBy("k.threshold", "k.kind").agg(F.count(F.lit(1)).alias("n"))


_META = """count(*) AS n_containers, count(*) FILTER (ctype = 'ARRAY') AS n_array, count(*) FILTER (ctype = 'BITMAP') AS n_bitmap, count(*) FILTER (ctype = 'RUN') AS n_run,
 sum(card)::BIGINT AS cardinality, sum(9 + CASE ctype WHEN 'BITMAP' THEN 8192 WHEN 'ARRAY' THEN 2 * card ELSE 4 * n_runs END)::BIGINT AS bytes"""


@query("filter_meta", f"WITH {lines_sql()}, {RUNS}, {SIZES} SELECT filter_id, {_META} FROM c GROUP BY 1")
def filter_meta(spark, d):
    return containers.meta(containers.typed_words(line_words(spark, d)))


@query("promote_meta", f"WITH {events_sql()}, {RUNS}, {SIZES}, p AS (SELECT filter_id, card, n_runs, 'BITMAP' AS ctype FROM c) SELECT filter_id, {_META} FROM p GROUP BY 1")
def promote_meta(spark, d):
    return containers.meta(containers.promote(containers.build_words(event_words(spark, d))))


@query("promote_roundtrip", f"WITH {events_sql()} SELECT DISTINCT filter_id, id FROM m")
def promote_roundtrip(spark, d):
    return containers.members(containers.promote(containers.build_words(event_words(spark, d))))


@query("encode_roundtrip", f"WITH {events_sql()} SELECT DISTINCT filter_id, id FROM m")
def encode_roundtrip(spark, d):
    return containers.members(containers.build_words(event_words(spark, d)))


@query(
    "auto_threshold_table",
    """SELECT u AS universe, l AS cache_bytes, CASE WHEN u > 0 AND (u + 7) // 8 * 2 > l THEN 0 ELSE 4096 END AS threshold, u // 65536 * 8192 * 2 < (u + 7) // 8 AS promotes
FROM (SELECT unnest([0, 1000000, 10000000, 100000000, 1000000000]::BIGINT[]) AS u), (SELECT unnest([4194304, 100663296]::BIGINT[]) AS l)""",
)
def auto_threshold_table(spark, d):
    rows = spark.createDataFrame([(u, c) for u in (0, 10**6, 10**7, 10**8, 10**9) for c in (4 << 20, 96 << 20)], "universe long, cache_bytes long")
    threshold = policy.auto_threshold_of(F.col("universe"), F.col("cache_bytes"))
    return rows.select("universe", "cache_bytes", threshold.alias("threshold"), policy.promotes(F.floor(F.col("universe") / 65536), F.col("universe")).alias("promotes"))


@query("promote_auto_meta", f"WITH {events_sql()}, {RUNS}, {SIZES}, g AS (SELECT unnest([1000, 1000000]) AS cache_bytes), {EVENT_U}, p AS (SELECT filter_id, cache_bytes, card, n_runs, CASE WHEN u > 0 AND (u + 7) // 8 * 2 > cache_bytes THEN 'BITMAP' ELSE ctype END AS ctype FROM c, g, u) SELECT cache_bytes::INTEGER AS cache_bytes, filter_id, {_META} FROM p GROUP BY ALL")
def promote_auto_meta(spark, d):
    """Bitmaps where a flat bitset would outgrow the cache, the format's own encodings where it would not."""
    held, universe = containers.build_words(event_words(spark, d)), event_universe(spark, d)
    parts = [containers.meta(containers.promote_auto(held, universe, cache)).withColumn("cache_bytes", F.lit(cache)) for cache in (1000, 1000000)]
    return parts[0].unionByName(parts[1]).select("cache_bytes", *parts[0].columns[:-1])


@query("build_auto_meta", f"WITH {events_sql()}, {RUNS}, {SIZES}, g AS (SELECT unnest([131072, 10000000]::BIGINT[]) AS u), n AS (SELECT filter_id, count(*) AS n FROM c GROUP BY 1), p AS (SELECT filter_id, u, card, n_runs, CASE WHEN (u + 7) // 8 * 2 > 1000 AND n * 16384 < (u + 7) // 8 THEN 'BITMAP' ELSE ctype END AS ctype FROM c JOIN n USING (filter_id), g) SELECT u AS universe, filter_id, {_META} FROM p GROUP BY ALL")
def build_auto_meta(spark, d):
    """The guard: in the smaller universe bitmaps would take as much as the flat bitset."""
    rows = event_members(spark, d)
    parts = [containers.meta(containers.build_auto(rows, u, 1000)).withColumn("universe", F.lit(u).cast("long")) for u in (131072, 10000000)]
    return parts[0].unionByName(parts[1]).select("universe", *parts[0].columns[:-1])


# -- pairs of sets


def _pair_sql(op: str) -> str:
    word = {"and": "a & b", "or": "a | b", "andnot": "a & ~b & 4294967295", "xor": "xor(a, b)"}[op]
    return f"""WITH {lines_sql('R', 'few')}, {WORDS}, p AS (SELECT word_idx, coalesce(max(word) FILTER (filter_id = 'R'), 0) AS a, coalesce(max(word) FILTER (filter_id = 'few'), 0) AS b FROM w GROUP BY 1)
SELECT word_idx, {word} AS word FROM p WHERE ({word}) <> 0"""


def _ids_sql(op: str) -> str:
    a, b = ("SELECT id FROM m WHERE filter_id = '%s'" % n for n in ("R", "few"))
    both = {"and": f"({a}) INTERSECT ({b})", "or": f"({a}) UNION ({b})", "andnot": f"({a}) EXCEPT ({b})", "xor": f"(({a}) EXCEPT ({b})) UNION (({b}) EXCEPT ({a}))"}[op]
    return f"WITH {lines_sql('R', 'few')} {both}"


for _op in algebra.OPS:

    @query(f"set_{_op}", _pair_sql(_op))
    def set_words(spark, d, op=_op):
        return algebra.pairwise(op, line_words(spark, d, "R"), line_words(spark, d, "few"))

    @query(f"set_{_op}_ids", _ids_sql(_op))
    def set_ids(spark, d, op=_op):
        rows = line_members(spark, d, "R", "few")
        return algebra.pairwise_ids(op, *(rows.where(F.col("filter_id") == n).select("id") for n in ("R", "few")))


@query("set_arrays_and", f"WITH {events_sql('click', 'high')}, {RUNS}, {SIZES}, a AS (SELECT DISTINCT m.filter_id, id FROM m JOIN c ON m.filter_id = c.filter_id AND c.key = id >> 16 WHERE ctype = 'ARRAY') SELECT (x.id >> 16)::INTEGER AS key, (x.id & 65535)::INTEGER AS low FROM a x JOIN a y ON x.id = y.id AND x.filter_id = 'click' AND y.filter_id = 'high'")
def set_arrays_and(spark, d):
    held = containers.build_words(event_words(spark, d, "click", "high"))
    return containers.arrays_and(*(held.where(F.col("filter_id") == n) for n in ("click", "high")))


@query("set_array_with_any", f"WITH {events_sql('click', 'other', 'early')}, {RUNS}, {SIZES}, a AS (SELECT DISTINCT id FROM m JOIN c ON m.filter_id = c.filter_id AND c.key = id >> 16 WHERE ctype = 'ARRAY' AND m.filter_id = 'click') SELECT filter_id AS other, (a.id >> 16)::INTEGER AS key, (a.id & 65535)::INTEGER AS low FROM a JOIN (SELECT DISTINCT * FROM m WHERE filter_id <> 'click') b ON a.id = b.id")
def set_array_with_any(spark, d):
    held = containers.build_words(event_words(spark, d, "click", "other", "early"))
    click = held.where("filter_id = 'click'")
    parts = [containers.array_with(click, held.where(F.col("filter_id") == n)).select(F.lit(n).alias("other"), "key", "low") for n in ("other", "early")]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("set_runs_and", f"WITH {events_sql('early', 'other')}, {RUNS} SELECT x.key::INTEGER AS key, greatest(x.start, y.start)::INTEGER AS start, (least(x.start + x.length, y.start + y.length) - greatest(x.start, y.start))::INTEGER AS length FROM r x JOIN r y ON x.key = y.key AND x.start <= y.start + y.length AND y.start <= x.start + x.length WHERE x.filter_id = 'early' AND y.filter_id = 'other'")
def set_runs_and(spark, d):
    found = containers.word_runs(event_words(spark, d, "early", "other"))
    return containers.runs_and(*(found.where(F.col("filter_id") == n) for n in ("early", "other")))


@query("set_universe", f"WITH {LINE_U.replace('u AS', 'x AS')}, {EVENT_U.replace('u AS', 'y AS')} SELECT greatest(x.u, y.u) AS universe FROM x, y")
def set_universe(spark, d):
    return spark.createDataFrame([(line_universe(spark, d),), (event_universe(spark, d),)], "universe long").agg(F.max("universe").alias("universe"))


def _demorgan_sql() -> str:
    parts = []
    for op, sign in (("and", "INTERSECT"), ("or", "UNION"), ("andnot", "EXCEPT"), ("xor", "XOR")):
        for a in (False, True):
            for b in (False, True):
                sides = [f"(SELECT id FROM every EXCEPT SELECT id FROM m WHERE filter_id = '{n}')" if neg else f"(SELECT id FROM m WHERE filter_id = '{n}')" for n, neg in (("R", a), ("O", b))]
                both = f"(({sides[0]} EXCEPT {sides[1]}) UNION ({sides[1]} EXCEPT {sides[0]}))" if sign == "XOR" else f"({sides[0]} {sign} {sides[1]})"
                parts.append(f"SELECT '{op}' AS op, {str(a).lower()} AS left_negated, {str(b).lower()} AS right_negated, count(DISTINCT id) AS cardinality FROM {both}")
    return f"WITH {lines_sql('R', 'O')}, {LINE_U}, every AS (SELECT unnest(range(u)) AS id FROM u) " + " UNION ALL ".join(parts)


@query("demorgan_16", _demorgan_sql())
def demorgan_16(spark, d):
    words, universe = line_words(spark, d, "R", "O"), line_universe(spark, d)
    wide = words.groupBy("word_idx").agg(*[F.coalesce(F.bit_or(F.when(F.col("filter_id") == n, F.col("word"))), F.lit(0)).cast("long").alias(n) for n in ("R", "O")])
    counts, labels = [], []
    for op in algebra.OPS:
        for a in (False, True):
            for b in (False, True):
                stored, swap, negated = rewrite(op, a, b)
                sides = (F.col("O"), F.col("R")) if swap else (F.col("R"), F.col("O"))
                n = F.coalesce(F.sum(F.bit_count(algebra.combine(stored, *sides).bitwiseAND(4294967295))), F.lit(0)).cast("long")
                counts.append((F.lit(universe) - n if negated else n).cast("long").alias(f"n{len(labels)}"))
                labels.append((op, a, b))
    one = wide.agg(*counts)
    rows = [F.struct(F.lit(op).alias("op"), F.lit(a).alias("left_negated"), F.lit(b).alias("right_negated"), F.col(f"n{k}").alias("cardinality")) for k, (op, a, b) in enumerate(labels)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


@query(
    "expression",
    f"""WITH {lines_sql()}, {LINE_U}, every AS (SELECT unnest(range(u)) AS id FROM u)
SELECT id FROM every WHERE NOT ((id IN (SELECT id FROM m WHERE filter_id = 'R') AND NOT id IN (SELECT id FROM m WHERE filter_id = 'O'))
 OR (id IN (SELECT id FROM m WHERE filter_id = 'cut') <> NOT id IN (SELECT id FROM m WHERE filter_id = 'few')))""",
)
def expression(spark, d):
    tree = ~((Filter("R") & ~Filter("O")) | (Filter("cut") ^ ~Filter("few")))
    return export.enumerate_ids(evaluate(line_words(spark, d, "R", "O", "cut", "few"), tree, line_universe(spark, d)))


# -- many sets


def _and_sql(*names: str) -> str:
    return f"WITH {lines_sql(*names)} " + " INTERSECT ".join(f"(SELECT id FROM m WHERE filter_id = '{n}')" for n in names)


@query("multi_and_3", _and_sql("R", "O", "few"))
def multi_and_3(spark, d):
    """All three predicates are of one table: one scan, one shuffle of words, no join."""
    wide = ingest.wide_words(table(spark, d, "lineitem"), F.expr(LINE_ID), line_predicates("R", "O", "few"))
    word = reduce(lambda a, b: a.bitwiseAND(b), [F.col(n) for n in ("R", "O", "few")])
    return export.enumerate_ids(wide.select("word_idx", word.alias("word")).where("word <> 0"))


_EIGHT = ("R", "O", "few", "cut", "tax", "late", "most", "cheap")


@query("multi_and_8", _and_sql(*_EIGHT))
def multi_and_8(spark, d):
    return export.enumerate_ids(algebra.multi_and(line_words(spark, d, *_EIGHT), _EIGHT))


@query("multi_and_chain", _and_sql("R", "O", "few", "cut"))
def multi_and_chain(spark, d):
    return export.enumerate_ids(algebra.multi_and_chain(line_words(spark, d, "R", "O", "few", "cut"), ["R", "O", "few", "cut"]))


@query("multi_and_subset", _and_sql("cut", "few"))
def multi_and_subset(spark, d):
    """Of a batch of all sets, two are named, one of them twice."""
    return export.enumerate_ids(algebra.multi_and(line_words(spark, d), ["cut", "few", "cut"]))


@query("multi_and_empty", _and_sql("R", "none"))
def multi_and_empty(spark, d):
    return export.enumerate_ids(algebra.multi_and(line_words(spark, d, "R", "none"), ["R", "none"]))


@query("multi_or", f"WITH {lines_sql('R', 'cut', 'tax')} SELECT DISTINCT id FROM m")
def multi_or(spark, d):
    return export.enumerate_ids(algebra.multi_or(line_words(spark, d, "R", "cut", "tax"), ["R", "cut", "tax"]))


@query("multi_and_builtin", f"WITH x AS ({_and_sql('R', 'O', 'few')}) SELECT id // 32768 AS bucket, count(*) AS card FROM x GROUP BY 1")
def multi_and_builtin(spark, d):
    return export.bitmaps_and(export.to_bitmaps(line_members(spark, d, "R", "O", "few")), ["R", "O", "few"])


@query("multi_or_builtin", f"WITH {lines_sql('R', 'cut')} SELECT id // 32768 AS bucket, count(DISTINCT id) AS card FROM m GROUP BY 1")
def multi_or_builtin(spark, d):
    return export.bitmaps_or(export.to_bitmaps(line_members(spark, d, "R", "cut")), ["R", "cut"])


@query("multi_and_mixed_negation", f"WITH {lines_sql('R', 'most', 'O', 'cut')} (SELECT id FROM m WHERE filter_id = 'R' INTERSECT SELECT id FROM m WHERE filter_id = 'most') EXCEPT (SELECT id FROM m WHERE filter_id IN ('O', 'cut'))")
def multi_and_mixed_negation(spark, d):
    words = line_words(spark, d, "R", "most", "O", "cut")
    return export.enumerate_ids(algebra.multi_and_negated(words, ["R", "most"], ["O", "cut"], line_universe(spark, d)))


@query("multi_and_all_negated", f"WITH {lines_sql('R', 'O')}, {LINE_U} SELECT unnest(range(u)) AS id FROM u EXCEPT SELECT id FROM m")
def multi_and_all_negated(spark, d):
    return export.enumerate_ids(algebra.multi_and_negated(line_words(spark, d, "R", "O"), [], ["R", "O"], line_universe(spark, d)))


@query("multi_and_keys", f"WITH {lines_sql('R', 'O', 'few')} SELECT (id >> 16)::INTEGER AS key FROM m GROUP BY 1 HAVING count(DISTINCT filter_id) = 3")
def multi_and_keys(spark, d):
    return export.container_keys(line_words(spark, d, "R", "O", "few"), ["R", "O", "few"])


# -- complements


@query("complement_gaps", f"WITH {events_sql('other')}, {EVENT_U} SELECT unnest(range(u)) AS id FROM u EXCEPT SELECT id FROM m")
def complement_gaps(spark, d):
    return algebra.complement_gaps(event_members(spark, d, "other").select("id"), event_universe(spark, d))


@query("complement_antijoin", f"WITH {lines_sql('O')}, {LINE_U} SELECT unnest(range(u)) AS id FROM u EXCEPT SELECT id FROM m")
def complement_antijoin(spark, d):
    return algebra.complement_ids(line_members(spark, d, "O").select("id"), line_universe(spark, d))


@query("complement_words", f"WITH {lines_sql('O')}, {LINE_U}, n AS (SELECT unnest(range(u)) AS id FROM u EXCEPT SELECT id FROM m) SELECT id // 32 AS word_idx, bit_or(1::BIGINT << (id % 32)::INTEGER) AS word FROM n GROUP BY 1")
def complement_words(spark, d):
    return algebra.complement(line_words(spark, d, "O"), line_universe(spark, d))
