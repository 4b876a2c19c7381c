"""Sets against Python sets."""

import random
import re
from functools import reduce
from itertools import product
from pathlib import Path

import pytest
from fixtures import SETS, batch, bernoulli, frame, sets_of
from pyspark.sql import functions as F

from sievespark.functions import policy
from sievespark.operators import algebra, containers, export, generate, ingest, probe
from sievespark.plans.expr import Filter, Not, Op, evaluate, normalise
from sievespark.sources import portable

OPS = {"and": set.__and__, "or": set.__or__, "andnot": set.__sub__, "xor": set.__xor__}


def ids(df) -> set[int]:
    rows = [r[0] for r in df.select("id").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def words_of(spark, sets):
    return ingest.to_words(frame(spark, sets))


def one(words, name):
    return words.where(F.col("filter_id") == name).select("word_idx", "word")


def test_ids_are_sets(spark):
    raw = spark.createDataFrame([(x,) for x in (200, 5, 100000, 42, 65536, 0, 100000, 5, None)], "id long")
    out = ingest.from_ids(raw, F.lit("a"), F.col("id"), 200_000)
    assert sets_of(out)["a"] == {200, 5, 100000, 42, 65536, 0}
    with pytest.raises(Exception, match="outside the universe"):
        ingest.from_ids(raw, F.lit("a"), F.col("id"), 1000).collect()


def test_every_form_returns_the_set(spark):
    members = frame(spark, SETS)
    assert sets_of(export.enumerate_ids(ingest.to_words(members))) == SETS
    held = containers.build(members).cache()
    assert sets_of(containers.members(held)) == SETS
    for threshold in (0, 100, 4096):
        promoted = containers.promote(held, threshold).cache()
        assert sets_of(containers.members(promoted)) == SETS
        assert promoted.where(F.col("card") > threshold).where("ctype <> 'BITMAP'").count() == 0
    kinds = {(r.filter_id, r.key): r.ctype for r in held.collect()}
    assert kinds["three", 0] == "RUN" and kinds["full", 0] == "RUN" and kinds["sparse", 0] == "ARRAY" and kinds["mix", 0] == "ARRAY"
    assert {r.card for r in held.where("filter_id = 'full'").collect()} == {65536}
    assert sets_of(containers.members(portable.parse(portable.serialise(held)))) == SETS


def test_portable_format_is_the_public_one(spark):
    held = containers.build(frame(spark, SETS))
    jvm = spark._jvm
    for row in portable.serialise(held).collect():
        bitmap = jvm.org.roaringbitmap.RoaringBitmap()
        bitmap.deserialize(jvm.java.nio.ByteBuffer.wrap(bytes(row.data)))
        assert set(bitmap.toArray()) == SETS[row.filter_id]
        assert bitmap.serializedSizeInBytes() == len(row.data)


def test_run_rule(spark):
    rows = [(2, 1, "ARRAY"), (3, 1, "RUN"), (20, 10, "ARRAY"), (21, 10, "RUN"), (8000, 2047, "RUN"), (8000, 2048, "BITMAP"), (4096, 4000, "ARRAY"), (4097, 4000, "BITMAP"), (65536, 1, "RUN")]
    df = spark.createDataFrame(rows, "card int, n_runs int, want string").withColumn("got", policy.encoding(F.col("card"), F.col("n_runs")))
    assert df.where("want <> got").count() == 0
    assert policy.auto_threshold(10**6) == 4096 and policy.auto_threshold(10**9, 96 << 20) == 0 and policy.auto_threshold(0) == 4096


@pytest.mark.parametrize(("p", "q"), [(0.6, 0.4), (0.02, 0.01), (0.5, 0.02)])
def test_pairs(spark, p, q):
    sets = {"a": bernoulli(100_000, p, 1), "b": bernoulli(100_000, q, 2)}
    words, members = words_of(spark, sets).cache(), frame(spark, sets)
    for op, python in OPS.items():
        want = python(sets["a"], sets["b"])
        found = algebra.pairwise(op, one(words, "a"), one(words, "b"))
        assert found.where("word = 0").count() == 0
        assert ids(export.enumerate_ids(found)) == want
        assert ids(algebra.pairwise_ids(op, *(members.where(F.col("filter_id") == n).select("id") for n in "ab"))) == want


def test_disjoint_keys_and_itself(spark):
    words = words_of(spark, {"a": set(range(1000)), "b": set(range(65536, 66536))})
    a, b = one(words, "a"), one(words, "b")
    assert algebra.pairwise("and", a, b).count() == 0
    assert ids(export.enumerate_ids(algebra.pairwise("or", a, b))) == set(range(1000)) | set(range(65536, 66536))
    assert algebra.pairwise("xor", a, a).count() == 0
    with pytest.raises(ValueError):
        algebra.pairwise("nand", a, b)


def test_demorgan_grid(spark):
    universe, sets = 10_007, {"a": bernoulli(10_007, 0.3, 42), "b": bernoulli(10_007, 0.4, 99)}
    words, every = words_of(spark, sets).cache(), set(range(10_007))
    for op, a, b in product(OPS, (False, True), (False, True)):
        left, right = (Not(Filter(n)) if neg else Filter(n) for n, neg in (("a", a), ("b", b)))
        want = OPS[op](every - sets["a"] if a else sets["a"], every - sets["b"] if b else sets["b"])
        assert ids(export.enumerate_ids(evaluate(words, Op(op, left, right), universe))) == want, (op, a, b)


def test_random_expressions(spark):
    rng, universe = random.Random(4), 2003
    sets = {n: bernoulli(universe, p, k) for k, (n, p) in enumerate({"a": 0.1, "b": 0.5, "c": 0.9, "d": 0.0}.items())}
    words, every = words_of(spark, sets).cache(), set(range(universe))

    def tree(depth):
        if depth == 0:
            return Filter(rng.choice("abcd"))
        if rng.random() < 0.3:
            return Not(tree(depth - 1))
        return Op(rng.choice(list(OPS)), tree(depth - 1), tree(depth - 1))

    def value(e):
        if isinstance(e, Filter):
            return sets[e.name]
        return every - value(e.of) if isinstance(e, Not) else OPS[e.op](value(e.left), value(e.right))

    def holds_not(e):
        return isinstance(e, Not) or isinstance(e, Op) and (holds_not(e.left) or holds_not(e.right))

    for _ in range(12):
        e = tree(4)
        assert not holds_not(normalise(e)[0])
        assert ids(export.enumerate_ids(evaluate(words, e, universe))) == value(e)


def test_many(spark):
    sets = {f"s{v}": batch(v) for v in range(4)} | {"none": set()}
    words = words_of(spark, sets).cache()
    for names in (["s0"], ["s0", "s1"], ["s2", "s3"], ["s0", "s1", "s2", "s3"], ["s2", "s2", "s3"]):
        want = reduce(set.__and__, (sets[n] for n in names))
        assert ids(export.enumerate_ids(algebra.multi_and(words, names))) == want
        assert ids(export.enumerate_ids(algebra.multi_and_chain(words, names))) == want
    assert algebra.multi_and(words, ["s0", "none"]).count() == 0
    assert ids(export.enumerate_ids(algebra.multi_or(words, ["s0", "s3"]))) == sets["s0"] | sets["s3"]
    for call in (lambda: algebra.multi_and(words, []), lambda: algebra.multi_or(words, []), lambda: algebra.multi_and_negated(words, [], [], 10)):
        with pytest.raises(ValueError):
            call()
    requests = spark.createDataFrame([(1, "s0"), (1, "s1"), (1, "s0"), (2, "s3"), (3, "s0"), (3, "none")], "query_id long, filter_id string")
    got = export.enumerate_ids(algebra.multi_and_grouped(words, requests)).collect()
    assert {(r.query_id, r.id) for r in got} == {(1, i) for i in sets["s0"] & sets["s1"]} | {(2, i) for i in sets["s3"]}


def test_negated_inputs(spark):
    universe = 3 * 65536
    b = set(range(universe)) - {70000, 70001, 70005, 70100, 70200}
    c = {i for i in range(0, 65536, 3)} | set(range(131072, 140000))
    a = bernoulli(universe, 0.2, 3) | {70000, 70100}
    sets = {"a": a, "nb": set(range(universe)) - b, "c": c}
    words, every = words_of(spark, sets).cache(), set(range(universe))
    assert ids(export.enumerate_ids(algebra.multi_and_negated(words, ["a"], ["nb"], universe))) == a & b
    assert ids(export.enumerate_ids(algebra.multi_and_negated(words, ["a"], ["nb", "c"], universe))) == a & b - c
    got = ids(export.enumerate_ids(algebra.multi_and_negated(words, [], ["a", "c"], universe - 5)))
    assert got == {i for i in every - a - c if i < universe - 5}


@pytest.mark.parametrize("rule", [lambda i: i % 10 != 0, lambda i: i % 10 == 0, lambda i: i < 5, lambda i: False, lambda i: True])
def test_complements(spark, rule):
    universe = 70_001
    s = {i for i in range(universe) if rule(i)}
    members, want = frame(spark, {"a": s}), set(range(universe)) - s
    assert ids(algebra.complement_ids(members.select("id"), universe)) == want
    assert ids(algebra.complement_gaps(members.select("id"), universe)) == want
    words = one(ingest.to_words(members), "a")
    assert ids(export.enumerate_ids(algebra.complement(words, universe))) == want
    dense = {r.word_idx: r.word for r in export.decompress(words, universe, negated=True).collect()}
    assert len(dense) == -(-universe // 32) and sum(w.bit_count() for w in dense.values()) == len(want)


def test_density(spark):
    sets = {"half": set(range(50)), "more": set(range(51)), "all": set(range(100)), "few": {1}}
    rows = {r.filter_id: (r.negated, r.cardinality, r.stored) for r in ingest.catalog(frame(spark, sets), 100).collect()}
    assert rows == {"half": (False, 50, 50), "more": (True, 51, 49), "all": (True, 100, 0), "few": (False, 1, 1)}


def test_probes(spark):
    sets = {f"s{v}": batch(v) for v in range(4)}
    members = frame(spark, sets)
    asked = spark.range(0, 280_000, 37).crossJoin(spark.createDataFrame([(f"s{v}",) for v in range(5)], "filter_id string")).select("filter_id", "id")
    by_words, by_containers = probe.contains_each(asked, ingest.to_words(members)), probe.contains_in_containers(asked, containers.build(members))
    for out in (by_words, by_containers):
        assert all(r.hit == (r.id in sets.get(r.filter_id, set())) for r in out.collect())
    assert probe.mismatches(by_words, by_containers, ["filter_id", "id"]).first().mismatches == 0
    words = one(ingest.to_words(members), "s0")
    for negated in (False, True):
        rows = probe.contains(spark.range(-5, 300_000, 53), words, 250_000, negated).collect()
        assert all(r.hit == (0 <= r.id < 250_000 and (r.id in sets["s0"]) != negated) for r in rows)


def test_indptr_and_buckets(spark):
    sets = {"a": SETS["three"], "b": SETS["boundary"]}
    words = words_of(spark, sets)
    rows = sorted((r.filter_id, r.key, r.card, r.start) for r in export.indptr(words).collect())
    assert rows == [("a", 0, 100, 0), ("a", 1, 50000, 100), ("a", 2, 10000, 50100), ("b", 0, 1, 0), ("b", 1, 1, 1)]
    got = export.bitmaps_and(export.to_bitmaps(frame(spark, sets)), ["a", "b"]).collect()
    assert sum(r.card for r in got) == len(sets["a"] & sets["b"])


def test_generators(spark):
    n = generate.bernoulli(spark, 100_000, 0.3, 42).count()
    assert 28_000 < n < 32_000
    assert generate.draws(spark, 1000, 5000, 1).agg(F.max("id")).first()[0] < 1000
    members = frame(spark, {"rare": {5, 900}, "often": set(range(0, 1000, 5))})
    sizes = members.groupBy("filter_id").agg(F.count(F.lit(1)).alias("n"))
    rows = generate.reordered(members, sizes).collect()
    assert {r.new_id for r in rows if r.filter_id == "rare"} == {0, 1} and {r.new_id for r in rows} == set(range(len({r.id for r in rows})))
    with pytest.raises(ValueError):
        generate.probes(spark, 10, 10, "spiral", 1)


def test_empty(spark):
    none = frame(spark, {"a": set()})
    words = ingest.to_words(none)
    assert words.count() == containers.build(none).count() == export.enumerate_ids(words).count() == 0
    assert ids(algebra.complement_gaps(none.select("id"), 10)) == set(range(10))
    assert ids(export.enumerate_ids(evaluate(words, ~Filter("a"), 40))) == set(range(40))


def test_buffer_beyond_the_universe(spark):
    words = one(words_of(spark, {"a": {0, 33, 63}}), "a")
    rows = {r.word_idx: r.word for r in export.decompress(words, 64, limit=10).collect()}
    assert rows == {0: 1, 1: (1 << 1) | (1 << 31)} | {k: 0 for k in range(2, 10)}
    rows = {r.word_idx: r.word for r in export.decompress(words, 40, negated=True, limit=3).collect()}
    assert rows == {0: 0xFFFFFFFE, 1: 0xFD, 2: 0}
    assert {r.word_idx for r in export.decompress(words, 64, limit=1).collect()} == {0}


def test_runs_of_words(spark):
    sets = {"a": {0, 1, 31, 32, 33, 63, 64, 65535, 65536, 65537, 200_000}, "all": set(range(131072)), "b": set(range(5, 4000, 2)) | set(range(10_000, 30_000))}
    got = {}
    for r in containers.runs(frame(spark, sets)).collect():
        got.setdefault((r.filter_id, r.key), []).append((r.start, r.length))
    for name, s in sets.items():
        for key in {i >> 16 for i in s}:
            lows, want = sorted(i & 65535 for i in s if i >> 16 == key), []
            for low in lows:
                if want and sum(want[-1]) + 1 == low:
                    want[-1] = (want[-1][0], want[-1][1] + 1)
                else:
                    want.append((low, 0))
            assert sorted(got[name, key]) == want
    sizes = {(r.filter_id, r.key): (r.card, r.n_runs) for r in containers.sizes(frame(spark, sets)).collect()}
    assert sizes["all", 0] == sizes["all", 1] == (65536, 1) and sizes["a", 0] == (8, len(got["a", 0]))


def test_automatic_promotion(spark):
    members = frame(spark, {"a": {1, 70000}, "b": set(range(0, 60_000, 7))})
    held = containers.build(members)
    kinds = lambda df: {(r.filter_id, r.key): r.ctype for r in df.collect()}
    assert kinds(containers.promote_auto(held, 10**6)) == kinds(held)
    assert set(kinds(containers.promote_auto(held, 10**9)).values()) == {"BITMAP"}
    assert set(kinds(containers.build_auto(members, 10**9)).values()) == {"BITMAP"}
    # 16 KB of bitmaps are half of the flat bitset of 2**18 ids
    assert kinds(containers.build_auto(members, 1 << 18, 100)) == kinds(held)
    assert sets_of(containers.members(containers.promote_auto(held, 10**9))) == sets_of(members)
    for call in (lambda: containers.promote(held, policy.AUTO), lambda: containers.build(members, policy.AUTO)):
        with pytest.raises(ValueError, match="resolved"):
            call()


def test_unknown_sets_and_places(spark):
    catalog = ingest.catalog(frame(spark, {"a": {1}, "b": {2}}), 10)
    assert algebra.known(catalog, ["b", "a", "b"]) == ["b", "a"]
    with pytest.raises(KeyError, match="nope"):
        algebra.known(catalog, ["a", "nope"])
    assert algebra.named(["a", "b"], [1, 0, 1]) == ["b", "a", "b"]
    for place in (2, -1):
        with pytest.raises(IndexError):
            algebra.named(["a", "b"], [0, place])
    requests = spark.createDataFrame([(1, "a"), (1, "c")], "query_id long, filter_id string")
    assert {(r.filter_id, r.known) for r in algebra.checked(requests, catalog).collect()} == {("a", True), ("c", False)}


def test_dense_pairs_by_stretches(spark, monkeypatch):
    monkeypatch.setattr(export, "STRETCH", 3)
    words = words_of(spark, {"a": {0, 64, 700}, "b": set()})
    universes = spark.createDataFrame([("a", 701), ("b", 64), ("none", 0)], "filter_id string, universe long")
    rows = {(r.filter_id, r.pair_idx): (r.low, r.high) for r in export.decompress_batch(words, universes).collect()}
    assert set(rows) == {("a", k) for k in range(11)} | {("b", 0)}
    assert rows["a", 0] == rows["a", 1] == (1, 0) and rows["a", 10] == (0, 1 << 28)


def test_lists_end_to_end(spark):
    sets = {"a": {5, 70_000, 70_001}, "b": {1}, "c": set(range(65530, 65540))}
    rows = sorted((r.filter_id, r.key, r.ids, r.start, r.stop) for r in export.csr(frame(spark, sets)).collect())
    assert [r[3] for r in rows] == [0, 1, 3, 4, 10] and [r[4] for r in rows] == [1, 3, 4, 10, 14]
    assert [i for r in rows for i in r[2]] == [i for n in "abc" for i in sorted(sets[n])]


def test_words_of_predicates_meet_after_the_shuffle(spark):
    """One row an id is shuffled, not one a set; more predicates than a number has bits; ids repeated, null or in no set."""
    rows = [(i % 5000 * 3 if i % 7 else None, i) for i in range(8000)]
    df = spark.createDataFrame(rows, "id long, v int")
    predicates = {f"p{k}": F.expr(f"v % {k + 2} = 1") for k in range(65)} | {"null": F.lit(None).cast("boolean"), "all": F.lit(True)}
    words = ingest.predicate_words(df, F.col("id"), predicates)
    want = {f"p{k}": {i for i, v in rows if i is not None and v % (k + 2) == 1} for k in range(65)} | {"all": {i for i, _ in rows if i is not None}}
    assert sets_of(export.enumerate_ids(words)) == {n: s for n, s in want.items() if s}
    assert sets_of(export.enumerate_ids(ingest.to_words(ingest.from_predicates(df, F.col("id"), predicates)))) == {n: s for n, s in want.items() if s}
    plan = words._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange") and plan.count("Exchange") == 1


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", ["upload_batch_words", "upload_catalog", "container_types", "filter_meta", "form_bytes", "tag_density", "enumerate_ids", "enumerate_indptr", "multi_and_8", "reorder_ids"])
def test_queries_shuffle_lines_before_they_multiply(spark, name):
    from sievespark.plans.queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Generate") < plan.rindex("RepartitionByExpression")


def test_pages_of_containers(spark):
    """A probe looks through a page: of each encoding, a page holds its own positions only."""
    sets = {"list": set(range(0, 65536, 17)), "runs": set(range(100, 60000)) - set(range(1000, 50000, 40)), "words": {i for i in range(65536) if i % 3}, "two": {5, 65536 + 300}}
    held = containers.build(frame(spark, sets))
    kinds = {(r.filter_id, r.key): r.ctype for r in held.collect()}
    assert set(kinds.values()) == {"ARRAY", "RUN", "BITMAP"}
    got = {n: set() for n in sets}
    for r in containers.pages(held).collect():
        assert kinds[r.filter_id, r.key] == r.ctype and [x is not None for x in (r.arr, r.runs, r.words)] == [r.ctype == c for c in ("ARRAY", "RUN", "BITMAP")]
        low = [*(r.arr or []), *(x for s in r.runs or [] for x in range(s.start, s.start + s.length + 1)), *(32 * w.pos + b for w in r.words or [] for b in range(32) if w.word >> b & 1)]
        assert len(set(low)) == len(low) and {x // containers.PAGE for x in low} == {r.page}
        got[r.filter_id] |= {r.key * 65536 + x for x in low}
    assert got == sets
    asked = spark.range(0, 140_000).select(F.explode(F.array(*[F.lit(n) for n in [*sets, "absent"]])).alias("filter_id"), "id")
    rows = probe.contains_in_containers(asked.union(asked.limit(3)), held).groupBy("filter_id").agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.when(F.col("hit"), F.col("id"))).alias("ids"))
    assert {r.filter_id: set(r.ids) for r in rows.collect()} == sets | {"absent": set()}


def test_repeated_probes_stay_single_rows(spark, tmp_path):
    """An event that comes twice asks twice; both methods' answers are of one probe, not paired by its id."""
    from sievespark.plans.queries import QUERIES

    rows = [(k % 70, "click" if k % 3 else "view", float(k)) for k in range(100)]
    spark.createDataFrame(rows, "event_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["method_mismatches"](spark, str(tmp_path)).collect()
    assert len(got) == 300 and not any(r.differs for r in got)
    click = {i for i, t, _ in rows if t == "click"}
    assert all(r.by_words == (r.id in click) for r in got if r.filter_id == "click")


def test_packed_probes(spark):
    sets = {"a": {1, 5, 40}, "b": {100}}
    asked = frame(spark, {"a": {1, 2, 40, 41}, "b": {1}, "absent": {7}})
    packed = probe.contains_packed(ingest.to_words(asked), ingest.to_words(frame(spark, sets)))
    assert sorted((r.filter_id, r.n, r.hits, r.rate) for r in probe.packed_hits(packed).collect()) == [("a", 4, 2, 0.5), ("absent", 1, 0, 0.0), ("b", 1, 0, 0.0)]
    one_by_one = probe.hits(probe.contains_each(asked, ingest.to_words(frame(spark, sets))))
    assert sorted(map(tuple, one_by_one.collect())) == sorted(map(tuple, probe.packed_hits(packed).collect()))


def test_reordering_orders_no_group_in_one_task(spark):
    sets = {"rare": set(range(7, 200_000, 501)), "mid": set(range(0, 200_000, 3)), "all": set(range(150_000))}
    members = frame(spark, sets)
    found = generate.reordered(members, members.groupBy("filter_id").agg(F.count(F.lit(1)).alias("n")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"windowspecdefinition\(rank#\d+L?, id#", plan)
    order = sorted(set().union(*sets.values()), key=lambda i: (0 if i in sets["rare"] else 1 if i in sets["mid"] else 2, i))
    new = {i: k for k, i in enumerate(order)}
    got = {n: {} for n in sets}
    for r in found.collect():
        assert r.id not in got[r.filter_id]
        got[r.filter_id][r.id] = r.new_id
    assert got == {n: {i: new[i] for i in s} for n, s in sets.items()}
