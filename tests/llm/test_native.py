"""Sharding and mixing."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from sievespark.llm import mixing, sharding

MASK = (1 << 64) - 1


def jump(key, n):
    b, j, key = -1, 0, key & MASK
    while j < n:
        b = j
        key = (key * sharding.MULTIPLIER + 1) & MASK
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump(spark):
    rng = random.Random(1)
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *(rng.getrandbits(64) - 2**63 for _ in range(2000))]
    rows = sharding.shard(spark.createDataFrame([(k,) for k in keys], "doc_id long"), shards=24, buckets=8).collect()
    assert len(rows) == len(keys)
    for r in rows:
        assert r.shard == jump(r.doc_id, 24) and r.grown_shard == jump(r.doc_id, 25)
        assert r.grown_shard in (r.shard, 24)
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_shard_edges(spark):
    schema = "doc_id long, shard string, slot long, text string"
    rows = [(None, "x", 9, "a"), (None, "x", 9, "a"), (5, "y", 1, None), (5, "y", 1, "")]
    out = sharding.shard(spark.createDataFrame(rows, schema), buckets=4)
    assert out.columns == ["doc_id", "text", "shard", "slot", "grown_shard"] and out.count() == 4
    assert out.groupBy("shard", "slot").count().where("count > 1").count() == 0
    assert sharding.shard(spark.createDataFrame([], schema)).count() == 0
    named = sharding.shard(spark.createDataFrame([("a",), ("b",), (None,)], "name string"), key="name", shards=3)
    assert named.count() == 3
    with pytest.raises(ValueError):
        sharding.shard(spark.createDataFrame([], schema), shards=0)


def test_op4(spark, tmp_path):
    rows = [(k, "é" * (k % 7) if k % 5 else None, "en", "s", 0) for k in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    for r in sharding.op4_jump_sharding(spark, str(tmp_path)).collect():
        raw = (rows[r.doc_id][1] or "").encode()
        assert (r["size"], r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "key")


def filled(sizes, weights, cap):
    """Shares by weight, excess shared again until none is above its cap."""
    names = sorted((n for n in sizes if n is not None)) + ([None] if None in sizes else [])
    w = {n: weights[k % len(weights)] for k, n in enumerate(names)}
    total, free, fixed = sum(sizes.values()), set(names), {}
    while free:
        left = total - sum(fixed.values())
        share = {n: left * w[n] / sum(w[m] for m in free) for n in free}
        above = {n for n in free if share[n] > cap * sizes[n] + 1e-9}
        if not above:
            return fixed | share
        fixed |= {n: cap * sizes[n] for n in above}
        free -= above
    return fixed


def mixed_rows(seed=2, n=600):
    rng = random.Random(seed)
    names = ["b", "a", "é", "Z", None, "tiny", "empty"]
    rows = []
    for k in range(n):
        s = rng.choices(names, [6, 2, 2, 2, 1, 0.1, 0.2])[0]
        rows.append((k, s, 0 if s == "empty" else rng.randrange(0, 60)))
    return [*rows, rows[0], rows[0]]


def test_mix(spark):
    rows = mixed_rows()
    df = spark.createDataFrame(rows, "doc_id long, source string, size long").repartition(5)
    out = mixing.mix(df, digits=1).collect()
    assert len(out) == len(rows)
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    want = filled(sizes, mixing.WEIGHTS, mixing.CAP)
    for s in sizes:
        own = [r for r in out if r.source == s]
        assert own[0].source_size == sizes[s] and own[0].target == pytest.approx(want[s])
        assert sum(r.taken for r in own) == round(own[0].target)
    assert all(0 <= r.taken <= 3 * r["size"] for r in out)
    again = mixing.mix(df.repartition(3), digits=2).collect()
    assert sorted((r.doc_id, r.taken) for r in out) == sorted((r.doc_id, r.taken) for r in again)


def test_mix_documents(spark):
    rows = [(k, " ".join(["w"] * n), s, k) for k, s, n in mixed_rows()[:-2]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, key long")
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    plan = {r.doc_id: r.whole for r in mixing.mix(docs.select("doc_id", "source", F.regexp_count("text", F.lit("w")).alias("size"))).collect()}
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == {k: v for k, v in plan.items() if v}


def test_mix_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_documents(none).count() == 0
    odd = spark.createDataFrame([(None, None, None), (1, None, ""), (2, "a", None)], "doc_id long, source string, size long".replace("size long", "t string"))
    rows = odd.select("doc_id", "source", F.lit(None).cast("long").alias("size"))
    assert [r.taken for r in mixing.mix(rows).collect()] == [0, 0, 0]


def test_slots_of_one_key(spark):
    rows = [(None, f"t{k}") for k in range(500)] + [(7, "same")] * 20
    df = spark.createDataFrame(rows, "doc_id long, text string")
    runs = [{(r.doc_id, r.text, r.shard, r.slot) for r in sharding.shard(df.repartition(n), shards=3, buckets=16).collect()} for n in (2, 5)]
    assert runs[0] == runs[1] and len(runs[0]) == 520
    for s in range(3):
        slots = sorted(slot for *_, own, slot in runs[0] if own == s)
        assert slots == list(range(len(slots)))


def test_jump_of_many_shards(spark):
    rng = random.Random(9)
    keys = [rng.getrandbits(64) - 2**63 for _ in range(500)]
    for n in (1, 2, 40, 100_000):
        for r in sharding.shard(spark.createDataFrame([(k,) for k in keys], "doc_id long"), shards=n).collect():
            assert (r.shard, r.grown_shard) == (jump(r.doc_id, n), jump(r.doc_id, n + 1))


def test_mix_documents_of_one_id(spark):
    same = [(1, "a b c d e f g h", "x")] * 50
    other = [(2, "a " * 10 + str(k), "x") for k in range(30)] + [(None, f"n {k} m", "y") for k in range(40)] + [(3, "z " * 50, "z"), (4, None, "z"), (5, "", None)]
    docs = spark.createDataFrame(same + other, "doc_id long, text string, source string").repartition(3)
    plan = mixing.mix(docs.select("doc_id", "source", F.regexp_count("text", F.lit("[^ ]+")).alias("size"), F.xxhash64("doc_id", "text", "source").alias("tie"))).collect()
    out = mixing.mix_documents(docs).collect()
    for s in ("x", "y", "z"):
        assert sum(len(r.text.split()) for r in out if r.source == s and r.text) == sum(r.whole * r["size"] for r in plan if r.source == s)
        budget = round(next(r.target for r in plan if r.source == s))
        longest = max(r["size"] for r in plan if r.source == s)
        assert budget <= sum(r.whole * r["size"] for r in plan if r.source == s) < budget + longest + 1
    again = mixing.mix_documents(docs.repartition(5)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
