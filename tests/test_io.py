import numpy as np
import pytest
from pyspark.sql import functions as F

from sievespark.operators import algebra, ingest, search, stats
from sievespark.sources import binary, results
from sievespark.sources.storage import new_folder


def test_tags(spark, tmp_path):
    rows = [(t, i) for t in (3, 9) for i in range(0, 300, t)]
    folder = f"file://{tmp_path}/tags"
    assert binary.write_tags(spark.createDataFrame(rows + rows[:5], "tag_id long, id long"), folder) == 2
    raw = np.fromfile(tmp_path / "tags" / "tag_9.bin", "<u4")
    assert raw[0] == 34 and raw[1] == 9 and raw[2:].tolist() == list(range(0, 300, 9))
    assert sorted(tuple(r) for r in binary.read(spark, "tags", folder).collect()) == sorted(rows)


def test_tags_of_a_join_that_turns_into_a_broadcast(spark, tmp_path):
    """Adaptive execution then reads the shuffles of the join map by map: a tag must still come to one task."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "20k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        rows = spark.range(40_000).repartition(8).select((F.col("id") % 3).alias("tag_id"), "id")
        folder = f"file://{tmp_path}/tags"
        assert binary.write_tags(rows, folder) == 3
        assert binary.read(spark, "tags", folder).exceptAll(rows).count() == 0 and binary.read(spark, "tags", folder).count() == 40_000
    finally:
        for name in settings:
            spark.conf.unset(name)


def test_queries_and_truth(spark, tmp_path):
    folder = f"file://{tmp_path}"
    path = binary.write_queries(spark.createDataFrame([(7, 1), (7, 4), (9, 2)], "query_id long, tag_id long"), folder)
    assert np.fromfile(tmp_path / "queries.bin", "<u4").tolist() == [2, 2, 1, 4, 1, 2]
    assert sorted(tuple(r) for r in binary.read(spark, "queries", path).collect()) == [(0, 1), (0, 4), (1, 2)]
    path = binary.write_truth(spark.createDataFrame([(5, 1, 30), (5, 2, 31), (6, 1, 8)], "query_id long, rank int, id long"), folder, 2)
    assert np.fromfile(tmp_path / "groundtruth.bin", "<u4").tolist() == [2, 2, 30, 31, 8, 2**32 - 1]
    assert binary.read(spark, "truth", path).where("rank = 1").count() == 2


def test_queries_are_cut_between_records(tmp_path, monkeypatch):
    """No part holds all of a file, whatever the records' sizes; a file that ends early is an error."""
    monkeypatch.setattr(binary, "SPLIT", 8)
    sizes = [3, 0, 1, 20, 2, 0, 0, 7, 1] * 5
    want, words = [], [len(sizes)]
    for q, n in enumerate(sizes):
        words += [n, *range(q, q + n)]
        want += [(q, t) for t in range(q, q + n)]
    np.array([*words, 99, 99], "<u4").tofile(tmp_path / "queries.bin")
    reader = binary.QueryReader(f"file://{tmp_path}/queries.bin")
    parts = reader.partitions()
    assert len(parts) > 5 and max(p.stop - p.start for p in parts) <= 8 + 21 + 8
    assert [(q, t) for p in parts for b in reader.read(p) for q, t in zip(*(c.to_pylist() for c in b.columns), strict=True)] == want
    np.array(words[:-1], "<u4").tofile(tmp_path / "queries.bin")
    with pytest.raises(ValueError):
        reader.partitions()


def test_vectors_and_sparse(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(binary, "SPLIT", 2)
    folder = f"file://{tmp_path}"
    rows = [(k, [float(k), 2.0, 200.0]) for k in range(5)]
    df = spark.createDataFrame(rows, "id long, vector array<float>")
    for layout in ("u8", "i32", "f32"):
        found = binary.read(spark, layout, binary.write_vectors(df, folder, f"x.{layout}", layout))
        assert sorted((r.id, list(r.vector)) for r in found.collect()) == rows
    cells = [(0, 3, 1.0), (2, 0, 2.0), (2, 4, 3.0), (4, 1, 0.5)]
    path = binary.write_sparse(spark.createDataFrame(cells, "row long, col long, value float"), folder, "m.spmat", 5, 6)
    assert sorted(tuple(r) for r in binary.read(spark, "sparse", path).collect()) == cells
    with pytest.raises(Exception, match="unknown layout"):
        binary.read(spark, "other", path).collect()


def test_nothing(spark):
    folder = new_folder(spark, "none")
    assert binary.write_tags(spark.createDataFrame([], "tag_id long, id long"), folder) == 0
    assert binary.read(spark, "tags", folder).count() == 0


def test_search(spark):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(300, 8)).astype(np.float32)
    df = spark.createDataFrame([(k, k % 3, p.tolist()) for k, p in enumerate(points)], "id long, label int, embedding array<float>")
    asked = df.where("id % 50 = 0").select(F.col("id").alias("query_id"), "label", "embedding")
    got = search.search_all(asked, df, 5).collect()
    for q in range(0, 300, 50):
        d = ((points.astype(float) - points[q].astype(float)) ** 2).sum(axis=1)
        d[q] = np.inf
        assert [r.id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == np.argsort(d, kind="stable")[:5].tolist()
    truth = search.search_within(asked, df, "label", 5)
    assert search.recall(truth, truth).first().recall == 1.0
    partial = search.recall(spark.createDataFrame([(1, 5), (1, 6), (2, -1)], "query_id long, id long"), spark.createDataFrame([(1, 5)], "query_id long, id long")).first()
    assert partial.queries == 2 and partial.recall == 0.25


def test_search_in_blocks_and_through_sets(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_VECTORS", 40)
    monkeypatch.setattr(search, "BLOCK_QUERIES", 2)
    rng = np.random.default_rng(2)
    points = rng.normal(size=(300, 4))
    vectors = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(points)] + [(300, None)], "id long, embedding array<double>")
    asked = vectors.where("id % 30 = 0").select(F.col("id").alias("query_id"), "embedding")
    sets = {"even": set(range(0, 300, 2)), "low": set(range(150)), "empty": set()}
    words = ingest.to_words(spark.createDataFrame([(n, i) for n, s in sets.items() for i in s], "filter_id string, id long"))
    wants = {0: ["even", "low"], 30: ["even"], 60: ["low", "even"], 90: ["low"], 120: ["even", "empty"]}
    requests = spark.createDataFrame([(q, n) for q, names in wants.items() for n in names], "query_id long, filter_id string")
    allowed, members = algebra.multi_and_classes(words, requests)
    assert len({r.class_id for r in members.collect()}) == 4
    got = {}
    for r in search.search_filtered(asked, vectors, allowed, members, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))
    for q, names in wants.items():
        inside = set.intersection(*(sets[n] for n in names)) - {q}
        near = sorted(inside, key=lambda i: (((points[i] - points[q]) ** 2).sum(), i))[:5]
        assert [i for _, i in sorted(got.get(q, []))] == near
    every = search.search_all(asked, vectors, 3).collect()
    for q in range(0, 300, 30):
        near = sorted(set(range(300)) - {q}, key=lambda i: (((points[i] - points[q]) ** 2).sum(), i))[:3]
        assert [r.id for r in sorted(every, key=lambda r: r["rank"]) if r.query_id == q] == near


def test_search_makes_no_row_a_pair(spark, monkeypatch):
    """Against brute force, with ties, odd components and several blocks; pairs meet in tasks and not in a join."""
    monkeypatch.setattr(search, "BLOCK_VECTORS", 100)
    rng = np.random.default_rng(3)
    points = [[float(x) for x in p] for p in rng.integers(0, 4, size=(250, 5))]
    points[7], points[50], points[60], points[61], points[100] = [1.0, None, 2.0, 0.0, 1.0], [float("nan"), 1.0, 1.0, 1.0, 1.0], [None] * 5, [2.0, 1.0], [1e200, 1.0, 0.0, 0.0, 0.0]
    df = spark.createDataFrame([(k, k % 2, p) for k, p in enumerate(points)], "id long, label int, embedding array<double>")
    asked = df.where("id % 25 = 0").select(F.col("id").alias("query_id"), "label", "embedding")
    held = np.array([[np.nan if x is None else x for x in p + [None] * (5 - len(p))] for p in points])
    there = np.array([[x is not None for x in p + [None] * (5 - len(p))] for p in points])

    def near(q, allowed, k):
        def key(i):
            both = there[q] & there[i]
            d = sum(((held[q, c] - held[i, c]) ** 2 for c in range(5) if both[c]), 0.0)
            return (not both.any(), np.isnan(d), 0.0 if np.isnan(d) else d, i)

        return sorted(allowed - {q}, key=key)[:k]

    def got(found):
        rows = sorted((r.query_id, r["rank"], r.id) for r in found.collect())
        return {q: [i for p, _, i in rows if p == q] for q in range(0, 250, 25)}

    every, label = set(range(250)), lambda q: {i for i in range(250) if i % 2 == q % 2}
    found = search.search_all(asked, df, 20)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert got(found) == {q: near(q, every, 20) for q in range(0, 250, 25)}
    assert got(search.search_all(asked, df, 400)) == {q: near(q, every, 400) for q in range(0, 250, 25)}
    assert got(search.search_within(asked, df, "label", 6)) == {q: near(q, label(q), 6) for q in range(0, 250, 25)}
    after = {q: [i for i in near(q, every, 20) if i in label(q)][:5] for q in range(0, 250, 25)}
    assert got(search.search_after(asked, df, "label", 5, 4)) == after
    pairs = spark.createDataFrame([(q, i) for q in range(0, 250, 25) for i in label(q)], "query_id long, id long")
    assert got(search.search_after(asked, df, pairs, 5, 4)) == after


@pytest.mark.parametrize("kind", results.FORMATS)
def test_results(spark, tmp_path, kind):
    rows = [(1, "a, \"b\"", 0.1), (2, None, None), (3, "two\nlines" if kind == "json" else "x", 1e-300)]
    df = spark.createDataFrame(rows, "id int, name string, qps double")
    folder = results.write_results(df, f"file://{tmp_path}/r", kind)
    assert sorted(tuple(r) for r in results.read_results(spark, folder, "id int, name string, qps double", kind).collect()) == rows
    with pytest.raises(ValueError):
        results.write_results(df, folder, "xml")


def test_curves(spark):
    rows = [("s", 0.9, 100.0), ("s", 0.8, 400.0), ("s", 0.85, 50.0), ("s", 0.99, 10.0), ("t", 0.5, 7.0)]
    curves = spark.createDataFrame(rows, "system string, recall double, qps double")
    assert sorted(r.recall for r in search.pareto(curves, ["system"]).where("system = 's'").collect()) == [0.8, 0.9, 0.99]
    at = {r.system: r.qps for r in search.qps_at(curves, ["system"], 0.85).collect()}
    assert at["s"] == pytest.approx(200.0) and at["t"] is None
    assert search.qps_at(curves, ["system"], 0.995).where("system = 's'").first().qps == 10.0
    assert search.recall_at(curves, ["system"], 250.0).where("system = 's'").first().recall == pytest.approx(0.85)


def test_formats(spark):
    df = spark.createDataFrame([(1.5e6, 2.5e9, 90.0), (2500.0, 1.5e3, 0.5), (12.0, 10.0, 2e-5), (None, None, None)], "q double, b double, s double")
    rows = df.select(stats.format_qps(F.col("q")), stats.format_bytes(F.col("b")), stats.format_seconds(F.col("s"))).collect()
    assert [tuple(r) for r in rows] == [("1.5M", "2.5GB", "1.5min"), ("3K", "1.5KB", "500.0ms"), ("12", "10B", "20us"), (None, None, None)]
