"""Language identification, neighbours, media, and the pipeline."""

import hashlib
import random
import zipfile
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievespark.llm import language, media, neighbours
from sievespark.llm._shared import new_path

SYLLABLES = {"aa": ["ka", "to", "mi", "re"], "bb": ["schu", "ung", "ßer", "ich"], "cc": ["ção", "nho", "é", "lhe"]}


def said(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_windows_cover_everything():
    for n in (0, 1, 2, 3, 4, 255, 256, 257, 5000):
        data = bytes(random.Random(n).randrange(1, 256) for _ in range(n))
        rows = language.windows(data)
        step = language.WINDOW - language.OVERLAP
        joined = b"".join(bytes(r[:step]) for r in rows[:-1]) + bytes(rows[-1])
        assert joined.rstrip(b"\0") == data and rows.shape[1] == language.WINDOW


def test_language(spark):
    rng = random.Random(1)
    rows = [(k, said(rng, lang := rng.choice(list(SYLLABLES)), rng.choice([3, 30, 400])), lang if k % 11 else None) for k in range(600)]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 34 .. !!", "bb"), (1003, "一" * 3, None), (None, "ka to", "aa"), (1004, "ka" * 20_000, None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, score int").repartition(3)
    net = language.fit(docs, per_lang=150)
    assert net.langs == ["aa", "bb", "cc"]
    out = language.predict(docs.withColumn("held_out", language.held_out()), net, ["doc_id", "held_out"]).collect()
    assert len(out) == len(rows)
    found = {r.doc_id: r for r in out}
    for i in (1000, 1001, 1002):
        assert (found[i].lang_pred, found[i].score) == ("und", 0.0)
    assert found[1003].lang_pred in net.langs and found[1004].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in out)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    own = [(r.lang_pred, rows[r.doc_id][2]) for r in out if r.held_out and r.doc_id < 600 and rows[r.doc_id][2]]
    assert sum(a == b for a, b in own) >= 0.97 * len(own)
    kept = language.only_known(docs)
    assert kept.columns == ["doc_id", "text", "lang", "score"] and kept.schema["score"].dataType.typeName() == "integer"
    assert 1002 not in {r.doc_id for r in kept.collect()} and {r.score for r in kept.collect()} == {1}
    clash = language.predict(docs.withColumn("__text", F.lit("x")), net, ["doc_id", "score", "__text"])
    assert clash.columns == ["doc_id", "__text", "lang_pred", "score"] and clash.where("score > 1 OR __text <> 'x'").count() == 0


def test_network_by_brute_force():
    """Probabilities against a convolution of one-hot bytes, position by position."""
    rng = np.random.default_rng(5)
    taps = {w: rng.normal(size=(w, 256, language.FILTERS)).astype(np.float32) for w in language.WIDTHS}
    width = language.FILTERS * len(language.WIDTHS)
    net = language.Network(["a", "b", "c"], taps, rng.normal(size=width).astype(np.float32), rng.normal(size=(width, 3)).astype(np.float32), rng.normal(size=3).astype(np.float32))
    block = language.windows(bytes(rng.integers(0, 256, 900, dtype=np.uint8)))
    for row, got in zip(block, net.probabilities(block), strict=True):
        hot = np.eye(256)[row]
        tops = [max((hot[k : k + w] * taps[w][:, :, f]).sum() for k in range(language.WINDOW - w + 1)) for w in language.WIDTHS for f in range(language.FILTERS)]
        logits = np.maximum(np.array(tops) + net.bias, 0) @ net.out + net.out_bias
        want = np.exp(logits - logits.max())
        assert got == pytest.approx(want / want.sum(), abs=1e-4)


def test_many_languages_are_all_learned(spark):
    rows = [(k, f"{chr(0x400 + k % 130)}a " * 20, f"l{k % 130:03d}") for k in range(400)]
    net = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_lang=50, per_doc=1)
    assert net.langs == sorted({r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2}) and len(net.langs) > 100


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "ka", None)], "doc_id long, text string, lang string")
    assert language.fit(docs) is None
    assert language.only_known(docs).collect() == docs.collect()
    assert language.predict(docs, None, ["doc_id"]).collect()[0].lang_pred == "und"
    assert language.predict(docs.limit(0), None, ["doc_id"]).count() == 0


def test_chi_square():
    assert neighbours.chi_square(neighbours.quantile(0.95, 8), 8) == pytest.approx(0.95)
    assert neighbours.quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)


def brute(rows, k):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 12 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.setdefault(i, np.array(v, float))
    out = {}
    for q in (i for i in good if i % 20 == 0):
        near = sorted((float(np.sqrt(((v - good[q]) ** 2).sum())), i) for i, v in good.items() if i != q)
        out[q] = near[:k]
    return out


@pytest.mark.parametrize("sizes", [(10**6, 10**6), (100, 60)])
def test_neighbours(spark, sizes):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 12)) * 4
    rows = [(i, (centres[i % 8] + rng.normal(size=12)).astype(np.float32).tolist()) for i in range(900)]
    common = rows[0][1]
    rows = [(i, common if i % 3 == 0 else v) for i, v in rows]
    odd = [(2000, None), (2020, [0.0] * 12), (2040, [float("nan")] * 12), (2060, [None] * 12), (2080, [1.0] * 3), (2100, []), (2120, [float("inf")] + [0.0] * 11), (None, common)]
    rows += odd + [rows[1], rows[1]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).repartition(3)
    out = neighbours.nearest(df, F.col("vec_id") % 20 == 0, 10, cell=sizes[0], block=sizes[1]).collect()
    want, got = brute(rows, 10), {}
    for r in sorted(out, key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert set(got) == set(want) and all(len(got[q]) == 10 for q in got)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q in want:
        if q % 3 == 0:
            assert got[q] == want[q]  # copies of one vector: the smaller ids first


def test_neighbours_of_few(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (20, [5.0, 2.0])], "vec_id long, embedding array<double>")
    rows = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect())
    assert rows == [(0, 1, 1, 0.0), (0, 2, 20, 4.0), (20, 1, 0, 4.0), (20, 2, 1, 4.0)]
    assert neighbours.nearest(df.limit(0), F.lit(True)).count() == 0


def test_neighbours_of_repeated_ids(spark):
    rows = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (5, [0.0, 1.0]), (20, [1.0, 1.0]), (7, [3.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect()
    assert sorted((r["rank"], r.vec_id) for r in found) == [(1, 5), (2, 7)]


MEDIA = [(0, "abc"), (1, None), (2, ""), (3, "é" * 96), (4, "x" * 193), (5, "abc"), (-7, "trailing  "), (None, "no id"), (8, "l" * 300_000), (8, "l" * 300_000)]


def test_png():
    for raw in (b"", b"a", b"\0" * 192, bytes(range(256)) * 9):
        data = media.to_png(raw)
        payload, n = media.from_png(data)
        assert n == len(raw) and payload[:n] == raw and len(payload) % 192 == 0 and len(payload) >= 192 and set(payload[n:]) <= {32}
        with pytest.raises((ValueError, KeyError)):
            media.from_png(data[:-20] + bytes([data[-20] ^ 1]) + data[-19:])


def test_media(spark, monkeypatch):
    folder = new_path(spark, "m")
    docs = spark.createDataFrame([(i, t, b"z") for i, t in MEDIA], "doc_id long, text string, media binary").repartition(3)
    n = media.write_archives(docs, folder)
    paths = sorted(Path(folder.removeprefix("file://")).glob("*.zip"))
    assert n == len(paths)
    assert sorted(x for p in paths for x in zipfile.ZipFile(p).namelist()) == sorted(media.member_name(i) for i, _ in MEDIA)
    assert all(zipfile.ZipFile(p).testzip() is None for p in paths)
    (paths[0].parent / "left-over.zip").write_bytes(b"not named")
    rows = media.features(media.read_archives(spark, folder, splitBytes=500, batchBytes=200)).collect()
    assert len(rows) == len(MEDIA)
    for r in rows:
        raw = (next(t for i, t in MEDIA if i == r.doc_id) or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
        stored = media.to_png(raw)
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(stored), hashlib.sha256(stored).hexdigest(), media.feature(payload))
    with pytest.raises(ValueError, match="integer"):
        media.write_archives(docs.selectExpr("cast(doc_id AS string) AS doc_id", "text"), folder)
    empty = new_path(spark, "m")
    media.write_archives(docs.limit(0), empty)
    assert media.read_archives(spark, empty).count() == 0


def test_media_damage(spark):
    folder = new_path(spark, "m")
    docs = spark.createDataFrame([(k, "text %d" % k) for k in range(20)], "doc_id long, text string").coalesce(1)
    media.write_archives(docs, folder)
    (path,) = Path(folder.removeprefix("file://")).glob("*.zip")
    info = zipfile.ZipFile(path).infolist()[7]
    raw = bytearray(path.read_bytes())
    raw[info.header_offset + 70] ^= 255
    path.write_bytes(raw)
    rows = media.read_archives(spark, folder, onError="row", retries=1).collect()
    assert [r.member for r in rows if r.media is None] == [media.member_name(7)] and len(rows) == 20
    assert all(r.error is None for r in rows if r.media is not None)
    with pytest.raises(Exception, match="damaged"):
        media.read_archives(spark, folder, retries=1).collect()


def test_member_is_read_again(tmp_path, monkeypatch):
    import pyarrow.fs

    archive = media._Archive(pyarrow.fs.LocalFileSystem(), str(tmp_path / "a.zip"))
    for k in range(5):
        archive.add(media.member_name(k).encode(), b"data %d" % k)
    archive.close()
    (tmp_path / "archives.json").write_text(f'[["a.zip", 5, {archive.at}]]')
    reader = media.ArchiveReader({"path": f"file://{tmp_path}", "retries": "2"})
    (part,) = reader.partitions()
    calls, real = [], media.ArchiveReader.member

    def flaky(self, fs, path, entry, name):
        calls.append(entry[16])
        if len(calls) == 1:
            raise OSError("lost")
        return real(self, fs, path, entry, name)

    monkeypatch.setattr(media.ArchiveReader, "member", flaky)
    monkeypatch.setattr(media.time, "sleep", lambda s: None)
    real_checked = media.ArchiveReader.checked
    once = []

    def torn(block, entry, name):
        if entry[16] and not once:
            once.append(1)
            raise OSError("torn")
        return real_checked(block, entry, name)

    monkeypatch.setattr(media.ArchiveReader, "checked", staticmethod(torn))
    (batch,) = reader.read(part)
    assert batch.column("media").to_pylist() == [b"data %d" % k for k in range(5)] and len(calls) == 2 and len(set(calls)) == 1
