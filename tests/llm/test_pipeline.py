"""The pipeline against a brute-force version of each of its stages."""

import collections
import hashlib
import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from test_copies import Groups, jaccard
from test_native import filled

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from sievespark.llm import language, mixing, passages  # noqa: E402

SYLLABLES = {"aa": ["ka", "to", "mi", "re", "zu", "lo"], "bb": ["schu", "ung", "ßer", "ich", "wä", "tzt"]}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, lang, n):
    return ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(3, 6))) for _ in range(n)]


def corpus(rng):
    rows, stock = [], {lang: words(rng, lang, 70) for lang in SYLLABLES}
    for k in range(160):
        lang = rng.choice(list(SYLLABLES))
        text = words(rng, lang, rng.choice([6, 60, 150]))
        if rng.random() < 0.25:
            text += stock[lang]
        rows.append((3 * k, text, lang, rng.choice(["x", "y", "z", None])))
        for c in range(rng.choice([0, 0, 1, 2])):  # copies, and copies with a word changed
            again = list(text)
            if c:
                again[len(again) // 3] = words(rng, lang, 1)[0]
            rows.append((3 * k + c + 1, again, lang, rng.choice(["x", "y"])))
    rows += [(900, ["12", "34"], "aa", "x"), (901, [], "aa", None), (902, ["!"] * 80, None, "y")]
    return [(i, None if i == 901 else " ".join(t), lang, s, 0 if i == 901 else len(" ".join(t))) for i, t, lang, s in rows]


def brute_languages(rows, net):
    kept = []
    for row in rows:
        if row[1] is None or not any(c.isalpha() for c in row[1]):
            continue
        data = row[1].encode()
        parts = language.windows(data)
        chance = [net.probabilities(p[None])[0] for p in parts]
        weights = [language.WINDOW] * (len(parts) - 1) + [max(1, len(data) - (len(parts) - 1) * (language.WINDOW - language.OVERLAP))]
        mean = sum(np.array(c, float) * w for c, w in zip(chance, weights, strict=True)) / sum(weights)
        if mean.max() >= 0.5:
            kept.append(row)
    return kept


def brute_copies(rows):
    same, split = Groups(), [(r[1] or "").lower().split() for r in rows]
    for a in range(len(rows)):
        for b in range(a):
            if split[a] == split[b] or split[a] and split[b] and jaccard(split[a], split[b]) >= 0.8:
                same.join(rows[a][0], rows[b][0])
    return [r for r in rows if same.find(r[0]) == r[0]]


def brute_passages(rows):
    """Every 45 words in a row that an earlier text has too: what a paragraph of fifty shares without its unequal ends."""
    cut, seen = {}, set()
    for row in sorted(rows):
        split = (row[1] or "").split()
        runs = {k: tuple(split[k : k + 45]) for k in range(len(split) - 44)} if len(split) >= 50 else {}
        marks = np.zeros(len(split), bool)
        for k, run in runs.items():
            if run in seen:
                marks[k : k + 45] = True
        seen.update(runs.values())
        edges = np.flatnonzero(np.diff(np.concatenate([[False], marks, [False]]).astype(int))).reshape(-1, 2).tolist()
        cut[row[0]] = passages.cut(row[1], [tuple(e) for e in edges]) if edges else row[1]
    return [(r[0], cut[r[0]], *r[2:]) for r in rows if cut[r[0]] == r[1] or cut[r[0]].split()]


def brute_mix(rows):
    size = {r[0]: len((r[1] or "").split()) for r in rows}
    total = collections.Counter()
    for r in rows:
        total[r[3]] += size[r[0]]
    target, out = filled(total, mixing.WEIGHTS, mixing.CAP), []
    for source in total:
        budget = round(target[source])
        passes, rest = divmod(budget, max(total[source], 1))
        at = 0
        for r in sorted((r for r in rows if r[3] == source), key=lambda r: hashlib.md5(f"{mixing.SEED}:{r[0]}".encode()).hexdigest()):
            out += [r] * (passes + (at < rest))
            at += size[r[0]]
    return out


def test_pipeline_by_brute_force(spark, tmp_path):
    rows = corpus(random.Random(41))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    steps = [rows]
    steps.append(brute_languages(rows, language.fit(docs)))
    steps.append(brute_copies(steps[-1]))
    steps.append(brute_passages(steps[-1]))
    steps.append(brute_mix(steps[-1]))
    assert len(rows) > len(steps[1]) > len(steps[2]) + 20 and sum(a[1] != b[1] for a, b in zip(sorted(steps[2]), sorted(steps[3]), strict=False)) > 5
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(docs.collect(), SCHEMA)
        assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=str) == sorted(((r[0], r[1]) for r in steps[k + 1]), key=str)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.decoded_crc32) for r in out) == sorted((r[0], zlib.crc32((r[1] or "").encode())) for r in steps[-1])


def test_stages_on_odd_tables(spark):
    """Nulls in any column, clashing names, repeated rows, a long text, no rows: each stage has its result."""
    long = " ".join(words(random.Random(1), "aa", 20_000))
    rows = [(1, "ka to mi", "aa", "x", 8), (1, "ka to mi", "aa", "x", 8), (None, "schu ung", "bb", None, None), (2, None, None, None, None), (3, "", "aa", "x", 0), (4, long, "aa", "y", len(long)), (5, long + " lo", None, "y", 1)]
    names = ["score", "key", "print", "hash", "keys", "node", "id", "ids", "size", "taken", "place", "start", "__gone", "__text", "__letters", "tie"]
    df = spark.createDataFrame([(*r, *[k for k in range(len(names))]) for r in rows], SCHEMA + ", " + ", ".join(f"`{n}` int" for n in names)).repartition(2)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, "")
        assert out.columns == df.columns
        assert {tuple(r)[5:] for r in out.collect()} <= {tuple(range(len(names)))}
        assert stage(spark, df.limit(0), "").count() == 0
    near = {r.doc_id for r in corpus_pipeline.no_near_copies(spark, df, "").collect()}
    assert near == {1, None, 2, 4}
    assert corpus_pipeline.encoded(spark, df, "").count() == len(rows)


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="needs the test tables")
def test_reruns_agree(spark):
    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = corpus_pipeline.run(spark, data).collect()
    assert out and {r.doc_id for r in out} <= {r.doc_id for r in docs.select("doc_id").collect()}
    assert all(r.exact and r.n_pieces == len(r.ids) for r in out)
    again = corpus_pipeline.run(spark, data).collect()
    assert sorted((r.doc_id, r.ids_crc32) for r in out) == sorted((r.doc_id, r.ids_crc32) for r in again)
