"""Golay codes, SimHash groups, near copies, repeated passages."""

import random
import re

import numpy as np
import pyarrow as pa
import xxhash

from sievespark.llm import golay, passages, simhash
from sievespark.llm._shared import components

VOCABULARY = [f"w{k:05d}" for k in range(20000)]


class Groups(dict):
    def find(self, a):
        while self.setdefault(a, a) != a:
            a = self[a]
        return a

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def prose(rng, n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def test_golay():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 3000).astype(np.uint32)
    near = lambda x: [set(a[m].tolist()) for a, m in zip(*golay.indices(x), strict=True)]
    own = near(words)
    assert {len(s) for s in own} == {1, 6}
    for flips in (1, 2):
        other = words.copy()
        for k in range(len(words)):
            for bit in rng.choice(23, flips, replace=False):
                other[k] ^= np.uint32(1 << int(bit))
        assert all(a & b for a, b in zip(own, near(other), strict=True))
    assert golay.indices(np.zeros(0, np.uint32))[0].shape == (0, 6)


def test_components(spark):
    rng, edges, want = random.Random(2), [], Groups()
    chain = list(range(100, 160))
    edges += list(zip(chain, chain[1:], strict=False)) + [(1000, k) for k in range(1001, 1200)] + [(5, 5), (7, 8), (8, 7)]
    edges += [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(150)]
    for a, b in edges:
        want.join(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: want.find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_print(text):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    parts = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def copies(rng):
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "One"), (4, "one two"), (5, "ONE  two"), (6, "É é"), (None, "one two"), (9, "x" * 50_000)]
    rows += [(10, "a b c"), (10, "a b c"), (11, "A B\x0bC")]
    for k in range(12):
        base = prose(rng, rng.choice([8, 60, 400]))
        for c in range(rng.randint(1, 6)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                text[rng.randrange(len(text))] = rng.choice(VOCABULARY)
            rows.append((100 + 10 * k + c, " ".join(text)))
    return rows


def test_simhash_groups(spark):
    rows = copies(random.Random(3))
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, print long").repartition(3)
    out = simhash.groups(docs).collect()
    prints = [brute_print(t) for _, t in rows]
    want = Groups()
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                want.join(a, b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[want.find(k)] = min(least.get(want.find(k), i), i)
    expected = sorted((str(i), prints[k], least[want.find(k)]) for k, (i, _) in enumerate(rows))
    assert sorted((str(r.doc_id), r.print & (2**64 - 1), r.component_id) for r in out) == expected
    assert simhash.groups(docs.limit(0)).count() == 0


def test_links_of_crowded_keys(spark):
    rng, prints = random.Random(4), set()
    for centre in (rng.getrandbits(64) for _ in range(12)):
        for _ in range(50):
            value = centre
            for bit in rng.sample(range(64), rng.randint(0, 4)):
                value ^= 1 << bit
            prints.add(value - (1 << 64) if value >> 63 else value)
    got, want = Groups(), Groups()
    for r in simhash.links(spark.createDataFrame([(p,) for p in prints], "print long")).collect():
        assert ((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 2
        got.join(r.a, r.b)
    listed = sorted(prints)
    for k, a in enumerate(listed):
        for b in listed[:k]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                want.join(a, b)
    assert all(got.find(p) == want.find(p) for p in listed)


def jaccard(a, b):
    sets = [{tuple(x[k : k + 5]) for k in range(max(1, len(x) - 4))} for x in (a, b)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_near_copies(spark):
    rng, rows, want, k = random.Random(5), [], Groups(), 0
    for _ in range(40):
        base = prose(rng, rng.choice([30, 120, 500]))
        group = []
        for c in range(rng.randint(1, 4)):
            text = list(base)
            if c:
                for _ in range(rng.choice([0, 1, len(base) // 60, len(base) // 12])):
                    text[rng.randrange(len(text))] = rng.choice(VOCABULARY)
            group.append((k, text))
            k += 1
        rows += group
    for a in range(len(rows)):
        for b in range(a):
            if jaccard(rows[a][1], rows[b][1]) >= 0.8:
                want.join(rows[a][0], rows[b][0])
    extra = [(9000, None), (9001, ""), (None, " ".join(rows[0][1])), (9002, "alone"), (9003, "Alone"), (9003, "Alone")]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows] + extra, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.kept_id for r in simhash.near_copies(docs).collect()}
    expected = {i: want.find(i) for i, _ in rows if want.find(i) != i} | {9001: 9000, 9003: 9002}
    assert set(got) <= set(expected) and len(got) >= 0.97 * len(expected)
    assert all(expected[i] == kept for i, kept in got.items())
    kept = simhash.without_near_copies(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() - len(got) - 1
    assert simhash.near_copies(docs.limit(0)).count() == 0


def test_near_copies_of_one_base(spark):
    """Versions of one base that are often too far from both pivots of a key; brute force links them all."""
    rng = random.Random(2)
    base, rows, want = prose(rng, 200), [], Groups()
    for k in range(200):
        text = list(base)
        for at in rng.sample(range(200), rng.randint(1, 4)):
            text[at] = rng.choice(VOCABULARY)
        rows.append((k, text))
    sets = [{tuple(w[k : k + 5]) for k in range(196)} for _, w in rows]
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                want.join(a, b)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.kept_id for r in simhash.near_copies(docs).collect()}
    assert got == {i: want.find(i) for i, _ in rows if want.find(i) != i}


def test_rows_of_a_large_group_of_versions(spark, monkeypatch):
    """Rows grow with the members of a group, however many keys they share, and no link is lost, also where a key takes several blocks."""
    rng, written, made = random.Random(8), simhash.written, {}

    def counted(df, name):
        out = written(df, name)
        made[name] = out.count()
        return out

    base, texts, want = prose(rng, 200), [], Groups()
    for _ in range(240):
        text = list(base)
        for at in rng.sample(range(200), rng.randint(2, 9)):
            text[at] = rng.choice(VOCABULARY)
        texts.append(text)
    sets = [{tuple(w[k : k + 5]) for k in range(196)} for w in texts]
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                want.join(a, b)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(3)
    monkeypatch.setattr(simhash, "written", counted)
    for block in (simhash.BLOCK, 32):
        monkeypatch.setattr(simhash, "BLOCK", block)
        got = {r.doc_id: r.kept_id for r in simhash.near_copies(docs).collect()}
        assert got == {i: want.find(i) for i in range(len(texts)) if want.find(i) != i} and 20 < len(got) < 230
        assert made["shared"] > 10 * len(texts) and made["pairs"] <= len(texts)


def test_links_of_a_cell():
    """A cell whose documents are all alike and not linked yet gives a link a document, not one a pair."""
    n, same = 60, np.arange(50, dtype=np.int32)

    def links(rows):
        rows = [{"id": i, "key": 7, "root": i, "i": 0, "j": 0, "kind": kind, "shingles": same.tolist()} for i, kind in rows]
        types = [("id", pa.int64()), ("key", pa.int64()), ("root", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("kind", pa.int32()), ("shingles", pa.list_(pa.int32()))]
        batches = pa.Table.from_pylist(rows, pa.schema(types)).to_batches(max_chunksize=25)
        return [pair for out in simhash._met(0.8)(iter(batches)) for pair in zip(*(out.column(c).to_pylist() for c in "ab"), strict=True)]

    for rows in ([(i, kind) for kind in (0, 1) for i in range(n)], [(i, 2) for i in range(n)]):
        got, joined = links(rows), Groups()
        for a, b in got:
            joined.join(a, b)
        assert len(got) == n - 1 and {joined.find(i) for i in range(n)} == {0}


def test_members_of_another_block():
    """A document that is no member itself: its shingles that no member holds count for none."""
    rng = np.random.default_rng(3)
    base = rng.choice(5000, 60, replace=False)
    sets = [np.unique(np.concatenate([base[rng.random(60) < 0.9], rng.choice(5000, 6)])).astype(np.int32) for _ in range(40)]
    for own in sets[20:]:
        want = [i for i in range(20) if len(np.intersect1d(sets[i], own)) >= 0.75 * len(np.union1d(sets[i], own))]
        assert simhash._Members(list(range(20)), list(range(20)), sets[:20]).alike(own, 99, 0.75) == want


def planted(rng):
    rows, want, n = [], {}, 0
    for _ in range(25):
        size = rng.choice([50, 51, 55, 75, 120])
        passage, first = prose(rng, size), None
        for _ in range(rng.randint(2, 4)):
            base = prose(rng, rng.randrange(10, 300))
            at = rng.randint(0, len(base))
            rows.append((n, base[:at] + passage + base[at:]))
            if first is None:
                first = n
            else:
                want[n] = (at, at + size, first)
            n += 1
    line = prose(rng, 12)  # common, but short
    for _ in range(40):
        base = prose(rng, 200)
        rows.append((n, base[:100] + line + base[100:] + line))
        n += 1
    return rows, want


def test_repeats(spark):
    rng = random.Random(6)
    rows, want = planted(rng)
    whole = prose(rng, 90)
    twins = [(5000, whole), (5001, whole), (5001, whole), (5002, ["Short", "copy"]), (5003, ["short", "copy"])]
    inner = prose(rng, 60)
    rows += [(6000, prose(rng, 30) + inner + prose(rng, 30) + inner)]  # within one document only
    text = [(i, " ".join(w)) for i, w in rows + twins] + [(7000, None), (7001, ""), (None, " ".join(whole))]
    docs = spark.createDataFrame([(i, t, 0) for i, t in text], "doc_id long, text string, hash int").repartition(3)
    got = {r.doc_id: (r.start, r.stop, r.kept_id) for r in passages.repeats(docs).collect()}
    assert got == want | {5001: (0, 90, 5000)}
    out = {r.doc_id: r.text for r in passages.without_repeats(docs.where("doc_id IS NOT NULL AND doc_id <> 5001")).collect()}
    for i, w in rows:
        a, b, _ = want.get(i, (0, 0, 0))
        assert out[i].split() == w[:a] + w[b:]
    assert out[7000] is None and out[7001] == "" and 5000 in out
    assert 5001 not in {r.doc_id for r in passages.without_repeats(docs).collect()}
    assert passages.repeats(docs.limit(0)).count() == 0


def test_repeats_behind_a_common_line(spark):
    """The line's first document shares only the line; the passage around it is found all the same."""
    rng = random.Random(8)
    line, rows, want = prose(rng, 10), [], {}
    rows.append((0, prose(rng, 80) + line + prose(rng, 80)))
    for k in range(20):
        passage = prose(rng, 20) + line + prose(rng, 20)
        for c in range(2):
            head = prose(rng, 40)
            rows.append((1 + 2 * k + c, head + passage + prose(rng, 40)))
        want[2 + 2 * k] = (40, 90, 1 + 2 * k)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    assert {r.doc_id: (r.start, r.stop, r.kept_id) for r in passages.repeats(docs).collect()} == want


def test_edited_passage(spark):
    rng = random.Random(9)
    passage = prose(rng, 160)
    edited = list(passage)
    edited[80] = "edited"
    docs = spark.createDataFrame([(1, " ".join(prose(rng, 50) + passage)), (2, " ".join(prose(rng, 70) + edited + prose(rng, 9)))], "doc_id long, text string")
    (row,) = passages.repeats(docs).collect()
    assert (row.doc_id, row.start, row.stop, row.kept_id, row.component_id) == (2, 70, 230, 1, 1)


def test_passage_with_a_word_more_or_less(spark):
    rng, rows, want = random.Random(21), [], {}
    for k in range(20):
        size = rng.choice([60, 75])
        passage = prose(rng, size)
        edited = passage[: size // 2] + (["more"] + passage[size // 2 :] if k % 2 else passage[size // 2 + 1 :])
        at, head = rng.randrange(30, 60), rng.randrange(30, 60)
        rows += [(2 * k, prose(rng, at) + passage + prose(rng, 50)), (2 * k + 1, prose(rng, head) + edited + prose(rng, 50))]
        want[2 * k + 1] = (head, head + len(edited), 2 * k)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    assert {r.doc_id: (r.start, r.stop, r.kept_id) for r in passages.repeats(docs).collect()} == want


def test_near_passages_behind_their_shingles(spark):
    """The first document holds every shingle of the passages, but no paragraph of them; only later ones are alike."""
    rng = random.Random(22)
    rows, want, first = [], {}, []
    for k in range(20):
        passage = prose(rng, 60)
        first += [w for at in range(0, 55, 5) for w in passage[at : at + 10] + prose(rng, 3)]
        edited = list(passage)
        edited[30] = "edited"
        rows.append((1 + 2 * k, prose(rng, 40) + passage[:12] + prose(rng, 60) + passage + prose(rng, 40)))
        rows.append((2 + 2 * k, prose(rng, 40) + edited + prose(rng, 40)))
        want[2 + 2 * k] = (40, 100, 1 + 2 * k)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in [(0, first), *rows]], "doc_id long, text string")
    assert {r.doc_id: (r.start, r.stop, r.kept_id) for r in passages.repeats(docs).collect()} == want


def test_cut():
    assert passages.cut("a  b c\nd e", [(1, 3)]) == "a  d e"
    assert passages.cut("a b", [(0, 2)]) == "" and passages.cut("a b", [(5, 9)]) == "a b"


def brute_repeats(rows):
    """Words of each text that are in a paragraph of fifty with a Jaccard similarity of 0.8 or more to one of an earlier text."""
    out = {}
    for b, (name, words) in enumerate(rows):
        gone = np.zeros(len(words), bool)
        for _, other in rows[:b]:
            n, m = len(words) - 49, len(other) - 49
            if n <= 0 or m <= 0:
                continue
            own, theirs = ([hash(tuple(w[k : k + 5])) for k in range(len(w) - 4)] for w in (words, other))
            same = np.zeros((len(own) + 1, len(theirs) + 1), np.int64)
            same[1:, 1:] = (np.array(own)[:, None] == np.array(theirs)).cumsum(axis=0).cumsum(axis=1)
            common = same[46:, 46:] - same[:-46, 46:] - same[46:, :-46] + same[:-46, :-46]
            for k in np.flatnonzero((common >= 0.8 * (92 - common)).any(axis=1)):
                gone[k : k + 50] = True
        out[name] = gone
    return out


def test_repeats_by_brute_force(spark):
    """Passages with edits, behind lines that more documents share, whose first document holds the line only."""
    rng, rows = random.Random(31), []
    lines = [prose(rng, n) for n in (8, 20, 30, 40)]
    stock = [prose(rng, rng.choice([50, 56, 70, 110])) for _ in range(6)]
    stock += [prose(rng, 12) + line + prose(rng, 14) for line in lines]
    rows += [(k, prose(rng, 60) + line + prose(rng, 50)) for k, line in enumerate(lines)]
    for k in range(70):
        text = prose(rng, rng.randint(20, 60))
        for passage in rng.sample(stock, rng.randint(0, 2)):
            passage = list(passage)
            for _ in range(rng.choice([0, 1, 1, 2])):
                at, kind = rng.randrange(len(passage)), rng.randrange(3)
                passage[at : at + (kind != 1)] = [rng.choice(VOCABULARY)] * (kind != 2)
            text += passage + prose(rng, rng.randint(0, 40)) + rng.choice([[], rng.choice(lines)]) + prose(rng, 5)
        rows.append((10 + k, text))
    got = {name: np.zeros(len(words), bool) for name, words in rows}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(3)
    for r in passages.repeats(docs).collect():
        got[r.doc_id][r.start : r.stop] = True
        assert r.kept_id < r.doc_id
    want = brute_repeats(rows)
    for name, _ in rows:
        assert not (got[name] & ~want[name]).any()
        edges = np.flatnonzero(np.diff(np.concatenate([[False], want[name], [False]]).astype(int)))
        for start, stop in zip(edges[::2], edges[1::2], strict=True):
            assert got[name][start + 10 : stop - 10].all(), (name, start, stop)
    assert sum(w.any() for w in want.values()) > 30


def test_repeats_defined_for_odd_rows(spark):
    rng = random.Random(32)
    passage, other = prose(rng, 60), prose(rng, 200)
    long = prose(rng, 30_000) + passage
    once = " ".join(prose(rng, 30) + passage + prose(rng, 30))
    rows = [(1, once, 0), (1, " ".join(other), 0), (2, " ".join(long), 0), (3, once + " tail", 0), (3, once + " tail", 0), (4, "x" * 300_000, 0), (5, None, 0), (None, once, 0), (6, "", 0)]
    rows += [(7, " ".join(["stop"] * 80), 0), (8, " ".join(prose(rng, 20) + ["stop"] * 300), 0), (9, " ".join(["again", "and"] * 40), 0), (10, " ".join(["and", "again"] * 30), 0)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, start int").repartition(3)
    found = passages.repeats(docs).collect()
    got = {(r.doc_id, r.start, r.stop) for r in found}
    # the texts under doc_id 1 are documents of their own, whose order is free
    assert {g for g in got if g[0] not in (1, 2, 3)} == {(8, 20, 320), (10, 0, 60)}
    assert all(stop - start >= 60 for i, start, stop in got if i in (1, 2, 3)) and len({g[0] for g in got} & {1, 2, 3}) == 2
    kept = passages.without_repeats(docs)
    assert kept.columns == docs.columns
    texts = [r.text for r in kept.where("doc_id = 1").collect()]
    assert " ".join(other) in texts
    assert passages.without_repeats(docs.limit(0)).count() == 0
