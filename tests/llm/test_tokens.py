"""Token files, token counts, piece encoding."""

import random
import string
import zlib

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
public = pytest.importorskip("public_tokenizers")

from sievespark.llm import pieces, token_counts, token_files  # noqa: E402
from sievespark.llm._shared import new_path  # noqa: E402
from sievespark.llm._tokens import PieceCounts, WordIds  # noqa: E402

WORDS, MODEL = public.path("word_bpe_49k.json"), public.path("piece_bpe_32k.model")
PARTS = ["a", "B", "é", "É", "ß", " ", "\n", "\t", "  ", ".", "'s", "'re", "1", "12", "́", "İ", "Σ", "<|endoftext|>", " ", "\x1c", "　", "漢", "x.", "Q!", "<s>", "▁", "\r", "the", "--", "|", "🙂", "‍", "ﬀ"]
ODD = ["", " ", "  ", "a  b", " a", "a ", "▁", "\n", "a\n\nb", "🙂" * 50, "x" * 3000, "a▁b", " lead  trail  ", "the The THE.", "l'été, où?"]


def texts(n=3000, seed=1):
    rng = random.Random(seed)
    return ODD + ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(n)]


@pytest.mark.parametrize("memory", [5, 10**6])
def test_words_are_the_librarys(memory):
    own, library = WordIds(WORDS, memory, 2 * memory), tokenizers.Tokenizer.from_file(WORDS)
    some = texts()
    for k in range(0, len(some), 50):
        got = own.encode(some[k : k + 50])
        want = library.encode_batch_fast(some[k : k + 50], add_special_tokens=False)
        assert [np.frombuffer(g, own.dtype).tolist() for g in got] == [w.ids for w in want]


def test_added_tokens_keep_their_case():
    own, library = WordIds(WORDS), tokenizers.Tokenizer.from_file(WORDS)
    for text in ["<|ENDOFTEXT|> <|EndOfText|>", "a<|endoftext|>B <|endoftext|>", "<|STARTOFTEXT|>x. A<|EndOfText|>b", "<|endoftext|> <|ENDOFTEXT|>"]:
        assert np.frombuffer(own.encode([text])[0], own.dtype).tolist() == library.encode(text, add_special_tokens=False).ids


class Counted:
    """A tokenizer that notes the words it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.given = tokenizer, []

    def encode_batch_fast(self, texts, **options):
        self.given += " ".join(texts).split()
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_marks_and_capitals_cost_no_encoding():
    own, library = WordIds(WORDS), tokenizers.Tokenizer.from_file(WORDS)
    own.tokenizer = Counted(own.tokenizer)
    marks = [*string.punctuation, "***", "&&&", ".'"]
    for text in [w + m for w in ("straße", "Straße", "abend", "ABEND") for m in ("", *marks)]:
        assert np.frombuffer(own.encode([text])[0], own.dtype).tolist() == library.encode(text, add_special_tokens=False).ids
    assert sorted(own.tokenizer.given) == sorted(["straße", "abend", *marks])


@pytest.mark.parametrize("memory", [5, 10**6])
def test_words_put_together_are_the_librarys(memory):
    own, library, rng = WordIds(WORDS, memory, 2 * memory), tokenizers.Tokenizer.from_file(WORDS), random.Random(11)
    parts = [*string.punctuation, *"aZÀÖ×ØßàöÞ÷øÿµª²Āſ", "\u0301", "\u0338", "the", "'S", "'ll", " ", "\n", "7", "\0", "\x7f", "\x85", "<|endoftext|>", "<|EndOfText|>"]
    some = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(6000)]
    for k in range(0, len(some), 100):
        got, want = own.encode(some[k : k + 100]), library.encode_batch_fast(some[k : k + 100], add_special_tokens=False)
        assert [np.frombuffer(g, own.dtype).tolist() for g in got] == [w.ids for w in want]
    assert own.encode([]) == [] and own.encode(["", " \n "]) == [b"", b""]


@pytest.mark.parametrize("memory", [5, 10**6])
def test_counts_are_the_librarys(memory):
    own, library = PieceCounts(MODEL, memory), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    some = texts()
    assert own.by_word
    for k in range(0, len(some), 50):
        assert own.count(some[k : k + 50]) == [len(x) for x in library.encode(some[k : k + 50])]


DOCS = [(k, t) for k, t in enumerate(texts(200, 3))] + [(1000, None), (-5, "minus"), (7, "twice"), (7, "twice"), (None, "no id")]


def docs(spark):
    rows = [(i, t, "x", 1) for i, t in DOCS]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string, digest string, n_tokens long").repartition(4)


def test_token_files(spark):
    folder = new_path(spark, "t")
    manifest = token_files.write_ids(docs(spark), WORDS, folder)
    rows = token_files.read_ids(manifest, folder).collect()
    library = tokenizers.Tokenizer.from_file(WORDS)
    want = sorted((-(10**9) if i is None else i, np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")) for i, t in DOCS if i != 7)
    seven = np.array([*library.encode("twice", add_special_tokens=False).ids, 1], "<u4")
    other = np.array([*library.encode(DOCS[7][1], add_special_tokens=False).ids, 1], "<u4")
    got = sorted(rows, key=lambda r: r.start)
    assert [-(10**9) if r.doc_id is None else r.doc_id for r in got] == sorted([i for i, _ in want] + [7] * 3)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    crc = {i: zlib.crc32(x.tobytes()) for i, x in want}
    for r in got:
        if r.doc_id == 7:
            assert r.ids_crc32 in (zlib.crc32(seven.tobytes()), zlib.crc32(other.tobytes()))
        else:
            assert r.ids_crc32 == crc[-(10**9) if r.doc_id is None else r.doc_id]


def test_token_files_of_nothing(spark):
    folder = new_path(spark, "t")
    assert token_files.read_ids(token_files.write_ids(docs(spark).limit(0), WORDS, folder), folder).count() == 0


def test_token_counts_and_their_cache(spark):
    cache, library = new_path(spark, "c"), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for _ in range(2):
        out = token_counts.count_tokens(docs(spark), MODEL, cache)
        assert out.columns == ["doc_id", "text", "digest", "n_bytes", "n_tokens"]
        rows = out.collect()
        assert len(rows) == len(DOCS)
        for r in rows:
            assert r.n_tokens == len(library.encode(r.text or "")) and r.n_bytes == len((r.text or "").encode())
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for _, t in DOCS})
    assert token_counts.count_tokens(docs(spark).limit(0), MODEL, new_path(spark, "c")).count() == 0


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """The same pieces declared unigram, without the scores that single precision cannot add: the library's Viterbi."""
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = pb.ModelProto()
    model.ParseFromString(open(MODEL, "rb").read())
    model.trainer_spec.model_type = 1
    for piece in model.pieces:
        piece.score = max(piece.score, -40000.0)
    path = tmp_path_factory.mktemp("m") / "u.model"
    path.write_bytes(model.SerializeToString())
    return str(path)


def test_viterbi_is_the_librarys(unigram):
    own, library = pieces.Pieces(unigram), sentencepiece.SentencePieceProcessor(model_file=unigram)
    rng = random.Random(5)
    some = [" ".join("".join(rng.choice(["a", "b", "the", "in", "Z", "é", "x", "ou", ".", "1", "tion", "er"]) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 8))) for _ in range(3000)]
    for text, ids, want in zip(some, own.encode(some), library.encode(some), strict=True):
        assert np.frombuffer(ids, own.dtype).tolist() == want, text


def test_viterbi_is_best():
    own = pieces.Pieces(MODEL)
    scores = {p: s for p, s in ((w[0], w[2]) for w in own.automaton.values())}
    names = {w: v for w, v in own.automaton.items()}
    for text in ("▁theon", "▁inre", "▁shation", "▁aé.tion"):
        best = [0.0] + [float("-inf")] * len(text)
        for e in range(1, len(text) + 1):
            for s in range(e):
                if text[s:e] in names:
                    best[e] = max(best[e], best[s] + names[text[s:e]][2])
        ids, score = own.viterbi(text)
        assert score == best[-1] and sum(scores[i] for i in ids) == score


@pytest.mark.parametrize("memory", [3, 10**6])
def test_words_alone_give_the_whole(memory):
    own, whole = pieces.Pieces(MODEL, memory), pieces.Pieces(MODEL)
    some = texts(400)
    for k in range(0, len(some), 20):
        for text, ids in zip(some[k : k + 20], own.encode(some[k : k + 20]), strict=True):
            want, best = whole.viterbi(pieces.SPACE + text.replace(" ", pieces.SPACE) if text else "")
            assert np.frombuffer(ids, own.dtype).tolist() == want and own.score(ids) == pytest.approx(best)
            assert own.decode(ids).decode() == text.replace(pieces.SPACE, " ")


def test_encode(spark):
    rows = pieces.encode(docs(spark), MODEL, ["doc_id", "text"], with_ids=True).collect()
    assert len(rows) == len(DOCS)
    for r in rows:
        text = r.text or ""
        assert r.exact == (pieces.SPACE not in text) and r.n_pieces == len(r.ids) and r.n_bytes == len(text.encode())
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert pieces.encode(docs(spark).limit(0), MODEL, ["doc_id"]).count() == 0


def test_other_tokenizers_read_whole_texts():
    path = public.path("byte_bpe_50k.json")
    own, library = WordIds(path), tokenizers.Tokenizer.from_file(path)
    assert not own.by_word and WordIds(WORDS).by_word
    some = texts(300, 7) + ["Hello World"]
    for text, code in zip(some, own.encode(some), strict=True):
        assert np.frombuffer(code, own.dtype).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("kind", ["int", "string"])
def test_token_files_are_in_order_of_ids(spark, kind):
    ids = [1, 2, 9, 10, 11, 100, -3]
    folder = new_path(spark, "t")
    df = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string").selectExpr(f"cast(doc_id AS {kind}) AS doc_id", "text").repartition(3)
    rows = sorted(token_files.read_ids(token_files.write_ids(df, WORDS, folder), folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted(map(str, ids) if kind == "string" else ids)


def test_encode_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", 5, True, 9, "t", [1]), (1, "a b", 5, True, 9, "t", [1]), (2, "x " * 50_000, 0, None, 0, None, None)], "doc_id long, text string, score int, exact boolean, n_bytes int, __text string, ids array<int>")
    out = pieces.encode(df, MODEL, df.columns, with_ids=True)
    rows = out.orderBy("doc_id").collect()
    assert sorted(out.columns) == sorted(["doc_id", "text", "__text", "n_bytes", "n_pieces", "ids_crc32", "score", "exact", "decoded_crc32", "ids"])
    assert [r.n_bytes for r in rows] == [3, 3, 100_000] and all(r.exact for r in rows)
