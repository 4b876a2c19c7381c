"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import fresh, small_batches
from ._tokens import MEMORY, chunks, once

#: SentencePiece's mark of a space, and what an unknown character scores below the worst piece.
SPACE, PENALTY = "▁", 10.0
#: Longer words are encoded each time.
REMEMBERED = 64

_spans = re.compile(f"{SPACE}+[^{SPACE}]*")


class Pieces:
    """The pieces of a sentencepiece model as a unigram language model over their scores.

    A text is encoded as the segmentation of the greatest total score, ties going to the longer last piece, with spaces
    as marks and one mark before the text. Characters that no piece covers alone may become their UTF-8 bytes' pieces (or
    the unknown piece, where the model has no bytes). For a model of type unigram that is the library's own encoding; one of
    type BPE gets the best-scoring segmentation of its pieces, which its merges need not find.
    """

    def __init__(self, path: str, memory: int = MEMORY * 3 // 4):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(k) for k in range(size)]
        self.unknown = model.unk_id()
        self.bytes = {int(names[k][3:5], 16): k for k in range(size) if model.is_byte(k)}
        normal = [k for k in range(size) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k))]
        self.automaton = ahocorasick.Automaton()
        for k in normal:
            self.automaton.add_word(names[k], (k, len(names[k]), model.get_score(k)))
        self.automaton.make_automaton()
        self.single = {names[k] for k in normal if len(names[k]) == 1}
        self.worst = min(model.get_score(k) for k in normal) - PENALTY
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.plain = [names[k].replace(SPACE, " ").encode() for k in range(size)]
        for value, k in self.bytes.items():
            self.plain[k] = bytes([value])
        for k in range(size):
            if model.is_control(k):
                self.plain[k] = b""
        self.plain[self.unknown] = " ⁇ ".encode()
        # no piece has a mark after another character: then no segmentation crosses the start of a word
        self.by_word = not any(SPACE in names[k].lstrip(SPACE) for k in normal)
        self.memory, self.ids = memory, {}
        # an unknown character's score stands with the first of its bytes
        self.points = np.array([model.get_score(k) for k in range(size)], np.float64)
        for value, k in self.bytes.items():
            self.points[k] = 0.0 if value & 0xC0 == 0x80 else self.worst
        self.points[self.unknown] = self.worst

    def viterbi(self, text: str) -> tuple[list[int], float]:
        """Ids and score of marked text. The automaton reports the pieces that end at each character, the longest first
        and the others by its output links; each relaxes the best score there from that at its start."""
        n = len(text)
        best, back, last = [0.0] + [0.0] * n, [0] * (n + 1), [-1] * (n + 1)
        at = 0  # characters up to here have their best score
        single, worst, low = self.single, self.worst, float("-inf")
        for end, (piece, length, score) in self.automaton.iter(text):
            while at <= end:
                known = text[at] in single
                best[at + 1], back[at + 1], last[at + 1] = low if known else best[at] + worst, at, -1
                at += 1
            start = end + 1 - length
            found = best[start] + score
            if found > best[end + 1]:
                best[end + 1], back[end + 1], last[end + 1] = found, start, piece
        while at < n:
            best[at + 1], back[at + 1], last[at + 1] = best[at] + worst, at, -1
            at += 1
        ids: list[int] = []
        while at:
            start = back[at]
            if last[at] >= 0:
                ids.append(last[at])
            elif self.bytes:
                ids += [self.bytes[b] for b in reversed(text[start:at].encode())]
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
            at = start
        return ids[::-1], best[n]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned integers of ``dtype``."""
        split = []
        for text in texts:
            words = text.split(" ") if self.by_word and SPACE not in text else [""]
            if "" in words:  # runs of spaces, or none at all
                marked = SPACE + text.replace(" ", SPACE) if text else ""
                words = _spans.findall(marked) if self.by_word else [marked]
                words = [w[1:] if w.rfind(SPACE) == 0 and len(w) > 1 else w for w in words]
            split.append(words)
        every = set().union(*split)
        missing = every.difference(self.ids)
        if len(self.ids) + len(missing) > self.memory:
            self.ids.clear()
            missing = every
        long = [w for w in missing if len(w) > REMEMBERED]
        for word in missing:
            # a word alone stands for itself after one mark; what holds marks already stands as it is
            ids, _ = self.viterbi(word if SPACE in word or not word else SPACE + word)
            self.ids[word] = np.array(ids, self.dtype).tobytes()
        out = [b"".join(map(self.ids.__getitem__, words)) for words in split]
        for word in long:
            del self.ids[word]
        return out

    def score(self, ids: bytes) -> float:
        """The segmentation's score: pieces' scores, and the penalty of unknown characters (of their runs, without bytes)."""
        return float(self.points[np.frombuffer(ids, self.dtype)].sum())

    def decode(self, ids: bytes) -> bytes:
        """The text's bytes: pieces joined, marks as spaces, without the one before the text."""
        joined = b"".join(map(self.plain.__getitem__, np.frombuffer(ids, self.dtype).tolist()))
        return joined[1:] if joined[:1] == b" " else joined


_COLUMNS = "n_bytes long, n_pieces long, ids_crc32 long, score double, exact boolean, decoded_crc32 long"


def _coded(model: str, carry: list[str], with_ids: bool, text_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = once(Pieces, model)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.int64()]
        names = [*carry, *(c.split(" ")[0] for c in _COLUMNS.split(", ")), *["ids"] * with_ids]
        for batch in batches:
            at = 0
            for some in chunks(t.as_py() or "" for t in batch.column(text_name)):  # results leave as they come
                rows, ids = [], []
                for text, code in zip(some, coder.encode(some), strict=True):
                    raw, back = text.encode(), coder.decode(code)
                    wide = np.frombuffer(code, coder.dtype)
                    rows.append((len(raw), len(wide), zlib.crc32(wide.astype("<u4").tobytes()), coder.score(code), raw == back, zlib.crc32(back)))
                    if with_ids:
                        ids.append(wide.astype(np.int32))
                part = batch.slice(at, len(some))
                at += len(some)
                out = [*(part.column(c) for c in carry), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))]
                yield pa.RecordBatch.from_arrays([*out, *([pa.array(ids, pa.list_(pa.int32()))] if with_ids else [])], names=names)

    return run


def encode(docs: DataFrame, model: str, keep: list[str], with_ids: bool = False) -> DataFrame:
    """Columns ``keep``, and of the whole text (null: empty): n_bytes (UTF-8), n_pieces, ids_crc32 (of the ids as little-endian
    unsigned 32-bit integers), score, exact (decoding the ids gives the text again), decoded_crc32, and the ids if asked.

    There is no shuffle. Decoding differs from the text only where that holds the mark of a space itself. The empty text
    has no pieces and score 0; texts may have any length; repeated rows are encoded each; a table without rows gives none.
    Columns of ``keep`` that are called like a result give way to it. For a model of type BPE the ids are those of the
    best-scoring segmentation, not those of the library's merges: a network trained with the latter needs the latter.
    """
    results = {c.split(" ")[0] for c in _COLUMNS.split(", ")} | ({"ids"} if with_ids else set())
    keep = [c for c in keep if c.lower() not in results]
    text = fresh(keep, "__text")
    rows = small_batches(docs).select(*keep, F.col("text").alias(text))
    kept = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]
    return rows.mapInArrow(_coded(model, keep, with_ids, text), ", ".join([*kept, _COLUMNS] + ["ids array<int>"] * with_ids))


def op8_piece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"])
