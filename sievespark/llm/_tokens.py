"""Exact, fast encoding of whole texts: both tokenizers here work word by word, so equal words are encoded once."""

from __future__ import annotations

import json
import os
import re
import string
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words remembered by a worker, as they stand and as stems. What is full loses its older half; results do not depend on it.
MEMORY, STEMS = 400_000, 1_200_000
#: Characters of text handled at a time, and where equal words are found by columns.
CHUNK, WIDE = 1 << 20, 1 << 22

MARKS = string.punctuation
_letters = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")


def chunks(texts: Iterable[str], limit: int = CHUNK) -> Iterator[list[str]]:
    """Lists of texts that together stay near ``limit`` characters; a longer text is alone."""
    now, size = [], 0
    for text in texts:
        if now and size + len(text) > limit:
            yield now
            now, size = [], 0
        now.append(text)
        size += len(text)
    if now:
        yield now


def drops_space(spec: dict) -> bool:
    """Whether a tokenizer (its JSON) lowers the text, drops white space and never merges across it, and marks ends of words."""
    rules, split, added = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    rules, split = rules.get("normalizers", [rules]), split.get("pretokenizers", [split])
    if [r.get("type") for r in rules] != ["NFC", "Replace", "Lowercase"] or rules[1].get("pattern") != {"Regex": r"\s+"} or rules[1].get("content") != " ":
        return False
    if [p.get("type") for p in split] != ["Split", "ByteLevel"] or split[0].get("behavior") != "Removed" or not split[0].get("invert"):
        return False
    pattern = split[0].get("pattern", {}).get("Regex", "")
    if not pattern.endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") or split[1].get("add_prefix_space") or split[1].get("use_regex"):
        return False
    model = spec.get("model", {})
    plain = not any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word", "normalized"))
    return plain and model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout") and not spec.get("post_processor") and not spec.get("truncation")


# By byte of UTF-8: whether Latin-1 letters have it (a letter beyond ASCII is 0xC3 and one more, of which 0x97 and 0xB7 are signs),
# whether it is a mark, and what it is in lower case within such letters.
_LETTER, _MARK, _LOWER = np.zeros(256, bool), np.zeros(256, bool), np.arange(256, dtype=np.uint8)
_LETTER[[*string.ascii_letters.encode(), 0xC3, *range(0x80, 0xC0)]] = True
_LETTER[[0x97, 0xB7]] = False
_MARK[[*MARKS.encode()]] = True
_LOWER[[*string.ascii_uppercase.encode(), *range(0x80, 0x9F)]] += 0x20


def _flat(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of large strings and where each begins, with the end."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    return np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])


def cut_words(texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words between spaces and line feeds, none empty, equal ones by one index; and where each text's words begin, with the end."""
    data, edges = _flat(pa.array(texts, pa.large_string()))
    gap = (data == 32) | (data == 10)
    gaps, left = np.flatnonzero(gap), data[~gap]
    edges = edges - np.searchsorted(gaps, edges)
    begins = np.zeros(len(left) + 1, bool)
    begins[gaps - np.arange(len(gaps))] = True
    begins[edges] = True
    begins[-1] = True
    offsets = np.flatnonzero(begins)
    return _strings(left, offsets).dictionary_encode(), np.searchsorted(offsets, edges)


def cut_marks(words: pa.Array, whole: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Which words are Latin-1 letters and then marks, if any; their letters in lower case; their marks.

    Other words, and those that are to stay ``whole``, have neither. No word is empty.
    """
    data, offsets = _flat(words)
    size = np.diff(offsets)
    place, first, end = np.arange(1, len(data) + 1), offsets[:-1], offsets[1:]
    last = np.maximum.accumulate(np.where(_MARK[data], 0, place))  # the end of what no mark follows
    stem = np.maximum(last[end - 1], first) if len(data) else first
    odd = np.concatenate([[0], np.cumsum(~_LETTER[data])])
    plain = (odd[stem] == odd[first]) & (stem > first) & ~whole
    in_stem = place <= np.repeat(stem, size)
    in_plain = np.repeat(plain, size)
    stems = _strings(_LOWER[data[in_stem & in_plain]], np.concatenate([[0], np.cumsum((stem - first) * plain)]))
    return plain, stems, _strings(data[~in_stem & in_plain], np.concatenate([[0], np.cumsum((end - stem) * plain)]))


class _Memory:
    """The ids of words, of which the older half is forgotten beyond ``limit``; ``learn`` gives those of new words."""

    def __init__(self, learn: Callable[[list[str]], Iterable[tuple[str, bytes]]], limit: int):
        self.learn, self.limit = learn, limit
        self.young, self.old = {}, {}

    def ids(self, words: pa.Array) -> pa.Array:
        if len(self.young) > self.limit // 2:
            self.young, self.old = {}, self.young
        found = words.dictionary_encode()
        keys = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        codes = list(map(self.young.get, keys))
        missing = [k for k, code in zip(keys, codes, strict=True) if code is None]
        if missing:
            seen = list(map(self.old.get, missing))
            self.young.update((k, code) for k, code in zip(missing, seen, strict=True) if code is not None)
            self.young.update(self.learn([k for k, code in zip(missing, seen, strict=True) if code is None]))
            codes = list(map(self.young.__getitem__, keys))
        return pa.array(codes, pa.large_binary()).take(found.indices)


class WordIds:
    """Ids of a tokenizer of the library ``tokenizers``: word by word where its pre-tokens never cross white space.

    Where ``drops_space`` does not know the tokenizer's rules, whole texts are given to the library. Where it does, the text's spaces and line feeds, which its normaliser treats alike, cut it into words; each word's ids are the
    library's own. A word of Latin-1 letters and closing marks is two pre-tokens and is put together from them; Latin-1
    and ASCII words are looked up in lower case, as the normaliser lowers them, but as they stand where their lower case
    holds an added token. Words are cut and put together by columns; only new ones meet the library.
    """

    def __init__(self, path: str, memory: int = MEMORY, stems: int = STEMS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = drops_space(json.loads(self.tokenizer.to_str()))
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.ends = np.array([(self.tokenizer.id_to_token(k) or "").endswith("</w>") for k in range(size)])
        # the library looks for added tokens before it lowers the text
        added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)").search
        self.lettered = any(_letters.fullmatch(t.rstrip(MARKS) or "a") for t in added)
        self.words, self.stems = _Memory(self._learn, memory), _Memory(self._learn_stems, stems)

    def _learn(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        for k in range(0, len(words), 4096):
            some = words[k : k + 4096]
            for word, code in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                yield word, np.array(code.ids, self.dtype).tobytes()

    def _learn_stems(self, stems: list[str]) -> Iterator[tuple[str, bytes]]:
        """Stems of lower-case letters are one pre-token each, whose last piece alone ends a word: many of them are encoded
        as one text and told apart by their ends."""
        if "" in stems:
            yield "", b""
            stems = [s for s in stems if s]
        for words, code in self._lines(stems):
            ids = np.array(code.ids, self.dtype)
            stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(stops) != len(words) or stops[-1] != len(ids):
                yield from self._learn(words)
                continue
            raw, size = ids.tobytes(), self.dtype.itemsize
            yield from ((w, raw[a * size : b * size]) for w, a, b in zip(words, [0, *stops], stops, strict=False))

    def _lines(self, stems: list[str]) -> Iterator[tuple[list[str], object]]:
        lines = [stems[k : k + 256] for k in range(0, len(stems), 256)]
        for k in range(0, len(lines), 64):
            some = lines[k : k + 64]
            yield from zip(some, self.tokenizer.encode_batch_fast([" ".join(w) for w in some], add_special_tokens=False), strict=True)

    def _as_looked_up(self, word: str) -> str:
        return word.lower() if word.isascii() and not self.added(word.lower()) else word

    def _ids(self, words: pa.Array) -> pa.Array:
        hidden = np.array([bool(self.added(w.lower())) for w in words.to_pylist()], bool) if self.lettered else np.zeros(len(words), bool)
        plain, stems, marks = cut_marks(words, hidden)
        rest = np.full(len(words), "", object)
        rest[~plain] = [self._as_looked_up(w) for w in words.filter(pa.array(~plain)).to_pylist()]
        return pc.binary_join_element_wise(self.stems.ids(stems), self.words.ids(marks), self.words.ids(pa.array(rest, pa.large_string())), pa.scalar(b"", pa.large_binary()))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned integers of ``dtype``."""
        if not self.by_word:
            return [np.array(c.ids, self.dtype).tobytes() for c in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        words, firsts = cut_words(texts)
        found = self._ids(words.dictionary).take(words.indices)
        data, offsets = _flat(found)
        cuts = offsets[firsts].tolist()
        return [data[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]


class PieceCounts:
    """Token counts of a sentencepiece model of which no piece holds white space after another character.

    Such a model's merges never cross a single space, and its dummy prefix gives a word alone the same pieces as within
    the text. Texts with runs of spaces, with one at an end or with the mark itself are given to the library whole.
    """

    def __init__(self, path: str, memory: int = MEMORY):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        self.by_word = not any("▁" in p.lstrip("▁") for p in pieces) and len(self.model.encode(" a")) == len(self.model.encode("a")) + 1
        self.memory, self.known = memory, {}

    def count(self, texts: list[str]) -> list[int]:
        split = [t.split(" ") if self.by_word and "▁" not in t else [""] for t in texts]
        whole = [k for k, s in enumerate(split) if "" in s]
        for k in whole:
            split[k] = []
        words = set().union(*split)
        known = self.known
        missing = words.difference(known)
        if len(known) + len(missing) > self.memory:
            known.clear()
            missing = words
        new = list(missing)
        for k in range(0, len(new), 4096):
            some = new[k : k + 4096]
            known.update(zip(some, map(len, self.model.encode(some, num_threads=1)), strict=True))
        out = [sum(map(known.__getitem__, s)) for s in split]
        for k in whole:
            out[k] = len(self.model.encode(texts[k], num_threads=1))
        return out


_made: dict[tuple, object] = {}


def once(kind: type, path: str):
    """The worker's own instance: loaded once, and kept from task to task."""
    if (kind, path) not in _made:
        _made[kind, path] = kind(path)
    return _made[kind, path]
