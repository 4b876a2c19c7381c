"""Language identification by a byte convolutional network, trained and applied in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import fresh, small_batches

#: Bytes of a window; neighbouring windows overlap so that no filter misses a stretch at their border.
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
OVERLAP = max(WIDTHS) - 1
#: Bounds of the training sample: documents a language, windows a document.
PER_LANG, PER_DOC = 500, 4
BLOCK = 128
#: A document is of a known language if its probability is at least this, or twice that of chance where that is less.
LEAST_SCORE = 0.5


def windows(data: bytes) -> np.ndarray:
    """(n, WINDOW) bytes that cover all of ``data``; the last window ends in zeros. No bytes: one window of zeros."""
    step = WINDOW - OVERLAP
    n = max(1, -(-(len(data) - OVERLAP) // step))
    held = np.zeros(n * step + OVERLAP, np.uint8)
    held[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(held, WINDOW)[::step]


@dataclass
class Network:
    """One-hot bytes, filters of several widths, the maximum over positions, a rectifier, softmax."""

    langs: list[str]
    taps: dict[int, np.ndarray]  # width -> (width, 256, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def __post_init__(self):
        self.pairs = None

    def _tables(self) -> dict[int, list[np.ndarray]]:
        """A filter's neighbouring taps joined into one table by byte pair: half as many look-ups."""
        if self.pairs is None:
            self.pairs = {w: [(t[k][:, None] + t[k + 1][None]).reshape(1 << 16, -1) if k + 1 < w else t[k] for k in range(0, w, 2)] for w, t in self.taps.items()}
        return self.pairs

    def pooled(self, block: np.ndarray) -> np.ndarray:
        """(n, WINDOW) to the filters' maxima."""
        rows = np.ascontiguousarray(block.T)
        pair = (rows[:-1].astype(np.intp) << 8) | rows[1:]
        found = []
        for w, tables in self._tables().items():
            n = WINDOW - w + 1
            total = None
            for k, table in enumerate(tables):
                at = pair[2 * k : 2 * k + n] if len(table) > 256 else rows[2 * k : 2 * k + n]
                values = table.take(at, axis=0)
                total = values if total is None else np.add(total, values, out=total)
            found.append(total.max(axis=0))
        return np.concatenate(found, axis=1) + self.bias

    def probabilities(self, block: np.ndarray) -> np.ndarray:
        parts = []
        for k in range(0, len(block), BLOCK):
            logits = np.maximum(self.pooled(block[k : k + BLOCK]), 0) @ self.out + self.out_bias
            odds = np.exp(logits - logits.max(axis=1, keepdims=True))
            parts.append(odds / odds.sum(axis=1, keepdims=True))
        return np.concatenate(parts)


def train(data: np.ndarray, labels: np.ndarray, langs: list[str], epochs: int = 8, rate: float = 0.01, seed: int = 7) -> Network:
    """Fits a network to windows (n, WINDOW) with class numbers by Adam; classes weigh alike. Half of the windows of a
    pass are cut to a random length, so that short texts are known too."""
    rng = np.random.default_rng(seed)
    taps = {w: rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
    width = FILTERS * len(WIDTHS)
    values = [*taps.values(), np.zeros(width, np.float32), rng.normal(0, 0.1, (width, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)]
    first, second, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    share = 1 / np.maximum(np.bincount(labels, minlength=len(langs)), 1)
    weight = (share / share[labels].mean())[labels].astype(np.float32)
    lanes = np.arange(FILTERS)
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for k in range(0, len(data), 64):
            pick = order[k : k + 64]
            block = data[pick].copy()
            ends = np.where(rng.random(len(pick)) < 0.5, rng.integers(12, WINDOW, len(pick)), WINDOW)
            block[np.arange(WINDOW)[None] >= ends[:, None]] = 0
            rows, n = np.ascontiguousarray(block.T), len(pick)
            tops, places = [], []
            for w, t in zip(WIDTHS, values, strict=False):
                total = sum(t[j].take(rows[j : j + WINDOW - w + 1], axis=0) for j in range(w))
                at = total.argmax(axis=0)
                places.append(at)
                tops.append(np.take_along_axis(total, at[None], axis=0)[0])
            bias, out, out_bias = values[-3:]
            pre = np.concatenate(tops, axis=1) + bias
            high = np.maximum(pre, 0)
            logits = high @ out + out_bias
            odds = np.exp(logits - logits.max(axis=1, keepdims=True))
            slope = odds / odds.sum(axis=1, keepdims=True)
            slope[np.arange(n), labels[pick]] -= 1
            slope *= weight[pick][:, None] / n
            back = (slope @ out.T) * (pre > 0)
            grads = []
            for i, w in enumerate(WIDTHS):
                g = np.zeros_like(values[i])
                part = back[:, i * FILTERS : (i + 1) * FILTERS]
                for j in range(w):
                    np.add.at(g[j], (rows[places[i] + j, np.arange(n)[:, None]], lanes[None]), part)
                grads.append(g)
            grads += [back.sum(axis=0), high.T @ slope, slope.sum(axis=0)]
            step += 1
            for v, g, a, b in zip(values, grads, first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                v -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return Network(langs, dict(zip(WIDTHS, values, strict=False)), *values[-3:])


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that are never learned from: crc32 of the id as text, modulo 4, is 2. An id that is null is not one."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, per_lang: int = PER_LANG, per_doc: int = PER_DOC) -> Network | None:
    """Learns from a bounded sample of labelled documents that are not held out; None where there are none.

    Documents are drawn by the hash of their id, at a rate that gives each language about twice ``per_lang``; of these
    the least hashes count, at most ``per_lang`` a language, and of each document ``per_doc`` stretches at hashed places.
    The driver sees no more than that and one count a language; every language of the labels is learned.
    """
    usable = docs.where("lang IS NOT NULL AND text IS NOT NULL AND length(text) > 0").where(~held_out())
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    rate = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 2.0 * per_lang / n))])
    draw = F.xxhash64("doc_id")
    chosen = usable.withColumn("draw", draw).where(F.pmod("draw", F.lit(1 << 30)) < F.element_at(rate, F.col("lang")) * (1 << 30))
    span = F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1
    parts = [F.substring(F.col("text"), (F.pmod(F.xxhash64("doc_id", F.lit(j)), span) + 1).cast("int"), F.lit(WINDOW)).alias(f"w{j}") for j in range(per_doc)]
    listed = chosen.select("lang", "draw", *parts).orderBy("draw", "lang", *[f"w{j}" for j in range(per_doc)]).limit(4 * per_lang * len(counts)).collect()
    langs, taken = sorted(counts), dict.fromkeys(counts, 0)
    data, labels = [], []
    for row in listed:
        taken[row["lang"]] += 1
        if taken[row["lang"]] <= per_lang:
            for j in range(per_doc):
                data.append(windows(row[f"w{j}"].encode()[:WINDOW])[0])
                labels.append(langs.index(row["lang"]))
    if not data:
        return None
    return train(np.stack(data), np.array(labels), langs)


def _judged(net: Network | None, text: str, letters: str, keep: list[str], names: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for value, lettered in zip(batch.column(text), batch.column(letters).to_pylist(), strict=True):
                if not lettered:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                data = value.as_py().encode()
                chance = net.probabilities(windows(data))
                weight = np.full(len(chance), float(WINDOW))
                weight[-1] = max(1, len(data) - (len(chance) - 1) * (WINDOW - OVERLAP))
                mean = weight @ chance / weight.sum()
                best = int(mean.argmax())
                langs.append(net.langs[best])
                scores.append(min(1.0, float(mean[best])))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*keep, *names])

    return run


def predict(docs: DataFrame, net: Network | None, keep: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Columns ``keep`` with the language (lang_pred) and score of the whole text: its windows' probabilities, averaged by length.

    A text that is null, empty or without a letter, and any text where nothing could be learned, is ``und`` with score 0. Only
    the text is looked at, all of it, however long. Repeated rows are judged alike; a table without rows gives none. Columns
    of ``keep`` that are called like a result give way to it; ``names`` gives the results other names.
    """
    keep = [c for c in keep if c.lower() not in {n.lower() for n in names}]
    text, letters = fresh([*keep, *names], "__text"), fresh([*keep, *names], "__letters")
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)) & F.lit(net is not None)
    rows = small_batches(docs).select(*keep, F.col("text").alias(text), lettered.alias(letters))
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep] + [f"{names[0]} string", f"{names[1]} double"])
    return rows.mapInArrow(_judged(net, text, letters, keep, names), schema)


def only_known(docs: DataFrame, least: float | None = None) -> DataFrame:
    """``docs`` without those whose language cannot be told: no letter (null and empty texts too), or a score below ``least``.

    ``least`` is LEAST_SCORE, or twice the probability of chance where there are so many languages that this is less. Where
    nothing could be learned, all documents stay. Columns keep their names and values, whatever they are called.
    """
    net = fit(docs)
    if net is None:
        return docs
    least = min(LEAST_SCORE, 2 / len(net.langs)) if least is None else least
    lang, score = fresh(docs.columns, "__lang"), fresh(docs.columns, "__score")
    judged = predict(docs, net, docs.columns, (lang, score))
    return judged.where((F.col(lang) != "und") & (F.col(score) >= least)).select(*docs.columns)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs.withColumn("held_out", held_out()), fit(docs), ["doc_id", "held_out"])
    return out
