"""Language identification: sparse multinomial logistic regression on TF-IDF of
character n-grams, trained by follow-the-regularised-leader with elastic-net penalties
and calibrated by a temperature.

N-grams of one to three characters are hashed.  Letters are lower-cased and everything
else counts as a blank.  The term frequency of a text is its count over all n-grams,
so a linear score is one sum over the text, however long.  Document frequencies come
from every training row; the regression itself is fitted on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflux.llm.labels import fetch_sample, remainder
from folioflux.llm.rows import TextBlock, block_of, text_blocks

FOLDS, HELD = 3, 1
BUCKETS = 1 << 17
ORDERS = (1, 2, 3)
#: Bound of the labelled sample that reaches the driver, for all languages together.
SAMPLE_BYTES, SAMPLE_ROWS = 12 << 20, 1200
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-3
SCALE = 30.0
UNKNOWN = "und"

_BLOCK = 1 << 20
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(k).isalpha() for k in range(0x110000)), bool, 0x110000))
    return _letters[0]


@dataclass
class Grams:
    """Characters of a block: hashed n-grams by order, and where each text begins."""

    hashes: list[np.ndarray]
    valid: list[np.ndarray]
    first: np.ndarray
    letters: np.ndarray


def grams(block: TextBlock) -> Grams:
    """A blank stands before, between and after texts; n-grams of blanks alone don't count."""
    texts = [block.raw(k).decode("utf-8", "replace").lower() for k in range(len(block))]
    chars = np.frombuffer((" " + "".join(t + "   " for t in texts)).encode("utf-32-le", "replace"), np.uint32)
    is_letter = letter_table()[chars]
    chars = np.where(is_letter, chars, np.uint32(32))
    size = np.fromiter((len(t) + 3 for t in texts), np.int64, len(texts))
    first = np.concatenate([[0], np.cumsum(size)])
    n = int(first[-1])  # the n-gram at p covers p .. p + order - 1, and a text its leading blank
    chars, is_letter = np.append(chars[: n + 1], np.full(2, 32, np.uint32)), np.append(is_letter[: n + 1], [False, False])
    hashes, valid = [], []
    for order in ORDERS:
        h = np.full(n, order * 0x01000193, np.uint32)
        seen = np.zeros(n, bool)
        for k in range(order):
            h = (h ^ chars[k : n + k]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            seen |= is_letter[k : n + k]
        hashes.append((h >> np.uint32(3)) & np.uint32(BUCKETS - 1))
        valid.append(seen)
    letters = np.add.reduceat(np.append(is_letter[1 : n + 1], 0).astype(np.int64), first[:-1]) if len(texts) else np.zeros(0, np.int64)
    return Grams(hashes, valid, first, letters)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts of ``docs`` each bucket occurs, and how many texts there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, texts = np.zeros(BUCKETS + 1, np.int64), 0
        for block in text_blocks(batches, "text", limit=_BLOCK):
            found = grams(block)
            for k in range(len(block)):
                mark = np.zeros(BUCKETS, bool)
                own = slice(found.first[k], found.first[k + 1])
                for h, ok in zip(found.hashes, found.valid, strict=True):
                    mark[h[own][ok[own]]] = True
                total[:BUCKETS] += mark
            total[BUCKETS] += len(block)
            texts += len(block)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    sums = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS + 1, np.int64)
    for r in sums.toLocalIterator():  # at most BUCKETS + 1 rows
        out[r.bucket] = r.n
    return out[:BUCKETS], int(out[BUCKETS])


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages, IDF folded in
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, block: TextBlock) -> tuple[np.ndarray, np.ndarray]:
        found = grams(block)
        z = np.zeros((len(block), len(self.languages)))
        total = np.zeros(len(block))
        for h, ok in zip(found.hashes, found.valid, strict=True):
            if not len(h):
                continue
            rows = self.weights[h]
            rows[~ok] = 0
            z += np.add.reduceat(rows, found.first[:-1], axis=0)
            total += np.add.reduceat(ok.astype(np.int64), found.first[:-1])
        return z * (SCALE / np.maximum(total, 1))[:, None] + self.bias, found.letters

    def predict(self, block: TextBlock) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNKNOWN] * len(block), np.zeros(len(block))
        z, letters = self.logits(block)
        p = softmax(z / self.temperature)
        best = p.argmax(axis=1)
        known = letters > 0
        return [self.languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), known.tolist(), strict=True)], np.where(known, p[np.arange(len(p)), best], 0.0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _vectors(texts: list[str], idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for n in range(0, len(texts), 100):
        found = grams(block_of(texts[n : n + 100]))
        for k in range(len(found.first) - 1):
            own = slice(found.first[k], found.first[k + 1])
            every = np.concatenate([h[own][ok[own]] for h, ok in zip(found.hashes, found.valid, strict=True)])
            at, counts = np.unique(every, return_counts=True)
            out.append((at.astype(np.int64), counts * (SCALE / max(1, len(every))) * idf[at]))
    return out


def fit(texts: list[str], languages: list[str], df: np.ndarray, n_docs: int) -> LanguageModel:
    """FTRL-proximal over the sample; a fifth of it sets the temperature."""
    names = sorted(set(languages))
    idf = np.log((n_docs + 1) / (df + 1)) + 1.0
    k = len(names)
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))  # the last row is the bias
    if not k:
        return LanguageModel([], z[:BUCKETS].astype(np.float32), z[BUCKETS])
    x = [(np.append(at, BUCKETS), np.append(v, 1.0)) for at, v in _vectors(texts, idf)]
    y = np.array([names.index(v) for v in languages])
    order = np.random.default_rng(7).permutation(len(x))
    held, train = order[: len(order) // 5], order[len(order) // 5 :]

    def weights(at: np.ndarray) -> np.ndarray:
        own, grown = z[at], n[at]
        l1 = np.where(at == BUCKETS, 0.0, L1)[:, None]
        return np.where(np.abs(own) <= l1, 0.0, -(own - np.sign(own) * l1) / ((BETA + np.sqrt(grown)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for one in train:
            at, v = x[one]
            w = weights(at)
            p = softmax((v @ w)[None])[0]
            p[y[one]] -= 1.0
            g = v[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    final = weights(np.arange(BUCKETS + 1))
    model = LanguageModel(names, (final[:BUCKETS] * idf[:, None]).astype(np.float32), final[BUCKETS])
    if len(held):
        raw = np.stack([x[one][1] @ final[x[one][0]] for one in held])
        grid = np.geomspace(0.05, 20, 120)
        losses = [-np.log(np.maximum(softmax(raw / t)[np.arange(len(held)), y[held]], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(losses))])
    return model


def train_model(docs: DataFrame, folds: int = FOLDS, held: int = HELD) -> LanguageModel:
    """Learn from texts with a known language outside the held-out fold."""
    rows = docs.where((remainder(folds) != held) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    df, n_docs = document_frequencies(rows)
    sample = rows.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("label"))
    return fit(*fetch_sample(sample, None, SAMPLE_BYTES, SAMPLE_ROWS, F.lit(True)), df, n_docs)


def predict_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) of every row.

    A null text, and one without a letter, is ``und`` with score 0, as is every text
    when there was nothing to learn from.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, limit=_BLOCK):
            names, scores = sent.value.predict(block)
            yield pa.RecordBatch.from_arrays([block.ids, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, "doc_id bigint, lang_pred string, score double")


def op3_languages(docs: DataFrame) -> DataFrame:
    found = predict_languages(docs, train_model(docs))
    return found.select("doc_id", (remainder(FOLDS) == HELD).alias("held_out"), "lang_pred", "score")
