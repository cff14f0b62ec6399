"""Quality by a byte-level convolutional network in numpy.

Input of a position: a learned embedding of its byte, and an echo channel that tells
how well the last bytes repeat those a short lag before.  Filters run over the text in
overlapping chunks that cover it whole; each filter's maximum over all chunks goes
through one dense layer to a probability.  Since a maximum over chunks is the maximum
over the text, memory depends on the chunk alone.  Training is back-propagation with
Adam on a bounded sample of labelled texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflux.llm.labels import fetch_sample, known_labels, remainder
from folioflux.llm.rows import TextBlock, append_score

FOLDS, HELD = 3, 1
THRESHOLD = 0.5
#: Bound of the labelled sample that reaches the driver.
SAMPLE_BYTES, SAMPLE_ROWS = 5 << 20, 900
KERNEL, STRIDE, DIM, FILTERS = 8, 2, 6, 20
CHUNK = 1 << 16
LAGS = range(2, 33)
ECHO_RUN = 8
EPOCHS, RATE, DECAY = 8, 0.02, 1e-4
_CHANNELS = DIM + 1


def echo(data: np.ndarray) -> np.ndarray:
    """Part of the last bytes that equal those a lag before, at the best lag."""
    best = np.zeros(len(data), np.uint8)
    for lag in LAGS:
        if len(data) <= lag + ECHO_RUN:
            break
        same = (data[lag:] == data[:-lag]).astype(np.uint8)
        run = same[: len(same) - ECHO_RUN + 1].copy()
        for k in range(1, ECHO_RUN):
            run += same[k : len(same) - ECHO_RUN + 1 + k]
        at = lag + ECHO_RUN - 1
        np.maximum(best[at:], run, out=best[at:])
    return best.astype(np.float32) / ECHO_RUN


def _padded(text: np.ndarray) -> np.ndarray:
    """Blanks at the end, so that even an empty text has one position."""
    return np.concatenate([text, np.full(KERNEL + (-len(text)) % STRIDE, 32, np.uint8)])


@dataclass
class ByteNet:
    embed: np.ndarray  # 256 x DIM
    filters: np.ndarray  # KERNEL * channels x FILTERS
    bias: np.ndarray
    dense: np.ndarray
    offset: float

    @classmethod
    def fresh(cls, seed: int = 3) -> ByteNet:
        r = np.random.default_rng(seed)
        return cls(r.normal(0, 0.5, (256, DIM)).astype(np.float32), r.normal(0, 0.25, (KERNEL * _CHANNELS, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), r.normal(0, 0.3, FILTERS).astype(np.float32), 0.0)

    def tables(self) -> np.ndarray:
        """KERNEL x 256 x FILTERS: what each byte adds at each place of a filter."""
        w = self.filters.reshape(KERNEL, _CHANNELS, FILTERS)
        return np.einsum("bd,kdf->kbf", self.embed, w[:, :DIM]).astype(np.float32)

    def pooled(self, text: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Maximum of each filter over all chunks of one text."""
        best = np.full(FILTERS, -np.inf, np.float32)
        w_echo = self.filters.reshape(KERNEL, _CHANNELS, FILTERS)[:, DIM]
        text = _padded(text)
        back = max(LAGS) + ECHO_RUN + (-(max(LAGS) + ECHO_RUN)) % STRIDE
        for start in range(0, len(text) - KERNEL + 1, CHUNK):
            stop = min(len(text), start + CHUNK + KERNEL - 1)
            before = min(start, back)
            part, heard = text[start:stop], echo(text[start - before : stop])[before:]
            n = (len(part) - KERNEL) // STRIDE + 1
            z = np.zeros((n, FILTERS), np.float32)
            for k in range(KERNEL):
                z += tables[k].take(part[k : k + STRIDE * (n - 1) + 1 : STRIDE], axis=0)
            loud = np.flatnonzero(np.lib.stride_tricks.sliding_window_view(heard, KERNEL)[: STRIDE * (n - 1) + 1 : STRIDE].any(axis=1))
            if len(loud):
                z[loud] += np.stack([heard[k + STRIDE * loud] for k in range(KERNEL)], axis=1) @ w_echo
            best = np.maximum(best, z.max(axis=0))
        return best + self.bias

    def scores(self, block: TextBlock) -> np.ndarray:
        tables = self.tables()
        pooled = np.stack([self.pooled(block.data[a:b], tables) for a, b in zip(block.starts, block.ends, strict=True)])
        z = np.maximum(pooled, 0) @ self.dense + self.offset
        return (1 / (1 + np.exp(-np.clip(z.astype(np.float64), -40, 40)))).reshape(-1)


class _Adam:
    def __init__(self, shapes: list[tuple], rate: float):
        self.m, self.v, self.t, self.rate = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes], 0, rate

    def steps(self, grads: list[np.ndarray]) -> list[np.ndarray]:
        self.t += 1
        out = []
        for k, g in enumerate(grads):
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            out.append(self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8))
        return out


def fit(texts: list[str], good: list[int], epochs: int = EPOCHS, seed: int = 3) -> ByteNet:
    """Train on whole texts; with one class only, the net says that class's prior."""
    net = ByteNet.fresh(seed)
    y = np.array(good, np.float64)
    if len(set(good)) < 2:
        net.dense[:] = 0
        net.offset = 0.0 if not good else (4.0 if good[0] else -4.0)
        return net
    raw = [_padded(np.frombuffer(t.encode(), np.uint8)) for t in texts]
    heard = [echo(r) for r in raw]
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    adam = _Adam([net.embed.shape, net.filters.shape, net.bias.shape, net.dense.shape, ()], RATE)
    r = np.random.default_rng(seed)
    for epoch in range(epochs):
        adam.rate = RATE * (1 - epoch / epochs)
        for group in np.array_split(r.permutation(len(raw)), max(1, len(raw) // 16)):
            pools, inputs = np.empty((len(group), FILTERS), np.float32), np.empty((len(group), FILTERS, KERNEL * _CHANNELS), np.float32)
            spots = np.empty((len(group), FILTERS), np.int64)
            for n, one in enumerate(group):
                x = np.concatenate([net.embed[raw[one]], heard[one][:, None]], axis=1)
                windows = np.lib.stride_tricks.sliding_window_view(x.reshape(-1), KERNEL * _CHANNELS)[:: STRIDE * _CHANNELS]
                z = windows @ net.filters
                at = z.argmax(axis=0)
                pools[n] = z[at, np.arange(FILTERS)] + net.bias
                inputs[n], spots[n] = windows[at], at * STRIDE
            live = np.maximum(pools, 0)
            p = 1 / (1 + np.exp(-np.clip(live @ net.dense + net.offset, -30, 30)))
            d = (p - y[group]) * weight[group] / len(group)
            d_pool = d[:, None] * net.dense * (pools > 0)
            g_filters = np.einsum("nf,nfi->if", d_pool, inputs)
            g_embed = np.zeros_like(net.embed)
            w = net.filters.reshape(KERNEL, _CHANNELS, FILTERS)
            for n, one in enumerate(group):
                for f in np.flatnonzero(d_pool[n]):
                    np.add.at(g_embed, raw[one][spots[n, f] : spots[n, f] + KERNEL], d_pool[n, f] * w[:, :DIM, f])
            grads = [g_embed, g_filters + DECAY * net.filters, d_pool.sum(axis=0), live.T @ d + DECAY * net.dense, d.sum()]
            steps = adam.steps(grads)
            net.embed = (net.embed - steps[0]).astype(np.float32)
            net.filters = (net.filters - steps[1]).astype(np.float32)
            net.bias = (net.bias - steps[2]).astype(np.float32)
            net.dense = (net.dense - steps[3]).astype(np.float32)
            net.offset = float(net.offset - steps[4])
    return net


def fit_quality(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held: int = HELD) -> ByteNet:
    """Learn from labelled rows outside the held-out fold."""
    known = known_labels(labels, "quality").where("label in (0, 1)")
    return fit(*fetch_sample(docs, known, SAMPLE_BYTES, SAMPLE_ROWS, remainder(folds) != held))


def score_texts(docs: DataFrame, net: ByteNet, name: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the probability of good quality; a null text scores as an empty one."""
    return append_score(docs, docs.sparkSession.sparkContext.broadcast(net), name, keep)


def op8_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row, repeated rows and null ids included."""
    scored = score_texts(docs, fit_quality(docs, labels), keep=["doc_id"])
    return scored.select("doc_id", (remainder(FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the network doesn't reject, with their own columns."""
    return score_texts(docs, fit_quality(docs, labels), "__good").where(F.col("__good") >= THRESHOLD).drop("__good")
