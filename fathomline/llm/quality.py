"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Every token has a sparse ternary index vector drawn from its hash. A token's word vector is the sum of the
index vectors around it in the learning sample, scaled to unit length; a token never learned has none. A
document is pooled to the mean and the spread of its tokens' vectors beside the share of tokens of each
shape and of unlearned ones. The network is plain numpy, and its temperature is fitted on documents that
it was not trained on, so that scores are probabilities.

Null, empty or wordless text pools to zeros and is scored like any other. A long text is pooled stretch by
stretch, so memory is that of a stretch. Without labelled rows, or with one class among them, every score is
the (smoothed) share of that class; without documents there are no rows. Repeated rows score the same, extra
columns are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import VectorMemo, labelled_sample, per_worker, residue, stretches, trained, trimmed

#: Dimensions of a vector, non-zeros of an index vector, tokens of context on either side, hidden units.
DIMENSIONS, SEEDS, CONTEXT, HIDDEN = 64, 6, 2, 24
#: Least count of a learned token; score from which a document is predicted good.
SUPPORT, THRESHOLD = 3, 0.3
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
SHAPES = 6


def tokens_of(chunk: str) -> list[tuple[str, int]]:
    """(token, shape) of a chunk between white space; shapes: lower, title, upper, digits, marks, letter."""
    out = []
    for t in _TOKEN.findall(chunk):
        if t[0].isalpha():
            out.append((t.lower(), 5 if len(t) == 1 else 2 if t.isupper() else 1 if t[0].isupper() else 0))
        else:
            out.append(("0", 3) if t[0].isdigit() else (t[:8], 4))
    return out


def index_vector(token: str) -> np.ndarray:
    """Sparse ternary, drawn from a hash of the token."""
    v, h = np.zeros(DIMENSIONS, np.float32), zlib.crc32(token.encode("utf-8", "replace"))
    for _ in range(SEEDS):
        h = (h * 1664525 + 1013904223) & 0xFFFFFFFF
        v[(h >> 8) % DIMENSIONS] += 1.0 if h >> 31 else -1.0
    return v / max(1.0, float(np.linalg.norm(v)))


def word_vectors(texts: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """Summed index vectors of the contexts of each token with enough support, at unit length."""
    place: dict[str, int] = {}
    docs = [np.array([place.setdefault(t, len(place)) for c in x.split() for t, _ in tokens_of(c)], np.int64) for x in texts]
    counts = np.bincount(np.concatenate([np.zeros(0, np.int64), *docs]), minlength=len(place))
    index = np.stack([index_vector(t) for t in place]) if place else np.zeros((0, DIMENSIONS), np.float32)
    kept = np.flatnonzero(counts >= SUPPORT)
    new = np.full(len(place), -1)
    new[kept] = np.arange(len(kept))
    total = np.zeros((len(kept) + 1, DIMENSIONS), np.float32)
    for d in docs:
        for k in range(1, CONTEXT + 1):
            if len(d) > k:
                np.add.at(total, new[d[:-k]], index[d[k:]] / k)
                np.add.at(total, new[d[k:]], index[d[:-k]] / k)
    total = total[:-1]
    total /= np.maximum(1e-6, np.linalg.norm(total, axis=1, keepdims=True))
    names = list(place)
    return {names[i]: k for k, i in enumerate(kept.tolist())}, total


class Network:
    """features -> tanh layer -> logit, trained by Adam on the log loss; divided by a fitted temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, epochs: int = 60, seed: int = 5):
        r = np.random.default_rng(seed)
        order = r.permutation(len(x))
        held, used = order[: len(x) // 5], order[len(x) // 5 :]
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        x = (x - self.mean) / self.scale
        w = [r.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), r.normal(0, 0.2, HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
        for _ in range(epochs):
            for rows in np.array_split(r.permutation(used), max(1, len(used) // 64)):
                a, step = x[rows], step + 1
                h = np.tanh(a @ w[0] + w[1])
                d = (_sigmoid(h @ w[2] + w[3]) - y[rows]) / len(rows)
                back = np.outer(d, w[2]) * (1 - h * h)
                grads = [a.T @ back + 1e-3 * w[0], back.sum(0), h.T @ d + 1e-3 * w[2], d.sum(keepdims=True)]
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    w[k] = w[k] - 0.005 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.weights, self.temperature = w, 1.0
        if len(held):
            logits = np.tanh(x[held] @ w[0] + w[1]) @ w[2] + w[3]
            loss = lambda t: -np.mean(np.log(np.clip(np.where(y[held] == 1, _sigmoid(logits / t), _sigmoid(-logits / t)), 1e-9, 1)))
            self.temperature = float(min(np.geomspace(0.25, 8, 41), key=loss))

    def probability(self, x: np.ndarray) -> np.ndarray:
        w = self.weights
        return _sigmoid((np.tanh(((x - self.mean) / self.scale) @ w[0] + w[1]) @ w[2] + w[3]) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


class Model:
    def __init__(self, rows: list):
        self.place, self.vectors = word_vectors([t for _, t, _ in rows])
        y = np.array([float(v == 1) for _, _, v in rows])
        self.constant = None if 0 < y.sum() < len(y) else float((y.sum() + 1) / (len(y) + 2))
        if self.constant is None:
            memo = self.memo()
            self.network = Network(np.stack([self.pooled(t, memo) for _, t, _ in rows]), y)

    def key(self, chunk: str) -> tuple:
        """What a chunk's vector depends on: its learned tokens, and the shapes of all."""
        return tuple((t if t in self.place else "", s) for t, s in tokens_of(chunk))

    def vector(self, key: tuple) -> np.ndarray:
        """Summed vectors of a chunk's learned tokens, the same squared, and counts of tokens by shape."""
        out = np.zeros(2 * DIMENSIONS + SHAPES + 1, np.float32)
        for token, shape in key:
            if token:
                v = self.vectors[self.place[token]]
                out[:DIMENSIONS] += v
                out[DIMENSIONS : 2 * DIMENSIONS] += v * v
            else:
                out[-1] += 1
            out[2 * DIMENSIONS + shape] += 1
        return out

    def memo(self) -> VectorMemo:
        return VectorMemo(self.vector, 2 * DIMENSIONS + SHAPES + 1, 300_000, self.key)

    def pooled(self, text: str | None, memo: VectorMemo) -> np.ndarray:
        """Mean and spread of the token vectors, shares of shapes and of unlearned tokens, log length,
        the share of chunks distinct within their stretch and that of chunks like the one before."""
        total, words, distinct, repeats = np.zeros(2 * DIMENSIONS + SHAPES + 1), 0, 0, 0
        for _, stretch in stretches(text):
            chunks = stretch.split()
            rows = memo.rows(chunks)
            for at in range(0, len(rows), 4096):
                total += memo.matrix[rows[at : at + 4096]].sum(0)
            words, distinct, repeats = words + len(chunks), distinct + len(set(chunks)), repeats + int((rows[1:] == rows[:-1]).sum())
        n = max(1.0, float(total[2 * DIMENSIONS : -1].sum()))
        mean = total[:DIMENSIONS] / n
        spread = np.sqrt(np.maximum(0, total[DIMENSIONS : 2 * DIMENSIONS] / n - mean * mean))
        return np.concatenate([mean, spread, total[2 * DIMENSIONS :] / n, [np.log1p(words) / 5, distinct / max(1, words), repeats / max(1, words - 1)]])

    def scores(self, texts: list, memo: VectorMemo) -> np.ndarray:
        if self.constant is not None or not texts:
            return np.full(len(texts), self.constant or 0.0)
        return self.network.probability(np.stack([self.pooled(t, memo) for t in texts]))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """From a bounded sample of the labelled documents that are not held out."""
    return trained(labelled_sample(docs, labels, "quality"), Model)


def score_quality(docs: DataFrame, labels: DataFrame, model: Model | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of each row, from its text alone."""
    shipped, token = docs.sparkSession.sparkContext.broadcast(model or learn(docs, labels)), uuid.uuid4().hex

    def scored(batches):
        model = shipped.value
        memo = per_worker(token, model.memo)
        for b in batches:
            found = model.scores(b.column(2).to_pylist(), memo)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(found, pa.float64()), pa.array((found >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (residue("doc_id", 5) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(trimmed(scored), "doc_id long, held_out boolean, score double, predicted int")
