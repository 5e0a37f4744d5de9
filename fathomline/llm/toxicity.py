"""Toxicity by a linear-chain conditional random field over the words of a document.

Labels are of documents, so words are labelled first: a word of a toxic document is toxic if it, or one of
its stems, occurs in toxic documents more often than chance allows, at a false discovery rate. The chain
has two states; a word's emission sums the weights of the word and its stems. Weights and transitions are
trained on the likelihood of the labelled words. Forward-backward marginals give the offending offsets, and
aggregated (highest, expected number, share) the document's score through a logistic layer.

Null or empty text has no words: the score of a document without evidence. A long text is one chain; its
words are looked up stretch by stretch, and a few numbers are held for each. With no labelled rows, or one
class among them, every score is the smoothed share of that class; without documents there are no rows.
Repeated rows score the same. Extra columns are ignored by the digest and kept by the filter.
"""

from __future__ import annotations

import heapq
import re
import sys
import uuid
import zlib
from collections import Counter
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import labelled_sample, per_worker, residue, slices, stretches, trained, trimmed

#: Stem lengths, false discovery rate and least purity of word labels, words of a training segment, score that rejects.
STEMS, DISCOVERY, PURITY, SEGMENT, THRESHOLD = (4, 5, 6), 0.001, 0.9, 32, 0.5
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_CHUNK = re.compile(r"\S+")


def features_of(chunk: str) -> list[str]:
    """A chunk between white space: its word in lower case, and the word's stems."""
    word = _EDGE.sub("", chunk).lower()
    if not word:
        return []
    return [word, *(f"{word[:n]}*" for n in STEMS if len(word) > n)]


def toxic_features(docs: list, labels: np.ndarray) -> dict[str, int]:
    """Features that favour toxic documents at the false discovery rate (Benjamini-Hochberg over the
    Chernoff bound of a binomial tail), numbered. Near copies, known by the three words that hash lowest,
    count once, else what only they share would look like evidence."""
    toxic, clean, seen = Counter(), Counter(), set()
    for chunks, y in zip(docs, labels, strict=True):
        words = set(chunks)
        lowest = (bool(y), *heapq.nsmallest(3, (zlib.crc32(w.encode("utf-8", "replace")) for w in words)))
        if lowest not in seen:
            seen.add(lowest)
            (toxic if y else clean).update({f for c in words for f in features_of(c)})
    names = sorted(f for f, n in toxic.items() if n >= 2)
    if not names:
        return {}
    k = np.array([toxic[f] for f in names], float)
    n = k + np.array([clean[f] for f in names])
    base, share = labels.mean(), np.minimum(k / n, 1 - 1e-9)
    divergence = share * np.log(share / base) + (1 - share) * np.log((1 - share) / (1 - base))
    p = np.where(share > base, np.exp(-n * divergence), 1.0)
    order = np.argsort(p, kind="stable")
    passing = np.flatnonzero(p[order] <= DISCOVERY * np.arange(1, len(p) + 1) / len(names))
    kept = order[: passing[-1] + 1] if len(passing) else order[:0]
    return {names[i]: j for j, i in enumerate(sorted(i for i in kept if share[i] >= PURITY))}


def marginals(emission: np.ndarray, lengths: np.ndarray, jump: np.ndarray) -> np.ndarray:
    """P(state 1) of every word. emission: log potentials of state 1 against 0, one chain after another;
    jump: 2 x 2 log potentials of transitions. All chains advance together, longest first."""
    e = np.exp(np.clip(emission, -30, 30).astype(np.float64))
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    (p00, p01), (p10, p11) = np.exp(jump)
    forward, backward = np.empty_like(e), np.empty_like(e)
    steps = int(sizes[0]) if len(sizes) else 0
    active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(steps), "right")
    r = np.ones(len(sizes))
    for t in range(steps):
        at = starts[: active[t]] + t
        r = e[at] * (p01 + p11 * r[: len(at)]) / (p00 + p10 * r[: len(at)]) if t else e[at]
        forward[at] = r
    ends = starts + sizes - 1
    for t in range(steps):
        at = ends[: active[t]] - t
        if t:
            s = e[at + 1] * s[: len(at)]
            s = (p10 + p11 * s) / (p00 + p01 * s)
        else:
            s = np.ones(len(at))
        backward[at] = s
    odds = forward * backward
    return odds / (1 + odds)


def _train(x: list, y: np.ndarray, width: int, steps: int = 200) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and transitions that maximise the likelihood of labelled segments, by Adam. x: for each
    segment SEGMENT lists of features; y: segments x SEGMENT states."""
    rows = np.array([i for i, fs in enumerate(f for seg in x for f in seg) for _ in fs], np.int64)
    cols = np.array([f for seg in x for fs in seg for f in fs], np.int64)
    n, k = y.shape
    lengths = np.full(n, k)
    theta = [np.zeros(width), np.array(-2.0), np.zeros((2, 2))]
    m, v = [np.zeros_like(p) for p in theta], [np.zeros_like(p) for p in theta]
    pairs = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
    for step in range(1, steps + 1):
        w, bias, jump = theta
        emission = np.bincount(rows, w[cols], n * k) + bias
        p = marginals(emission, lengths, jump).reshape(n, k)
        # Expected transitions: the pair marginal of adjacent states, from the two one-sided messages.
        expected = _pair_counts(emission.reshape(n, k), jump)
        gap = (y - p).ravel()
        grads = [np.bincount(cols, gap[rows], width) - 0.02 * w, gap.sum() - 0.02 * bias, pairs - expected - 0.02 * jump]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            theta[i] = theta[i] + 0.1 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return theta[0], float(theta[1]), theta[2]


def _pair_counts(emission: np.ndarray, jump: np.ndarray) -> np.ndarray:
    """Expected number of each transition over chains of one length."""
    e = np.stack([np.ones_like(emission), np.exp(np.clip(emission, -30, 30))], -1)
    q, k = np.exp(jump), e.shape[1]
    after = np.ones((len(e), k, 2))
    for t in range(k - 2, -1, -1):
        b = (e[:, t + 1] * after[:, t + 1]) @ q.T
        after[:, t] = b / b.sum(1, keepdims=True)
    total, a = np.zeros((2, 2)), e[:, 0]
    for t in range(k - 1):
        a = a / a.sum(1, keepdims=True)
        pair = a[:, :, None] * q * (e[:, t + 1] * after[:, t + 1])[:, None, :]
        total += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
        a = (a @ q) * e[:, t + 1]
    return total


class Emissions(dict):
    """Chunk to emission, a bounded memo."""

    def __init__(self, model: Model, limit: int = 200_000):
        super().__init__()
        self.model, self.limit = model, limit

    def __missing__(self, chunk: str) -> float:
        known, w = self.model.features, self.model.weights
        value = self[chunk] = self.model.bias + sum(w[known[f]] for f in features_of(chunk) if f in known)
        return value

    def of(self, text: str | None) -> np.ndarray:
        """Emissions of a text's words, looked up stretch by stretch."""
        out = [np.zeros(0)]
        for _, stretch in stretches(text):
            if len(self) > self.limit:
                self.clear()
            chunks = stretch.split()
            out.append(np.fromiter(map(self.__getitem__, chunks), np.float64, len(chunks)))
        return np.concatenate(out)


class Model:
    def __init__(self, rows: list):
        y = np.array([v == 1 for _, _, v in rows])
        docs = [[sys.intern(w) for w in t.split()] for _, t, _ in rows]  # a word is held once
        self.constant = None if 0 < y.sum() < len(y) else float((y.sum() + 1) / (len(y) + 2))
        self.features, self.weights, self.bias, self.jump = {}, [], 0.0, np.zeros((2, 2))
        if self.constant is not None:
            return
        self.features = toxic_features(docs, y)
        segments, states = [], []
        for chunks, toxic in zip(docs, y, strict=True):
            marked = [[self.features[f] for f in features_of(c) if f in self.features] for c in chunks]
            for a in range(0, len(marked), SEGMENT):
                part = marked[a : a + SEGMENT]
                if any(part) or a == len(marked) // 2 // SEGMENT * SEGMENT:  # every marked segment, one other a document
                    segments.append(part + [[]] * (SEGMENT - len(part)))
                    states.append([int(toxic and bool(fs)) for fs in part] + [0] * (SEGMENT - len(part)))
        if self.features:
            w, self.bias, self.jump = _train(segments, np.array(states), len(self.features))
            self.weights = w.tolist()
        del docs, segments, states
        memo = Emissions(self)
        x = np.concatenate([self.aggregates([t for _, t, _ in rows[at : at + 256]], memo)[0] for at in range(0, len(rows), 256)])
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        x = np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))])
        c = np.zeros(x.shape[1])
        for _ in range(25):  # Newton steps of a penalised logistic regression
            p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
            h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(c)) * 0.1
            c += np.linalg.solve(h, x.T @ (y - p) - 0.1 * c)
        self.layer = c

    def aggregates(self, texts: list, memo: Emissions) -> tuple[np.ndarray, list]:
        """Of each text: log odds of the highest marginal, log expected number of toxic words, and their
        share; and the marginals themselves."""
        each = [memo.of(t) for t in texts]
        lengths = np.array([len(e) for e in each], np.int64)
        p = np.clip(marginals(np.concatenate([np.zeros(0), *each]), lengths, self.jump), 1e-6, 1 - 1e-6)
        each = np.split(p, np.cumsum(lengths)[:-1]) if len(texts) else []
        out = np.zeros((len(texts), 3))
        for i, q in enumerate(each):
            if len(q):
                top, n = q.max(), q.sum()
                out[i] = np.log(top / (1 - top)), np.log1p(n), n / len(q)
            else:
                out[i] = np.log(1e-6), 0, 0
        return out, each

    def score(self, texts: list, memo: Emissions) -> tuple[np.ndarray, list]:
        """Score of each text and its offending code-point spans."""
        if self.constant is not None:
            return np.full(len(texts), self.constant), [[] for _ in texts]
        x, each = self.aggregates(texts, memo)
        scores = 1 / (1 + np.exp(-np.clip(np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))]) @ self.layer, -30, 30)))
        spans: list = []
        for text, q in zip(texts, each, strict=True):
            hit = q >= 0.5
            found = compress(_CHUNK.finditer(text), hit.tolist()) if hit.any() else ()
            spans.append([{"start": m.start(), "end": m.end()} for m in found])
        return scores, spans


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """From a bounded sample of the labelled documents that are not held out."""
    return trained(labelled_sample(docs, labels, "toxic"), Model)


#: Bytes of text scored together: their chains advance side by side, and memory is that of their words.
TOGETHER = 4 << 20


def tag_toxicity(docs: DataFrame, model: Model, keep: tuple | list = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """For each row its columns `keep` as struct `row`, text, score, predicted, and spans: the code-point
    offsets of the words tagged toxic."""
    shipped, token = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def scored(batches):
        model = shipped.value
        memo = per_worker(token, lambda: Emissions(model))
        for whole in batches:
            for at, rows in slices(whole.column(1), TOGETHER):
                b = whole.slice(at, rows)
                scores, spans = model.score(b.column(1).to_pylist(), memo)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32)), pa.array(spans, pa.list_(span))],
                    names=["row", "text", "score", "predicted", "spans"],
                )

    rows = docs.select(F.struct(*keep).alias("row"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([*rows.schema.fields, *T._parse_datatype_string("score double, predicted int, spans array<struct<start:long,end:long>>").fields])
    return rows.mapInArrow(trimmed(scored), schema)


def digest(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """The columns that op1 is compared by, and the offending offsets."""
    tagged = tag_toxicity(docs, model or learn(docs, labels))
    return tagged.select(
        F.col("row.doc_id").cast("long").alias("doc_id"),
        (residue("row.doc_id", 5) == 0).alias("held_out"),
        "score",
        "predicted",
        F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"]))).alias("toxic_offsets"),
    )


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """docs, with its own columns, without the rows that are predicted toxic."""
    keep = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    clean = tag_toxicity(docs, model, keep).where("predicted = 0")
    return clean.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))
