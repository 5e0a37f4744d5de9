"""Language identification, words first.

A known word scores by its log frequency in each language. A word never learned falls back to its longest
character n-grams of which any is known, and on to progressively shorter ones. A document is scored by the
sum over its words; the answer is the best language, its score the posterior at a flattened temperature.

Null text, or text without a letter: `und`, score 0. The same where no language was learned. Ties go to the
language first in order. Rows are scored one by one, so repeated rows get repeated answers; a long text is
scored stretch by stretch, so memory is that of a stretch. Without documents there are no rows; extra columns
are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import VectorMemo, labelled_sample, per_worker, residue, stretches, trained, trimmed

#: Documents of each language learned from at most; a language is a value of `lang`, so there are few.
ROWS = 500
#: Longest n-gram, least count of a known word or n-gram, smoothing, and the number of words beyond which
#: evidence no longer sharpens the score.
LONGEST, SUPPORT, SMOOTHING, EVIDENCE = 4, 2, 0.5, 20.0
_RUN = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return [w for w in _RUN.findall(text.lower()) if any(map(str.isalpha, w))]


def grams(word: str, n: int) -> list[str]:
    word = f"<{word}>"
    return [word[i : i + n] for i in range(len(word) - n + 1)]


class Model:
    """Log frequencies: words and, by length, n-grams, each a vector over the languages."""

    def __init__(self, rows: list):
        self.languages = sorted({y for _, _, y in rows})
        place = {y: i for i, y in enumerate(self.languages)}
        words: list[Counter] = [Counter() for _ in self.languages]
        for _, text, y in rows:
            words[place[y]].update(words_of(text))
        self.words = self._table(words)
        self.grams = {}
        for n in range(1, LONGEST + 1):
            counted: list[Counter] = [Counter() for _ in self.languages]
            for c, w in zip(counted, words, strict=True):
                for word, k in w.items():
                    for g in grams(word, n):
                        c[g] += k
            self.grams[n] = self._table(counted)

    @staticmethod
    def _table(counts: list[Counter]) -> dict[str, list[float]]:
        total = sum(counts, Counter())
        keys = sorted(k for k, n in total.items() if n >= SUPPORT)
        seen = np.array([[c[k] for k in keys] for c in counts], np.float32).reshape(len(counts), len(keys))
        logs = np.log((seen + SMOOTHING) / (seen.sum(1, keepdims=True) + SMOOTHING * max(1, len(keys))))
        logs -= logs.max(0, keepdims=True) if len(counts) else 0
        return dict(zip(keys, logs.T.tolist(), strict=True))

    def word(self, word: str) -> list[float]:
        if word in self.words:
            return self.words[word]
        for n in range(LONGEST, 0, -1):
            known = self.grams[n]
            if found := [known[g] for g in grams(word, n) if g in known]:
                return [sum(v) / len(found) for v in zip(*found, strict=True)]
        return [0.0] * len(self.languages)

    @staticmethod
    def key(chunk: str) -> str:
        """A chunk between white space without case and the mark that ends it."""
        return (chunk[:-1] if chunk[-1] in ".,;:!?" else chunk).lower()

    def vector(self, chunk: str) -> list[float]:
        """Summed scores of a chunk's words, and their number."""
        words = [chunk] if chunk.isalpha() else words_of(chunk)
        if len(words) == 1:
            return [*self.word(words[0]), 1.0]
        return [*map(sum, zip(*map(self.word, words), strict=True)), len(words)] if words else [0.0] * (len(self.languages) + 1)

    def predict(self, text: str | None, memo: VectorMemo) -> tuple[str, float]:
        total = np.zeros(len(self.languages) + 1)
        for _, stretch in stretches(text if self.languages else None):
            rows = memo.rows(stretch.split())
            total += memo.matrix[rows].sum(0, dtype=np.float64)
        if not total[-1]:
            return "und", 0.0
        logits = total[:-1] * min(1.0, EVIDENCE / total[-1])
        p = np.exp(logits - logits.max())
        best = int(np.argmax(total[:-1]))
        return self.languages[best], float(p[best] / p.sum())

    def memo(self) -> VectorMemo:
        return VectorMemo(self.vector, len(self.languages) + 1, key=self.key)


def learn(docs: DataFrame) -> Model:
    """From a bounded sample, of each language, of the documents with one that are not held out."""
    return trained(labelled_sample(docs, docs.select("doc_id", F.col("lang").cast("string").alias("lang")), "lang", 4, 2, ROWS, each=True), Model)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row, from its text alone."""
    shipped, token = docs.sparkSession.sparkContext.broadcast(model or learn(docs)), uuid.uuid4().hex

    def scored(batches):
        model = shipped.value
        known = per_worker(token, model.memo)
        for b in batches:
            found = [model.predict(t, known) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (residue("doc_id", 4) == 2).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(trimmed(scored), "doc_id long, held_out boolean, lang_pred string, score double")
