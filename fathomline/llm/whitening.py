"""Whitening of embeddings: covariance in double-double, its eigenvectors, and every vector on the leading ones.

Components are whole numbers, floor(64 * c) + 1,000,000, so a plain sum of squares would lose the spread under the
offset. The covariance is taken over the distinct vectors, each once, in two passes: sums first, as exact
integers, then products of what is left after the mean, which is itself a pair of doubles. The products are
error-free: a block of centred vectors is cut into slices of so few bits that the matrix product of two slices
has no rounding at all, and each product is added to a pair of matrices, high and low, by an error-free sum. A task
gives one such pair; pairs are merged, high and low parts alike, by groups of FAN until the driver adds the
last. It then holds dimensions x dimensions numbers and solves for the eigenvectors by reduction to
tridiagonal form and divide and conquer, which is what LAPACK's syevd, called through numpy.linalg.eigh, does.

The distinct vectors are written once and read by both passes and by the check of the result: the covariance of
the whitened components, again in double-double, against the identity.

Defined results: vectors that are null, hold null or non-finite components, or lack an id take no part, nor do
those whose length is not the commonest (of equally common ones the shortest). Components are held within 2^40.
Repeated rows each get rows, but count once in the fit. Components whose eigenvalue is not above the rounding
of the greatest one are left out, so vectors that are all alike give no rows. A deviation beyond a long is
held at its end. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codes import finite, of_one_length
from .common import discard, materialise

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Rows of a block, and bits of a slice: a product of slices over a block stays within 53 bits.
BLOCK, BITS, SLICES = 1 << 12, 20, 4
#: Pairs merged by one task, and by the driver in the end.
FAN = 32
_PAIR = "task long, n long, high binary, low binary"


def two_sum(a, b):
    """a + b as its rounded value and the exact error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


class Pair:
    """A matrix as the unevaluated sum of a high and a low part."""

    def __init__(self, high: np.ndarray, low: np.ndarray):
        self.high, self.low = high, low

    def add(self, high, low=0.0) -> None:
        self.high, error = two_sum(self.high, high)
        self.high, self.low = two_sum(self.high, self.low + error + low)


def slices_of(high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
    """Slices whose sum is high + low, to the last slice's unit; a column's slices share their units."""
    top = np.abs(high).max(axis=0, initial=0)
    unit = np.ldexp(1.0, np.frexp(np.where(top > 0, top, 1.0))[1])  # a power of two above all of the column
    out, rest = [], high
    for k in range(SLICES):
        unit = unit * 2.0**-BITS
        cut = np.rint(rest / unit) * unit
        out.append(cut)
        rest = rest - cut
        if k == 0:
            rest = rest + low
    return out


def add_products(total: Pair, high: np.ndarray, low: np.ndarray) -> None:
    """Add the sum of y y' over the rows y = high + low. Products of slices are exact, whatever the order of their sums."""
    for at in range(0, len(high), BLOCK):
        cuts = slices_of(high[at : at + BLOCK], low[at : at + BLOCK])
        for i in range(SLICES):
            for j in range(i, SLICES - i):
                product = cuts[i].T @ cuts[j]
                total.add(product)
                if i != j:
                    total.add(product.T)


def centred(x: np.ndarray, mean: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """x less the mean, as high and low."""
    high, error = two_sum(x.astype(np.float64), -mean[0])
    return two_sum(high, error - mean[1])


def split(values) -> tuple[np.ndarray, np.ndarray]:
    """Exact fractions as high and low doubles."""
    high = np.array([float(v) for v in values])
    return high, np.array([float(v - Fraction(h)) for v, h in zip(values, high.tolist(), strict=True)])


def matrix(batch: pa.RecordBatch, column: int, size: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy().reshape(-1, size)


def integers(vectors: DataFrame, scale: int = SCALE, offset: int = OFFSET) -> tuple[DataFrame, int]:
    """vec_id and x, whole components, of the vectors that take part, and their number."""
    rows, size = of_one_length(finite(vectors), "embedding")
    most = 1 << 40
    hold = lambda v: F.greatest(F.least(F.floor(v * scale), F.lit(most)), F.lit(-most)).cast("long") + offset
    return rows.select("vec_id", F.transform("embedding", hold).alias("x")), size


def sums(fit: DataFrame, size: int) -> tuple[int, list[int]]:
    """Number of vectors and the sums of their components, exact."""

    def made(batches):
        n, s, most = 0, np.zeros(size, object), 0
        for b in batches:
            n += b.num_rows
            for at in range(0, b.num_rows, BLOCK):  # 2^12 times 2^40 is far from the end of a long
                s = s + matrix(b, 0, size)[at : at + BLOCK].sum(0).astype(object)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([[str(v) for v in s.tolist()]], pa.list_(pa.string()))], names=["n", "s"])

    rows = fit.select("x").mapInArrow(made, "n long, s array<string>")
    total = rows.agg(F.sum("n").alias("n"), *(F.sum(F.col("s")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(size))).first()
    return total["n"] or 0, [int(total[f"s{i}"] or 0) for i in range(size)]


def _pair_row(n: int, total: Pair) -> pa.RecordBatch:
    cells = [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([n], pa.int64()), pa.array([total.high.tobytes()], pa.binary()), pa.array([total.low.tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(cells, names=["task", "n", "high", "low"])


def _load(cell: bytes, width: int) -> np.ndarray:
    return np.frombuffer(cell, np.float64).reshape(width, width)


def covariance(fit: DataFrame, size: int, mean, onto: np.ndarray | None = None) -> Pair:
    """The covariance of x, or of x less the mean on the columns of `onto`, over the fit list (divisor n)."""
    width = size if onto is None else onto.shape[1]

    def made(batches):
        n, total = 0, Pair(np.zeros((width, width)), np.zeros((width, width)))
        for b in batches:
            high, low = centred(matrix(b, 0, size), mean)
            if onto is not None:
                high = high @ onto + low @ onto
                low = np.zeros_like(high)
            add_products(total, high, low)
            n += b.num_rows
        if n:
            yield _pair_row(n, total)

    def merged(key, table):
        total = Pair(np.zeros((width, width)), np.zeros((width, width)))
        for high, low in zip(table.column("high").to_pylist(), table.column("low").to_pylist(), strict=True):
            total.add(_load(high, width), _load(low, width))
        row = _pair_row(sum(table.column("n").to_pylist()), total)
        return pa.Table.from_batches([row.set_column(0, "task", pa.array([key[0].as_py()], pa.int64()))])

    pairs = materialise(fit.select("x").mapInArrow(made, _PAIR), "whitening-pairs")
    while pairs.count() > FAN:
        fewer = pairs.groupBy(F.floor(F.col("task") / FAN).alias("part")).applyInArrow(merged, _PAIR)
        fewer = materialise(fewer, "whitening-pairs")
        discard(pairs)
        pairs = fewer
    total, n = Pair(np.zeros((width, width)), np.zeros((width, width))), 0
    for r in sorted(pairs.collect(), key=lambda r: r["task"]):
        total.add(_load(bytes(r["high"]), width), _load(bytes(r["low"]), width))
        n += r["n"]
    discard(pairs)
    high = total.high / n
    # What the division leaves, from the exact product of n with its result.
    back = [[float(Fraction(h) + Fraction(low) - n * Fraction(q)) / n for h, low, q in zip(*row, strict=True)] for row in zip(total.high.tolist(), total.low.tolist(), high.tolist(), strict=True)]
    return Pair(high, np.array(back).reshape(width, width))


class Whitening:
    """n and sums of the fit, its mean, components as columns and their share, and how far the result is from white."""

    def __init__(self, n: int, total: list[int]):
        self.n, self.total = n, total
        self.mean = split([Fraction(s, n) for s in total])

    def solve(self, v: Pair, most: int) -> None:
        values, vectors = np.linalg.eigh(v.high + v.low)
        values, vectors = values[::-1], vectors[:, ::-1]
        real = int((values > max(values[0], 0) * len(values) * np.finfo(float).eps * 4).sum())
        self.values, self.onto = values[: min(most, real)], vectors[:, : min(most, real)]
        self.explained = self.values / np.trace(v.high + v.low)
        self.scaled = self.onto / np.sqrt(self.values)


def fit_whitening(x: DataFrame, size: int, components: int = COMPONENTS) -> Whitening | None:
    """Fit on the distinct vectors of x; None if nothing spreads."""
    distinct = materialise(x.select("x").distinct(), "whitening")
    n, total = sums(distinct, size)
    if not n:
        discard(distinct)
        return None
    model = Whitening(n, total)
    model.solve(covariance(distinct, size, model.mean), components)
    if len(model.values):
        white = covariance(distinct, size, model.mean, model.scaled)
        model.identity_error = float(np.abs((white.high - np.eye(len(model.values))) + white.low).max())
    discard(distinct)
    return model if len(model.values) else None


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def deviations(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """The sum of (n x - S)^2 over the dimensions, exact, held at the end of a long."""
    s = np.array(total, object)
    far = max(1, max((int(np.abs(x).max(initial=0)) + 1) * n + max(abs(t) for t in total), 1))
    kind = np.int64 if far < 1 << 62 else object
    apart = n * x.astype(kind) - s.astype(kind)
    top = int(np.abs(apart).max(initial=0))
    if kind is object or top * top * x.shape[1] >= 1 << 63:
        apart = apart.astype(object)
    return np.minimum((apart * apart).sum(1), np.iinfo(np.int64).max).astype(np.int64)


def whiten(x: DataFrame, size: int, model: Whitening) -> DataFrame:
    """A row for each row of x and component."""
    n, total, mean, scaled, explained, error = model.n, model.total, model.mean, model.scaled, model.explained, model.identity_error
    k = len(explained)

    def made(batches):
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                values, m = matrix(part, 1, size), part.num_rows
                high, low = centred(values, mean)
                cells = (
                    np.repeat(part.column(0).to_numpy(), k), np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, n),
                    np.repeat(deviations(values, n, total), k), (high @ scaled + low @ scaled).ravel(), np.tile(explained, m), np.full(m * k, error),
                )
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.select("vec_id", "x").mapInArrow(made, _OUT)


def digest(vectors: DataFrame) -> DataFrame:
    """What op13 returns: every kept row on the leading components."""
    x, size = integers(vectors)
    model = fit_whitening(x, size) if size else None
    if model is None:
        return x.where("false").select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in (f.split() for f in _OUT.split(", ")[1:])))
    return whiten(x, size, model)
