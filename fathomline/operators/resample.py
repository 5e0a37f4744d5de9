"""Bootstraps with the published draws (A17, A18), computed where they are needed.

The published generator is a linear congruence of 32 bits, one number after the other through all draws. A step
is an affine map, so n steps are one too, and any place of the sequence is reached in the logarithm of n: a task
computes its own stretch of a draw, whatever came before it. A drawn number picks an element by its place in a
list; places are given by the order of the elements over range partitions, counted in two levels. A task sends,
for each stretch of a draw and each chunk of the list, which places it picked; all draws' picks of a chunk meet its
values once, and only their sums go on: one row a draw.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import json_text
from ..functions.stats import ratio
from ..sources.tables import materialise
from .evaluation import metric_rules

C = F.col
#: Multipliers and increments of the two generators, and how many draws are made.
CLUSTER_STEP, CLUSTER_DRAWS = (1_664_525, 1_013_904_223), 1000
AGREEMENT_STEP, AGREEMENT_DRAWS = (1_103_515_245, 12_345), 500
#: Places of a chunk of the list (at most 1 << 16, as picks are two bytes), picks of a stretch, and picks made at once.
CHUNK, STRETCH, BLOCK = 1 << 14, 1 << 20, 1 << 16
_MASK = (1 << 32) - 1


def ahead(step: tuple[int, int], n: int) -> tuple[int, int]:
    """Multiplier and increment of n steps at once."""
    a, c = 1, 0
    by, add = step
    while n:
        if n & 1:
            a, c = a * by & _MASK, (c * by + add) & _MASK
        by, add = by * by & _MASK, (add * by + add) & _MASK
        n >>= 1
    return a, c


def ladder(step: tuple[int, int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and increments of 1 to n steps."""
    a, c = np.array([step[0]], np.uint32), np.array([step[1]], np.uint32)
    while len(a) < n:  # k steps more than each that is known
        by, add = a[-1], c[-1]
        a, c = np.concatenate([a, a * by]), np.concatenate([c, a * add + c])
    return a[:n], c[:n]


def stretch(step: tuple[int, int], seed: int, start: int, count: int, rungs: tuple[np.ndarray, np.ndarray]):
    """Blocks of the sequence from place `start` on (place 0 is the first after the seed)."""
    while count > 0:
        a, c = ahead(step, start)
        state = np.uint32((a * seed + c) & _MASK)
        n = min(count, len(rungs[0]))
        yield rungs[0][:n] * state + rungs[1][:n]
        start, count = start + n, count - n


def list_seed(texts: DataFrame) -> int:
    """The seed that the published rules make of a list: the first eight digits of the hash of its canonical JSON. A
    hash takes one byte after the other, so this column alone goes through one task, batch by batch: texts(position,
    json), json being an element's. Who cannot afford that gives a seed."""

    def hashed(batches):
        digest, first = hashlib.sha256(b"["), True
        for b in batches:
            for text in b.column(0).to_pylist():
                digest.update((text if first else f",{text}").encode())
                first = False
        digest.update(b"]")
        yield pa.RecordBatch.from_arrays([pa.array([digest.hexdigest()])], names=["digest"])

    row = texts.repartition(1).sortWithinPartitions("position").select("json").mapInArrow(hashed, "digest string").first()
    return int((row["digest"] if row else hashlib.sha256(b"[]").hexdigest())[:8], 16)


def numbered(rows: DataFrame, order: str) -> tuple[DataFrame, int]:
    """rows with `place`, 0 and up in the order of a column, and how many there are. Rows are sorted by ranges; a
    row's place is its place in its range and the sizes of the ranges before, of which the driver sees one number
    each."""
    laid = materialise(rows.orderBy(order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    sizes = {r["p"]: r["n"] for r in laid.groupBy(F.shiftright("_at", 33).alias("p")).agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for p in sorted(sizes):
        before.append((p, total))
        total += sizes[p]
    starts = rows.sparkSession.createDataFrame(before, "_p long, _before long")
    placed = laid.withColumn("_p", F.shiftright("_at", 33)).join(F.broadcast(starts), "_p")
    return placed.withColumn("place", C("_before") + C("_at").bitwiseAND((1 << 33) - 1)).drop("_p", "_at", "_before"), total


def draw_sums(placed: DataFrame, values: list[str], total: int, step: tuple[int, int], seed: int, draws: int) -> DataFrame:
    """draw and the sum of each value over the elements that the draw picks, one row a draw; placed(place, values).
    A chunk meets all picks of its places in one group: two bytes a pick, one a place and draw on the average. Neither
    side is ever broadcast: Spark takes the picks for as small as the numbers of the stretches they are made of."""
    spark = placed.sparkSession
    parts = max(1, -(-total // STRETCH))

    def picked(batches):
        rungs = ladder(step, BLOCK)
        for b in batches:
            for unit in b.column(0).to_pylist():
                draw, part = divmod(unit, parts)
                start, end = part * total // parts, (part + 1) * total // parts
                if start == end:
                    continue
                blocks = stretch(step, seed, draw * total + start, end - start, rungs)
                places = np.sort(np.concatenate([np.floor(states.astype(np.float64) / 4294967296.0 * total).astype(np.int64) for states in blocks]))
                chunks, first = np.unique(places // CHUNK, return_index=True)
                at = [(own - k * CHUNK).astype(np.uint16).tobytes() for k, own in zip(chunks.tolist(), np.split(places, first[1:]), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), draw)), pa.array(chunks), pa.array(at, pa.binary())], names=["draw", "chunk", "at"])

    def summed(picks: pa.Table, elements: pa.Table) -> pa.Table:
        place = elements["place"].to_numpy() % CHUNK
        held = np.zeros((CHUNK, len(values)))
        for j, v in enumerate(values):
            held[place, j] = elements[v].to_numpy()
        out = np.zeros((picks.num_rows, len(values)))
        for i, at in enumerate(picks["at"]):
            out[i] = np.bincount(np.frombuffer(at.as_py(), np.uint16), minlength=CHUNK) @ held
        return pa.table([picks["draw"], *(pa.array(out[:, j]) for j in range(len(values)))], names=["draw", *values])

    picks = spark.range(draws * parts).select("id").mapInArrow(picked, "draw long, chunk long, at binary")
    elements = placed.select("place", *(F.coalesce(C(v).cast("double"), F.lit(0.0)).alias(v) for v in values), F.floor(C("place") / CHUNK).alias("chunk"))
    met = picks.groupBy("chunk").cogroup(elements.groupBy("chunk"))
    sums = met.applyInArrow(summed, "draw long, " + ", ".join(f"{v} double" for v in values))
    return sums.groupBy("draw").agg(*(F.sum(v).alias(v) for v in values))


def _bounds(estimates: list[float]) -> tuple[float, float]:
    """The published bounds of sorted estimates: 0 and 1 without any."""
    e = sorted(estimates)
    return (e[int(len(e) * 0.025)], e[min(len(e) - 1, int(len(e) * 0.975))]) if e else (0.0, 1.0)


def cluster_bootstrap(cases: DataFrame, position: str = "case_id", seed: int | None = None, draws: int = CLUSTER_DRAWS) -> DataFrame:
    """Actionable precision with a cluster bootstrap interval over organisation, producer and consumer (A17), with the
    published draws: clusters in the order of their first case by `position`; the seed is that of the list of
    case ids unless one is given. Where weights are no whole numbers a draw's sums are rounded in another order."""
    spark = cases.sparkSession
    counts, success, open_ = metric_rules()["actionable_precision"]
    seen = cases.where(counts & ~open_)
    key = ["organization", "producer", "consumer"]
    clusters = seen.groupBy(*key).agg(F.min(position).alias("first"), F.sum("weight").alias("d"), F.sum(F.when(success, C("weight")).otherwise(0.0)).alias("n"))
    placed, total = numbered(clusters.select("first", "n", "d"), "first")
    point = placed.agg(F.coalesce(ratio(F.sum("n"), F.sum("d")), F.lit(0.0)).alias("estimate")).first()["estimate"]
    estimates = []
    if total:
        if seed is None:
            seed = list_seed(seen.select(C(position).alias("position"), json_text(C("case_id").cast("string")).alias("json")))
        sums = draw_sums(placed, ["n", "d"], total, CLUSTER_STEP, seed, draws)
        estimates = [r["n"] / r["d"] if r["d"] else 0.0 for r in sums.collect()]  # one a draw
    low, high = _bounds(estimates)
    return spark.createDataFrame([(point, total, low, high, len(estimates))], "estimate double, clusters long, lower95 double, upper95 double, iterations long")


def _alpha(cells: np.ndarray, a: list, b: list) -> np.ndarray:
    """Krippendorff's nominal alpha of each row of cell counts; cell k pairs labels a[k] and b[k]."""
    n = cells.sum(1)
    labels = list(dict.fromkeys([*a, *b]))
    of = np.array([[(x == left) + (x == right) for x in labels] for left, right in zip(a, b, strict=True)], float)
    observed = 1 - cells @ np.array([left == right for left, right in zip(a, b, strict=True)], float) / n
    expected = 1 - ((cells @ of / (2 * n)[:, None]) ** 2).sum(1)
    return np.where(expected == 0, 1.0, 1 - observed / np.where(expected == 0, 1, expected))


def agreement_intervals(pairs: DataFrame, position: str = "position", seeds: dict[str, int] | None = None, draws: int = AGREEMENT_DRAWS) -> DataFrame:
    """Bootstrap intervals of Krippendorff's alpha of each axis (A18), with the published draws: pairs(axis, a, b,
    position) in the order of `position`; an axis's seed is that of its list of pairs unless one is given. Axes
    and the pairs of labels that occur are vocabularies; an axis costs a pass."""
    spark, out = pairs.sparkSession, []
    text = pairs.select("axis", C("a").cast("string").alias("a"), C("b").cast("string").alias("b"), C(position).alias("position"))
    cells = text.groupBy("axis", "a", "b").count().orderBy("axis", "a", "b").collect()
    for axis in sorted({r["axis"] for r in cells}):
        own = text.where(C("axis") == axis)
        kinds = [(r["a"], r["b"]) for r in cells if r["axis"] == axis]
        seed = (seeds or {}).get(axis)
        if seed is None:
            seed = list_seed(own.select("position", F.concat(F.lit("["), json_text(C("a")), F.lit(","), json_text(C("b")), F.lit("]")).alias("json")))
        names = [f"c{k}" for k in range(len(kinds))]
        one_hot = own.select("position", *(((C("a") == a) & (C("b") == b)).cast("double").alias(n) for n, (a, b) in zip(names, kinds, strict=True)))
        placed, total = numbered(one_hot, "position")
        drawn = draw_sums(placed, names, total, AGREEMENT_STEP, seed, draws)
        counts = np.array([[r[n] for n in names] for r in drawn.collect()])
        out.append((axis, *_bounds(_alpha(counts, *map(list, zip(*kinds, strict=True))).tolist())))
    return spark.createDataFrame(out, "axis string, lower95 double, upper95 double")
