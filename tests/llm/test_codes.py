"""Heap Lloyd against plain Lloyd in integers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain_lloyd(q, parts, entries, rounds):
    width = q.shape[1] // parts
    books = np.stack([q[:entries, p * width : (p + 1) * width] for p in range(parts)]).astype(object)

    def assign(p):
        cut = q[:, p * width : (p + 1) * width].astype(object)
        square = np.array([[int(((x - b) ** 2).sum()) for b in books[p]] for x in cut], object)
        own = np.array([min(range(len(r)), key=lambda e: (r[e], e)) for r in square])
        return cut, own, square[np.arange(len(own)), own]

    for _ in range(rounds):
        for p in range(parts):
            cut, own, _ = assign(p)
            for e in range(len(books[p])):
                of = cut[own == e]
                if len(of):
                    books[p][e] = [int(s) // len(of) for s in of.sum(0)]
    done = [assign(p) for p in range(parts)]
    return ["".join(f"{d[1][i]:02x}" for d in done) for i in range(len(q))], sum(d[2] for d in done), books


def check(spark, rows, monkeypatch=None, parts=4, entries=8, rounds=4, scale=1024):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("q", "n", "entry", "sums", "code", "of", "size")})
    out, books = codes.compress(df.repartition(5), parts, entries, rounds, scale)
    kept = [(i, [float(np.float32(v)) for v in x]) for i, x, _ in rows if i is not None and x is not None and all(v is not None and np.isfinite(v) for v in x) and len(x) == 8]
    q = np.array([[int(np.floor(v * scale)) for v in x] for _, x in kept])
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0], q[k].tolist()))
    want, error, made = plain_lloyd(q[order], parts, entries, rounds)
    assert (books == made.astype(np.int64)).all()
    assert sorted((r.vec_id, r.code, r.error) for r in out.collect()) == sorted((kept[k][0], c, int(e)) for k, c, e in zip(order, want, error, strict=True))


def rows_of(n, seed=0, spread=1.0):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 1, (5, 8))
    return [(i, (centres[r.integers(5)] + r.normal(0, spread, 8)).astype(float).tolist(), int(r.integers(4)) if i % 7 else None) for i in range(n)]


@pytest.mark.parametrize("shard", [16, 1 << 14])
def test_equals_plain_lloyd(spark, monkeypatch, shard):
    monkeypatch.setattr(codes, "SHARD", shard)
    check(spark, rows_of(150, spread=0.2))
    check(spark, rows_of(150, 1, spread=2.0))


def test_ties_repeats_and_odd_rows(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.integers(-1, 2, 8).astype(float).tolist(), 1) for i in range(120)]  # a grid: most distances are tied
    rows += [rows[0]] * 40 + [(1, rows[5][1], None)]
    rows += [(200, None, 1), (201, [1.0] * 7 + [None], 1), (202, [float("nan")] * 8, 1), (203, [float("inf")] + [0.0] * 7, 1), (None, [0.0] * 8, 1), (204, [1.0] * 5, 1), (205, [], 1)]
    check(spark, rows, scale=1)
    check(spark, rows_of(3), entries=8)
    check(spark, rows_of(20), entries=1)


def test_great_components_stay_exact(spark):
    check(spark, [(i, [v * 3e4 for v in x], y) for i, x, y in rows_of(40)])


def test_heaps_pop_only_the_violated():
    heap = codes.Heaps(2)
    heap.fill(np.array([0, 0, 1, 0]), np.array([3.0, 0.5, 0.1, 1.0]))
    assert heap.violated([1.0, 0.0]) == ([1, 3], [0, 0])
    assert codes.Heaps.load(*heap.dump()).violated([1.0, 0.0]) == ([], [])
    heap.push([1, 3], [1, 0], [9.0, 2.0])
    assert heap.owners(4).tolist() == [0, 1, 1, 0]


def test_few_parts_are_measured_again(spark, monkeypatch):
    """Far clusters: after the first rounds nothing is violated, and the codes are right all the same."""
    rows = [(i, [float(10 * (i % 4)) + 0.01 * (i // 4 % 3)] * 8, 0) for i in range(80)]
    check(spark, rows, entries=4)
    q, size = codes.integers(spark.createDataFrame(rows, SCHEMA))
    shards, books = codes.fit(q, size, 4, 4, 4)
    assert shards.agg(F.sum(F.size("entry"))).first()[0] == 0  # the last round moved none


def test_label_sums(spark):
    rows = rows_of(60)
    out = codes.digest(spark.createDataFrame(rows, SCHEMA)).collect()
    label = {i: y for i, _, y in rows}
    total = {}
    for r in out:
        total[label[r.vec_id]] = total.get(label[r.vec_id], 0) + r.error
    assert all(r.label_error == total[label[r.vec_id]] for r in out) and len(out) == 60


def test_empty(spark):
    for rows in ([], [(1, None, 1)], [(1, [1.0, 2.0, 3.0], 1)]):
        assert codes.digest(spark.createDataFrame(rows, SCHEMA)).count() == 0
