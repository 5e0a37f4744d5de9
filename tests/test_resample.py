"""The published draws, number by number, against plain Python."""

import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.operators import resample


def numbers(step, state):
    while True:
        state = (state * step[0] + step[1]) % (1 << 32)
        yield state / 4294967296


def seed_of(items):
    return int(hashlib.sha256(json.dumps(items, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()[:8], 16)


@pytest.mark.parametrize("step", [resample.CLUSTER_STEP, resample.AGREEMENT_STEP])
def test_any_place_of_the_sequence(step):
    draw = numbers(step, 99)
    want = np.array([int(next(draw) * 4294967296) for _ in range(5000)], np.uint32)
    for start, count, rungs in ((0, 5000, 7), (0, 1, 1), (1234, 2000, 64), (4999, 1, 4096)):
        got = np.concatenate(list(resample.stretch(step, 99, start, count, resample.ladder(step, rungs))))
        assert (got == want[start : start + count]).all()
    assert resample.ahead(step, 1 << 32) == (1, 0)  # after its period it is where it was


def plain_bootstrap(cases, draws):
    clusters = {}
    for c in cases:
        clusters.setdefault((c["organization"], c["producer"], c["consumer"]), []).append(c)
    clusters, draw = list(clusters.values()), numbers(resample.CLUSTER_STEP, seed_of([str(c["case_id"]) for c in cases]))

    def estimate(values):
        d = sum(v["weight"] for v in values)
        return sum(v["weight"] for v in values if v["label_action"] == "coordinate") / d if d else 0

    samples = sorted(estimate([v for _ in clusters for v in clusters[math.floor(next(draw) * len(clusters))]]) for _ in range(draws))
    return estimate(cases), len(clusters), samples[math.floor(draws * 0.025)], samples[min(draws - 1, math.floor(draws * 0.975))], draws


CASE = "case_id long, organization string, producer long, consumer long, label_action string, weight double"


def frame(spark, rows):
    fixed = {"policy_selected": F.lit(True), "detector_output": F.lit("candidate"), "suppressed": F.lit(False), "claim_action": F.lit("coordinate"), "claim_impact": F.lit("x"), "label_edge": F.lit("confirmed"), "label_impact": F.lit("x")}
    return spark.createDataFrame(rows, CASE).withColumns(fixed)


@pytest.mark.parametrize("chunk,stretch", [(1 << 14, 1 << 20), (4, 16)])
def test_clusters_are_drawn_as_published(spark, monkeypatch, chunk, stretch):
    monkeypatch.setattr(resample, "CHUNK", chunk)
    monkeypatch.setattr(resample, "STRETCH", stretch)
    monkeypatch.setattr(resample, "BLOCK", 8)
    r = np.random.default_rng(1)
    rows = [(i, f"o{r.integers(3)}", int(r.integers(5)), int(r.integers(4)), str(r.choice(["coordinate", "none"])), float(r.integers(1, 4))) for i in range(150)]
    df = frame(spark, rows).repartition(7)
    out = resample.cluster_bootstrap(df.unionByName(df.limit(5).withColumns({"label_action": F.lit("indeterminate"), "case_id": F.col("case_id") + 1000})), draws=60).first()
    want = plain_bootstrap([dict(zip(("case_id", "organization", "producer", "consumer", "label_action", "weight"), x, strict=True)) for x in rows], 60)
    assert tuple(out) == (want[0], want[1], want[2], want[3], want[4])


def test_nothing_to_draw(spark):
    out = resample.cluster_bootstrap(frame(spark, [])).first()
    assert tuple(out) == (0.0, 0, 0.0, 1.0, 0)
    assert resample.agreement_intervals(spark.createDataFrame([], "axis string, a string, b string, position long")).count() == 0
    one = resample.cluster_bootstrap(frame(spark, [(1, "o", 1, 1, "coordinate", 0.0)]), draws=10).first()
    assert tuple(one) == (0.0, 1, 0.0, 0.0, 10)


def test_pairs_are_drawn_as_published(spark):
    r = np.random.default_rng(2)
    pairs = {axis: [(str(r.choice(list("xyz"))), str(r.choice(list("xyz")))) for _ in range(n)] for axis, n in (("edge", 40), ("impact", 7))}
    pairs["action"] = [("é\"", "é\"")] * 5
    rows = [(axis, a, b, i) for axis, ps in pairs.items() for i, (a, b) in enumerate(ps)]
    got = {g.axis: (g.lower95, g.upper95) for g in resample.agreement_intervals(spark.createDataFrame(rows, "axis string, a string, b string, position long").repartition(5), draws=80).collect()}

    def alpha(values):
        count = {}
        for pair in values:
            for x in pair:
                count[x] = count.get(x, 0) + 1
        expected = 1 - sum((c / (2 * len(values))) ** 2 for c in count.values())
        return 1.0 if expected == 0 else 1 - (1 - sum(a == b for a, b in values) / len(values)) / expected

    for axis, ps in pairs.items():
        draw = numbers(resample.AGREEMENT_STEP, seed_of([list(p) for p in ps]))
        samples = sorted(alpha([ps[math.floor(next(draw) * len(ps))] for _ in ps]) for _ in range(80))
        assert got[axis] == pytest.approx((samples[2], samples[78]), abs=1e-12)


def test_places_follow_the_order(spark):
    df = spark.createDataFrame([(int(x),) for x in np.random.default_rng(3).permutation(500)], "v long").repartition(9)
    placed, total = resample.numbered(df, "v")
    assert total == 500 and all(r.v == r.place for r in placed.collect())


def test_picks_are_never_broadcast(spark):
    """They are as many as elements times draws; Spark takes them for a few numbers."""
    placed = spark.range(3000).select(F.col("id").alias("place"), F.lit(1.0).alias("one"), F.col("id").alias("v"))
    sums = resample.draw_sums(placed, ["one", "v"], 3000, resample.AGREEMENT_STEP, 7, 20)
    rows = sums.collect()
    assert len(rows) == 20 and all(r.one == 3000 for r in rows)
    assert "Broadcast" not in sums._jdf.queryExecution().explainString(sums.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
