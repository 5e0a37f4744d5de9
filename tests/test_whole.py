"""Queries do the whole job: brute force over small tables, where SQL is too slow to compare with."""

import datetime as dt
import os
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fathomline.operators import graph
from fathomline.plans import queries as plans

N = 23


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Orders of customers 0 to 22 for parts whose producers are among them, with cycles and loops."""
    path = str(tmp_path_factory.mktemp("whole"))
    pairs = sorted({(c, (c * c + 5 * k + 3) % N) for c in range(N) for k in range(3)} | {(4, 4)})
    day = dt.datetime(1999, 1, 1)
    items = [(i, p, 1, 1, "A", day) for i, (_, p) in enumerate(pairs)]
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_shipdate timestamp_ntz").write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(i, c) for i, (c, _) in enumerate(pairs)], "o_orderkey long, o_custkey long").write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame([(s,) for s in range(0, N, 2)], "s_suppkey long").write.parquet(f"{path}/supplier.parquet")
    spark.createDataFrame([(0,), (7,)], "n_nationkey int").write.parquet(f"{path}/nation.parquet")
    return path, [(p, c) for c, p in pairs]


def test_transitive_follows_every_edge(spark, folder):
    path, edges = folder
    after = defaultdict(set)
    for p, c in edges:
        after[p].add(c)
    name = lambda p, c: f"{p:012d}-{c:012d}"
    want = {}
    for s in range(0, N, 2):
        paths = [[s]]
        for depth in (1, 2, 3):
            paths = [[*x, c] for x in paths for c in after[x[-1]] if c not in x]
            for x in paths if depth > 1 else []:
                key, via = (s, x[-1], depth), ",".join(map(name, x, x[1:]))
                want[key] = min(want.get(key, via), via)
    got = plans.transitive(spark, path).collect()
    assert {(r.start, r.consumer, r.depth): r.via for r in got} == want and len(got) == len(want) > 100


def test_closure_follows_every_edge(spark, folder):
    path, edges = folder
    want, frontier, k = {0: 0, 7: 0}, {0, 7}, 0
    while frontier:
        k += 1
        frontier = {c for p, c in edges if p in frontier and c not in want}
        want |= dict.fromkeys(frontier, k)
    got = plans.invalidation_closure(spark, path).collect()
    assert {r.node: r.distance for r in got} == want and len(got) == len(want) > 10


def test_closure_of_a_chain_longer_than_any_bound(spark):
    chain = spark.createDataFrame([(i + 1, i) for i in range(70)] + [(0, 70)], "node long, depends_on long").coalesce(1)
    got = graph.closure(spark.createDataFrame([(0,)], "node long"), chain).collect()
    assert {r.node: r.distance for r in got} == {i: i for i in range(71)} and len(got) == 71


def test_only_files_beyond_two_mebibytes_are_oversized(spark, tmp_path):
    sizes = {21: 2 * 1024 * 1024 + 1, 22: 6001, 33: 2 * 1024 * 1024, 32: 10}
    rows = spark.createDataFrame([(i, "s") for i in sizes], "doc_id long, source string").withColumn("text", F.expr("repeat('x', " + "CASE doc_id " + " ".join(f"WHEN {i} THEN {n}" for i, n in sizes.items()) + " END)"))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.path: r for r in plans.artifact_classify(spark, str(tmp_path)).collect()}
    assert got["src/f21.md"].classification == "oversized" and got["src/f21.md"].content_hash is None and got["src/f21.md"].line_count is None
    for path in ("src/f22.ts", "src/f32.md", "src/f33.ts"):
        assert (got[path].classification, got[path].line_count) == ("source", 1) and got[path].content_hash
    total = plans.coverage_rollup(spark, str(tmp_path)).first()
    assert (total.limited, total.processed, total.lines) == (1, 3, 3)


def test_the_join_reads_its_references_once(spark):
    """Selected references and states are written once; what is joined does not read lines and orders again."""
    from fathomline.plans import analyze

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no tables")
    edges, problems = analyze.joined(spark, "/root/testdata/sf0.001")
    for df in (edges, problems):
        assert not [f for f in df.inputFiles() if "lineitem" in f or "orders" in f]


def test_aliases_of_equal_conditions_are_one_row(spark):
    """A request meets conditions, not services: as many aliases as there are add nothing to the join."""
    from fathomline.operators import registry

    always = ["cast('2000-01-01' as date) as valid_from", "cast(null as date) as valid_until"]
    services = spark.range(300).selectExpr("id", *always)
    aliases = spark.range(300).selectExpr("id as service", "'host' as kind", "'svc' as value", "cast(null as string) as path_prefix", "'prod' as environment", *always)
    asked = spark.sql("select 'r' as request_id, 'host' as kind, 'SVC.' as value, 'prod' as environment, cast(null as string) as path, cast('2001-01-01' as date) as at")
    both = registry.resolve_aliases(asked, aliases, services)
    assert [r.state for r in both.collect()] == ["ambiguous"] and "min(service" in both._jdf.queryExecution().optimizedPlan().toString()
    one = registry.resolve_aliases(asked, aliases.where("service = 7"), services).first()
    assert (one.state, one.service) == ("resolved", 7)


def test_paths_by_blocks_and_slices(spark, folder, monkeypatch):
    """Whatever the blocks of starts and slices of ends are, the paths are the same; the last step is taken in tasks, so
    the many paths to one end are no rows."""
    path, _ = folder
    once = plans.transitive(spark, path)
    assert "FlatMapCoGroupsInArrow" in once._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(graph, "BLOCK_PATHS", 5)
    monkeypatch.setattr(graph, "SLICE_HOPS", 9)
    rows = lambda df: sorted(map(tuple, df.collect()))
    got = rows(plans.transitive(spark, path))
    assert got == rows(once) and len(got) > 100


def test_paths_are_shuffled_packed(spark, monkeypatch):
    """A block of starts and a slice of ends are one row each: hops are not shuffled once a block, nor paths once a slice;
    and a start's second path counts where the first one leads through the end."""
    n = 60
    monkeypatch.setattr(graph, "BLOCK_PATHS", 400)
    monkeypatch.setattr(graph, "SLICE_HOPS", 60)
    pairs = [(p, (p * 7 + 11 * k) % n) for p in range(n) for k in range(1, 8)] + [(p, 1000 + (p + k) % 90) for p in range(n) for k in range(20)]
    edges = {(p, c): f"{(p * 31 + c * 17) % 997:03d}-{p}-{c}" for p, c in pairs if p != c}
    e = spark.createDataFrame([(i, p, c) for (p, c), i in edges.items()], "edge_id string, producer long, consumer long")
    out = graph.bounded_paths(e, spark.range(0, n, 2).withColumnRenamed("id", "start"))
    store = spark.sparkContext._jsc.sc().statusStore()

    def records():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = records()
    got = {(r.start, r.consumer, r.depth): tuple(r.via) for r in out.collect()}
    shuffled, after, want = records() - before, defaultdict(set), {}
    for p, c in edges:
        after[p].add(c)
    for s in range(0, n, 2):
        paths = [[s]]
        for depth in (1, 2, 3):
            paths = [[*x, c] for x in paths for c in after[x[-1]] if c not in x]
            for x in paths if depth > 1 else []:
                key, via = (s, x[-1], depth), tuple(edges[h] for h in zip(x, x[1:], strict=False))
                want[key] = min(want.get(key, via), via)
    assert got == want and len(got) > 3000
    assert shuffled < len(edges)
