"""Trees as a source, records taken once by batches, and forms of identifiers."""

import pytest
from pyspark.sql import functions as F

from fathomline.functions import identity
from fathomline.sources import extract, tables, trees
from fathomline.streaming.ledger import LedgerSink

SHA, OTHER = "a" * 40, "b" * 64
ENTRY = "repository string, commit string, path string, mode string, type string, object_id string, size long"


def dumps(spark, tmp_path):
    rows = [
        ("one", "c1", "src/a b.ts", "100644", "blob", SHA, 12), ("one", "c1", "line\nend.ts", "100755", "blob", OTHER, 0), ("one", "c1", "link", "120000", "blob", SHA, 3), ("one", "c1", "sub", "160000", "commit", SHA, None),
        ("one", "c2", "src/a.ts", "100644", "blob", SHA, 1 << 40), ("two", "c1", "tab\tin name", "100644", "blob", SHA, 5),
        ("bad", "c1", "good.ts", "100644", "blob", SHA, 1), ("bad", "c1", "../up", "100644", "blob", SHA, 1), ("bad", "c2", "x", "100644", "blob", "short", 1), ("bad", "c3", "ok", "100644", "blob", SHA, 1),
    ]
    folder = f"file://{tmp_path}/dumps"
    trees.write_dumps(spark.createDataFrame(rows, ENTRY), folder)
    return rows, folder


def test_dumps_come_back(spark, tmp_path):
    rows, folder = dumps(spark, tmp_path)
    entries, refused = trees.read_trees(spark, folder)
    kind = lambda r: "submodule" if r[3] == "160000" else "symlink" if r[3] == "120000" else "blob"
    want = {(r[0], r[1], r[2], r[3], kind(r), r[5], r[6]) for r in rows if (r[0], r[1]) not in (("bad", "c1"), ("bad", "c2"))}
    assert {tuple(r) for r in entries.select("repository", "commit", "path", "mode", "kind", "object_id", "size").collect()} == want
    assert {tuple(r) for r in refused.collect()} == {("bad", "c1", 1), ("bad", "c2", 1)}
    (tmp_path / "dumps/repository=raw/commit=c").mkdir(parents=True)
    (tmp_path / "dumps/repository=raw/commit=c/tree").write_bytes(f"100644 blob {SHA}      12\tx.ts\x00garbage\x00".encode())
    assert {r.repository for r in trees.read_trees(spark, folder)[1].collect()} == {"bad", "raw"}


def test_folders_are_pruned(spark, tmp_path):
    _, folder = dumps(spark, tmp_path)
    entries, _ = trees.read_trees(spark, folder)
    one = entries.where("repository = 'one' and commit = 'c2'")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "repository" in plan.split("PartitionFilters")[1][:200]
    assert [r.path for r in one.collect()] == ["src/a.ts"]


RECORD = "id long, hash string, payload string"


def test_conflicts_within_a_batch_are_told(spark):
    held = spark.createDataFrame([(1, "a", "x"), (5, None, "n")], RECORD)
    rows = [(1, "a", "again"), (1, "a", "x"), (2, "b", "x"), (2, "b", "y"), (3, "c", "x"), (3, "d", "x"), (4, None, "x"), (5, None, "x"), (5, "z", "x"), (6, None, "x"), (6, "q", "x")]
    new, conflicts = tables.insert_if_absent(held, spark.createDataFrame(rows, RECORD), ["id"], "hash")
    assert sorted(map(tuple, new.collect())) == [(2, "b", "x"), (4, None, "x")]
    assert sorted((r.id, str(r.hash)) for r in conflicts.collect()) == [(3, "c"), (3, "d"), (5, "None"), (5, "z"), (6, "None"), (6, "q")]
    one = spark.createDataFrame([(1, "other", "x")], RECORD)
    assert [x.count() for x in tables.insert_if_absent(held, one, ["id"], "hash")] == [0, 1]


def test_a_batch_is_taken_once(spark, tmp_path, monkeypatch):
    sink = lambda: LedgerSink(spark, f"file://{tmp_path}/sink", RECORD, ["id"], "hash")
    frame = lambda rows: spark.createDataFrame(rows, RECORD)
    assert sink().records().count() == 0
    sink().write(frame([(1, "a", "x"), (2, "b", "x")]), 0)
    broken = sink()

    def dies(*_):
        raise RuntimeError("between the rows and the ledger")

    monkeypatch.setattr(broken, "_commit", dies)
    with pytest.raises(RuntimeError):
        broken.write(frame([(2, "other", "x"), (3, "c", "x")]), 1)
    assert {r.id for r in sink().records().collect()} == {1, 2}  # what the ledger has not is not read
    sink().write(frame([(2, "other", "x"), (3, "c", "x")]), 1)
    sink().write(frame([(2, "other", "x"), (3, "c", "x")]), 1)
    assert sorted(r.id for r in sink().records().collect()) == [1, 2, 3]
    assert [(r.batch, r.id) for r in sink().conflicts().collect()] == [(1, 2)]
    assert {tuple(r) for r in sink().batches().select("batch", "appended", "conflicts").collect()} == {(0, 2, 0), (1, 1, 1)}


def test_a_stream_restarts(spark, tmp_path, monkeypatch):
    source, place = f"file://{tmp_path}/in", f"file://{tmp_path}/sink"
    for k in range(3):
        spark.createDataFrame([(10 * k + i, f"h{i}", "x") for i in range(4)] + [(0, "h0", "again")], RECORD).coalesce(1).write.mode("append").parquet(source)
    sink = LedgerSink(spark, place, RECORD, ["id"], "hash")
    stream = lambda: spark.readStream.schema(RECORD).option("maxFilesPerTrigger", 1).parquet(source)
    commit, seen = sink._commit, []

    def dies_once(number, *counts):
        if number == 1 and not seen:
            seen.append(number)
            raise RuntimeError("the driver is gone")
        commit(number, *counts)

    monkeypatch.setattr(sink, "_commit", dies_once)
    with pytest.raises(Exception, match="the driver is gone"):
        sink.start(stream(), f"file://{tmp_path}/checkpoint").awaitTermination()
    sink.start(stream(), f"file://{tmp_path}/checkpoint").awaitTermination()
    assert seen == [1] and sorted(r.id for r in sink.records().collect()) == sorted({10 * k + i for k in range(3) for i in range(4)})
    assert sink.batches().count() == 3


def test_identifiers(spark):
    uuid = "0190a2b4-7c1d-7e3f-8a5b-0123456789ab"
    cases = [
        ("workspace", f"wsp_{uuid}", True), ("workspace", f"gen_{uuid}", False), ("job", f"job_{uuid.replace('-7e3f', '-4e3f')}", False), ("repository", "github:12", True), ("repository", "github:012", False), ("repository", "local:sha256:" + "a" * 64, True),
        ("registry", "reg_sha256:" + "0" * 64, True), ("edge", "edg_sha256:" + "0" * 63, False), ("adapter", "acme.x", True), ("adapter", "acme", False), ("instant", "2024-02-29T00:00:00.000Z", True), ("instant", "2023-02-29T00:00:00.000Z", False), ("instant", "2024-02-01T00:00:00Z", False),
    ]
    row = spark.range(1).select(*(identity.valid_identifier(k, F.lit(v)).alias(f"c{i}") for i, (k, v, _) in enumerate(cases))).first()
    assert [bool(x) for x in row] == [w for _, _, w in cases]


def test_composed_segments_and_paths(spark):
    rows = [("cafe\u0301",), ("\u3000a b\ufeff",), ("\U0001f600" * 257,), ("\U0001f600" * 256,), (" \t",), ("a\0",), (None,)]
    df = spark.createDataFrame(rows, "x string").coalesce(1)
    got = [r.s for r in df.select(identity.identity_segment(F.col("x")).alias("s")).collect()]
    assert got[:3] == ["caf%C3%A9", "a%20b", None] and got[3] == "%F0%9F%98%80" * 256 and got[4:] == [None, None, None]
    paths = [("a/b.ts", True), ("caf\u00e9.ts", True), ("cafe\u0301.ts", False), ("C:x", False), ("/a", False), ("a//b", False), ("a/../b", False), ("a\\b", False)]
    df = spark.createDataFrame([(p,) for p, _ in paths], "x string").coalesce(1)
    assert [r.ok for r in df.select(identity.valid_repo_path(F.col("x")).alias("ok")).collect()] == [w for _, w in paths]


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_routes_are_looked_for_once_and_by_many_tasks(spark, monkeypatch):
    """Many small files in one part of a table are spread, and their texts looked through once for all rows."""
    seen, keep = [], extract.materialise
    monkeypatch.setattr(extract, "materialise", lambda df, label: seen.append(_plan(df)) or keep(df, label))
    texts = ["app.get('/a/:id', h); fetch(url);", "app.get('/a/:id', h); fetch(url);", "x.use('/p', proxy())"]
    out = extract.http_contracts(spark.createDataFrame([(f"f{i % 2}", t) for i, t in enumerate(texts)], "path string, text string").coalesce(1))
    assert len(seen) == 1 and "RepartitionByExpression" in seen[0] and "Generate" not in _plan(out)
    assert sorted((r.path, r.role, r.method, r.route) for r in out.collect()) == [
        ("f0", "definition", "GET", "/a/{param}"), ("f0", "limitation", "dynamic_url", None), ("f0", "limitation", "proxy_rewrite_unsupported", None), ("f1", "definition", "GET", "/a/{param}"), ("f1", "limitation", "dynamic_url", None),
    ]


def test_namespaces_are_replayed_by_many_tasks(spark):
    """No frame a namespace, texts in order of path, and namespaces that end within and between batches."""
    rows = [(f"n{i % 700}", str(i // 700), ["CREATE TABLE t (a int)", "ALTER TABLE t RENAME TO u"][i // 700]) for i in range(1400)]
    files = spark.createDataFrame(rows[::-1], "namespace string, path string, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = extract.replay_migrations(files)
        assert "FlatMapGroups" not in _plan(out) and "RepartitionByExpression" in _plan(out)
        got = sorted((r.namespace, r.kind, r.name) for r in out.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    tables = [g for g in got if g[1] == "table"]
    assert len({g[0] for g in got}) == 700 and all(g[2] == "u" or g[2].startswith("u.") for g in got), tables[:3]


def test_modules_are_read_by_many_tasks(spark):
    out = extract.module_symbols(spark.createDataFrame([("a.ts", "export const x = 1;")], "path string, text string").coalesce(1))
    assert "RepartitionByExpression" in _plan(out) and [(r.role, r.name) for r in out.collect()] == [("export", "x")]
