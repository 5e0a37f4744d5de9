"""The join kept up to date against a join from scratch, round after round."""

import random

from pyspark.sql import functions as F

from fathomline.operators import contracts, incremental

CHANGE = "contract_kind string, canonical_key string, producer long, change_kind string, compatibility string, service long, producer_generation string, definition_stratum string"
REF = "reference_id string, consumer long, contract_kind string, canonical_key string, constrained_key string, context_basis string, alias_state string, alias_service long"
COLUMNS = ["edge_id", "canonical_key", "consumer", "reference_id", "basis", "compatibility"]


def change(r, k):
    return ("kind" + str(k % 2), f"k{k}", 1, "changed", r.choice(["breaking", "compatible"]), r.randrange(3), "g", "s")


def reference(r, i):
    basis = r.choice([None, None, "heuristic", "declared_context"])
    own, other = r.choice([None, f"k{r.randrange(30)}"]), r.choice([None, f"k{r.randrange(30)}"])
    return (f"r{i}", i % 7, "kind" + str(r.randrange(2)), own, other, basis, r.choice([None, "resolved", "ambiguous"]), r.randrange(3))


def refs_of(spark, rows):
    df = spark.createDataFrame(rows, REF)
    known = df.where("alias_state is not null").select("reference_id", F.col("alias_state").alias("state"), F.col("alias_service").alias("service"))
    made = df.drop("alias_state", "alias_service").withColumns({"generation_id": F.lit(1).cast("long"), "first_observed": F.lit("a"), "last_observed": F.lit("b"), "stratum": F.lit("t"), "unresolved_pattern": F.lit(None).cast("string")})
    return contracts.with_alias_state(made, known)


def edges_of(df):
    return sorted(tuple(map(str, x)) for x in df.select(*COLUMNS).collect())


def clean(spark, changes, refs):
    df = refs_of(spark, list(refs.values()))
    return edges_of(incremental.joined(spark.createDataFrame(list(changes.values()), CHANGE), incremental.keyed(df), "w", "rev"))


def test_rounds_equal_a_clean_join(spark, tmp_path):
    r = random.Random(4)
    changes, refs = {k: change(r, k) for k in range(20)}, {i: reference(r, i) for i in range(450)}
    store = incremental.RejoinStore(spark, f"file://{tmp_path}/s", "w", "rev", buckets=64)
    store.create(spark.createDataFrame(list(changes.values()), CHANGE), refs_of(spark, list(refs.values())))
    assert edges_of(store.edges()) == clean(spark, changes, refs) and len(edges_of(store.edges())) > 20
    for turn in range(3):
        was_c, now_c, was_r, now_r = [], [], [], []
        for k in r.sample(range(30), 3):  # changed, new or gone
            if k in changes:
                was_c.append(changes.pop(k))
            if turn < 2:
                changes[k] = change(r, k)
                now_c.append(changes[k])
        for i in r.sample(range(470), 6):
            if i in refs:
                was_r.append(refs.pop(i))
            if i % 3:
                refs[i] = reference(r, i)
                now_r.append(refs[i])
        frame = lambda rows: spark.createDataFrame(rows, CHANGE)
        delta = {"changes": (frame(was_c), frame(now_c)), "references": (refs_of(spark, was_r), refs_of(spark, now_r))}
        written = store.refresh(**delta)
        assert edges_of(store.edges()) == clean(spark, changes, refs)
        assert 0 < len(written) < 40
        if turn == 1:  # done again, as after a crash
            store.refresh(**delta)
            assert edges_of(store.edges()) == clean(spark, changes, refs)
    assert store.refresh() == [] and store.refresh(changes=(frame([]), frame([]))) == []
    # Every change goes: no bucket keeps what it had.
    store.refresh(changes=(frame(list(changes.values())), frame([])))
    assert edges_of(store.edges()) == []


def test_only_touched_buckets_are_read_and_written(spark, tmp_path):
    r = random.Random(5)
    changes, refs = [change(r, k) for k in range(30)], [reference(r, i) for i in range(200)]
    store = incremental.RejoinStore(spark, f"file://{tmp_path}/s", "w", "rev", buckets=16)
    store.create(spark.createDataFrame(changes, CHANGE), refs_of(spark, refs))
    stamp = {p: p.stat().st_mtime_ns for p in (tmp_path / "s").glob("*/bucket=*/*.parquet")}
    plan = store.read("references", [3])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan and store.read("references", [3]).count() < store.read("references").count()
    one = spark.createDataFrame([changes[4]], CHANGE)
    (bucket,) = store.refresh(changes=(one, one.withColumn("compatibility", F.lit("unknown"))))
    same = {p for p, t in stamp.items() if p.exists() and p.stat().st_mtime_ns == t}
    assert {p.parent.name for p in stamp if p not in same} == {f"bucket={bucket}"}
    assert {x.compatibility for x in store.edges().where("canonical_key = 'k4'").collect()} <= {"unknown"}


def test_repair_joins_buckets_anew(spark, tmp_path):
    r = random.Random(6)
    changes, refs = [change(r, k) for k in range(30)], [reference(r, i) for i in range(200)]
    store = incremental.RejoinStore(spark, f"file://{tmp_path}/s", "w", "rev", buckets=8)
    store.create(spark.createDataFrame(changes, CHANGE), refs_of(spark, refs))
    before = edges_of(store.edges())
    store._write("edges", store.read("edges").where("false"), [1, 2, 5])  # what a refresh that broke off may leave
    assert edges_of(store.edges()) != before
    store.repair([1, 2, 5])
    assert edges_of(store.edges()) == before


def test_a_store_holds_what_edges_are_made_of(spark, tmp_path):
    store = incremental.RejoinStore(spark, f"file://{tmp_path}/s", "w", "rev", buckets=2)
    refs = refs_of(spark, [("r1", 1, "kind0", "k0", None, None, None, 0)]).withColumn("target_path", F.lit("/api"))
    store.create(spark.createDataFrame([("kind0", "k0", 1, "changed", "breaking", 0, "g", "s")], CHANGE), refs)
    assert not {"target_path", "unresolved_pattern"} & set(store.read("references").columns) and store.edges().count() == 1
