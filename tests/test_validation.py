"""Rules of validation one by one, refused writes, sets' hashes and composed text."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from fathomline.functions.text import is_nfc, nfc, trimmed, units
from fathomline.operators import validation as v

C = F.col
HASH = "sha256:" + "a" * 64
SHAPE = json.dumps({"key": 1}, separators=(",", ":"))
GOOD_DEFINITION = {
    "contract_kind": "typescript_symbol", "canonical_key": "npm:a#b", "display_name": "b", "path": "src/a.ts", "start_line": 1, "start_column": 2, "end_line": 1, "end_column": 2, "content_hash": HASH,
    "shape_hash": "sha256:" + hashlib.sha256(SHAPE.encode()).hexdigest(), "shape": SHAPE, "evidence_stratum": "exact",
}
DEFINITION = "contract_kind string, canonical_key string, display_name string, path string, start_line long, start_column long, end_line long, end_column long, content_hash string, shape_hash string, shape string, evidence_stratum string"


def rules_of(spark, schema, good, changes, check):
    rows = [tuple({**good, **c}.values()) for c in changes]
    return [r.violation and (r.violation.code, r.violation.rule) for r in v.with_violation(spark.createDataFrame(rows, schema).coalesce(1), check).collect()]


def test_definitions_name_the_first_rule(spark):
    cases = [
        ({}, None), ({"contract_kind": "soap"}, ("invalid_output", "kind_unknown")), ({"canonical_key": ""}, ("invalid_output", "key_not_bounded")), ({"canonical_key": "a\0b"}, ("invalid_output", "key_not_bounded")),
        ({"canonical_key": "\U0001f600" * 1025}, ("invalid_output", "key_not_bounded")), ({"canonical_key": "\U0001f600" * 1024}, None), ({"display_name": "\u3000\ufeff"}, ("invalid_manifest", "display_name_empty")),
        ({"display_name": "x" * 513}, ("invalid_manifest", "display_name_too_long")), ({"path": ""}, ("invalid_path", "path_empty")), ({"path": "a\0"}, ("invalid_path", "path_nul")), ({"path": "a\\b"}, ("invalid_path", "path_backslash")),
        ({"path": "/a"}, ("invalid_path", "path_absolute")), ({"path": "C:a"}, ("invalid_path", "path_absolute")), ({"path": "a/"}, ("invalid_path", "path_not_canonical")), ({"path": "a//b"}, ("invalid_path", "path_not_canonical")),
        ({"path": "a/./b"}, ("invalid_path", "path_traversal")), ({"path": ".."}, ("invalid_path", "path_traversal")), ({"path": "cafe\u0301.ts"}, ("invalid_path", "path_not_composed")), ({"path": "caf\u00e9.ts"}, None),
        ({"start_line": None, "start_column": None, "end_line": None, "end_column": None}, None), ({"start_line": None}, ("invalid_output", "range_not_positive")), ({"start_column": 0}, ("invalid_output", "range_not_positive")),
        ({"end_column": 1}, ("invalid_output", "range_backwards")), ({"end_line": 2, "end_column": 1}, None), ({"end_column": 1 << 53}, ("invalid_output", "range_not_positive")), ({"content_hash": "sha256:A"}, ("invalid_hash", "content_hash")),
        ({"shape_hash": "x"}, ("invalid_hash", "shape_hash")), ({"shape": "{}"}, ("invalid_output", "shape_hash_differs")), ({"evidence_stratum": " "}, ("invalid_manifest", "evidence_stratum_empty")),
        ({"contract_kind": "soap", "path": ""}, ("invalid_output", "kind_unknown")), ({"contract_kind": None}, ("invalid_output", "kind_unknown")),
    ]
    assert rules_of(spark, DEFINITION, GOOD_DEFINITION, [c for c, _ in cases], v.definition_violation) == [w for _, w in cases]


def test_references_are_resolved_or_not(spark):
    schema = "contract_kind string, canonical_key string, unresolved_pattern string, unresolved_reason string, path string, start_line long, start_column long, end_line long, end_column long, content_hash string, activation string, evidence_stratum string"
    good = {"contract_kind": "protobuf_field", "canonical_key": "k", "unresolved_pattern": None, "unresolved_reason": None, "path": "a", "start_line": None, "start_column": None, "end_line": None, "end_column": None, "content_hash": HASH, "activation": "unknown", "evidence_stratum": "s"}
    both = ("invalid_output", "neither_or_both_resolved")
    cases = [
        ({}, None), ({"canonical_key": None}, both), ({"unresolved_pattern": "p", "unresolved_reason": "r"}, both), ({"canonical_key": None, "unresolved_pattern": "p"}, both), ({"canonical_key": None, "unresolved_pattern": "p", "unresolved_reason": "r"}, None),
        ({"unresolved_pattern": " "}, ("invalid_manifest", "unresolved_pattern_empty")), ({"canonical_key": None, "unresolved_pattern": "p", "unresolved_reason": "r" * 257}, ("invalid_manifest", "unresolved_reason_too_long")), ({"activation": "soon"}, ("invalid_output", "activation_unknown")),
    ]
    assert rules_of(spark, schema, good, [c for c, _ in cases], v.reference_violation) == [w for _, w in cases]


def test_manifests_go_tool_by_tool(spark):
    schema = "schema_version string, id string, version string, identity_version long, contract_kinds array<string>, tiers array<struct<input:string,tier:string>>, strata array<struct<id:string,state:string,evidence:array<string>>>, tools array<struct<id:string,version:string,digest:string,license:string,network:boolean>>, limitations array<string>, maintainer string, budget map<string,long>"
    tool = ("t", "1", HASH, "MIT", False)
    good = {"schema_version": "1.0", "id": "a.b", "version": "1.0.0", "identity_version": 1, "contract_kinds": ["openapi_operation"], "tiers": [("*.ts", "preview")], "strata": [("one", "UNMEASURED", ["e"])], "tools": [tool], "limitations": [], "maintainer": "m", "budget": {"ms": 1}}
    bad = "invalid_manifest"
    cases = [
        ({}, None), ({"tools": []}, None), ({"schema_version": "1"}, ("unsupported_manifest_schema", "schema")), ({"id": "ab"}, ("invalid_id", "adapter_id")), ({"version": "1.0.0-"}, (bad, "version")), ({"version": "01.0.0"}, (bad, "version")),
        ({"identity_version": None}, (bad, "identity_version")), ({"contract_kinds": []}, (bad, "no_kinds")), ({"contract_kinds": ["protobuf_field"] * 2}, (bad, "kinds")), ({"tiers": []}, (bad, "tiers")), ({"tiers": [("", "preview")]}, (bad, "tiers")),
        ({"strata": []}, (bad, "no_strata")), ({"strata": [("one", "UNMEASURED", [])]}, (bad, "stratum_without_evidence")), ({"strata": [("a", "UNMEASURED", ["e"])] * 2}, (bad, "stratum_twice")),
        ({"strata": [("a", "MEASURED", ["e"]), ("A", "UNMEASURED", ["e"])]}, (bad, "stratum_measured")), ({"tools": [("t", "1", HASH, " ", False), ("", "1", HASH, "x", False)]}, (bad, "tool_license_empty")), ({"tools": [tool, tool]}, (bad, "tool_twice")),
        ({"tools": [("t", "1", HASH, "MIT", True)]}, (bad, "tool_network")), ({"limitations": ["x", ""]}, (bad, "limitation_empty")), ({"budget": {"ms": 1, "mb": 0}}, (bad, "budget")),
    ]
    assert rules_of(spark, schema, good, [c for c, _ in cases], v.manifest_violation) == [w for _, w in cases]


HEADER = "result_id string, adapter_id string, adapter_version string, identity_version long, config_revision string, source_fingerprint string, state string, eligible long, processed long, skipped long, failed long, diagnostics array<struct<safe_message:string,scope:string,detail_hash:string>>"


def test_results_are_finalised(spark):
    config = "cfg_" + HASH
    head = lambda name, **k: tuple({"result_id": name, "adapter_id": "a.b", "adapter_version": "1.0.0", "identity_version": 1, "config_revision": config, "source_fingerprint": HASH, "state": "complete", "eligible": 1, "processed": 1, "skipped": 0, "failed": 0, "diagnostics": [], **k}.values())
    headers = spark.createDataFrame([head("empty"), head("failed", state="failed", processed=0, failed=1), head("one"), head("same"), head("stamp"), head("coverage", processed=0), head("scope", diagnostics=[("m", "e\u0301", None)]), head("both")], HEADER)
    stamp = {"adapter_id": "a.b", "adapter_version": "1.0.0", "identity_version": 1, "config_revision": config}
    item = lambda r, p, **k: tuple({"result_id": r, "position": p, **GOOD_DEFINITION, **stamp, **k}.values())
    schema = f"result_id string, position long, {DEFINITION}, adapter_id string, adapter_version string, identity_version long, config_revision string"
    rows = [item("one", 1), item("one", 2, path="b"), item("same", 9, path="b"), item("same", 3), item("stamp", 1), item("stamp", 2, adapter_version="1.0.1"), item("both", 1, config_revision="x"), item("both", 2, path="")]
    definitions = spark.createDataFrame(rows, schema)
    references = spark.createDataFrame([], f"{schema.replace('display_name string, ', '').replace('shape_hash string, shape string, ', '')}, unresolved_pattern string, unresolved_reason string, activation string, semantic_owner string")
    out = {r.result_id: r for r in v.finalise_extractions(headers, definitions, references).collect()}
    assert out["one"].output_hash == out["same"].output_hash and out["one"].definitions == 2
    assert len({out[r].output_hash for r in ("empty", "failed", "one")}) == 3
    assert (out["stamp"].code, out["stamp"].rule) == ("incompatible_output_version", "stamp_differs")
    assert out["both"].rule == "path_empty"  # items before stamps, whatever their positions
    assert (out["coverage"].rule, out["scope"].rule) == ("complete_leaves_some_out", "path_not_composed")
    assert all((r.output_hash is None) == (r.code is not None) for r in out.values())


def test_refused_writes_leave_nothing(spark, tmp_path):
    good, bad = tuple(GOOD_DEFINITION.values()), tuple({**GOOD_DEFINITION, "path": "/x"}.values())
    columns = list(GOOD_DEFINITION)
    checked = lambda rows: v.with_violation(spark.createDataFrame(rows, DEFINITION).repartition(3), v.definition_violation)
    path = f"file://{tmp_path}/out"
    with pytest.raises(v.Refused) as refused:
        v.write_checked(checked([good, bad, bad]), columns, path)
    assert refused.value.counts == {"invalid_path": 2} and os.listdir(tmp_path) == []
    done = v.write_checked(checked([good] * 3), columns, path)
    read = spark.read.parquet(path)
    assert (done.rows, read.count(), read.columns) == (3, 3, columns)
    assert read.agg(v.set_hash(v.item_digest(columns)).alias("h")).first().h == done.set_hash
    with pytest.raises(FileExistsError):
        v.write_checked(checked([good]), columns, path)
    assert spark.read.parquet(path).count() == 3 and len(os.listdir(tmp_path)) == 1
    assert v.write_checked(checked([]), columns, f"{path}-empty").rows == 0


def test_one_reference_an_identity(spark):
    rows = [(1, "k", None, "b", 1), (1, "k", None, "a", 2), (1, "k", None, "a", 3), (1, None, "k", "c", 4), (2, "k", None, "z", 5), (1, None, None, "n", 6)]
    df = spark.createDataFrame(rows, "generation_id long, canonical_key string, unresolved_pattern string, path string, position long").withColumns({"contract_kind": F.lit("protobuf_field"), "semantic_owner": F.lit(None).cast("string"), "evidence_stratum": F.lit("s")})
    assert sorted((r.generation_id, r.path, r.position) for r in v.materialise_references(df).collect()) == [(1, "a", 2), (1, "n", 6), (2, "z", 5)]


def test_text(spark):
    values = ["abc", "caf\u00e9", "cafe\u0301", "A\u030a", "\uac00", "\u1100\u1161", "", None, "\U0001f600x", "\u3000 a\t\ufeff"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i long, x string").select("i", nfc(C("x")).alias("c"), is_nfc(C("x")).alias("is"), trimmed(C("x")).alias("t"), units(C("x")).alias("u")).orderBy("i").collect()
    assert [r.c for r in rows[:6]] == ["abc", "caf\u00e9", "caf\u00e9", "\u00c5", "\uac00", "\uac00"]
    assert [r["is"] for r in rows[:7]] == [True, True, False, False, True, False, True] and rows[7]["is"] is None
    assert (rows[9].t, rows[8].u, rows[7].u) == ("a", 3, None)


def test_references_once_by_what_their_identity_is_made_of(spark):
    rows = [(1, "k", "a", None, None, "s", "b.ts", 1), (1, "k", "a", None, "module", "s", "a.ts", 2), (1, "k", None, "a", None, "s", "c.ts", 3), (1, "k", None, None, None, "s", "z.ts", 4), (1, "m", None, None, "o", "t", "y.ts", 5), (2, "k", "a", None, None, "s", "b.ts", 6)]
    df = spark.createDataFrame(rows, "generation_id long, contract_kind string, canonical_key string, unresolved_pattern string, semantic_owner string, evidence_stratum string, path string, position long")
    out = v.materialise_references(df, [])
    assert out.columns == ["generation_id", "stable_id", "path", "position"]
    assert sorted((r.generation_id, r.stable_id is None, r.path, r.position) for r in out.collect()) == [(1, False, "a.ts", 2), (1, True, "y.ts", 5), (2, False, "b.ts", 6)]
    assert v.materialise_references(df).where("position = 6").first().contract_kind == "k"
