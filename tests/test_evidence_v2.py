"""The join and findings of the second protocol on rows by hand."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from fathomline.operators import evidence_v2 as e

STAMP = {"adapter_id": "a.x", "adapter_version": "1", "extraction_version": 2, "identity_version": 2, "partitioning_version": 1, "compatibility_version": 1}
STAMPED = "adapter_id string, adapter_version string, extraction_version long, identity_version long, partitioning_version long, compatibility_version long"
CHANGE = {"workspace": "w", "position": 1, "family": "http", "contract_kind": "http.route", "canonical_key": "k", "producer": "p", "head_generation": "h", "base_generation": "b", "head_sha": "H", "base_sha": "B", "change_kind": "removed", "compatibility": "breaking", "coverage_state": "complete", "coverage_dependencies": ["z", "a", "z"], **STAMP}
DEFINITION = {"workspace": "w", "position": 1, "repository": "p", "generation_id": "h", "commit_sha": "H", "family": "http", "contract_kind": "http.route", "canonical_key": "k", "path": "a.ts", **STAMP}
REFERENCE = {"workspace": "w", "position": 1, "repository": "c", "generation_id": "g", "commit_sha": "G", "family": "http", "contract_kind": "http.route", "canonical_key": "k", "semantic_owner": None, "evidence_stratum": "call", **STAMP}


def digest(record):
    return "sha256:" + hashlib.sha256(json.dumps(record, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def schema(of):
    kind = lambda k, v: "array<string>" if isinstance(v, list) else "long" if isinstance(v, int) else "string"
    return ", ".join(f"{k} {kind(k, v)}" for k, v in of.items())


def frame(spark, of, changes):
    return spark.createDataFrame([tuple({**of, **c}.values()) for c in changes], schema(of))


def references(spark, rows):
    df = frame(spark, REFERENCE, rows)
    return df.withColumn("stable_id", e.stable_reference_id(F.col("family"), F.col("contract_kind"), F.col("canonical_key"), F.lit(None).cast("string"), F.col("semantic_owner"), F.col("evidence_stratum")))


def join(spark, changes=({},), definitions=({},), refs=({},), repositories="pc", revision="r", scope_revision="r", change_refs=lambda df: df):
    selections = spark.createDataFrame([("c", "g", "G"), ("p", "h", "H")], "repository string, generation_id string, commit_sha string")
    scope = spark.createDataFrame([(x,) for x in repositories], "repository string")
    return e.join_changed_contracts(frame(spark, CHANGE, changes), frame(spark, DEFINITION, definitions), change_refs(references(spark, refs)), selections, scope, "w", revision, scope_revision)


def test_ids(spark):
    (edge,) = join(spark).collect()
    ref = "ref_" + digest({"family": "http", "contractKind": "http.route", "canonicalKey": "k", "evidenceStratum": "call", "protocol": 2})
    assert edge.stable_id == ref
    record = {"workspaceId": "w", "producerRepositoryId": "p", "consumerRepositoryId": "c", "producerGenerationId": "h", "consumerGenerationId": "g", "definitionKey": "k", "stableReferenceId": ref, "family": "http", "registryRevision": "r", "protocol": 2}
    assert edge.edge_id == "edg_" + digest(record) and edge.basis == "exact"
    owned = references(spark, [{"semantic_owner": "m"}]).first().stable_id
    assert owned == "ref_" + digest({"family": "http", "contractKind": "http.route", "canonicalKey": "k", "semanticOwner": "m", "evidenceStratum": "call", "protocol": 2})
    neither = spark.range(1).select(e.stable_reference_id(F.lit("f"), F.lit("k"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("o"), F.lit("s")), e.stable_reference_id(F.lit("f"), F.lit("k"), F.lit("a"), F.lit("b"), F.lit("o"), F.lit("s"))).first()
    assert tuple(neither) == (None, None)


def test_what_meets(spark):
    refs = [{}, {"position": 2, "semantic_owner": "m"}, {"position": 3, "family": "events"}, {"position": 4, "contract_kind": "http.call"}, {"position": 5, "canonical_key": "other"}, {"position": 6, "generation_id": "old"}, {"position": 7, "commit_sha": "old"}, {"position": 8, "workspace": "v"}, {"position": 9, "repository": "q"}]
    assert join(spark, refs=refs).count() == 2
    assert join(spark, definitions=[{"canonical_key": "other"}]).count() == 0  # no definition, no edge
    base = join(spark, definitions=[{"generation_id": "b", "commit_sha": "B"}]).first()
    assert base.producer_generation == "b"
    both = join(spark, definitions=[{"generation_id": "b", "commit_sha": "B", "position": 9}, {}]).first()
    assert both.producer_generation == "h"


def test_the_last_of_equals_counts(spark):
    # A later definition of another workspace would be the one that is looked at, and is refused.
    with pytest.raises(e.Refused) as refused:
        join(spark, definitions=[{}, {"position": 2, "workspace": "v"}])
    assert refused.value.counts == {"definition_provenance": 1}
    assert join(spark, definitions=[{"position": 2}, {"workspace": "v"}]).count() == 1
    assert join(spark, refs=[{}, {}, {"position": 3}]).count() == 1
    changes = [{"producer": "p", "position": 1}, {"producer": "c", "position": 2, "head_generation": "g", "head_sha": "G"}]
    last = join(spark, changes=changes, definitions=[{}, {"repository": "c", "generation_id": "g", "commit_sha": "G"}]).collect()
    assert [r.producer for r in last] == ["c"]


@pytest.mark.parametrize("name,given", [
    ("registry_revision", {"scope_revision": "older"}), ("selection_out_of_scope", {"repositories": "p"}), ("producer_out_of_scope", {"repositories": "c"}), ("change_workspace", {"changes": [{"workspace": "v"}]}),
    ("definition_provenance", {"definitions": [{"compatibility_version": 2}]}), ("definition_provenance", {"definitions": [{"commit_sha": "X"}]}), ("definition_provenance", {"definitions": [{"family": "events"}]}),
    ("reference_adapter", {"refs": [{"identity_version": 1}]}), ("reference_identity", {"change_refs": lambda df: df.withColumn("stable_id", F.lit("ref_x"))}),
])
def test_disagreement_is_refused(spark, name, given):
    with pytest.raises(e.Refused) as refused:
        join(spark, **given)
    assert name in refused.value.counts


def test_findings(spark):
    cases = [{}, {"compatibility": "unknown"}, {"coverage_state": "partial"}, {"compatibility": "compatible"}, {"compatibility": "potentially_breaking"}]
    want = [("PREVIEW", "candidate", "coordinate"), ("ABSTAINED", "abstained", "review"), ("ABSTAINED", "abstained", "coordinate"), ("PREVIEW", "candidate", "none"), ("PREVIEW", "candidate", "coordinate")]
    edges = join(spark)
    ref = edges.first().stable_id
    for change, expected in zip(cases, want, strict=True):
        (f,) = e.findings(frame(spark, CHANGE, [{"position": 0, "compatibility": "compatible", "change_kind": "earlier"}, change]), edges, "ana", 3).collect()
        assert (f.state, f.edge_claim, f.action) == expected and f.coverage_dependencies == ["a", "z"]
        assert f.fingerprint == "fnd_" + digest({"workspaceId": "w", "producerRepositoryId": "p", "consumerRepositoryId": "c", "contractKind": "http.route", "canonicalKey": "k", "changeKind": "removed", "stableReferenceId": ref, "policyMajor": 3, "protocol": 2})
        assert f.occurrence_id == "occ_" + digest({"analysisId": "ana", "fingerprint": f.fingerprint, "baseSha": "B", "headSha": "H"})
    assert e.findings(frame(spark, CHANGE, [{"canonical_key": "other"}]), edges, "ana", 3).count() == 0
