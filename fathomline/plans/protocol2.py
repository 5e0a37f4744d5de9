"""Queries over evidence of the second protocol, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence_v2 as e
from ..sources.tables import BINDINGS, relation, relation_sql, table

C = F.col
WORKSPACE, REVISION, ANALYSIS = "wsp-2", "reg-9", "ana-1"
_FAMILY = "CASE k % 3 WHEN 0 THEN 'http' WHEN 1 THEN 'events' ELSE 'database' END"
_KIND = "CASE k % 3 WHEN 0 THEN 'http.route' WHEN 1 THEN 'event.topic' ELSE 'database.column' END"
_STAMP = "concat('acme.', CAST(k % 3 AS STRING)) AS adapter_id, '1.0.0' AS adapter_version, CAST(2 AS BIGINT) AS extraction_version, CAST(2 AS BIGINT) AS identity_version, CAST(1 AS BIGINT) AS partitioning_version, CAST(1 AS BIGINT) AS compatibility_version"

BINDINGS.update({
    # Every fiftieth change is of the same contract as one before it, and the later one counts.
    "v2_changes": f"""
        SELECT 'wsp-2' AS workspace, position, {_FAMILY} AS family, {_KIND} AS contract_kind, concat('part:', CAST(k AS STRING)) AS canonical_key, k % 20 AS producer, concat('head-', CAST(k % 20 AS STRING)) AS head_generation,
               CASE WHEN k % 4 <> 1 THEN concat('base-', CAST(k % 20 AS STRING)) END AS base_generation, md5(concat('h', CAST(k % 20 AS STRING))) AS head_sha, md5(concat('b', CAST(k % 20 AS STRING))) AS base_sha,
               CASE WHEN position % 2 = 0 THEN 'operation_removed' ELSE 'operation_changed' END AS change_kind, CASE position % 5 WHEN 0 THEN 'breaking' WHEN 1 THEN 'unknown' WHEN 2 THEN 'potentially_breaking' ELSE 'compatible' END AS compatibility,
               CASE WHEN position % 6 = 0 THEN 'partial' ELSE 'complete' END AS coverage_state, {_STAMP}
        FROM (SELECT p_partkey AS position, CASE WHEN p_partkey % 50 = 7 THEN p_partkey - 3 ELSE p_partkey END AS k FROM {{part}} WHERE p_partkey % 8 <> 5) p""",
    "v2_definitions": f"""
        SELECT 'wsp-2' AS workspace, position, k % 20 AS repository, generation_id, commit_sha, {_FAMILY} AS family, {_KIND} AS contract_kind, concat('part:', CAST(k AS STRING)) AS canonical_key, path, {_STAMP}
        FROM (SELECT p_partkey AS k, p_partkey AS position, concat('head-', CAST(p_partkey % 20 AS STRING)) AS generation_id, md5(concat('h', CAST(p_partkey % 20 AS STRING))) AS commit_sha, 'a.ts' AS path FROM {{part}} WHERE p_partkey % 10 <> 0
              UNION ALL SELECT p_partkey, p_partkey + 1, concat('head-', CAST(p_partkey % 20 AS STRING)), md5(concat('h', CAST(p_partkey % 20 AS STRING))), 'later.ts' FROM {{part}} WHERE p_partkey % 30 = 3
              UNION ALL SELECT p_partkey, p_partkey, concat('base-', CAST(p_partkey % 20 AS STRING)), md5(concat('b', CAST(p_partkey % 20 AS STRING))), 'b.ts' FROM {{part}} WHERE p_partkey % 7 <> 0) d""",
    "v2_references": f"""
        SELECT 'wsp-2' AS workspace, position, repository, generation_id, commit_sha, CASE WHEN line = 6 THEN 'graphql' ELSE {_FAMILY} END AS family, CASE WHEN line = 5 THEN 'http.call' ELSE {_KIND} END AS contract_kind, concat('part:', CAST(k AS STRING)) AS canonical_key,
               CASE WHEN line = 1 THEN 'module' WHEN line = 2 THEN 'handler' END AS semantic_owner, 'call' AS evidence_stratum, {_STAMP}
        FROM (SELECT l_partkey AS k, l_orderkey * 8 + l_linenumber AS position, l_linenumber AS line, l_suppkey AS repository, CASE WHEN l_linenumber = 7 THEN 'gen-old' ELSE concat('gen-', CAST(l_suppkey AS STRING)) END AS generation_id,
                     CASE WHEN l_linenumber = 4 THEN md5('other') ELSE md5(concat('c', CAST(l_suppkey AS STRING))) END AS commit_sha FROM {{lineitem}}) l""",
    "v2_selections": """
        SELECT s_suppkey AS repository, concat('gen-', CAST(s_suppkey AS STRING)) AS generation_id, CASE WHEN s_suppkey % 17 = 3 THEN md5('moved') ELSE md5(concat('c', CAST(s_suppkey AS STRING))) END AS commit_sha FROM {supplier} WHERE s_suppkey % 13 <> 4""",
})


def _inputs(spark, sf_dir):
    changes = relation(spark, sf_dir, "v2_changes").withColumn("coverage_dependencies", F.array(F.concat(F.lit("z:"), C("producer").cast("string")), C("family"), C("family")))
    references = relation(spark, sf_dir, "v2_references")
    references = references.withColumn("stable_id", e.stable_reference_id(C("family"), C("contract_kind"), C("canonical_key"), F.lit(None).cast("string"), C("semantic_owner"), C("evidence_stratum")))
    scope = table(spark, sf_dir, "supplier").select(C("s_suppkey").alias("repository")).unionByName(relation(spark, sf_dir, "v2_changes").select(C("producer").alias("repository"))).distinct()
    return changes, relation(spark, sf_dir, "v2_definitions"), references, relation(spark, sf_dir, "v2_selections"), scope


def _edges(spark, sf_dir):
    changes, *rest = _inputs(spark, sf_dir)
    return changes, e.join_changed_contracts(changes, *rest, WORKSPACE, REVISION, REVISION)


def v2_join(spark, sf_dir):
    return _edges(spark, sf_dir)[1]


def v2_findings(spark, sf_dir):
    changes, edges = _edges(spark, sf_dir)
    return e.findings(changes, edges, ANALYSIS, 2).withColumn("coverage_dependencies", F.array_join("coverage_dependencies", ","))


def v2_violations(spark, sf_dir):
    """The same with faults: what each rule refuses, which the join enforces."""
    changes, definitions, references, selections, scope = _inputs(spark, sf_dir)
    changes = changes.withColumn("workspace", F.when(C("position") % 41 == 0, "wsp-other").otherwise(C("workspace")))
    definitions = definitions.withColumns({"compatibility_version": C("compatibility_version") + F.when(C("position") % 43 == 0, 1).otherwise(0), "commit_sha": F.when(C("position") % 47 == 0, "none").otherwise(C("commit_sha"))})
    references = references.withColumns({"adapter_id": F.when(C("position") % 53 == 0, "acme.other").otherwise(C("adapter_id")), "stable_id": F.when(C("position") % 59 == 0, "ref_other").otherwise(C("stable_id"))})
    scope = scope.where("repository % 19 <> 6")
    evidence = e.written(e.joined(changes, definitions, references, selections, WORKSPACE))
    counts = e.violations(changes, *evidence, selections, scope, WORKSPACE)
    try:
        e.join_changed_contracts(changes, definitions, references, selections, scope, WORKSPACE, REVISION, evidence=evidence)
    except e.Refused:
        return counts
    return counts.where("false")


def _json(record: dict) -> str:
    """SQL text of canonical JSON of texts; whole numbers stand as they are."""
    return "concat('{', " + ", ',', ".join(f"'\"{k}\":', " + (str(record[k]) if isinstance(record[k], int) else f"to_json(CAST({record[k]} AS VARCHAR))") for k in sorted(record)) + ", '}')"


def _stable(family, kind, key, owner, stratum):
    base = {"family": family, "contractKind": kind, "canonicalKey": key, "evidenceStratum": stratum, "protocol": 2}
    return f"concat('ref_sha256:', sha256(CASE WHEN {owner} IS NULL THEN {_json(base)} ELSE {_json(base | {'semanticOwner': owner})} END))"


_EDGE = _json({"workspaceId": "'wsp-2'", "producerRepositoryId": "d.repository", "consumerRepositoryId": "r.repository", "producerGenerationId": "d.generation_id", "consumerGenerationId": "r.generation_id", "definitionKey": "c.canonical_key", "stableReferenceId": "r.stable_id", "family": "c.family", "registryRevision": "'reg-9'", "protocol": 2})
_FINDING = _json({"workspaceId": "c.workspace", "producerRepositoryId": "c.producer", "consumerRepositoryId": "consumer", "contractKind": "e.contract_kind", "canonicalKey": "e.canonical_key", "changeKind": "change_kind", "stableReferenceId": "stable_id", "policyMajor": 2, "protocol": 2})
_RELATIONS = ("v2_changes", "v2_definitions", "v2_references", "v2_selections")


def _joined(changes="v2_changes", definitions="v2_definitions", references="v2_references"):
    """Every change with every definition and reference it may mean, decided row by row."""
    own = _stable("family", "contract_kind", "canonical_key", "semantic_owner", "evidence_stratum")
    return f"""{relation_sql(*_RELATIONS)}, c AS (SELECT * FROM {changes}), dl AS (SELECT * FROM {definitions} QUALIFY row_number() OVER (PARTITION BY repository, generation_id, contract_kind, canonical_key ORDER BY position DESC) = 1),
        cd AS (SELECT c.position AS cp, dl.* FROM c JOIN dl ON dl.repository = c.producer AND dl.contract_kind = c.contract_kind AND dl.canonical_key = c.canonical_key AND dl.generation_id IN (c.head_generation, c.base_generation)
            QUALIFY row_number() OVER (PARTITION BY c.position ORDER BY CASE WHEN dl.generation_id = c.head_generation THEN 0 ELSE 1 END) = 1),
        r AS (SELECT *, {own} AS own_id, {own} AS stable_id FROM {references}),
        m AS (SELECT c.position AS cp, r.position AS rp, c.canonical_key, c.family, c.contract_kind, d.repository AS producer, r.repository AS consumer, d.generation_id AS producer_generation, r.generation_id AS consumer_generation, r.stable_id, 'exact' AS basis, concat('edg_sha256:', sha256({_EDGE})) AS edge_id,
                     r.adapter_id IS DISTINCT FROM c.adapter_id OR r.identity_version IS DISTINCT FROM c.identity_version AS "foreign", r.position AS rpos
            FROM c JOIN cd d ON d.cp = c.position JOIN r ON r.workspace = 'wsp-2' AND r.family = c.family AND r.contract_kind = c.contract_kind AND r.canonical_key = c.canonical_key JOIN v2_selections s ON s.repository = r.repository AND s.generation_id = r.generation_id AND s.commit_sha = r.commit_sha),
        e AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY canonical_key, consumer, stable_id ORDER BY cp DESC, rp DESC) = 1)"""


_FAULTY = {
    "changes": "(SELECT * REPLACE (CASE WHEN position % 41 = 0 THEN 'wsp-other' ELSE workspace END AS workspace) FROM v2_changes)",
    "definitions": "(SELECT * REPLACE (compatibility_version + CASE WHEN position % 43 = 0 THEN 1 ELSE 0 END AS compatibility_version, CASE WHEN position % 47 = 0 THEN 'none' ELSE commit_sha END AS commit_sha) FROM v2_definitions)",
    "references": "(SELECT * REPLACE (CASE WHEN position % 53 = 0 THEN 'acme.other' ELSE adapter_id END AS adapter_id) FROM v2_references)",
}

SQL = {
    "v2_join": _joined() + "\nSELECT edge_id, family, contract_kind, canonical_key, producer, consumer, producer_generation, consumer_generation, stable_id, basis FROM e",
    "v2_findings": _joined() + f""", l AS (SELECT * FROM v2_changes QUALIFY row_number() OVER (PARTITION BY family, contract_kind, canonical_key ORDER BY position DESC) = 1),
        f AS (SELECT e.*, c.compatibility, c.base_sha, c.head_sha, c.coverage_state, concat_ws(',', CASE WHEN c.family < 'z' THEN c.family END, concat('z:', c.producer)) AS deps, concat('fnd_sha256:', sha256({_FINDING})) AS fingerprint FROM e JOIN l c ON c.family = e.family AND c.contract_kind = e.contract_kind AND c.canonical_key = e.canonical_key)
        SELECT concat('occ_sha256:', sha256({_json({"analysisId": "'ana-1'", "fingerprint": "fingerprint", "baseSha": "base_sha", "headSha": "head_sha"})})) AS occurrence_id, fingerprint, edge_id, family, contract_kind, canonical_key, consumer,
            CASE WHEN coverage_state <> 'complete' OR compatibility = 'unknown' THEN 'ABSTAINED' ELSE 'PREVIEW' END AS state, CASE WHEN coverage_state <> 'complete' OR compatibility = 'unknown' THEN 'abstained' ELSE 'candidate' END AS edge_claim, compatibility AS impact,
            CASE WHEN compatibility IN ('breaking', 'potentially_breaking') THEN 'coordinate' WHEN compatibility = 'unknown' THEN 'review' ELSE 'none' END AS action, deps AS coverage_dependencies, 'preview_only' AS decision, 'stratum_unmeasured' AS reason FROM f""",
    "v2_violations": _joined(**_FAULTY) + """, sc AS (SELECT s_suppkey AS repository FROM supplier WHERE s_suppkey % 19 <> 6 UNION SELECT producer FROM c WHERE producer % 19 <> 6),
        n AS (SELECT 'selection_out_of_scope' AS rule, count(*) AS n FROM v2_selections WHERE repository NOT IN (SELECT repository FROM sc) UNION ALL SELECT 'producer_out_of_scope', count(*) FROM c WHERE producer NOT IN (SELECT repository FROM sc)
            UNION ALL SELECT 'change_workspace', count(*) FROM c WHERE workspace <> 'wsp-2' UNION ALL SELECT 'definition_provenance', count(*) FROM cd JOIN c ON c.position = cd.cp WHERE NOT (cd.compatibility_version = c.compatibility_version AND cd.commit_sha = CASE WHEN cd.generation_id = c.head_generation THEN c.head_sha ELSE c.base_sha END)
            UNION ALL SELECT 'reference_adapter', count(*) FROM m WHERE "foreign" UNION ALL SELECT 'reference_identity', count(*) FROM m WHERE rpos % 59 = 0)
        SELECT rule, n FROM n WHERE n > 0""",
}


def queries() -> dict:
    return {n: f for n, f in globals().items() if n in SQL and callable(f)}
