"""The join of changed contracts and the findings of the second protocol (J2, J8): exact keys only, with every
adapter's provenance held against the change's, and nothing joined while any of it disagrees.

A change meets its producer's definition at the head, else at the base, of the last definition by position; a change
without one is left out. A reference meets it if family, kind and key are the same and it is of the generation
and commit selected for its repository. Both are equi-joins. What the published rules throw on is counted by
rule over the joined rows, which are written once; edges are made only if all counts are zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import hash_record, whole
from ..sources.tables import materialise

C = F.col
#: What a definition must have in common with its change, and a reference with its change.
STAMP = ("adapter_id", "adapter_version", "extraction_version", "identity_version", "partitioning_version", "compatibility_version")
REFERENCE_STAMP = ("adapter_id", "identity_version")
KEY = ("family", "contract_kind", "canonical_key")


class Refused(ValueError):
    """A join that was not made; `counts` says how many rows each rule refuses."""

    def __init__(self, counts: dict[str, int]):
        super().__init__(f"evidence disagrees: {counts}")
        self.counts = counts


def stable_reference_id(family: Column, kind: Column, key: Column, pattern: Column, owner: Column, stratum: Column) -> Column:
    """A reference's identity in the second protocol (F5): exactly one of key and pattern; parts that are missing are
    not in the record at all."""
    forms = []
    for target, name in ((key, "canonicalKey"), (pattern, "unresolvedPattern")):
        for with_owner in (True, False):
            record = {"family": family, "contractKind": kind, name: target, "evidenceStratum": stratum, "protocol": 2} | ({"semanticOwner": owner} if with_owner else {})
            forms.append((target.isNotNull() & (owner.isNotNull() if with_owner else owner.isNull()), hash_record(record)))
    out = F.when(key.isNotNull() == pattern.isNotNull(), None)
    for when, digest in forms:
        out = out.when(when, F.concat(F.lit("ref_"), digest))
    return out


def last_definitions(definitions: DataFrame) -> DataFrame:
    """The last definition by position of each repository, generation, kind and key."""
    key = ["repository", "generation_id", "contract_kind", "canonical_key"]
    rest = [c for c in definitions.columns if c not in (*key, "position")]
    last = definitions.groupBy(*key).agg(F.max(F.struct("position", *rest)).alias("of"))
    return last.select(*key, *(C(f"of.{c}").alias(c) for c in rest))


def with_definitions(changes: DataFrame, definitions: DataFrame) -> DataFrame:
    """Changes with d_ columns of the definition at their head, else at their base; those without one are left out."""
    own = last_definitions(definitions)
    fields = [c for c in own.columns if c not in ("contract_kind", "canonical_key")]
    side = lambda n: own.select("contract_kind", "canonical_key", C("repository").alias("producer"), C("generation_id").alias(f"{n}_generation"), F.struct(*fields).alias(f"_{n}"))
    out = changes
    for n in ("head", "base"):
        out = out.join(side(n), ["producer", f"{n}_generation", "contract_kind", "canonical_key"], "left")
    out = out.withColumn("_d", F.coalesce("_head", "_base")).where("_d is not null")
    return out.withColumns({f"d_{f}": C(f"_d.{f}") for f in fields}).drop("_head", "_base", "_d")


def _agrees(columns, side: str, of: str = "") -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & C(f"{side}{c}").eqNullSafe(C(f"{of}{c}"))
    return out


def _outside(rows: DataFrame, column: str, scope: DataFrame) -> DataFrame:
    return rows.where(C(column).isNotNull()).join(scope.select(C("repository").alias(column)), column, "left_anti")


def joined(changes: DataFrame, definitions: DataFrame, references: DataFrame, selections: DataFrame, workspace: str) -> tuple[DataFrame, DataFrame]:
    """Changes with their definitions, and these with the references they meet (r_ columns); faults are marked."""
    at = lambda n: C("d_generation_id").eqNullSafe(C(f"{n}_generation")) & C("d_commit_sha").eqNullSafe(C(f"{n}_sha"))
    sound = (C("d_workspace") == workspace) & C("d_family").eqNullSafe(C("family")) & (at("head") | at("base")) & _agrees(STAMP, "d_")
    defined = with_definitions(changes, definitions).withColumn("_unsound", ~F.coalesce(sound, F.lit(False)))
    chosen = references.where(C("workspace") == workspace).join(selections.select("repository", "generation_id", "commit_sha"), ["repository", "generation_id", "commit_sha"], "left_semi")
    rest = ["repository", "generation_id", "stable_id", "semantic_owner", "evidence_stratum", "position", *REFERENCE_STAMP]
    met = defined.join(chosen.select(*KEY, *(C(c).alias(f"r_{c}") for c in rest)), list(KEY))
    identity = stable_reference_id(C("family"), C("contract_kind"), C("canonical_key"), F.lit(None).cast("string"), C("r_semantic_owner"), C("r_evidence_stratum"))
    met = met.withColumns({"_foreign": ~_agrees(REFERENCE_STAMP, "r_"), "_misnamed": ~C("r_stable_id").eqNullSafe(identity)})
    return defined, met


def written(evidence: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """What joined() gives, written once with the columns that violations() and edges_of() read."""
    defined, met = evidence
    columns = ["position", *KEY, "d_repository", "d_generation_id", "r_repository", "r_generation_id", "r_stable_id", "r_position", "_foreign", "_misnamed"]
    return materialise(defined.select("_unsound"), "v2-defined"), materialise(met.select(*columns), "v2-met")


def edges_of(met: DataFrame, workspace: str, revision: str) -> DataFrame:
    """One edge of each key, consumer and reference: that of the last change and the last reference by position."""
    text = lambda c: C(c).cast("string")
    record = {
        "workspaceId": F.lit(workspace), "producerRepositoryId": text("d_repository"), "consumerRepositoryId": text("r_repository"), "producerGenerationId": text("d_generation_id"), "consumerGenerationId": text("r_generation_id"),
        "definitionKey": C("canonical_key"), "stableReferenceId": C("r_stable_id"), "family": C("family"), "registryRevision": F.lit(revision), "protocol": 2,
    }
    # Edges are named after the last one is known, so no name is made or shuffled for the others.
    last = met.groupBy("canonical_key", "r_repository", "r_stable_id").agg(F.max(F.struct("position", "r_position", "family", "contract_kind", "d_repository", "d_generation_id", "r_generation_id")).alias("of"))
    last = last.select("canonical_key", "r_repository", "r_stable_id", "of.*")
    return last.select(
        F.concat(F.lit("edg_"), hash_record(record)).alias("edge_id"), "family", "contract_kind", "canonical_key", C("d_repository").alias("producer"), C("r_repository").alias("consumer"),
        C("d_generation_id").alias("producer_generation"), C("r_generation_id").alias("consumer_generation"), C("r_stable_id").alias("stable_id"), F.lit("exact").alias("basis"),
    )


def violations(changes: DataFrame, defined: DataFrame, met: DataFrame, selections: DataFrame, scope: DataFrame, workspace: str) -> DataFrame:
    """rule and how many rows it refuses; a row for every rule that refuses any."""
    count = lambda df, rule: df.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
    rows = [
        count(_outside(selections, "repository", scope), "selection_out_of_scope"), count(_outside(changes, "producer", scope), "producer_out_of_scope"), count(changes.where(~C("workspace").eqNullSafe(workspace)), "change_workspace"),
        count(defined.where("_unsound"), "definition_provenance"), count(met.where("_foreign"), "reference_adapter"), count(met.where("_misnamed"), "reference_identity"),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.where("n > 0")


def join_changed_contracts(changes: DataFrame, definitions: DataFrame, references: DataFrame, selections: DataFrame, scope: DataFrame, workspace: str, revision: str, scope_revision: str | None = None, evidence: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Edges, or Refused. The scope is the repositories that a capability lets be read, and the revision it is bound to.
    evidence is what written() gave of these inputs, if they were joined before."""
    if scope_revision is not None and scope_revision != revision:
        raise Refused({"registry_revision": 1})
    defined, met = evidence or written(joined(changes, definitions, references, selections, workspace))
    counts = {r["rule"]: r["n"] for r in violations(changes, defined, met, selections, scope, workspace).collect()}  # six at most
    if counts:
        raise Refused(counts)
    return edges_of(met, workspace, revision)


def findings(changes: DataFrame, edges: DataFrame, analysis: str, policy_major: int) -> DataFrame:
    """A finding of each edge with the last change of its family, kind and key: abstained where coverage is not complete
    or compatibility unknown, else a preview; always of an unmeasured stratum, so never delivered."""
    rest = ["workspace", "producer", "change_kind", "compatibility", "coverage_state", "coverage_dependencies", "base_sha", "head_sha"]
    last = changes.groupBy(*KEY).agg(F.max(F.struct("position", *rest)).alias("of")).select(*KEY, *(C(f"of.{c}").alias(f"c_{c}") for c in rest))
    both = edges.join(last, list(KEY))
    text = lambda c: C(c).cast("string")
    print_ = F.concat(F.lit("fnd_"), hash_record({
        "workspaceId": C("c_workspace"), "producerRepositoryId": text("c_producer"), "consumerRepositoryId": text("consumer"), "contractKind": C("contract_kind"), "canonicalKey": C("canonical_key"), "changeKind": C("c_change_kind"),
        "stableReferenceId": C("stable_id"), "policyMajor": whole(F.lit(policy_major)), "protocol": 2,
    }))
    both = both.withColumn("fingerprint", print_)
    occurrence = F.concat(F.lit("occ_"), hash_record({"analysisId": F.lit(analysis), "fingerprint": C("fingerprint"), "baseSha": C("c_base_sha"), "headSha": C("c_head_sha")}))
    incomplete = ~C("c_coverage_state").eqNullSafe("complete") | (C("c_compatibility") == "unknown")
    action = F.when(C("c_compatibility").isin("breaking", "potentially_breaking"), "coordinate").when(C("c_compatibility") == "unknown", "review").otherwise("none")
    return both.select(
        occurrence.alias("occurrence_id"), "fingerprint", "edge_id", *KEY, "consumer", F.when(incomplete, "ABSTAINED").otherwise("PREVIEW").alias("state"), F.when(incomplete, "abstained").otherwise("candidate").alias("edge_claim"),
        C("c_compatibility").alias("impact"), action.alias("action"), F.array_sort(F.array_distinct("c_coverage_dependencies")).alias("coverage_dependencies"), F.lit("preview_only").alias("decision"), F.lit("stratum_unmeasured").alias("reason"),
    )
