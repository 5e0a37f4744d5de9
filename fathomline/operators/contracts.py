"""Contract diffs, the joins of changed contracts to their consumers, and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import canonical
from ..functions.identity import PAYLOAD, column_compatibility, enum_compatibility, payload_compatibility, signature_compatibility
from .registry import first_by

C = F.col


def contract_diff(base: DataFrame, head: DataFrame, complete: bool = True, changed: Column | None = None, added: Column | None = None) -> DataFrame:
    """Changes between definitions(contract_kind, canonical_key, producer, shape, width, ...): equal shapes are
    no change; what is missing on either side is added or removed; `changed` gives a changed one's
    compatibility from b_* and h_* columns (J12), `added` an added one's. On incomplete input nothing is more
    than unknown."""
    key = ["contract_kind", "canonical_key"]
    rest = [c for c in base.columns if c not in key]
    b = base.select(*key, *(F.col(c).alias(f"b_{c}") for c in rest), F.lit(True).alias("_b"))
    h = head.select(*key, *(F.col(c).alias(f"h_{c}") for c in rest), F.lit(True).alias("_h"))
    both = b.join(h, key, "full_outer").where(~F.col("b_shape").eqNullSafe(F.col("h_shape")))
    kind = F.when(F.col("_b").isNull(), "added").when(F.col("_h").isNull(), "removed").otherwise("changed")
    wider = changed if changed is not None else F.when(F.col("h_width") >= F.col("b_width"), "compatible").otherwise("breaking")
    new = added if added is not None else F.lit("compatible")
    verdict = F.when(F.lit(not complete), "unknown").when(F.col("_b").isNull(), new).when(F.col("_h").isNull(), "breaking").otherwise(wider)
    return both.select(*key, F.coalesce("h_producer", "b_producer").alias("producer"), kind.alias("change_kind"), verdict.alias("compatibility"))


def described_compatibility(exact: Column, differ: Column, added: Column, complete: Column) -> Column:
    """Compatibility of described operations and messages, whose differ is another tool (J12): known only on
    complete input, for exact identities, and as far as that tool has said; an addition is compatible."""
    sure = complete & exact
    return F.when(sure & added, "compatible").when(sure & differ.isin("breaking", "compatible"), differ).otherwise("unknown")


def family_compatibility() -> Column:
    """Compatibility of a changed contract by its family (J12), from b_ and h_ columns: data_type and nullable
    of columns, values of enumerations, payload of events, overloads of symbols; other families' changes of
    shape are compatible where their keys stay."""
    kind = C("contract_kind")
    return (
        F.when(kind == "database.column", column_compatibility(C("b_data_type"), C("h_data_type"), C("b_nullable"), C("h_nullable")))
        .when(kind == "database.enum", enum_compatibility(C("b_values"), C("h_values")))
        .when(kind.startswith("event."), payload_compatibility(C("b_payload"), C("h_payload")))
        .when(kind == "typescript_symbol", signature_compatibility(C("b_overloads"), C("h_overloads")))
        .otherwise("compatible")
    )


def drop_ambiguous(definitions: DataFrame, key: list[str], shape: str = "shape") -> DataFrame:
    """One row of each key whose shapes agree; keys with different shapes go altogether."""
    agreed = definitions.groupBy(*key).agg(F.min(shape).alias(shape), F.max(shape).alias("_max"), F.count("*").alias("copies"))
    return agreed.where(F.col(shape) == F.col("_max")).drop("_max")


#: Order of states in which a generation is preferred.
STATE_RANK = {"complete": 0, "partial": 1, "failed": 2}


def select_generations(generations: DataFrame) -> DataFrame:
    """One generation a repository: the best state, then the latest start, then the largest id (J22, O4). The
    best is an aggregate, so it combines before the shuffle where a window would not."""
    rank = F.coalesce(*(F.when(F.col("state") == s, F.lit(r)) for s, r in STATE_RANK.items()), F.lit(9))
    best = generations.groupBy("repository").agg(F.max(F.struct((-rank).alias("r"), "started_at", "generation_id", "state")).alias("best"))
    return best.select("repository", "best.generation_id", "best.state", "best.started_at")


def consumer_states(members: DataFrame, selections: DataFrame, observations: DataFrame, at: Column, ttl_days: int, denied: DataFrame) -> DataFrame:
    """Each member's state (J6), the first that holds: unauthorized; failed, for its selected generation or the
    contracts observed of it; not_indexed, without a generation or without observed contracts; unsupported;
    stale; current. What is not usable has no generation."""
    joined = members.join(selections, "repository", "left").join(observations.select("generation_id", "coverage_state", "completed_at"), "generation_id", "left")
    joined = joined.join(denied.select("repository", F.lit(True).alias("_denied")).distinct(), "repository", "left")
    age = F.greatest(F.datediff(at, F.coalesce("completed_at", at)), F.lit(0))
    state = (
        F.when(C("_denied"), "unauthorized")
        .when(C("state") == "failed", "failed")
        .when(C("generation_id").isNull() | C("coverage_state").isNull(), "not_indexed")
        .when(C("coverage_state") == "failed", "failed")
        .when(C("coverage_state") == "unsupported", "unsupported")
        .when(age > ttl_days, "stale")
        .otherwise("current")
    )
    out = joined.withColumn("consumer_state", state)
    aged = C("consumer_state").isin("stale", "current")
    usable = aged | (C("consumer_state") == "unsupported")
    return out.select("repository", F.when(usable, C("generation_id")).alias("generation_id"), "consumer_state", F.when(aged, age).alias("age_days"), F.when(aged, C("coverage_state")).alias("coverage_state"))


def producer_state(head: DataFrame, denied: DataFrame) -> DataFrame:
    """The producer's head as its own consumer (J7): head(repository, generation_id, coverage_state) is current
    at age 0 unless the use is denied or its contracts failed or aren't supported."""
    joined = head.join(denied.select("repository", F.lit(True).alias("_denied")).distinct(), "repository", "left")
    state = F.when(C("_denied"), "unauthorized").when(C("coverage_state").isin("failed", "unsupported"), C("coverage_state")).otherwise("current")
    out = joined.withColumn("consumer_state", state)
    now = C("consumer_state") == "current"
    usable = now | (C("consumer_state") == "unsupported")
    return out.select("repository", F.when(usable, C("generation_id")).alias("generation_id"), "consumer_state", F.when(now, F.lit(0)).alias("age_days"), F.when(now, C("coverage_state")).alias("coverage_state"))


def changed_definitions(changes: DataFrame, definitions: DataFrame) -> DataFrame:
    """Changes with the first definition of their producer, kind and key, by `position` (J1a); a change without
    one is left out."""
    key = ["producer", "contract_kind", "canonical_key"]
    first = first_by(definitions.select(*key, "position", "service", C("generation_id").alias("producer_generation"), C("stratum").alias("definition_stratum")), key, "position")
    return changes.join(first.drop("position"), key)


def selected_references(references: DataFrame, selections: DataFrame) -> DataFrame:
    """References of the generation that is selected for their repository."""
    chosen = selections.where("generation_id is not null").select(C("repository").alias("consumer"), "generation_id")
    return references.join(chosen, ["consumer", "generation_id"], "left_semi")


CONTEXT_ONLY = ("declared_context", "behavioural_context")


def with_alias_state(references: DataFrame, resolved: DataFrame) -> DataFrame:
    """References with what their alias means, and whether that leaves them open to a join."""
    known = resolved.select("reference_id", C("state").alias("alias_state"), C("service").alias("alias_service"))
    refs = references.join(known, "reference_id", "left")
    only = F.coalesce(C("context_basis").isin(*CONTEXT_ONLY), F.lit(False))
    ambiguous = F.coalesce(C("alias_state") == "ambiguous", F.lit(False))
    return refs.withColumns({"_only": only, "_ambiguous": ~only & ambiguous})


def asked_keys(refs: DataFrame) -> DataFrame:
    """Open references, a row for each contract key that they may mean: their own, or the one they are constrained to."""
    keys = F.array_distinct(F.array_compact(F.array(F.when(C("context_basis").isNull(), C("canonical_key")), C("constrained_key"))))
    return refs.where("not _only and not _ambiguous").withColumn("key", F.explode(keys)).withColumnRenamed("canonical_key", "own_key")


def decide(changes: DataFrame, asked: DataFrame) -> DataFrame:
    """Changes with the references that may mean them and the basis of each, null where there is none."""
    hit = changes.join(asked, (changes["contract_kind"] == asked["contract_kind"]) & (changes["canonical_key"] == asked["key"])).drop(asked["contract_kind"])
    exact = C("context_basis").isNull() & F.coalesce(C("own_key") == C("key"), F.lit(False))
    agrees = F.coalesce((C("alias_state") == "resolved") & (C("alias_service") == C("service")), F.lit(False))
    contradicts = exact & F.coalesce((C("alias_state") == "resolved") & (C("alias_service") != C("service")), F.lit(False))
    constrained = F.coalesce(C("constrained_key") == C("key"), F.lit(False))
    basis = F.when(contradicts, None).when(exact, "exact").when(constrained & agrees, "registry_resolved").when(constrained & (C("context_basis") == "heuristic"), "heuristic")
    return hit.withColumns({"basis": basis, "_contradicts": contradicts})


def decided_edges(decided: DataFrame, workspace: str, revision: str) -> DataFrame:
    text = lambda c: C(c).cast("string")
    steps = F.when(C("basis") == "registry_resolved", "producer_definition:exact+registry_alias:registry_resolved+consumer_reference:registry_resolved").otherwise(F.concat(F.lit("producer_definition:exact+consumer_reference:"), C("basis")))
    return decided.where("basis is not null").select(
        canonical.edge_id(F.lit(workspace), text("producer"), text("consumer"), C("canonical_key"), C("reference_id"), C("basis"), F.lit(revision)).alias("edge_id"),
        "contract_kind", "canonical_key", "producer", "consumer", "reference_id", "basis", "change_kind", "compatibility", "generation_id", "producer_generation", "first_observed", "last_observed",
        F.concat_ws("|", "contract_kind", "definition_stratum", "stratum", "basis", steps, F.lit("v1")).alias("stratum_key"),
    )


def join_changed_contracts(changes: DataFrame, references: DataFrame, resolved: DataFrame, workspace: str, revision: str) -> tuple[DataFrame, DataFrame]:
    """Edges from changed contracts to the references to them, and diagnostics.

    changes are with their definitions, references those of selected generations, resolved(reference_id,
    state, service) says what a reference's alias means. A reference of the change's kind gives an edge by
    the first basis that holds: exact, its key is the change's and nothing but structure says so; registry
    resolved, it is constrained to the key and its alias means the definition's service; heuristic, it is
    constrained to the key by a heuristic. Context alone never gives one, and neither does an ambiguous alias,
    not even for an exact key; an exact key whose alias means another service contradicts.

    A diagnostic is due for each change of its kind: the ambiguous references for all of them, the
    unresolved ones for those that they have no edge with. These are counted, not enumerated, so keys alone are
    joined: one equi-join on kind and key, whichever of a reference's keys it is."""
    refs = with_alias_state(references, resolved)
    decided = decide(changes, asked_keys(refs))
    edges = decided_edges(decided, workspace, revision)
    # How many changes of its kind a reference was held against, and how many of these it has an edge with.
    total = changes.groupBy("contract_kind").agg(F.count("*").alias("_changes"))
    met = decided.where("basis is not null or _contradicts").groupBy("reference_id", "consumer").agg(F.count("*").alias("_met"), F.count_if("_contradicts").alias("_contradictions"))
    counted = refs.join(total, "contract_kind").join(met, ["reference_id", "consumer"], "left")
    code = F.array(
        F.struct(F.lit("registry_ambiguity").alias("code"), F.when(C("_ambiguous"), C("_changes")).otherwise(0).alias("n")),
        F.struct(F.lit("registry_contradiction").alias("code"), F.coalesce("_contradictions", F.lit(0)).alias("n")),
        F.struct(F.lit("unresolved_reference").alias("code"), F.when(C("unresolved_pattern").isNotNull() & ~C("_ambiguous"), C("_changes") - F.coalesce("_met", F.lit(0))).otherwise(0).alias("n")),
    )
    problems = counted.select("consumer", "reference_id", F.explode(code).alias("d")).select("consumer", "reference_id", C("d.code").alias("diagnostic"), C("d.n").cast("long").alias("times"))
    return edges, problems.where("times > 0")


BASIS_RANK = {"exact": 0, "registry_resolved": 1, "heuristic": 1}


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """One edge of each (key, consumer, reference): exact before others, then the first by edge id (J1d). Most are the
    only one of theirs, so they are dealt out as they are: combined before, they would be sorted twice, the first
    time in tasks that are as wide as what edges are made from."""
    key = ["canonical_key", "consumer", "reference_id"]
    rank = F.coalesce(*(F.when(F.col("basis") == b, F.lit(r)) for b, r in BASIS_RANK.items()), F.lit(9))
    return first_by(edges.repartition(*key), key, rank, "edge_id")


def protocol_mismatches(changes: DataFrame, definitions: DataFrame, references: DataFrame) -> DataFrame:
    """Keys on which a change, its definition or a reference speak another protocol version (J2): a join of
    them is refused while there are any."""
    key = ["contract_kind", "canonical_key"]
    side = lambda df, name: df.select(*key, "protocol", F.lit(name).alias("side"))
    rows = side(definitions, "definition").unionByName(side(references, "reference"))
    own = changes.select(*key, C("protocol").alias("expected"))
    return rows.join(own, key).where(C("protocol") != C("expected")).groupBy(*key, "side").agg(F.count("*").alias("n"))


REASONS = {"stale": "stale_consumer_generation", "unsupported": "unsupported_language", "unauthorized": "privacy_restricted", "failed": "incomplete_index", "not_indexed": "incomplete_index"}


def abstention_reason(state: Column) -> Column:
    return F.coalesce(*(F.when(state == s, F.lit(r)) for s, r in REASONS.items()))


def findings(edges: DataFrame, states: DataFrame, workspace: str, policy_major: int = 1, coverage: Column | None = None) -> DataFrame:
    """Findings of edges by the state of their consumer: abstained with a reason, or a preview with an action
    (J8). A removal seen with incomplete coverage abstains as well."""
    covered = coverage if coverage is not None else F.lit(True)
    joined = edges.join(states.select(F.col("repository").alias("consumer"), "consumer_state"), "consumer")
    reason = F.when(~covered & F.col("change_kind").rlike("removed|deleted"), "incomplete_index").otherwise(abstention_reason(C("consumer_state")))
    action = F.when(F.col("compatibility").isin("breaking", "potentially_breaking"), "coordinate").when(F.col("compatibility") == "unknown", "review").otherwise("none")
    text = lambda c: C(c).cast("string")
    name = canonical.finding_fingerprint(F.lit(workspace), text("producer"), C("contract_kind"), C("canonical_key"), C("change_kind"), text("consumer"), C("reference_id"), F.lit(policy_major))
    return joined.select(
        name.alias("fingerprint"), "contract_kind", "canonical_key", "producer", "consumer", "reference_id", "edge_id", "stratum_key", "basis", "change_kind", "compatibility", "consumer_state",
        F.when(reason.isNull(), "PREVIEW").otherwise("ABSTAINED").alias("state"), reason.alias("reason"), action.alias("action"),
    )


def completeness(findings_: DataFrame, diagnostics: DataFrame, states: DataFrame) -> DataFrame:
    """One row: partial where any consumer isn't current or there is a diagnostic."""
    consumers = states.agg(F.coalesce(F.bool_or(F.col("consumer_state") != "current"), F.lit(False)).alias("gaps"))
    problems = diagnostics.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("diagnostics"))
    counted = findings_.agg(F.count("*").alias("findings"), F.count_if(F.col("state") == "ABSTAINED").alias("abstained"))
    one = counted.join(F.broadcast(consumers)).join(F.broadcast(problems))  # three rows of aggregates
    return one.select(F.when(F.col("gaps") | (F.col("diagnostics") > 0), "partial").otherwise("complete").alias("completeness"), "findings", "abstained", "diagnostics")


def abstentions(from_findings: DataFrame, from_states: DataFrame) -> DataFrame:
    """Abstentions of findings, and those of consumers that no finding reports yet."""
    key = ["consumer", "reason"]
    return from_findings.select(*key).distinct().unionByName(from_states.select(*key).distinct().join(from_findings.select(*key), key, "left_anti"))


def reconcile(provider: DataFrame, stored: DataFrame) -> DataFrame:
    """Actions that bring the stored state to the provider's (J15). Both have repository, selected, head and
    pulls (number to head); the provider's win. What is no longer selected, or gone, is purged if it was
    selected and nothing else is done for it; else a change of selection syncs the scope, another head of a
    selected repository is indexed, and every open pull request with another head is analysed."""
    theirs = provider.select("repository", C("selected").alias("now"), C("head").alias("head_now"), C("pulls").alias("pulls_now"), F.lit(True).alias("_there"))
    ours = stored.select("repository", C("selected").alias("was"), C("head").alias("head_was"), C("pulls").alias("pulls_was"))
    joined = theirs.join(ours, "repository", "full_outer")
    there, was, now = F.coalesce("_there", F.lit(False)), F.coalesce("was", F.lit(False)), F.coalesce("now", F.lit(False))
    purge = was & ~now
    act = lambda when, kind, head=None, number=None: F.when(when, F.struct(F.lit(kind).alias("kind"), (number if number is not None else F.lit(None)).cast("long").alias("pull_request"), (head if head is not None else F.lit(None)).cast("string").alias("head")))
    none = F.create_map().cast("map<bigint,string>")
    pulls = F.filter(F.map_entries(F.coalesce("pulls_now", none)), lambda e: ~F.coalesce(F.try_element_at(F.coalesce("pulls_was", none), e["key"]) == e["value"], F.lit(False)))
    analyse = F.transform(pulls, lambda e: F.struct(F.lit("analyze_pull_request").alias("kind"), e["key"].alias("pull_request"), e["value"].alias("head")))
    own = F.array_compact(F.array(
        act(purge, "purge_repository"),
        act(there & ~purge & ~C("now").eqNullSafe(C("was")), "sync_scope"),
        act(there & now & ~C("head_now").eqNullSafe(C("head_was")), "index_default_branch", C("head_now")),
    ))
    actions = F.concat(own, F.when(there & ~purge, analyse).otherwise(F.array().cast("array<struct<kind:string,pull_request:bigint,head:string>>")))
    return joined.select("repository", F.explode(actions).alias("a")).select("repository", C("a.kind").alias("action"), "a.pull_request", "a.head")


def resolve_modules(imports: DataFrame, available: DataFrame, suffixes: list[str]) -> DataFrame:
    """The first candidate path of each import that exists, candidates in the order of `suffixes`."""
    candidates = imports.select("import_id", F.posexplode(F.array(*(F.concat("target", F.lit(s)) for s in suffixes))).alias("ordinal", "path"))
    return candidates.join(available.select("path"), "path", "left_semi").groupBy("import_id").agg(F.min_by("path", "ordinal").alias("path"))


def resolve_path_aliases(imports: DataFrame, configs: DataFrame, available: DataFrame, suffixes: list[str]) -> DataFrame:
    """imports(import_id, folder, specifier) through the path aliases of configurations(folder, prefix, target):
    that of the nearest folder above the import first, then the longest prefix, then the candidates in order
    (J21). An import has as many folders above it as its path has parts, so the join is on the folder."""
    parts = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    each = imports.select("import_id", "specifier", F.posexplode(above).alias("depth", "at"))
    hit = each.join(configs.select(C("folder").alias("at"), "prefix", "target"), "at").where(C("specifier").startswith(C("prefix")))
    path = F.concat("target", F.substr("specifier", F.length("prefix") + 1))
    tried = hit.select("import_id", (-C("depth")).alias("depth"), (-F.length("prefix")).alias("length"), F.posexplode(F.array(*(F.concat(path, F.lit(s)) for s in suffixes))).alias("ordinal", "path"))
    found = tried.join(available.select("path"), "path", "left_semi")
    return found.groupBy("import_id").agg(F.min_by("path", F.struct("depth", "length", "ordinal", "path")).alias("path"))


def compose_coverage(scope: DataFrame, families: DataFrame, stored: DataFrame) -> DataFrame:
    """A row for every repository and family, with what is stored of the selected generation (J14): unavailable
    where nothing is, where the generation is another, or where the repository has none, with why. The
    families are a vocabulary of adapters, so a list of them goes with each repository."""
    names = F.broadcast(families.agg(F.array_sort(F.collect_set("family")).alias("names")))  # one row
    wanted = scope.join(names).select("repository", "generation_id", "consumer_state", F.explode("names").alias("family"))
    have = stored.select("repository", "family", C("generation_id").alias("_generation"), C("state").alias("_state"))
    joined = wanted.join(have, ["repository", "family"], "left")
    match = F.coalesce(C("_generation") == C("generation_id"), F.lit(False))
    why = F.when(C("generation_id").isNull(), F.concat(F.lit("repository_"), C("consumer_state"))).when(~match, "family_coverage_unavailable")
    return joined.select("repository", "family", F.when(why.isNull(), C("_state")).otherwise("unavailable").alias("state"), why.alias("reason"))


def touched_keys(changes: DataFrame, alias_keys: DataFrame) -> DataFrame:
    """What a rejoin must look at again: the changed contracts, and the changed aliases."""
    own = changes.select(F.concat_ws(":", "contract_kind", "canonical_key").alias("key"))
    return own.unionByName(alias_keys.select(F.concat(F.lit("registry:"), C("key")).alias("key"))).distinct()


def exact_references(consumers: DataFrame, producer_head: DataFrame, changes: DataFrame) -> DataFrame:
    """References to changed keys, of consumers and of the producer's own head."""
    key = ["contract_kind", "canonical_key"]
    return consumers.unionByName(producer_head).join(changes.select(*key).distinct(), key, "left_semi")


def dependencies_of(findings_: DataFrame, changes: DataFrame) -> DataFrame:
    """The coverage that each finding depends on, each dependency once and in order."""
    own = changes.select("contract_kind", "canonical_key", F.explode("coverage_dependencies").alias("dependency"))
    met = findings_.select("fingerprint", "contract_kind", "canonical_key").join(own, ["contract_kind", "canonical_key"])
    return met.groupBy("fingerprint").agg(F.array_sort(F.collect_set("dependency")).alias("dependencies"))


#: The columns that family_compatibility() compares, beside those of every definition.
FAMILY_COLUMNS = f"data_type string, nullable boolean, values array<string>, payload {PAYLOAD}, overloads array<struct<parameters:array<struct<optional:boolean,rest:boolean>>,hash:string>>"
