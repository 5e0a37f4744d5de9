"""Scope and consent, disclosure, suppression, policy replay, promotion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import hash_text
from ..functions.identity import uniform
from ..functions.stats import wilson
from ..sources.tables import materialise
from .evaluation import metric_rules, metric_set, pull_request_metrics
from .validation import set_hash

C = F.col


def prepare_scope(members: DataFrame, allowlist: DataFrame | None, consents: DataFrame, producer) -> DataFrame:
    """Each requested repository's standing: included, unknown, not_selected or consent_denied; the producer
    is always in, a denial beats an allowance (P11)."""
    requested = members.select("repository") if allowlist is None else allowlist.select("repository")
    denied = consents.where("decision = 'deny'").select("repository", F.lit(True).alias("_denied")).distinct()
    known = members.select("repository", F.col("selected").alias("_selected"))
    joined = requested.distinct().join(known, "repository", "left").join(denied, "repository", "left")
    standing = (
        F.when(C("repository") == F.lit(producer), "included")
        .when(C("_selected").isNull(), "unknown")
        .when(~C("_selected"), "not_selected")
        .when(C("_denied"), "consent_denied")
        .otherwise("included")
    )
    return joined.select("repository", standing.alias("standing"))


def authorize(scope: DataFrame, decisions: DataFrame, revision, producer=None) -> DataFrame:
    """Included repositories and gaps by the last decision on each: denied, unavailable, or of another
    revision (P12). Where the producer itself has a gap, nothing can be analysed, and that is every
    repository's gap."""
    last = decisions.groupBy("repository").agg(F.max_by(F.struct("decision", "revision"), "position").alias("last"))
    gap = F.when(C("last").isNull(), "unavailable").when(C("last.decision") != "allow", "denied").when(C("last.revision") != F.lit(revision), "revision_changed")
    out = scope.where("standing = 'included'").join(last, "repository", "left").select("repository", gap.alias("gap"))
    if producer is None:
        return out
    lost = F.broadcast(out.agg(F.bool_or((C("repository") == F.lit(producer)) & C("gap").isNotNull()).alias("_lost"), F.count_if(C("repository") == F.lit(producer)).alias("_there")))
    without = F.coalesce(C("_lost"), F.lit(False)) | (C("_there") == 0)
    return out.join(lost).select("repository", F.when(without, F.coalesce("gap", F.lit("producer_unavailable"))).otherwise(C("gap")).alias("gap"))


def restrict(rows: DataFrame, authorised: DataFrame, column: str = "repository") -> DataFrame:
    """Rows of authorised repositories only, joined before anything else reads them (P10)."""
    return rows.join(authorised.select(C("repository").alias(column)).distinct(), column, "left_semi")


def suppression_states(rules: DataFrame, events: DataFrame, predicates: DataFrame, versions: DataFrame, now: Column) -> DataFrame:
    """State of each rule: revoked, expired, invalidated, review_due, else active, with the reason (ST8), and all the
    reasons of an invalidation. The latest event of a rule decides; equal times go to the larger event id.

    predicates(rule_id, kind, subject, expected, position) hold while versions(kind, subject, current) say the same of
    their subject; nine kinds of subject, from code to registry, are one equi-join. The reason is that of the first
    predicate that does not hold, by position (by kind where there is none)."""
    event = [C("state"), C("next_review_at"), C("next_expires_at"), (C("reason") if "reason" in events.columns else F.lit(None).cast("string")).alias("reason")]
    last = events.groupBy("rule_id").agg(F.max_by(F.struct(*event), F.struct("at", "event_id")).alias("last"))
    held = predicates.join(versions, ["kind", "subject"], "left").where(~C("expected").eqNullSafe(C("current")))
    changed = F.concat("kind", F.lit("_changed"))
    place = C("position") if "position" in predicates.columns else C("kind")
    failed = held.groupBy("rule_id").agg(F.array_sort(F.collect_set(changed)).alias("reasons"), F.min_by(changed, F.struct(place, C("kind"))).alias("_first"))  # a rule's own predicates
    joined = rules.join(last, "rule_id", "left").join(failed, "rule_id", "left")
    state = (
        F.when(C("last.state") == "revoked", "revoked")
        .when(now >= F.coalesce("last.next_expires_at", "expires_at"), "expired")
        .when(C("reasons").isNotNull(), "invalidated")
        .when(now >= F.coalesce("last.next_review_at", "review_at"), "review_due")
        .otherwise("active")
    )
    reason = F.when(state == "revoked", C("last.reason")).when(state == "expired", "fallback_expiry_reached").when(state == "invalidated", C("_first")).when(state == "review_due", "scheduled_review_due")
    out = joined.select(*rules.columns, state.alias("state"), reason.alias("reason"), "reasons")
    return out.withColumn("reasons", F.when(C("state") == "invalidated", C("reasons")))


#: What a rule of each scope must agree with a finding on; rule ids of an adapter are many for a finding.
SCOPES = {
    "occurrence": ["occurrence_id"], "stable_finding": ["fingerprint"], "contract_consumer": ["contract_kind", "canonical_key", "consumer"],
    "repository_pair_kind": ["producer", "consumer", "contract_kind"], "adapter_rule": ["adapter", "adapter_rule"], "workspace_rule": ["adapter_rule"],
}
#: The scopes that one rule of spans many findings.
BROAD = ("adapter_rule", "workspace_rule")


def match_suppressions(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """The least active rule that matches each finding (J13): findings(occurrence_id, fingerprint, contract_kind,
    canonical_key, producer, consumer, adapter, adapter_rule_ids) and rules with the columns of their scope. One
    equi-join a scope, united and reduced; rules that ask for the same are one before findings meet them. Findings are
    read once a scope, so they are written once, and so is what rules ask for: tables of a known size, of which the
    small ones are not worth a shuffle of the findings."""
    findings = materialise(findings, "findings")
    active = materialise(rules.where("state = 'active'").select("rule_id", "scope", *sorted({k for keys in SCOPES.values() for k in keys})), "rules")
    each = findings.withColumn("adapter_rule", F.explode("adapter_rule_ids"))
    hits = []
    for scope, keys in SCOPES.items():
        # The least rule of each key stands for all, so no finding meets more than one row a scope and rule id.
        least = materialise(active.where(C("scope") == scope).groupBy(*keys).agg(F.min("rule_id").alias("rule_id")), "rules")
        hits.append((each if "adapter_rule" in keys else findings).join(least, keys).select("occurrence_id", "rule_id"))
    best = reduce(DataFrame.unionByName, hits).groupBy("occurrence_id").agg(F.min("rule_id").alias("rule_id"))
    return findings.join(best, "occurrence_id", "left").withColumn("suppressed", C("rule_id").isNotNull())


def audit_suppressions(rules: DataFrame, broad: int = 3) -> DataFrame:
    """One row: active rules by scope, the broad ones, and what is anomalous about them (A21): three or more
    broad rules in all, and any rule for a whole workspace."""
    active = rules.where("state = 'active'")
    wide = C("scope").isin(*BROAD)
    counted = active.agg(*(F.count_if(C("scope") == s).alias(s) for s in SCOPES), F.array_sort(F.collect_list(F.when(wide, C("rule_id")))).alias("broad_rules"))
    found = F.array_compact(F.array(F.when(F.size("broad_rules") >= broad, "broad_rule_concentration"), F.when(C("workspace_rule") > 0, "workspace_rule_active")))
    return counted.withColumn("anomalies", found)


def sample_population(population: DataFrame, probability: float, seed: str, compat: bool = False) -> DataFrame:
    """All cases with a finding, others by a deterministic draw, with inverse-probability weights.
    compat: draws as wide as the published ones, which keep one in sixteen of what the weight says."""
    finding = C("detector_output").isin("candidate", "abstained")
    kept = population.where(finding | (uniform(seed, C("pull_request"), compat) < probability))
    p = F.when(finding, 1.0).otherwise(probability)
    return kept.withColumns({"inclusion_probability": p, "sampling_weight": 1 / p})


#: The subsets of a corpus.
SUBSETS = ["historical", "executable_replay", "mutation", "forward_shadow"]


def corpus_manifest(cases: DataFrame, eligible: int, subsets: list[str] = SUBSETS) -> DataFrame:
    """Counts of every subset, also of empty ones, how many cases may be published, a hash of the set of all case
    ids that no order changes (set_hash(): 240 bits, summed where the cases lie), and whether the cases' pull requests are no more than the population they come from (A20)."""
    public = (C("releaseability") == "public") & C("research_consent") & C("evaluation_consent")
    counts = [F.count_if(C("subset") == s).alias(s) for s in subsets]
    ids = set_hash(hash_text(C("case_id").cast("string")))
    sizes = F.broadcast(cases.agg(F.count_distinct("pull_request").alias("pull_requests")))  # one row
    out = cases.agg(*counts, F.count("*").alias("cases"), F.count_if(public).alias("public_cases"), ids.alias("case_ids_hash")).join(sizes)
    return out.withColumn("population_valid", C("pull_requests") <= eligible)


def simulate_policy(cases: DataFrame, allowed_strata: list[str], allowed_impacts: list[str], respect_suppressions: bool = True) -> DataFrame:
    """Frozen cases with what a policy would have selected (A22): candidates of allowed strata and impact claims,
    unless suppressed ones are respected."""
    chosen = (C("detector_output") == "candidate") & C("stratum").isin(*allowed_strata) & C("claim_impact").isin(*allowed_impacts)
    return cases.withColumn("policy_selected", chosen & ~C("suppressed") if respect_suppressions else chosen)


def policy_arm(replayed: DataFrame, maximum_alerts: float) -> DataFrame:
    """What a policy would have done with frozen cases (A22): deliveries, abstentions (of the detector, and
    candidates that are neither selected nor suppressed), suppressions; and over the cases that aren't
    mutations its precision and alerts, with a warning where these exceed the budget or nothing is judged."""
    candidate = C("detector_output") == "candidate"
    done = replayed.agg(
        F.count_if("policy_selected").alias("deliveries"),
        F.count_if((C("detector_output") == "abstained") | candidate & ~C("policy_selected") & ~C("suppressed")).alias("abstentions"),
        F.count_if(candidate & C("suppressed")).alias("suppressions"),
    )
    real = replayed.where("subset <> 'mutation'")
    judged = metric_set(real).where("metric = 'actionable_precision'").select("total", "successes", "lower95")
    alerts = pull_request_metrics(real).select("alerted_per_thousand")
    out = done.join(F.broadcast(judged)).join(F.broadcast(alerts))  # one row each
    warnings = F.array_compact(F.array(F.when(C("alerted_per_thousand") > maximum_alerts, "alert_budget_exceeded"), F.when(C("total") == 0, "no_labelled_deliveries")))
    return out.withColumn("warnings", warnings)


#: The default advisory gate.
GATE = {
    "minimum_labels": 100, "minimum_actionable_lower95": 0.9, "minimum_edge_lower95": 0.95, "minimum_audits": 100,
    "maximum_confidentiality_defects": 0, "maximum_removal_defects": 0, "maximum_alerted_per_thousand": 50, "maximum_p95_latency_ms": 600_000,
}


def gate_failures(evidence: DataFrame, gate: dict = GATE) -> DataFrame:
    """Failed checks of each stratum, in order (A23). The first counts the actionable total, as published."""
    action, _ = wilson(C("actionable_successes"), C("actionable_total"))
    edge, _ = wilson(C("edge_successes"), C("edge_total"))
    checks = (
        (C("actionable_total") < gate["minimum_labels"], "insufficient_independent_labels"),
        (action < gate["minimum_actionable_lower95"], "actionable_precision_lower_bound_below_gate"),
        (edge < gate["minimum_edge_lower95"], "edge_precision_lower_bound_below_gate"),
        (C("audit_total") < gate["minimum_audits"], "insufficient_false_omission_audit"),
        (C("confidentiality_defects") > gate["maximum_confidentiality_defects"], "unresolved_confidentiality_defect"),
        (C("removal_defects") > gate["maximum_removal_defects"], "unsafe_removal_coverage_defect"),
        (C("alerted_per_thousand") > gate["maximum_alerted_per_thousand"], "alert_budget_exceeded"),
        (C("p95_latency_ms") > gate["maximum_p95_latency_ms"], "latency_budget_exceeded"),
        (C("deliveries_without_remedy") > 0, "delivery_without_remedy"),
    )
    return evidence.withColumn("failures", F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in checks))))


def fold_promotions(history: DataFrame) -> DataFrame:
    """States of each stratum over its decisions in order (ST9): history(stratum, sequence, version, failures,
    compatible). Another version than before resets, unless a compatibility evaluation is on record; else no
    failure promotes, and a failure demotes what was promoted. Whether a decision left the stratum promoted
    depends on it and on the version before alone, so nothing is folded: two steps back are enough."""
    w = Window.partitionBy("stratum").orderBy("sequence")
    before = F.lag("version").over(w)
    changed = before.isNotNull() & ~C("version").eqNullSafe(before) & ~F.coalesce("compatible", F.lit(False))
    marked = history.withColumns({"_changed": changed, "_sound": F.size("failures") == 0})
    marked = marked.withColumn("_promoted", F.coalesce(F.lag(C("_sound") & ~C("_changed")).over(w), F.lit(False)))
    state = F.when(C("_changed"), "UNMEASURED").when(C("_sound"), "PROMOTED").when(C("_promoted"), "DEMOTED").otherwise("PREVIEW")
    decision = F.when(C("_changed"), "reset_unmeasured").when(C("_sound"), "promote").when(C("_promoted"), "demote").otherwise("remain_preview")
    reasons = F.when(C("_changed"), F.array(F.lit("incompatible_version_change"))).otherwise(C("failures"))
    return marked.select("stratum", "sequence", state.alias("state"), decision.alias("decision"), reasons.alias("reasons"))


def adjudicate(primary: DataFrame, adjudicator: DataFrame) -> DataFrame:
    """Labels of cases: agreed ones, else the adjudicator's, else indeterminate."""
    by = primary.groupBy("case_id").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("reviews"))
    third = adjudicator.select("case_id", C("label").alias("_third"))
    return by.join(third, "case_id", "left").select("case_id", F.when(C("low") == C("high"), C("low")).otherwise(F.coalesce("_third", F.lit("indeterminate"))).alias("label"), "reviews")


def replay_labels(records: DataFrame) -> DataFrame:
    """The impact that an executed replay shows."""
    label = F.when(C("outcome") == "relevant_failure", "breaking").when((C("outcome") == "pass") & (F.trim("exercised_scope") != ""), "compatible").otherwise("indeterminate")
    return records.withColumn("label", label)


def in_order(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Histories in a canonical order, numbered within each key."""
    return events.withColumn("position", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
