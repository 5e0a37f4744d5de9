"""Operators on small tables, with published values where there are any."""

import datetime as dt
import hashlib
import hmac
import json
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathomline.functions import canonical, identity, stats
from fathomline.operators import artifacts, contracts, delivery, evaluation, governance, graph, queues, readers, reasoning, registry, snapshots
from fathomline.sources import extract, records, tables, yaml_subset
from fathomline.streaming import inbox

C = F.col


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_bounds_have_the_published_values(spark):
    r = one(spark, low=stats.wilson(F.lit(95), F.lit(100))[0], none=stats.wilson(F.lit(0), F.lit(0))[0], full=stats.wilson(F.lit(0), F.lit(0))[1])
    assert round(r.low, 4) == 0.9008 and (r.none, r.full) == (0.0, 1.0)
    assert round(stats.exact_lower_bound(95, 100), 4) == 0.8977 and round(stats.exact_lower_bound(29, 29), 4) == 0.9019


@given(st.integers(0, 60), st.integers(0, 60))
@settings(max_examples=60, deadline=None)
def test_exact_bound_is_below_the_ratio(k, extra):
    n = k + extra
    low = stats.exact_lower_bound(k, n)
    assert 0 <= low <= (k / n if n else 0) + 1e-9


def test_freshness_is_inclusive(spark):
    e = spark.createDataFrame([("a", dt.date(2000, 1, 1)), ("b", dt.date(1999, 12, 31)), ("c", dt.date(2000, 1, 12))], "edge_id string, last_observed date")
    got = graph.current_edges(e, F.lit("2000-01-11").cast("date"), 10)
    assert [r.edge_id for r in got.collect()] == ["a"]


CHANGED = "contract_kind string, canonical_key string, producer long, change_kind string, compatibility string, service long, producer_generation string, definition_stratum string"
REFS = "contract_kind string, canonical_key string, constrained_key string, context_basis string, unresolved_pattern string, consumer long, generation_id long, reference_id string, first_observed date, last_observed date, stratum string"
RESOLVED = "reference_id string, state string, service long"
DAY = dt.date(2000, 1, 1)


def changes(spark, *keys, kind="k"):
    return spark.createDataFrame([(kind, k, 1, "removed", "breaking", 10, "g", "d@1") for k in keys], CHANGED)


def ref(name, key=None, constrained=None, basis=None, pattern=None, kind="k", consumer=7):
    return (kind, key, constrained, basis, pattern, consumer, 1, name, DAY, DAY, "r@1")


def test_basis_precedence(spark):
    """One reference for each rule, against two changes of its kind; the third change is of another kind."""
    ch = changes(spark, "x", "y").unionByName(changes(spark, "x", kind="other"))
    refs = spark.createDataFrame([
        ref("exact", "x"), ref("exact, its alias agrees", "x"), ref("contradicted", "x", pattern="p"), ref("ambiguous", "x", pattern="p"), ref("registry", None, "x", "heuristic"), ref("registry without a basis", None, "x"),
        ref("another service", None, "x"), ref("heuristic", None, "x", "heuristic"), ref("heuristic, key alone", "x", None, "heuristic", "p"), ref("declared", "x", "x", "declared_context", "p"), ref("behavioural", "x", "x", "behavioural_context"),
        ref("nothing", None, None, None, "p"), ref("other kind", "x", kind="z"),
    ], REFS)
    resolved = spark.createDataFrame([("exact, its alias agrees", "resolved", 10), ("contradicted", "resolved", 11), ("ambiguous", "ambiguous", None), ("registry", "resolved", 10), ("registry without a basis", "resolved", 10), ("another service", "resolved", 11), ("heuristic", "not_found", None)], RESOLVED)
    edges, problems = contracts.join_changed_contracts(ch, refs, resolved, "w", "r1")
    assert {r.reference_id: r.basis for r in edges.collect()} == {
        "exact": "exact", "exact, its alias agrees": "exact", "registry": "registry_resolved", "registry without a basis": "registry_resolved", "heuristic": "heuristic",
    }
    # Each is held against both changes of its kind: a contradiction is of one, and leaves the other unresolved.
    assert {(r.reference_id, r.diagnostic): r.times for r in problems.collect()} == {
        ("contradicted", "registry_contradiction"): 1, ("contradicted", "unresolved_reference"): 1, ("ambiguous", "registry_ambiguity"): 2, ("heuristic, key alone", "unresolved_reference"): 2,
        ("declared", "unresolved_reference"): 2, ("nothing", "unresolved_reference"): 2,
    }
    one = edges.where("reference_id = 'registry'").first()
    record = {"basis": "registry_resolved", "consumerRepositoryId": "7", "definitionKey": "x", "producerRepositoryId": "1", "registryRevision": "r1", "stableReferenceId": "registry", "workspaceId": "w"}
    assert one.edge_id == "edg_sha256:" + hashlib.sha256(json.dumps(record, separators=(",", ":")).encode()).hexdigest()
    assert one.stratum_key == "k|d@1|r@1|registry_resolved|producer_definition:exact+registry_alias:registry_resolved+consumer_reference:registry_resolved|v1"


def test_the_first_definition_counts_and_a_change_without_one_does_not(spark):
    ch = changes(spark, "x", "lost").drop("service", "producer_generation", "definition_stratum")
    defs = spark.createDataFrame([(1, "k", "x", 2, 22, "g2", "s"), (1, "k", "x", 1, 11, "g1", "s"), (2, "k", "lost", 0, 5, "g", "s")], "producer long, contract_kind string, canonical_key string, position int, service long, generation_id string, stratum string")
    assert [(r.canonical_key, r.service, r.producer_generation) for r in contracts.changed_definitions(ch, defs).collect()] == [("x", 11, "g1")]


def test_only_the_selected_generation_is_joined(spark):
    refs = spark.createDataFrame([ref("old"), ref("none", consumer=8)], REFS)
    selections = spark.createDataFrame([(7, 2), (8, None)], "repository long, generation_id long")
    assert contracts.selected_references(refs, selections).count() == 0
    assert contracts.selected_references(refs, spark.createDataFrame([(7, 1)], "repository long, generation_id long")).count() == 1


def test_touched_keys_rejoin_equals_slice(spark):
    refs = spark.createDataFrame([ref(f"r{i}", f"k{i % 7}", consumer=i) for i in range(70)], REFS)
    ch = changes(spark, *(f"k{i}" for i in range(7)))
    none = spark.createDataFrame([], RESOLVED)
    join = lambda c, r: contracts.join_changed_contracts(c, r, none, "w", "r")[0]
    whole, part = join(ch, refs), join(ch.where("canonical_key in ('k1', 'k2')"), refs)
    assert {r.edge_id for r in part.collect()} == {r.edge_id for r in whole.where("canonical_key in ('k1', 'k2')").collect()}
    shuffled = join(ch.orderBy(F.rand(1)), refs.orderBy(F.rand(2)).repartition(3))
    assert {r.edge_id for r in shuffled.collect()} == {r.edge_id for r in whole.collect()}


def test_aliases_need_kind_environment_time_and_a_live_service(spark):
    d = dt.date
    services = spark.createDataFrame([(1, d(2000, 1, 1), None), (2, d(2000, 1, 1), None), (3, d(2000, 1, 1), d(2000, 3, 1))], "id long, valid_from date, valid_until date")
    aliases = spark.createDataFrame([
        (1, "host", "Web.Example.", None, "prod", d(2000, 1, 1), None), (2, "host", "web.example", None, "test", d(2000, 1, 1), None), (3, "host", "web.example", None, "prod", d(2000, 1, 1), None),
        (1, "path_prefix", "/api/", "api", "prod", d(2000, 1, 1), None), (1, "path_prefix", "api", "/api/v1/", "prod", d(2000, 1, 1), None),
    ], "service long, kind string, value string, path_prefix string, environment string, valid_from date, valid_until date")
    ask = lambda i, kind, value, env, path, at: (i, kind, value, env, path, at)
    requests = spark.createDataFrame([
        ask(1, "host", "WEB.example", "prod", None, d(2000, 6, 1)), ask(2, "host", "web.example", "prod", None, d(2000, 2, 1)), ask(3, "host", "web.example", "test", None, d(2000, 6, 1)), ask(4, "host", "web.example", "prod", None, d(1999, 1, 1)),
        ask(5, "path_prefix", "api", "prod", "//api//v1/pets/", d(2000, 6, 1)), ask(6, "path_prefix", "api", "prod", "apis/v1", d(2000, 6, 1)), ask(7, "package_coordinate", "web.example", "prod", None, d(2000, 6, 1)),
    ], "request_id long, kind string, value string, environment string, path string, at date")
    got = {r.request_id: (r.state, r.service, r.rewritten_path) for r in registry.resolve_aliases(requests, aliases, services).collect()}
    assert got == {
        1: ("resolved", 1, None), 2: ("ambiguous", None, None), 3: ("resolved", 2, None), 4: ("not_found", None, None), 5: ("resolved", 1, "pets"), 6: ("not_found", None, None), 7: ("not_found", None, None),
    }


def test_consumer_states(spark):
    d = dt.date
    members = spark.range(1, 9).select(C("id").alias("repository"))
    selections = spark.createDataFrame([(1, 11, "complete", d(2000, 1, 1)), (2, 12, "failed", d(2000, 1, 1)), (4, 14, "complete", d(2000, 1, 1)), (5, 15, "partial", d(2000, 1, 1)), (6, 16, "complete", d(2000, 1, 1)), (7, 17, "complete", d(2000, 1, 1)), (8, 18, "complete", d(2000, 1, 1))], "repository long, generation_id long, state string, started_at date")
    observed = spark.createDataFrame([(11, "complete", d(2000, 1, 1)), (15, "failed", d(2000, 1, 1)), (16, "unsupported", d(2000, 1, 1)), (17, "partial", d(1999, 12, 1)), (18, "partial", d(2000, 1, 9))], "generation_id long, coverage_state string, completed_at date")
    denied = spark.createDataFrame([(1,)], "repository long")
    got = {r.repository: (r.consumer_state, r.generation_id, r.age_days) for r in contracts.consumer_states(members, selections, observed, F.lit(d(2000, 1, 10)), 20, denied).collect()}
    assert got == {
        1: ("unauthorized", None, None), 2: ("failed", None, None), 3: ("not_indexed", None, None), 4: ("not_indexed", None, None), 5: ("failed", None, None), 6: ("unsupported", 16, None), 7: ("stale", 17, 40), 8: ("current", 18, 1),
    }
    head = spark.createDataFrame([(1, 5, "complete"), (2, 6, "partial"), (3, 7, "unsupported")], "repository long, generation_id long, coverage_state string")
    assert {r.repository: (r.consumer_state, r.age_days) for r in contracts.producer_state(head, denied).collect()} == {1: ("unauthorized", None), 2: ("current", 0), 3: ("unsupported", None)}


def test_removal_on_incomplete_coverage_abstains(spark):
    e = spark.createDataFrame([("k", "x", 9, 1, "exact", "r", "e", "s", "removed", "breaking")], "contract_kind string, canonical_key string, producer long, consumer long, basis string, reference_id string, edge_id string, stratum_key string, change_kind string, compatibility string")
    s = spark.createDataFrame([(1, "current")], "repository long, consumer_state string")
    assert contracts.findings(e, s, "w", coverage=F.lit(False)).first().reason == "incomplete_index"
    found = contracts.findings(e, s, "w").first()
    record = {"canonicalKey": "x", "changeKind": "removed", "consumerRepositoryId": "1", "contractKind": "k", "policyMajor": 1, "producerRepositoryId": "9", "stableReferenceId": "r", "workspaceId": "w"}
    assert found.action == "coordinate" and found.fingerprint == "fnd_sha256:" + hashlib.sha256(json.dumps(record, separators=(",", ":")).encode()).hexdigest()


def test_reconciliation_actions(spark):
    schema = "repository long, selected boolean, head string, pulls map<bigint,string>"
    provider = spark.createDataFrame([(1, True, "b", {7: "x", 8: "y"}), (2, False, "a", {1: "z"}), (3, False, "a", {}), (4, True, "a", {})], schema)
    stored = spark.createDataFrame([(1, True, "a", {7: "x", 8: "old"}), (2, True, "a", {}), (3, False, "a", {}), (5, True, "a", {}), (6, False, "a", {})], schema)
    got = {(r.repository, r.action, r.pull_request, r.head) for r in contracts.reconcile(provider, stored).collect()}
    assert got == {(1, "index_default_branch", None, "b"), (1, "analyze_pull_request", 8, "y"), (2, "purge_repository", None, None), (4, "sync_scope", None, None), (4, "index_default_branch", None, "a"), (5, "purge_repository", None, None)}


def test_unobserved_edges_need_complete_observation(spark):
    e = spark.createDataFrame([("a", "ra", 1, None), ("b", "rb", 2, None)], "edge_id string, reference_id string, consumer long, invalidated_at string")
    seen = spark.createDataFrame([], "reference_id string")
    done = spark.createDataFrame([(1,)], "consumer long")
    got = {r.edge_id: r.invalidated_at for r in graph.invalidate_unobserved(e, seen, done, F.lit("now")).collect()}
    assert got == {"a": "now", "b": None}


def test_paths_are_simple_and_bounded(spark):
    e = spark.createDataFrame([("e1", 1, 2), ("e2", 2, 3), ("e3", 3, 1), ("e4", 3, 4), ("e5", 2, 4)], "edge_id string, producer long, consumer long")
    got = {(r.consumer, r.depth): r.via for r in graph.bounded_paths(e, spark.createDataFrame([(1,)], "start long"), 9).collect()}
    assert got == {(3, 2): ["e1", "e2"], (4, 2): ["e1", "e5"], (4, 3): ["e1", "e2", "e4"]}


def test_invalidation_plan(spark):
    changed = spark.createDataFrame([("a", None), ("new", "b"), ("lost", None)], "path string, previous_path string")
    owners = spark.createDataFrame([("a", "pa"), ("b", "pb"), ("new", "pn")], "path string, partition string")
    deps = spark.createDataFrame([("x", "pa"), ("y", "x"), ("z", "q")], "node string, depends_on string")
    hit, unowned = graph.plan_invalidation(changed, owners, deps)
    assert {(r.node, r.distance) for r in hit.collect()} == {("pa", 0), ("pb", 0), ("pn", 0), ("x", 1), ("y", 2)}
    assert [r.path for r in unowned.collect()] == ["lost"]


RULES = "rule_id long, scope string, occurrence_id string, fingerprint string, contract_kind string, canonical_key string, producer long, consumer long, adapter string, adapter_rule string, review_at date, expires_at date"


def rule(i, scope="stable_finding", review=dt.date(2002, 1, 1), expires=dt.date(2003, 1, 1), **of):
    return (i, scope, *(of.get(c) for c in ("occurrence_id", "fingerprint", "contract_kind", "canonical_key", "producer", "consumer", "adapter", "adapter_rule")), review, expires)


def test_suppression_precedence(spark):
    d = dt.date
    rules = spark.createDataFrame([rule(i, review=d(2000, 1, 1), expires=d(2001, 1, 1)) for i in range(5)] + [rule(5), rule(6), rule(7)], RULES)
    ev = spark.createDataFrame([(0, "revoked", None, None, 2, 1), (0, "renewed", None, None, 1, 2), (1, "renewed", None, d(2009, 1, 1), 1, 3), (2, "renewed", d(2009, 1, 1), d(2009, 1, 1), 1, 4)], "rule_id long, state string, next_review_at date, next_expires_at date, at long, event_id long")
    predicates = spark.createDataFrame([(5, "policy_revision", "", "p1"), (5, "adapter_version", "ts", "1"), (6, "policy_revision", "", "p2"), (7, "contract_shape", "gone", "s"), (3, "policy_revision", "", "p1")], "rule_id long, kind string, subject string, expected string")
    versions = spark.createDataFrame([("policy_revision", "", "p2"), ("adapter_version", "ts", "2")], "kind string, subject string, current string")
    got = {r.rule_id: (r.state, r.reasons) for r in governance.suppression_states(rules, ev, predicates, versions, F.lit("2001-06-01").cast("date")).collect()}
    assert {i: s for i, (s, _) in got.items()} == {0: "revoked", 1: "review_due", 2: "active", 3: "expired", 4: "expired", 5: "invalidated", 6: "active", 7: "invalidated"}
    assert got[5][1] == ["adapter_version_changed", "policy_revision_changed"] and got[3][1] is None
    placed = predicates.withColumn("position", F.when(C("kind") == "policy_revision", 1).otherwise(2))
    why = {r.rule_id: r.reason for r in governance.suppression_states(rules, ev.withColumn("reason", F.lit("no longer wanted")), placed, versions, F.lit("2001-06-01").cast("date")).collect()}
    assert why == {0: "no longer wanted", 1: "scheduled_review_due", 2: None, 3: "fallback_expiry_reached", 4: "fallback_expiry_reached", 5: "policy_revision_changed", 6: None, 7: "contract_shape_changed"}


def test_suppressions_by_scope(spark):
    schema = "occurrence_id string, fingerprint string, contract_kind string, canonical_key string, producer long, consumer long, adapter string, adapter_rule_ids array<string>"
    found = spark.createDataFrame([(f"o{i}", f"f{i}", "k", f"c{i}", 1, i, "ts", ["a", f"r{i}"]) for i in range(7)], schema)
    rules = spark.createDataFrame([
        rule(20, "occurrence", occurrence_id="o0"), rule(21, "stable_finding", fingerprint="f1"), rule(22, "contract_consumer", contract_kind="k", canonical_key="c2", consumer=2), rule(23, "repository_pair_kind", producer=1, consumer=3, contract_kind="k"),
        rule(24, "adapter_rule", adapter="ts", adapter_rule="r4"), rule(25, "workspace_rule", adapter_rule="r5"), rule(19, "workspace_rule", adapter_rule="r0"), rule(18, "adapter_rule", adapter="other", adapter_rule="r6"), rule(17, "contract_consumer", contract_kind="k", canonical_key="c2", consumer=3),
    ], RULES)
    states = rules.withColumn("state", F.when(C("rule_id") == 21, "expired").otherwise("active"))
    got = {r.occurrence_id: r.rule_id for r in governance.match_suppressions(found, states).collect()}
    assert got == {"o0": 19, "o1": None, "o2": 22, "o3": 23, "o4": 24, "o5": 25, "o6": None}
    audit = governance.audit_suppressions(states).first()
    assert (audit.workspace_rule, audit.adapter_rule, audit.stable_finding) == (2, 2, 0) and audit.anomalies == ["broad_rule_concentration", "workspace_rule_active"] and audit.broad_rules == [18, 19, 24, 25]
    assert governance.audit_suppressions(states.where("scope = 'occurrence'")).first().anomalies == []


def test_promotion_states(spark):
    h = spark.createDataFrame([("s", 1, "v1", ["x"], False), ("s", 2, "v1", [], False), ("s", 3, "v1", ["x"], False), ("s", 4, "v2", [], False), ("s", 5, "v2", [], False), ("s", 6, "v3", ["y"], True)], "stratum string, sequence long, version string, failures array<string>, compatible boolean")
    got = [(r.state, r.decision, r.reasons) for r in governance.fold_promotions(h).orderBy("sequence").collect()]
    assert got == [
        ("PREVIEW", "remain_preview", ["x"]), ("PROMOTED", "promote", []), ("DEMOTED", "demote", ["x"]), ("UNMEASURED", "reset_unmeasured", ["incompatible_version_change"]), ("PROMOTED", "promote", []), ("DEMOTED", "demote", ["y"]),
    ]


def test_sampling_weights(spark):
    p = spark.range(4000).select(F.when(C("id") % 4 == 0, "candidate").otherwise("no_candidate").alias("detector_output"), C("id").cast("string").alias("pull_request"))
    got = governance.sample_population(p, 0.5, "s")
    by = {r.detector_output: (r.n, r.w) for r in got.groupBy("detector_output").agg(F.count("*").alias("n"), F.max("sampling_weight").alias("w")).collect()}
    assert by["candidate"] == (1000, 1.0) and by["no_candidate"][1] == 2.0 and abs(by["no_candidate"][0] - 1500) < 120
    compat = governance.sample_population(p, 0.5, "s", compat=True).where("detector_output = 'no_candidate'").count()
    assert abs(compat - 3000 / 32) < 40
    digest = hashlib.sha256(json.dumps("s\0" + "17").encode()).hexdigest()
    r = one(spark, narrow=identity.uniform("s", F.lit(17)), wide=identity.uniform("s", F.lit(17), compat=True))
    assert r.narrow == int(digest[:13], 16) / 16**13 and r.wide == int(digest[:13], 16) / 2**48


CASES = "organization string, pull_request string, stratum string, team long, opened_on string, detector_output string, policy_selected boolean, suppressed boolean, claim_impact string, claim_action string, label_edge string, label_impact string, label_action string, weight double, cost_microunits double, analysis_outcome string, independently_labelled boolean, action_observed boolean, time_to_action_ms long, action_censored boolean, subset string"


def case(pr, stratum="a", team=1, day="2024-01-01", out="candidate", selected=True, label="coordinate", weight=1.0, observed=None, took=None, suppressed=False, impact="breaking", subset="historical"):
    return ("o", pr, stratum, team, day, out, selected, suppressed, impact, "coordinate", "confirmed", "breaking", label, weight, 2.0, "completed", True, observed, took, False, subset)


def test_evaluation_by_hand(spark):
    cases = spark.createDataFrame([
        case("1", weight=2.0, observed=True, took=30), case("1", "b", label="none", observed=False), case("2", "b", team=2, day="2024-01-02", selected=False, observed=True, took=10),
        case("3", "b", team=3, day="2024-01-03", out="abstained", weight=3.0), case("4", "a", team=1, day="2024-01-03", label="indeterminate", observed=True, took=20), case("5", "a", out="no_candidate", label=None),
    ], CASES)
    m = evaluation.pull_request_metrics(cases).first()
    # Selected: both of 1 and that of 4, weights 2 + 1 + 1; candidates: these, 2 and 3; pull requests weigh 2, 1, 3, 1, 1.
    assert (m.pull_requests, m.alert_total, m.alert_successes, m.alert_indeterminate, m.alert_weighted) == (5, 1, 1, 1, 1.0)
    assert (m.selection_coverage, m.findings_per_thousand, m.alerted_per_thousand) == (0.5, 500.0, 375.0)
    assert (m.analysis_coverage, round(m.label_coverage, 6), m.total_cost, m.mean_cost) == (1.0, round(8 / 9, 6), 18.0, 2.25)
    risk = {r.stratum: (r.total, r.successes, r.selection_coverage, r.findings_per_thousand) for r in evaluation.risk_coverage(cases).collect()}
    assert risk == {"a": (1, 1, 0.375, 375.0), "b": (2, 1, 0.5, 500.0)}
    assert {r.team: (r.alerted, r.active) for r in evaluation.team_burden(cases).collect()} == {1: (2, 3), 2: (0, 3), 3: (0, 3)}
    u = evaluation.usefulness(cases).first()
    assert (u.eligible, u.observed_actions, u.action_rate, u.median_time_to_action, u.censored) == (4, 3, 0.75, 20, 0)


def test_policy_arms_by_hand(spark):
    cases = spark.createDataFrame([case("1"), case("2", suppressed=True), case("3", "b"), case("4", impact="compatible"), case("5", out="abstained"), case("6", subset="mutation")], CASES)
    arm = governance.policy_arm(governance.simulate_policy(cases, ["a"], ["breaking"]), 100).first()
    assert (arm.deliveries, arm.abstentions, arm.suppressions, arm.total, arm.successes, arm.warnings) == (2, 3, 1, 1, 1, ["alert_budget_exceeded"])
    none = governance.policy_arm(governance.simulate_policy(cases, [], ["breaking"]), 100).first()
    assert (none.deliveries, none.warnings) == (0, ["no_labelled_deliveries"])


def test_disclosure_takes_the_first_reason(spark):
    f = spark.createDataFrame([(a, *b) for a in ("static", "personalized") for b in ((True,) * 4, (False,) * 4, (True, False, False, False), (True, True, False, True), (True, True, True, False))], "audience string, explicit_grant boolean, app_can_read boolean, whole_audience_can_read boolean, viewer_can_read boolean")
    got = [r.omitted for r in delivery.disclose(f, C("audience")).collect()]
    assert got == [None, "no_explicit_grant", "app_access_denied", "whole_audience_safety_unproven", None, None, "no_explicit_grant", "app_access_denied", None, "viewer_access_denied"]


def test_alpha_of_perfect_and_chance_agreement(spark):
    same = spark.createDataFrame([("e", "a", "a"), ("e", "b", "b")] * 10, "axis string, a string, b string")
    assert evaluation.agreement(same).first().alpha == 1.0
    opposed = spark.createDataFrame([("e", "a", "b"), ("e", "b", "a")] * 10, "axis string, a string, b string")
    assert evaluation.agreement(opposed).first().alpha == pytest.approx(-1.0)


def test_compatibility_rules(spark):
    lit = F.lit
    array = lambda *x: F.array(*map(lit, x)) if x else F.array().cast("array<string>")
    kinds = lambda **k: F.create_map(*(lit(v) for kv in k.items() for v in kv)) if k else F.create_map().cast("map<string,string>")
    schema = lambda t="object", props=None, req=(), vals=(): F.struct(lit(t).alias("type"), kinds(**(props or {})).alias("properties"), array(*req).alias("required"), array(*vals).alias("values"))
    pay = identity.payload_compatibility
    long = "pässwörd " * 3 + "é" * 9
    r = one(
        spark,
        widen=identity.widens(lit("INT4"), lit("bigint")), shorter=identity.widens(lit("varchar(9)"), lit("varchar(8)")), text=identity.widens(lit("varchar"), lit("text")),
        lost=identity.enum_compatibility(array("a", "b"), array("a")), grown=identity.enum_compatibility(array("a"), array("a", "b")),
        retyped=pay(schema(props={"a": "int"}), schema(props={"a": "string"})), more=pay(schema(props={"a": "int"}), schema(props={"a": "int", "b": "int"})), unrequired=pay(schema(req=["a"]), schema()),
        other=pay(schema(), schema("array")), enum=pay(schema(vals=["x"]), schema(vals=["x", "y"])), first_enum=pay(schema(), schema(vals=["x"])), unknown=pay(lit(None).cast(identity.PAYLOAD), schema()),
        added=identity.addition_compatibility(lit("database.column"), lit(None).cast("boolean")), nullable=identity.column_compatibility(lit("text"), lit("text"), lit(True), lit(False)),
        route=identity.route_template(lit("//a//:id/{x}/b/?q=1")), seg=identity.identity_segment(lit(" a b/c!~ ")), empty=identity.identity_segment(lit("  ")), key=identity.contract_key("Sch", lit("a b"), lit("c")), gate=identity.gateway_rewrite(lit("//api//x/"), lit("/api")), no_gate=identity.gateway_rewrite(lit("apix"), lit("api")),
        host=identity.alias_value(lit("host"), lit(" Web.Example. ")), path=identity.alias_value(lit("path_prefix"), lit("//a//b/")),
        masked=identity.minimise_excerpt(lit("// c\n<!-- x\n-- y\nx token: abc\nprivate_key='a b'\n" + "z" * 50), 200), cut=identity.minimise_excerpt(lit(long), 30), line=identity.line_of(lit("a\nb\nc"), lit(3)), column=identity.column_of(lit("ab\ncde"), lit(5)),
        module=identity.module_path(lit("./src/a/../b/index.d.ts")), up=identity.module_path(lit("../../x.tsx")), elapsed=identity.elapsed_ms(lit("2024-01-01 00:00:01"), lit("2024-01-01 00:00:03.5")), early=identity.elapsed_ms(lit("2024-01-02"), lit("2024-01-01")),
        printable=identity.bounded_text(lit("ok"), 2), blank=identity.bounded_text(lit(" ok"), 5),
    )
    assert (r.widen, r.shorter, r.text) == (True, False, True)
    assert (r.lost, r.grown, r.nullable, r.added) == ("breaking", "potentially_breaking", "breaking", "potentially_breaking")
    assert (r.retyped, r.more, r.unrequired, r.other, r.enum, r.first_enum, r.unknown) == ("breaking", "compatible", "breaking", "breaking", "potentially_breaking", "compatible", "unknown")
    assert (r.route, r.seg, r.empty, r.key, r.gate, r.no_gate, r.host, r.path) == ("/a/{param}/{param}/b", "a%20b%2Fc!~", None, "sch:a%20b#c", "x", None, "web.example", "a/b")
    assert r.masked == "x token=[REDACTED]\nprivate_key=[REDACTED]\n[REDACTED]" and (r.line, r.column) == (2, 3)
    assert r.cut == long[:30].encode()[:30].decode(errors="ignore")
    assert (r.module, r.up, r.elapsed, r.early, r.printable, r.blank) == ("./src/b", "./x", 2500, 0, True, False)


def test_signatures(spark):
    p = lambda n, optional=0: [(False, False)] * n + [(True, False)] * optional
    rows = [
        ([(p(1), "a")], [(p(1, 1), "b")]), ([(p(1), "a")], [(p(2), "b")]), ([(p(1), "a"), (p(0), "z")], [(p(1), "a")]), ([(p(1), "a")], [(p(1), "a"), (p(3), "c")]), ([(None, "a")], [(p(1), "a")]), ([(p(1), "a")], [(p(1), "a")]),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, before {identity.OVERLOADS}, after {identity.OVERLOADS}").orderBy("i")
    got = [r[0] for r in df.select(identity.signature_compatibility(C("before"), C("after"), C("i") == 5)).collect()]
    assert got == ["potentially_breaking", "breaking", "potentially_breaking", "compatible", "unknown", "potentially_breaking"]


def test_canonical_hashes(spark):
    text = 'q"uote \\ tab\t \x01\x0b é 🙂'
    record = {"b": {"z": 1, "a": ["x", text]}, "a": None, "c": True}
    column = {"b": {"z": canonical.whole(F.lit(1)), "a": [F.lit("x"), F.lit(text)]}, "a": None, "c": True}
    want = json.dumps(record, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    r = one(spark, json=canonical.canonical_json(column), hash=canonical.hash_record(column), two=canonical.hash_parts(F.lit("ab"), F.lit("é")), swapped=canonical.hash_parts(F.lit("a"), F.lit("bé")), mac=canonical.hmac_sha256(b"k" * 70, F.lit("m").cast("binary")), nothing=canonical.stable_reference_id(F.lit("k"), F.lit(None), F.lit(None), F.lit(None), F.lit("s")))
    assert r.json == want and r.hash == "sha256:" + hashlib.sha256(want.encode()).hexdigest()
    sized = b"".join(len(x).to_bytes(8, "big") + x for x in (b"ab", "é".encode()))
    assert r.two == "sha256:" + hashlib.sha256(sized).hexdigest() != r.swapped and r.nothing is None
    assert r.mac == hmac.new(b"k" * 70, b"m", hashlib.sha256).hexdigest()


def test_sinks(spark, tmp_path):
    held = spark.createDataFrame([(1, "a"), (2, "b")], "id long, hash string")
    new, conflict = tables.insert_if_absent(held, spark.createDataFrame([(1, "a"), (2, "x"), (3, "c"), (3, "c")], "id long, hash string"), ["id"], "hash")
    assert new.count() == 1 and [r.id for r in conflict.collect()] == [2]
    left, ledger = tables.purge({"t": held}, "id", 1)
    assert left["t"].count() == 1 and ledger.first().deleted == 1
    assert [r.id for r in tables.page(held, ["id"], 1, 5).collect()] == [2]
    assert delivery.cap(held, ["id"], 1).first().truncated == 1
    side = lambda *rows: spark.createDataFrame(rows, "path string, content_hash string, entry_kind string, binary boolean")
    base, head = side(("a", "1", "file", False), ("b", "2", "file", True), ("c", "3", "file", False), ("t", "4", "file", False)), side(("a", "1", "file", False), ("d", "2", "file", True), ("c", "4", "file", True), ("e", "1", "file", False), ("t", "4", "symlink", False), ("n", "9", "file", False))
    got = {(r.path, r.change, r.previous_path, r.binary) for r in tables.tree_compare(base, head).collect()}
    assert got == {("d", "R", "b", True), ("b", "D", None, True), ("c", "M", None, True), ("e", "C", "a", False), ("t", "T", None, False), ("n", "A", None, False)}


def test_backups_are_checked_before_anything_is_restored(spark):
    df = spark.createDataFrame([("w", 1), ("w", 2)], "workspace string, x long")
    sums = {"t": tuple(records.manifest(df, df.columns).first())}
    assert sums["t"] == tuple(records.manifest(df.orderBy(F.desc("x")), df.columns).first())
    assert records.restore({"t": df}, sums, "w")["t"].count() == 2
    for backup, tenant in (({"t": df.where("x = 1")}, "w"), ({"t": df}, "v")):
        with pytest.raises(ValueError):
            records.restore(backup, sums, tenant)
    assert records.migrate({"t": df}, 1, [lambda t: {}, lambda t: {**t, "u": t["t"]}])[0].keys() == {"t", "u"}
    with pytest.raises(ValueError):
        records.migrate({}, 3, [])
    assert records.append_audit(spark.createDataFrame([(1,)], "audit_id long"), spark.createDataFrame([(1,), (2,), (2,)], "audit_id long")).count() == 1


def test_signed_deliveries(spark):
    secret, sha = b"s", "a" * 40
    push = json.dumps({"before": sha, "after": "b" * 40, "ref": "refs/heads/x", "installation": {"id": 3}, "repository": {"id": 4}}).encode()
    sign = lambda b, k=secret: "sha256=" + hmac.new(k, b, hashlib.sha256).hexdigest()
    rows = [("1", "push", push, sign(push)), ("2", "push", push, sign(push, b"x")), ("3", "star", push, sign(push)), ("4", "pull_request", push, sign(push)), ("5", "push", b"{}", sign(b"{}")), ("6", "push", push, None), ("", "push", push, sign(push))]
    taken, refused = records.receive(spark.createDataFrame(rows, "delivery_id string, event_type string, body binary, signature string"), secret)
    t = taken.collect()
    assert [(r.delivery_id, r.installation, r.repository, r.before, r.ref, r.payload_hash) for r in t] == [("1", 3, 4, sha, "refs/heads/x", "sha256:" + hashlib.sha256(push).hexdigest())]
    assert {r.delivery_id: r.reason for r in refused.collect()} == {"2": "signature_invalid", "3": "event_unsupported", "4": "action_unsupported", "5": "payload_invalid", "6": "signature_invalid", "": "delivery_id_invalid"}


def test_caches_configuration_and_bundles(spark, tmp_path):
    rows = spark.createDataFrame([("a", b"1"), ("b", b"x" * 70_000), ("c", b"3")], "key string, content binary")
    held = records.cache_put(rows.limit(0).withColumn("hash", F.lit("")), rows)
    assert {r.key for r in held.collect()} == {"a", "c"}
    spoilt = held.withColumn("content", F.when(C("key") == "c", F.lit(b"4")).otherwise(C("content")))
    assert {r.key: (r.hit, r.corrupt) for r in records.cache_get(spoilt, rows).collect()} == {"a": (True, False), "b": (False, False), "c": (False, True)}
    (tmp_path / "c.json").write_text('{"workspace": "w"}')
    assert records.load_config(spark, str(tmp_path / "c.json"), ["workspace"]) == {"workspace": "w"}
    with pytest.raises(ValueError):
        records.load_config(spark, str(tmp_path / "c.json"), ["policy"])
    bundle = {"manifest": {"caseIds": ["1", "2"], "revision": "r"}, "cases": [{"id": "1", "subset": "mutation"}, {"id": "3", "subset": "historical"}]}
    (tmp_path / "b.json").write_text(json.dumps(bundle))
    cases, problems = records.import_bundle(spark, str(tmp_path / "b.json"))
    assert cases.count() == 2 and {(r.id, r.problem) for r in problems.collect()} == {("2", "listed_without_case"), ("3", "case_not_listed")}


def test_readers(spark):
    refs = spark.createDataFrame([("a", None, 1, "r1", 1), (None, "a", 1, "r2", 1), ("a", "a", 1, "r3", 1), ("b", "c", 1, "r4", 1), (None, None, 1, "r5", 1)], "canonical_key string, constrained_key string, consumer long, reference_id string, generation_id long")
    keys = spark.createDataFrame([("a",), ("c",), ("a",)], "canonical_key string")
    assert sorted(r.reference_id for r in readers.read_references(refs, keys).collect()) == ["r1", "r2", "r3", "r4"]
    assert readers.snake_case(spark.createDataFrame([(1,)], "generationId long")).columns == ["generation_id"] and readers.camel_case(spark.createDataFrame([(1,)], "generation_id long")).columns == ["generationId"]
    assert readers.telemetry(spark.createDataFrame([("t", 1)], "type string, durationMs long")).columns == ["type", "durationMs"]
    with pytest.raises(ValueError):
        readers.telemetry(spark.createDataFrame([("t", "x")], "type string, path string"))


def test_derived_artifacts_through_their_chain(spark):
    g = spark.createDataFrame([(1, None, None), (2, 1, "a"), (3, 2, "b"), (8, 9, "x"), (9, 8, "y")], "generation_id long, base_generation_id long, overlay_id string")
    chains = snapshots.ancestry(g, g)
    assert {(r.generation_id, r.ancestor, r.depth, r.cycle) for r in chains.where("generation_id in (3, 8)").collect()} == {(3, 3, 0, False), (3, 2, 1, False), (3, 1, 2, False), (8, 8, 0, False), (8, 9, 1, False), (8, 8, 2, True)}
    artifacts_ = spark.createDataFrame([(1, "p", "old"), (1, "q", "old"), (1, "r", "old")], "generation_id long, path string, payload string")
    entries = spark.createDataFrame([("a", "p", "replacement", "mid"), ("a", "q", "tombstone", None), ("b", "q", "replacement", "new"), ("b", "r", "tombstone", None)], "overlay_id string, path string, kind string, payload string")
    got = {(r.path, r.payload) for r in snapshots.derived_artifacts(chains.where("generation_id = 3"), artifacts_, entries).collect()}
    assert got == {("p", "mid"), ("q", "new")}


def test_evidence_and_scrubbing(spark):
    handle = "repository string, generation_id string, path string, content_hash string"
    ch = spark.createDataFrame([(1, "x", "f"), (2, "y", "g")], "position long, canonical_key string, family string")
    defs = spark.createDataFrame([(1, "x", True, "r", "g", "dx", "1"), (2, "y", False, "r", "g", "dy", "2"), (3, "z", True, "r", "g", "dz", "3")], f"position long, canonical_key string, has_range boolean, {handle}")
    refs = spark.createDataFrame([(1, "x", "f", True, "r", "g", "rx", "1"), (2, None, "g", True, "r", "g", "rg", "2"), (3, None, "h", True, "r", "g", "rh", "3"), (4, "x", "f", True, "r", "g", "rx", "1")], f"position long, canonical_key string, family string, has_range boolean, {handle}")
    plan = reasoning.plan_evidence(ch, defs, refs, 9).orderBy("ordinal").collect()
    assert [r.side for r in plan] == ["producer", "consumer", "consumer"] and {r.path for r in plan} == {"dx", "rx", "rg"}
    assert reasoning.plan_evidence(ch, defs.limit(0), refs, 9).count() == 0
    runs, analyses = spark.createDataFrame([("a", 1), ("b", 2)], "run_id string, analysis_id long"), spark.createDataFrame([(1, "h"), (2, "i")], "analysis_id long, reasoning_hash string")
    clean, left = reasoning.scrub_run(analyses, runs, "a")
    assert {r.analysis_id: r.reasoning_hash for r in clean.collect()} == {1: None, 2: "i"} and left.count() == 1


def files(spark, *rows):
    return spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(rows)], "path string, text string")


def test_extractors(spark):
    http = extract.http_contracts(files(spark, "app.get('/pets/:id', h); axios.post(`https://X.io/pets/${id}?q`); fetch('/ping'); fetch('/p', {method: m}); api.put(`/a/${f(x)}`); router.get(`/${x}`)", "app.use('/v1', router); fetch(url)"))
    assert {(r.role, r.method, r.host, r.route) for r in http.collect()} == {
        ("definition", "GET", None, "/pets/{param}"), ("reference", "POST", "x.io", "/pets/{param}"), ("reference", "GET", None, "/ping"), ("limitation", "dynamic_http_method", None, None), ("reference", "PUT", None, None),
        ("limitation", "dynamic_url", None, None), ("definition", "GET", None, "/{param}"), ("limitation", "mounted_router_prefix_unresolved", None, None),
    }
    conf = extract.configuration(files(spark, "process.env.DB_URL; process.env[name]; isFeatureEnabled('beta'); secrets.get('vault', 'db')"), b"salt", "ns")
    got = {(r.role, r.kind): r.key for r in conf.collect()}
    assert got == {("reference", "configuration_key"): "DB_URL", ("limitation", "limitation"): "computed_configuration_key", ("reference", "feature_flag"): "beta", ("reference", "secret_reference"): "hmac-sha256:" + hmac.new(b"salt", b"2:ns5:vault2:db", hashlib.sha256).hexdigest()}
    ev = extract.event_destinations(files(spark, "p.send({topic: 'orders'}); c.subscribe({ topic: 'orders' }); new SendMessageCommand({QueueUrl: 'https://sqs.eu-1.amazonaws.com/1/jobs'}); pubsub.topic('t').subscription('s')"))
    assert {(r.provider, r.role, r.namespace, r.destination) for r in ev.collect()} == {("kafka", "producer", None, "orders"), ("kafka", "consumer", None, "orders"), ("aws_sqs", "producer", "aws:eu-1:1", "jobs"), ("gcp_pubsub", "consumer", None, "t")}
    man = extract.event_manifests(files(spark, "schema: events\nbindings:\n  - role: producer\n    provider: kafka\n    destination: orders\n    payloadSchema: {schema: {title: x, type: object, properties: {b: {type: string}, a: {type: number}}}}\n", "schema: events\nbindings:\n  - role: producer\n    provider: kafka\n", "schema: other"))
    assert {(r.kind, r.name, r.detail) for r in man.collect()} == {("producer", "kafka:topic:orders", '{"properties":{"a":{"type":"number"},"b":{"type":"string"}},"type":"object"}'), ("limitation", "ValueError", None)}
    mod = extract.module_symbols(files(spark, "export function a() {}\nexport { b as c, d };\nexport * from './z';\nexport { e as f } from './y';\nimport x from './y'"))
    assert {(r.role, r.name, r.source, r.imported) for r in mod.collect()} == {("export", "a", None, None), ("export", "c", None, None), ("export", "d", None, None), ("reexport", "*", "./z", "*"), ("reexport", "f", "./y", "e"), ("import", "./y", "./y", None), ("import", "./z", "./z", None)}
    api = extract.api_operations(files(spark, '{"paths": {"/p/{id}": {"get": {"parameters": [{"$ref": "#/c/q"}]}, "post": {"operationId": "mk"}}}, "c": {"q": {"name": "id", "required": true}}}', "not: [json", '{"paths": {"/x": {"get": {"parameters": [{"$ref": "#/l"}]}}}, "l": {"$ref": "#/l"}}', "paths:\n  /y:\n    get: {operationId: why}\n"))
    assert [(r.kind, r.name, r.detail) for r in api.orderBy("path", "name").collect()][:2] == [("operation", "GET /p/{}", "id"), ("operation", "mk", "")]
    assert api.where("kind = 'limitation'").count() == 2 and api.where("name = 'why'").count() == 1
    proto = extract.message_schemas(files(spark, '{"file": [{"package": "p", "messageType": [{"name": "M", "field": [{"name": "a", "number": 1, "type": "T"}], "nestedType": [{"name": "N", "field": [{"name": "b", "number": 2}]}]}], "service": [{"name": "S", "method": [{"name": "Go", "inputType": "M", "outputType": "M"}]}]}]}'))
    assert {r.name for r in proto.collect()} == {"p.M#1", "p.M.N#2", "p.S/Go"}
    ingress = "kind: Ingress\nmetadata: {name: i}\nspec:\n  rules:\n  - http:\n      paths:\n      - path: /\n        backend: {service: {name: web, port: {number: 80}}}\n"
    infra = extract.infrastructure(files(spark, '{"kind": "Service", "metadata": {"name": "web"}, "spec": {"ports": [{"port": 80}]}}', 'output "url" {}\nx = data.terraform_remote_state.net.outputs.vpc', "- yaml", ingress, "kind: {{ template }}"))
    assert {(r.kind, r.name, r.detail) for r in infra.collect()} == {
        ("service", "web", ""), ("endpoint", "web", "80/TCP"), ("output", "url", ""), ("output_reference", "vpc", "net"), ("limitation", "infrastructure_syntax_unresolved", ""), ("service_reference", "web", ""), ("endpoint_reference", "web", "80/TCP"),
        ("limitation", "helm_template_unresolved", ""),
    }


def test_reexports_are_followed_through_cycles(spark):
    symbols = spark.createDataFrame([("a", "export", "x", None, None), ("a", "export", "default", None, None), ("b", "reexport", "*", "./a", "*"), ("c", "reexport", "y", "./b", "x"), ("a", "reexport", "*", "./c", "*")], "path string, role string, name string, source string, imported string")
    targets = spark.createDataFrame([("b", "./a", "a"), ("c", "./b", "b"), ("a", "./c", "c")], "path string, source string, target string")
    got = {(r.path, r.name, r.declared_as, r.steps) for r in extract.reexported_symbols(symbols, targets).collect()}
    assert got == {("a", "x", "x", 0), ("a", "default", "default", 0), ("b", "x", "x", 1), ("c", "y", "x", 2), ("a", "y", "x", 3), ("b", "y", "x", 4)}


def test_yaml_subset():
    doc = "a: 1 # one\nb:\n- x\n- y: 'it''s'\n  z: \"q\\n\"\nc: {d: [1, 2.5, true, null], 'e f': g}\nf: |\n  one\n   two\n"
    assert yaml_subset.documents(doc) == [{"a": 1, "b": ["x", {"y": "it's", "z": "q\n"}], "c": {"d": [1, 2.5, True, None], "e f": "g"}, "f": "one\n two\n"}]
    assert yaml_subset.documents("a: 1\n---\nkind: B\n") == [{"a": 1}, {"kind": "B"}]
    for bad in ("a: &x 1", "a: *x", "a: 1\na: 2", "a:\n\t- b", "a: [1, 2", "a: !!str x", "<<: {a: 1}"):
        with pytest.raises(ValueError):
            yaml_subset.documents(bad)


def test_migrations_replay_in_order(spark):
    rows = [
        ("n", "001", "CREATE TABLE t (id int4 PRIMARY KEY, name varchar(10) NOT NULL, x numeric(10, 2)); -- c; d\nCREATE TYPE mood AS ENUM ('a', 'b;c');"),
        ("n", "002", "ALTER TABLE t ADD COLUMN y text, ALTER COLUMN name TYPE text, DROP COLUMN x; ALTER TYPE mood ADD VALUE 'z';"),
        ("n", "003", "ALTER TABLE t RENAME COLUMN y TO w; ALTER TABLE t RENAME TO u; CREATE TABLE gone (a int); DROP TABLE gone; INSERT INTO u VALUES ('a;b');"),
    ]
    df = spark.createDataFrame(rows[::-1], "namespace string, path string, text string")
    got = {(r.kind, r.name): r.shape for r in extract.replay_migrations(df).collect()}
    assert got == {("table", "u"): "", ("column", "u.id"): "int4|not null", ("column", "u.name"): "text|not null", ("column", "u.w"): "text|null", ("enum", "mood"): "a,b;c,z"}
    assert extract.split_statements("a; $$ x;y $$; 'q;''r' /* ; */ ; --;\n") == ["a", "$$ x;y $$", "'q;''r'"]


def test_queue_claims_and_breaker(spark):
    a = spark.createDataFrame([(1, i, f) for i, f in enumerate([True, True, False, True, True, True])], "k long, n long, failed boolean")
    assert [r.open for r in queues.breaker(a, ["k"], ["n"], 3).orderBy("n").collect()] == [False] * 5 + [True]
    r = queues.revoke(spark.createDataFrame([(1, "a"), (2, "b")], "id long, revision string"), spark.createDataFrame([("a",)], "revision string"))
    assert {x.id: x.revoked for x in r.collect()} == {1: True, 2: False}


def test_streamed_dedupe_equals_batch(spark, tmp_path):
    rows = [(i % 5, dt.datetime(2024, 1, 1, 0, i), i) for i in range(20)]
    df = spark.createDataFrame(rows, "k long, at timestamp, id long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = inbox.dedupe_stream(inbox.stream_table(spark, str(tmp_path / "in"), df.schema), ["k"], "at", "2 hours")
    q = out.writeStream.format("memory").queryName("inbox_out").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {r.k for r in spark.table("inbox_out").collect()} == set(range(5)) and spark.table("inbox_out").count() == 5


def test_a_lease_expires_without_another_action(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    schema = "job string, action string, at timestamp"
    batches = [[("j", "claim", at(5)), ("j", "claim", at(1)), ("k", "claim", at(2)), ("k", "complete", at(3))], [("other", "claim", at(50))], [("other", "complete", at(59))]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = inbox.lease_states(stream, lease_ms=10_000, maximum_attempts=1).writeStream.format("memory").queryName("leases").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = {(r.job, r.at_ms // 1000 % 60, r.state, r.attempt) for r in spark.table("leases").collect()}
    # The claim at 1 leases, the one at 5 finds it leased, and at 11 the lease ends though nothing comes for it.
    assert {("j", 1, "leased", 1), ("j", 5, "leased", 1), ("j", 11, "failed", 1), ("k", 3, "completed", 1)} <= got


def test_budgets_and_breakers_fold_in_order(spark):
    log = spark.createDataFrame([(1, "index", i, k, "artifacts", n) for i, (k, n) in enumerate([("reserve", 6), ("reserve", 5), ("release", 2), ("reserve", 5)])], "run_id long, lane string, step long, kind string, dimension string, amount long")
    limits = spark.createDataFrame([("index", "artifacts", 10)], "lane string, dimension string, limit long")
    r = queues.settle_budgets(log, limits).first()
    assert (r.used, r.exhausted) == (9, True)
    tries = [(0, "provider_failure"), (1, "provider_failure"), (2, "ok"), (12, "provider_failure"), (13, "provider_failure"), (14, "ok"), (25, "other"), (26, "provider_failure"), (30, "ok")]
    a = spark.createDataFrame([(1, at, out) for at, out in tries], "k long, at_ms long, outcome string")
    got = [r.result for r in queues.breaker_with_cooldown(a, ["k"], ["at_ms"], 2, 10).orderBy("at_ms").collect()]
    assert got == ["tried", "opened", "circuit_open", "opened", "circuit_open", "circuit_open", "tried", "opened", "circuit_open"]
    q = spark.createDataFrame([(1, i, 3) for i in range(0, 300_000, 50_000)], "lane long, n long, amount long")
    run = queues.running_budget(q, ["lane"], ["n"], "amount", 10).orderBy("n").collect()
    assert [r.used for r in run] == [3, 6, 9, 12, 15, 18] and [r.exhausts for r in run] == [False, False, False, True, False, False]


def test_dimensions_of_coverage(spark):
    files_ = spark.createDataFrame([("g", "source", "parsed", "python"), ("g", "source", "failed", "sql"), ("g", "vendored", "skipped", "unknown"), ("h", "source", "parsed", "sql")], "generation_id string, classification string, parse_state string, language string")
    trees = spark.createDataFrame([("g", False), ("h", True), ("empty", True)], "generation_id string, complete boolean")
    got = {(r.generation_id, r.dimension): (r.state, r.eligible, r.processed, r.skipped, r.failed) for r in artifacts.dimension_coverage(files_, trees).collect()}
    assert got["g", "file"] == ("partial", 3, 2, 1, 1) and got["g", "language"] == ("partial", 3, 2, 1, 0) and got["g", "tree"] == ("partial", 3, 3, 0, 1)
    assert got["h", "parser"] == ("complete", 1, 1, 0, 0) and got["h", "adapter"] == ("not_analysed", 0, 0, 0, 0) and got["empty", "file"] == ("complete", 0, 0, 0, 0)


def test_llm_is_not_needed():
    """Nothing but the entry point names the optional subpackage."""
    from pathlib import Path

    root = Path(tables.__file__).parents[1]
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert not re.search(r"\bllm\b", f.read_text()), f


def test_entry_point_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(tables.__file__).parents[2]
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_versions_of_a_service_overlap(spark):
    d = dt.date
    rows = [("a", d(2000, 1, 1), d(2001, 1, 1)), ("a", d(2001, 1, 1), None), ("b", d(2000, 1, 1), None), ("b", d(2005, 1, 1), d(2006, 1, 1)), ("c", d(2000, 1, 1), d(2010, 1, 1)), ("c", d(2001, 1, 1), d(2002, 1, 1)), ("c", d(2003, 1, 1), d(2004, 1, 1)), ("d", d(2000, 1, 1), d(2000, 1, 1))]
    services = spark.createDataFrame(rows, "id string, valid_from date, valid_until date")
    assert {tuple(r) for r in registry.overlapping_services(services).collect()} == {("b", d(2005, 1, 1)), ("c", d(2001, 1, 1)), ("c", d(2003, 1, 1))}
    assert [r.id for r in registry.empty_intervals(services).collect()] == ["d"]


def test_breakers_fold_over_ranges(spark):
    """Against a plain fold: providers over many ranges, ranges over many providers, pauses that reach over a range."""
    r = np.random.default_rng(4)
    kinds = ["provider_failure", "ok", "other"]
    rows = [(k, i, int(10 * i + r.integers(-40, 40)), kinds[r.choice(3, p=(0.6, 0.2, 0.2))]) for k, size in ((0, 600), (1, 3), (2, 1), (3, 400), (None, 50)) for i in range(size)]
    rows += [(9, i, 10 * i, "provider_failure") for i in range(300)]  # no success: phases never agree of themselves
    df = spark.createDataFrame(rows, "k int, i long, at_ms long, outcome string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(x.k, x.i): x.result for x in queues.breaker_with_cooldown(df, ["k"], ["i"], 3, 230).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, state = {}, {}
    for k, i, at, outcome in rows:
        n, until = state.get(k, (0, 0))
        if at < until:
            want[k, i] = "circuit_open"
            continue
        n = n + 1 if outcome == "provider_failure" else 0 if outcome == "ok" else n
        trips = outcome == "provider_failure" and n >= 3
        state[k] = (n, at + 230 if trips else 0 if outcome == "ok" else until)
        want[k, i] = "opened" if trips else "tried"
    assert got == want


def test_a_breaker_is_no_array(spark):
    """A provider's attempts are never gathered in one row."""
    a = spark.range(50).select(F.lit("a").alias("k"), F.col("id").alias("at_ms"), F.lit("ok").alias("outcome"))
    plan = queues.breaker_with_cooldown(a, ["k"], ["at_ms"], 2, 10)._jdf.queryExecution().toString()
    assert "collect_list" not in plan
