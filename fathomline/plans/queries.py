"""The registered queries: each operator applied to the bound tables, whole."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import canonical, identity, stats
from ..operators import artifacts, contracts, delivery, evaluation, governance, graph, incremental, queues, readers, reasoning, registry, renames, resample, snapshots
from ..sources import extract, records
from ..sources.tables import latest_by_key, materialise, relation, shared_dir, table
from . import adapters, analyze, more_sql, protocol2, stores
from .oracle import SQL

C = F.col


def _at():
    return analyze.at()


def _text(column):
    return C(column).cast("string")


def flagship(spark, sf_dir):
    """Findings by consumer state, change and action."""
    return analyze.findings(spark, sf_dir).groupBy("change_kind", "compatibility", "consumer_state", "state", "action", "basis").agg(F.count("*").alias("findings"), F.countDistinct("consumer").alias("consumers"))


def contract_diff(spark, sf_dir):
    return analyze.changes(spark, sf_dir)


def changed_contract_join(spark, sf_dir):
    return analyze.joined(spark, sf_dir)[0].select("canonical_key", "consumer", "reference_id", "basis", "change_kind", "compatibility")


def join_diagnostics(spark, sf_dir):
    return analyze.joined(spark, sf_dir)[1].groupBy("diagnostic").agg(F.sum("times").alias("n"), F.count("*").alias("references"))


def edge_ids(spark, sf_dir):
    return analyze.joined(spark, sf_dir)[0].select("edge_id", "stratum_key")


def first_definitions(spark, sf_dir):
    return contracts.changed_definitions(analyze.changes(spark, sf_dir), relation(spark, sf_dir, "definitions")).select("canonical_key", "producer", "change_kind", "service", "producer_generation")


def selected_references(spark, sf_dir):
    return analyze.references(spark, sf_dir).select("reference_id", "consumer", "generation_id")


def edge_dedupe(spark, sf_dir):
    uses = relation(spark, sf_dir, "uses")
    edge = lambda basis, edge_id: F.struct(basis.alias("basis"), edge_id.alias("edge_id"))
    first = edge(F.when(C("context_basis").isNull(), "exact").otherwise("heuristic"), C("reference_id"))
    both = F.explode(F.array(first, edge(F.lit("exact"), F.concat(F.lit("z"), "reference_id"))))
    twice = uses.select("canonical_key", "consumer", both.alias("e")).select("canonical_key", "consumer", C("canonical_key").alias("reference_id"), "e.basis", "e.edge_id")
    return contracts.dedupe_edges(twice).select("canonical_key", "consumer", "basis", "edge_id")


def alias_resolve(spark, sf_dir):
    return analyze.resolved(spark, sf_dir, relation(spark, sf_dir, "refs")).groupBy("state", "service", "rewritten_path").agg(F.count("*").alias("n"))


def alias_overlap(spark, sf_dir):
    return registry.overlapping_aliases(relation(spark, sf_dir, "aliases"))


def service_overlaps(spark, sf_dir):
    """Services with a second version each, some of which begin before the first has ended."""
    s = relation(spark, sf_dir, "services").select("id", "valid_from", "valid_until")
    start = F.date_add("valid_from", (C("id") % 11 * 250).cast("int"))
    later = s.select("id", start.alias("valid_from"), F.when(C("id") % 3 == 0, F.date_add(start, 400)).alias("valid_until"))
    first = s.withColumn("valid_until", F.coalesce("valid_until", F.date_add("valid_from", 1000)))
    return registry.overlapping_services(first.unionByName(later)).select("id", C("valid_from").cast("string").alias("valid_from"))


def fk_violations(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    checks = [("lineitem_order", "lineitem", "orders", "l_orderkey", "o_orderkey"), ("order_customer", "orders", "customer", "o_custkey", "c_custkey"), ("label_document", "labels", "documents", "doc_id", "doc_id")]
    out = None
    for name, child, parent, a, b in checks:
        one = registry.dangling(t(child).select(C(a).alias("_a")), t(parent).select(C(b).alias("_b")), [("_a", "_b")], name)
        out = one if out is None else out.unionByName(one)
    return out


def consumer_selection(spark, sf_dir):
    return analyze.states(spark, sf_dir)


def generation_selection(spark, sf_dir):
    return contracts.select_generations(relation(spark, sf_dir, "generations")).select("repository", "generation_id", "state")


def findings(spark, sf_dir):
    return analyze.findings(spark, sf_dir).select("fingerprint", "canonical_key", "consumer", "basis", "change_kind", "state", "reason", "action")


def analysis_completeness(spark, sf_dir):
    states = analyze.states(spark, sf_dir)
    edges, problems = analyze.joined(spark, sf_dir, states)
    return contracts.completeness(contracts.findings(edges, states, analyze.WORKSPACE), problems, states)


def abstentions(spark, sf_dir):
    return _abstentions(spark, sf_dir, analyze.states(spark, sf_dir))


def _abstentions(spark, sf_dir, states):
    found = contracts.findings(analyze.joined(spark, sf_dir, states)[0], states, analyze.WORKSPACE).where("state = 'ABSTAINED'").select("consumer", "reason")
    reason = contracts.abstention_reason(C("consumer_state"))
    return contracts.abstentions(found, states.select(C("repository").alias("consumer"), reason.alias("reason")).where("reason is not null"))


def ambiguous_defs(spark, sf_dir):
    base = relation(spark, sf_dir, "definitions_base").unionByName(relation(spark, sf_dir, "definitions_head"))
    return contracts.drop_ambiguous(base, ["contract_kind", "canonical_key"])


def reconcile(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    early, late = C("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz"), C("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")
    side = lambda when, n: o.where(when).groupBy(C("o_custkey").alias("repository")).agg(
        (C("o_custkey") % n != 0).alias("selected"), F.max("o_orderkey").cast("string").alias("head"),
        F.map_from_entries(F.collect_set(F.when(C("o_orderkey") % 4 == 0, F.struct(C("o_orderkey").alias("k"), (C("o_orderkey") % 3 + F.when(C("o_orderkey") % 8 == 0, n).otherwise(0)).cast("string").alias("v"))))).alias("pulls"),
    )
    return contracts.reconcile(side(early, 5), side(late, 7))


def coverage_compose(spark, sf_dir):
    families = table(spark, sf_dir, "region").select(C("r_name").alias("family"))
    stored = table(spark, sf_dir, "orders").groupBy(C("o_custkey").alias("repository")).agg(F.max("o_orderkey").alias("generation_id")).join(families)
    stored = stored.where((C("repository") + F.length("family")) % 3 != 0).withColumn("state", F.when(C("repository") % 2 == 0, "complete").otherwise("partial"))
    return contracts.compose_coverage(analyze.states(spark, sf_dir), families, stored)


def touched_keys(spark, sf_dir):
    return contracts.touched_keys(analyze.changes(spark, sf_dir), relation(spark, sf_dir, "aliases").where("service % 3 = 0").select(F.concat_ws(":", "kind", "value").alias("key")))


def exact_references(spark, sf_dir):
    refs = analyze.references(spark, sf_dir).select("contract_kind", "canonical_key", "consumer", "reference_id").where("canonical_key is not null")
    own = relation(spark, sf_dir, "definitions").where(f"producer = {analyze.PRODUCER} and position = 0").select("contract_kind", "canonical_key", F.lit(analyze.PRODUCER).cast("long").alias("consumer"), F.concat(F.lit("own-"), "canonical_key").alias("reference_id"))
    return contracts.exact_references(refs, own, analyze.changes(spark, sf_dir)).select("canonical_key", "consumer", "reference_id")


def finding_dependencies(spark, sf_dir):
    named = analyze.changes(spark, sf_dir).withColumn("coverage_dependencies", F.array(F.concat(F.lit("head."), "contract_kind"), F.concat(F.lit("base."), "contract_kind"), F.lit("base.all")))
    found = contracts.dependencies_of(analyze.findings(spark, sf_dir), named.unionByName(named))
    return found.select("fingerprint", F.concat_ws(",", "dependencies").alias("dependencies"))


def protocol_mismatches(spark, sf_dir):
    changes = analyze.changes(spark, sf_dir).withColumn("protocol", F.lit(2))
    definitions = relation(spark, sf_dir, "definitions").withColumn("protocol", F.when(C("service") == 3, 1).otherwise(2))
    refs = relation(spark, sf_dir, "refs").where("canonical_key is not null").withColumn("protocol", F.when(C("consumer") % 7 == 0, 1).otherwise(2))
    return contracts.protocol_mismatches(changes, definitions, refs)


def described_compatibility(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    differ = F.element_at(F.array(*map(F.lit, ["breaking", "compatible", "tool_failure"])), (C("p_partkey") % 3 + 1).cast("int"))
    verdict = contracts.described_compatibility(C("p_size") % 2 == 0, differ, C("p_partkey") % 5 == 0, C("p_partkey") % 7 != 0)
    return part.select("p_partkey", verdict.alias("compatibility"))


def read_definitions(spark, sf_dir):
    keys = table(spark, sf_dir, "lineitem").where("l_linenumber = 7").select(F.concat(F.lit("part:"), C("l_partkey").cast("string")).alias("canonical_key"))
    return readers.read_definitions(relation(spark, sf_dir, "definitions"), keys, kind=F.lit("ECONOMY")).select("canonical_key", "producer", "generation_id")


def read_references(spark, sf_dir):
    keys = table(spark, sf_dir, "part").where("p_size < 10").select(F.concat(F.lit("part:"), C("p_partkey").cast("string")).alias("canonical_key"))
    return readers.read_references(relation(spark, sf_dir, "refs"), keys).select("reference_id", "consumer")


def exactness_checks(spark, sf_dir):
    definitions = relation(spark, sf_dir, "definitions_head").select("producer", (C("producer") + 1).alias("generation_id"))
    return readers.exactness_violations(relation(spark, sf_dir, "observations"), definitions, relation(spark, sf_dir, "refs"), analyze.changes(spark, sf_dir))


def find_findings(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    found = orders.select(C("o_orderkey").alias("analysis_id"), (C("o_custkey") % 97).cast("string").alias("fingerprint"))
    analyses = orders.select(C("o_orderkey").alias("analysis_id"), (C("o_orderstatus") == "F").alias("is_current"), C("o_orderdate").alias("completed_at"))
    return readers.find_findings(found, analyses, table(spark, sf_dir, "nation").select(C("n_nationkey").cast("string").alias("fingerprint")))


def module_resolve(spark, sf_dir):
    imports = table(spark, sf_dir, "part").select(C("p_partkey").alias("import_id"), F.concat(F.lit("src/f"), C("p_partkey").cast("string")).alias("target"))
    return contracts.resolve_modules(imports, relation(spark, sf_dir, "artifacts"), [".ts", ".py", ".md", "/index.ts"])


def path_aliases(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    imports = part.select(C("p_partkey").alias("import_id"), F.concat(F.lit("pkg/p"), (C("p_partkey") % 7).cast("string"), F.lit("/src")).alias("folder"), F.concat(F.lit("@/f"), C("p_partkey").cast("string")).alias("specifier"))
    configs = table(spark, sf_dir, "region").select(F.concat(F.lit("pkg/p"), C("r_regionkey").cast("string")).alias("folder"), F.lit("@/").alias("prefix"), F.lit("src/").alias("target"))
    configs = configs.unionByName(spark.range(1).select(F.lit("").alias("folder"), F.lit("@/").alias("prefix"), F.lit("src/vendor/").alias("target")))
    return contracts.resolve_path_aliases(imports, configs, relation(spark, sf_dir, "artifacts"), [".ts", ".py", ".md"])


def tree_compare(spark, sf_dir):
    from ..sources.tables import tree_compare as compare

    tree = relation(spark, sf_dir, "artifacts").select("path", F.sha2("text", 256).alias("content_hash"), "blob", "entry_kind", (C("blob") % 5 == 0).alias("binary"))
    head = tree.where("blob % 8 <> 0").withColumn("path", F.when(C("blob") % 10 == 0, F.concat(F.lit("moved/"), "path")).otherwise(C("path")))
    head = head.withColumn("entry_kind", F.when(C("blob") % 31 == 0, "file").otherwise(C("entry_kind")))
    copies = tree.where("blob % 7 = 1 and blob % 8 <> 0 and blob % 9 <> 0").withColumn("path", F.concat(F.lit("copy/"), "path"))
    return compare(tree.where("blob % 9 <> 0"), head.unionByName(copies))


def _edges(spark, sf_dir):
    uses = relation(spark, sf_dir, "uses")
    return uses.select(
        C("reference_id").alias("edge_id"), "reference_id", "consumer", (F.substring("canonical_key", 6, 20).cast("long") % 1500).alias("producer"), "first_observed", "last_observed",
        C("canonical_key").alias("payload"), F.when(C("generation_id") % 9 == 0, C("last_observed")).alias("invalidated_at"),
    )


def current_edges(spark, sf_dir):
    return graph.current_edges(_edges(spark, sf_dir), _at(), analyze.TTL_DAYS).select("edge_id", "consumer")


def edge_upsert(spark, sf_dir):
    e = _edges(spark, sf_dir)
    day = F.expr("INTERVAL 10 DAYS")
    seen = e.where("consumer % 3 = 0").withColumns({"payload": F.concat(F.lit("new:"), "payload"), "last_observed": C("last_observed") + day, "invalidated_at": F.lit(None).cast("timestamp_ntz")})
    out = graph.upsert_edges(e.drop("reference_id", "consumer", "producer"), seen.drop("reference_id", "consumer", "producer"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    return out.select("edge_id", text("first_observed").alias("first_observed"), text("last_observed").alias("last_observed"), "payload", text("invalidated_at").alias("invalidated_at"))


def edge_invalidation(spark, sf_dir):
    e = _edges(spark, sf_dir).withColumn("invalidated_at", F.date_format("invalidated_at", "yyyy-MM-dd"))
    complete = contracts.select_generations(relation(spark, sf_dir, "generations")).where("state = 'complete'").select(C("repository").alias("consumer"))
    seen = e.where("producer % 5 <> 0").select("reference_id")
    return graph.invalidate_unobserved(e, seen, complete, F.lit(analyze.AS_OF)).select("edge_id", "invalidated_at")


def revision_invalidation(spark, sf_dir):
    e = _edges(spark, sf_dir).select("edge_id", "producer", "consumer", F.when(C("producer") % 2 == 0, "registry_resolved").otherwise("exact").alias("basis"), (C("producer") % 3).alias("revision"))
    selected = table(spark, sf_dir, "customer").where("c_custkey % 10 <> 0").select(C("c_custkey").alias("repository"))
    return graph.invalidate_on_revision(e, selected, F.lit(1)).groupBy("reason").agg(F.count("*").alias("n"))


def service_graph(spark, sf_dir):
    return graph.service_edges(_edges(spark, sf_dir)).select("producer", "consumer", "evidence")


def transitive(spark, sf_dir):
    e = graph.service_edges(_edges(spark, sf_dir).where("producer <> consumer"))
    e = e.select(F.concat_ws("-", F.lpad(C("producer").cast("string"), 12, "0"), F.lpad(C("consumer").cast("string"), 12, "0")).alias("edge_id"), "producer", "consumer")
    found = graph.bounded_paths(e, table(spark, sf_dir, "supplier").select(C("s_suppkey").alias("start")))
    return found.select("start", "consumer", "depth", F.concat_ws(",", "via").alias("via"))


def invalidation_closure(spark, sf_dir):
    e = graph.service_edges(_edges(spark, sf_dir)).select(C("consumer").alias("node"), C("producer").alias("depends_on"))
    return graph.closure(table(spark, sf_dir, "nation").select(C("n_nationkey").cast("long").alias("node")), e)


def overlay_materialize(spark, sf_dir):
    a = relation(spark, sf_dir, "artifacts").select("path", F.sha2("text", 256).alias("payload"), "blob")
    entries = a.where("blob % 6 in (0, 1)").select("path", F.concat(F.lit("new:"), "payload").alias("payload"), F.when(C("blob") % 6 == 0, "tombstone").otherwise("replacement").alias("kind"))
    return graph.overlay(a, entries)


def ancestry(spark, sf_dir):
    a = relation(spark, sf_dir, "artifacts").select(F.concat(F.lit("p"), (C("blob") % 300).cast("string")).alias("path"), (C("blob") % 997).alias("depth"), F.when(C("blob") % 5 == 0, "tombstone").otherwise("replacement").alias("kind"), C("blob").cast("string").alias("payload"))
    top = a.groupBy("path", "depth").agg(F.min(F.struct("payload", "kind")).alias("x")).select("path", "depth", "x.kind", "x.payload")
    return graph.resolve_layers(top)


def artifact_reuse(spark, sf_dir):
    a = relation(spark, sf_dir, "artifacts").select("path", "blob", F.lit("p1").alias("parser"), F.when(C("blob") % 4 == 0, "c2").otherwise("c1").alias("config"))
    return graph.reuse(a, a.withColumns({"config": F.lit("c1"), "generation": F.lit("g0")})).groupBy("step").agg(F.count("*").alias("n"))


def artifact_classify(spark, sf_dir):
    return artifacts.classify(relation(spark, sf_dir, "artifacts"), artifacts.MAXIMUM).select("path", "classification", "language", "line_count", "content_hash")


def coverage_rollup(spark, sf_dir):
    return artifacts.coverage(artifacts.classify(relation(spark, sf_dir, "artifacts"), artifacts.MAXIMUM), ["repository"])


def extraction_state(spark, sf_dir):
    return artifacts.extraction_state(relation(spark, sf_dir, "generations"), ["repository"])


def _parsed(spark, sf_dir):
    files = artifacts.classify(relation(spark, sf_dir, "artifacts"), artifacts.MAXIMUM)
    state = F.when(C("classification") != "source", "skipped").when(C("blob") % 37 == 0, "failed").otherwise("parsed")
    return files.withColumns({"generation_id": C("repository"), "parse_state": state})


def dimension_coverage(spark, sf_dir):
    files = _parsed(spark, sf_dir)
    return artifacts.dimension_coverage(files, files.select("generation_id").distinct().withColumn("complete", F.length("generation_id") % 2 == 0))


def overlay_coverage(spark, sf_dir):
    files = _parsed(spark, sf_dir).where("blob % 3 = 0")
    return artifacts.dimension_coverage(files, files.select("generation_id").distinct().withColumn("complete", F.lit(True)))


def observation_states(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(C("o_custkey").alias("generation_id"), F.element_at(F.array(*map(F.lit, ["complete", "failed", "unsupported"])), (C("o_orderkey") % 3 + 1).cast("int")).alias("state"), F.when(C("o_custkey") % 4 == 0, 0).otherwise(C("o_orderkey") % 2).alias("items"))
    return artifacts.observation_state(rows.where("o_custkey % 4 > 0 or state <> 'complete'".replace("o_custkey", "generation_id")), ["generation_id"])


def limitation_dedupe(spark, sf_dir):
    return artifacts.limitations(table(spark, sf_dir, "events").select(C("event_type").alias("code"), (C("user_id") % 5).alias("scope")))


def _cases(spark, sf_dir):
    return relation(spark, sf_dir, "cases")


def metric_set(spark, sf_dir):
    return evaluation.metric_set(_cases(spark, sf_dir))


def wilson(spark, sf_dir):
    by = _cases(spark, sf_dir).groupBy("team").agg(F.count_if("suppressed").alias("k"), F.count("*").alias("n"))
    low, high = stats.wilson(C("k"), C("n"), stats.Z_TWO)
    return by.select("team", "k", "n", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


def clopper_pearson(spark, sf_dir):
    by = _cases(spark, sf_dir).groupBy("team").agg(F.count_if(~C("suppressed")).alias("k"), F.count("*").alias("n"))
    return by.select("team", "k", "n", F.round(stats.clopper_pearson_lower("k", "n"), 9).alias("low"))


def pr_level_metrics(spark, sf_dir):
    return evaluation.pull_request_metrics(_cases(spark, sf_dir))


def latency_quantiles(spark, sf_dir):
    return evaluation.latency_quantiles(_cases(spark, sf_dir))


def grouped_metrics(spark, sf_dir):
    return evaluation.grouped_metrics(_cases(spark, sf_dir), ["stratum", "contract_kind", "language_pair", "organization", "month"])


def risk_coverage(spark, sf_dir):
    return evaluation.risk_coverage(_cases(spark, sf_dir))


def team_burden(spark, sf_dir):
    return evaluation.team_burden(_cases(spark, sf_dir))


def distinct_counts(spark, sf_dir):
    return evaluation.distinct_counts(_cases(spark, sf_dir))


def usefulness(spark, sf_dir):
    return evaluation.usefulness(_cases(spark, sf_dir))


def _pairs(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(F.lit("edge").alias("axis"), C("quality").alias("a"), (1 - C("toxic")).alias("b"))


def agreement(spark, sf_dir):
    return evaluation.agreement(_pairs(spark, sf_dir))


def confusion(spark, sf_dir):
    return evaluation.confusion(_pairs(spark, sf_dir))


def cluster_bootstrap(spark, sf_dir):
    out = resample.cluster_bootstrap(_cases(spark, sf_dir))
    return out.select(*(F.round(c, 12).alias(c) if c in ("estimate", "lower95", "upper95") else c for c in out.columns))


def agreement_intervals(spark, sf_dir):
    pairs = table(spark, sf_dir, "labels").select(F.lit("edge").alias("axis"), C("quality").alias("a"), (1 - C("toxic")).alias("b"), C("doc_id").alias("position"))
    return resample.agreement_intervals(pairs).select("axis", F.round("lower95", 12).alias("lower95"), F.round("upper95", 12).alias("upper95"))


def review_chain(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(C("conv_id").alias("subject"), C("turn").alias("sequence"), F.concat_ws("-", C("conv_id").cast("string"), C("turn").cast("string")).alias("event_id"))
    claimed = F.when(C("sequence") > 0, F.concat_ws("-", C("subject").cast("string"), (C("sequence") - F.when(C("subject") % 5 == 0, 2).otherwise(1)).cast("string")))
    return evaluation.review_chain(turns.withColumn("supersedes", claimed)).select("event_id", "valid")


def _rules(spark, sf_dir):
    events = table(spark, sf_dir, "events").where("event_type in ('error', 'view')").select(
        C("user_id").alias("rule_id"), F.when(C("event_type") == "error", "revoked").otherwise("renewed").alias("state"), F.lit(None).cast("date").alias("next_review_at"),
        F.when(C("event_id") % 2 == 0, F.lit("2001-01-01").cast("date")).alias("next_expires_at"), C("ts").alias("at"), "event_id",
    )
    return governance.suppression_states(relation(spark, sf_dir, "rules"), events, relation(spark, sf_dir, "rule_predicates"), relation(spark, sf_dir, "rule_versions"), _at())


def suppression_state(spark, sf_dir):
    return _rules(spark, sf_dir).select("rule_id", "state", "reason", F.concat_ws(",", "reasons").alias("reasons"))


def suppression_audit(spark, sf_dir):
    found = governance.audit_suppressions(_rules(spark, sf_dir))
    return found.withColumns({"broad_rules": F.size("broad_rules").cast("long"), "anomalies": F.concat_ws(",", "anomalies")})


def suppression_match(spark, sf_dir):
    rows = relation(spark, sf_dir, "candidates").withColumn("adapter_rule_ids", F.array_distinct(F.array("rule_one", "rule_two")))
    return governance.match_suppressions(rows, _rules(spark, sf_dir)).groupBy("rule_id", "suppressed").agg(F.count("*").alias("n"))


def scope_prepare(spark, sf_dir):
    members = table(spark, sf_dir, "customer").select(C("c_custkey").alias("repository"), (C("c_nationkey") % 4 != 0).alias("selected"))
    allow = table(spark, sf_dir, "orders").select(C("o_custkey").alias("repository")).unionByName(table(spark, sf_dir, "nation").select((C("n_nationkey") + 10_000_000).cast("long").alias("repository")))
    consents = table(spark, sf_dir, "orders").select(C("o_custkey").alias("repository"), F.when(C("o_orderkey") % 37 == 0, "deny").otherwise("allow").alias("decision"))
    return governance.prepare_scope(members, allow, consents, 5)


def authorization(spark, sf_dir):
    decisions = table(spark, sf_dir, "orders").select(C("o_custkey").alias("repository"), F.when(C("o_orderkey") % 5 == 0, "deny").otherwise("allow").alias("decision"), (C("o_orderkey") % 2).alias("revision"), C("o_orderkey").alias("position"))
    return governance.authorize(scope_prepare(spark, sf_dir), decisions, 1)


def provider_authorization(spark, sf_dir):
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    actions = F.array(*map(F.lit, ["evidence.consume", "producer_check.write", "consumer.write"]))
    requests = customer.select(C("c_custkey").alias("repository"), F.when(C("c_custkey") % 2 == 0, "app").otherwise("user").alias("subject"), F.explode(actions).alias("action"))
    members = customer.where("c_custkey % 11 <> 0").select(C("c_custkey").alias("repository"), (C("c_nationkey") % 4 != 0).alias("selected"))
    consents = orders.select(C("o_custkey").alias("repository"), F.element_at(actions, (C("o_orderkey") % 3 + 1).cast("int")).alias("action"), F.when(C("o_orderkey") % 2 == 0, "*").otherwise("user").alias("grantee"), F.when(C("o_orderkey") % 5 == 0, "deny").otherwise("allow").alias("decision"), C("o_orderkey").alias("position"))
    grants = customer.select(C("c_custkey").alias("repository"), (C("c_custkey") % 9 != 0).alias("app_can_read"), (C("c_custkey") % 3 == 0).alias("app_can_write_checks"))
    return delivery.provider_authorization(requests, members, consents, grants)


def disclosure(spark, sf_dir):
    facts = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (C("l_partkey") % 5 != 0).alias("explicit_grant"), (C("l_suppkey") % 4 != 0).alias("app_can_read"), (C("l_partkey") % 3 != 0).alias("whole_audience_can_read"), (C("l_partkey") % 2 != 0).alias("viewer_can_read"),
        F.when(C("l_orderkey") % 2 == 0, "static").otherwise("personalized").alias("audience"),
    )
    return delivery.disclose(facts, C("audience")).groupBy("audience", "allowed", "omitted").agg(F.count("*").alias("n"))


def _promotions(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    history = orders.select((C("o_custkey") % 60).cast("string").alias("stratum_key"), C("o_orderkey").alias("decided_at"), F.when(C("o_orderkey") % 3 == 0, "PREVIEW").otherwise("PROMOTED").alias("state"), F.concat(F.lit("v"), (C("o_orderkey") % 2).cast("string")).alias("versions"))
    current = table(spark, sf_dir, "customer").groupBy((C("c_custkey") % 60).cast("string").alias("stratum_key")).agg(F.lit("v1").alias("versions"))
    return delivery.promoted_strata(history, current, table(spark, sf_dir, "customer").select((C("c_custkey") % 70).cast("string").alias("stratum_key")))


def promoted_strata(spark, sf_dir):
    return _promotions(spark, sf_dir)


def delivered_findings(spark, sf_dir):
    found = table(spark, sf_dir, "lineitem").groupBy(F.concat_ws("-", _text("l_orderkey"), _text("l_linenumber")).alias("fingerprint")).agg(F.min(C("l_partkey") % 60).cast("string").alias("stratum_key"), F.min(F.when(C("l_returnflag") == "A", "ABSTAINED").otherwise("PREVIEW")).alias("state"), F.bool_or(C("l_suppkey") % 6 == 0).alias("suppressed"))
    told = table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0").select(F.concat_ws("-", _text("o_orderkey"), F.lit("1")).alias("fingerprint"))
    return delivery.delivered(found, _promotions(spark, sf_dir), told).select("fingerprint", "stratum_key")


def check_annotations(spark, sf_dir):
    found = table(spark, sf_dir, "part").select(_text("p_partkey").alias("fingerprint"))
    lines = table(spark, sf_dir, "lineitem").select(
        _text("l_partkey").alias("fingerprint"), F.struct("l_orderkey", "l_linenumber", "l_suppkey").alias("position"), F.concat(F.lit("f"), _text("l_orderkey")).alias("path"), C("l_linenumber").alias("start_line"),
        (C("l_linenumber") + C("l_suppkey") % 3).cast("int").alias("end_line"), F.sequence(F.lit(2), (C("l_orderkey") % 9 + 2).cast("int")).alias("changed_lines"),
    )
    return delivery.annotations(found, lines)


def check_coverage(spark, sf_dir):
    states = analyze.states(spark, sf_dir)
    return delivery.check_coverage(states, _abstentions(spark, sf_dir, states))


def check_plans(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        C("o_orderkey").alias("analysis_id"), (C("o_orderkey") % 13 != 0).alias("in_scope"), (C("o_orderkey") % 7).alias("head"), F.when(C("o_orderkey") % 5 == 0, -1).otherwise(C("o_orderkey") % 7).alias("current_head"),
        (C("o_orderkey") % 17 != 0).alias("is_current"), (C("o_custkey") % 6 != 0).alias("write_authorized"), (C("o_custkey") % 19 == 0).alias("kill_switch"), (C("o_custkey") % 2 == 0).alias("advisory_enabled"),
        (C("o_custkey") % 4).alias("promoted"), (C("o_orderkey") % 50).alias("findings"), F.when(C("o_orderstatus") == "F", "complete").when(C("o_orderstatus") == "O", "partial").otherwise("not_analysed").alias("state"), (C("o_orderkey") % 23 == 0).alias("timed_out"),
    )
    return delivery.plan_checks(o)


def annotation_batches(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((C("l_partkey") % 20).alias("analysis_id"), F.concat_ws("-", _text("l_orderkey"), _text("l_linenumber"), _text("l_partkey"), _text("l_suppkey")).alias("fingerprint"), F.lit("p").alias("path"), C("l_linenumber").alias("start_line"), F.lit("m").alias("message"))
    return delivery.annotation_batches(rows).groupBy("analysis_id", "batch").agg(F.count("*").alias("n"))


STRATA, IMPACTS = ["en", "de", "fr"], ["breaking", "behavior_risk"]


def policy_arm(spark, sf_dir):
    cases = relation(spark, sf_dir, "all_cases")
    arms = {"baseline": governance.simulate_policy(cases, STRATA[:1], IMPACTS[:1]), "candidate": governance.simulate_policy(cases, STRATA, IMPACTS, respect_suppressions=False)}
    each = [governance.policy_arm(a, 500).withColumns({"arm": F.lit(n), "warnings": F.concat_ws(",", "warnings")}) for n, a in arms.items()]
    return each[0].unionByName(each[1])


def _evidence(spark, sf_dir):
    r = evaluation.metric_rules()
    cases = _cases(spark, sf_dir)
    count = lambda n, k: [F.count_if(r[n][0] & ~r[n][2]).alias(f"{k}_total"), F.count_if(r[n][0] & ~r[n][2] & r[n][1]).alias(f"{k}_successes")]
    return cases.groupBy("stratum").agg(
        *count("actionable_precision", "actionable"), *count("edge_precision", "edge"), *count("false_omission", "audit"), F.count_if(C("team") == 9).alias("confidentiality_defects"),
        F.count_if((C("team") == 1) & (C("detector_output") == "abstained")).alias("removal_defects"), F.round(F.count_if(C("policy_selected")) * 1000 / F.count("*"), 6).alias("alerted_per_thousand"),
        F.max("latency_ms").alias("p95_latency_ms"), F.count_if("suppressed").alias("deliveries_without_remedy"),
    )


def gate_failures(spark, sf_dir):
    return governance.gate_failures(_evidence(spark, sf_dir)).select("stratum", F.concat_ws(",", "failures").alias("failures"))


def promotion_fold(spark, sf_dir):
    history = relation(spark, sf_dir, "generations").select(
        C("repository").cast("string").alias("stratum"), C("generation_id").alias("sequence"), F.when(C("generation_id") % 11 == 0, "v2").otherwise("v1").alias("version"),
        F.when(C("state") == "complete", F.array().cast("array<string>")).otherwise(F.array(F.lit("x"))).alias("failures"), (C("generation_id") % 4 == 0).alias("compatible"),
    )
    return governance.fold_promotions(history).withColumn("reasons", F.concat_ws(",", "reasons"))


def population_sample(spark, sf_dir):
    return governance.sample_population(_cases(spark, sf_dir), 0.5, "seed").select("case_id", "inclusion_probability", "sampling_weight")


def corpus_manifest(spark, sf_dir):
    return governance.corpus_manifest(relation(spark, sf_dir, "all_cases"), 1_000)


def replay_labels(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    outcome = F.element_at(F.array(*map(F.lit, ["pass", "relevant_failure", "unrelated_failure", "timeout"])), (C("o_orderkey") % 4 + 1).cast("int"))
    return governance.replay_labels(o.select("o_orderkey", outcome.alias("outcome"), F.when(C("o_custkey") % 3 == 0, " ").otherwise("scope").alias("exercised_scope"))).select("o_orderkey", "label")


def adjudication(spark, sf_dir):
    long = table(spark, sf_dir, "labels").select(C("doc_id").alias("case_id"), F.explode(F.array((C("quality") == 1).cast("string"), (C("toxic") == 0).cast("string"))).alias("label"))
    third = table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(C("doc_id").alias("case_id"), F.lit("true").alias("label"))
    return governance.adjudicate(long, third)


def inbox_dedupe(spark, sf_dir):
    inbox = relation(spark, sf_dir, "queue").select("supersession_key", "delivery_hash", "available_at", "event_id")
    return queues.dedupe_inbox(inbox, ["supersession_key", "delivery_hash"], ["available_at", "event_id"]).select("supersession_key", "delivery_hash", "event_id", "deliveries")


def job_claim(spark, sf_dir):
    return queues.claim(relation(spark, sf_dir, "queue"), ["kind", "supersession_key"], F.lit("2024-01-20").cast("timestamp_ntz")).select("kind", "supersession_key", "event_id", "attempt")


def job_settle(spark, sf_dir):
    jobs = relation(spark, sf_dir, "queue").withColumn("lease_owner", C("event_id") % 3)
    outcomes = jobs.select("event_id", F.lit(1).cast("long").alias("reporter"), (C("event_id") % 5 == 0).alias("succeeded"))
    return queues.settle(jobs, outcomes).groupBy("after").agg(F.count("*").alias("n"))


def supersede(spark, sf_dir):
    return queues.supersede(relation(spark, sf_dir, "queue"), "supersession_key", ["available_at", "event_id"]).select("event_id", "after")


def _webhooks(spark, sf_dir):
    kinds = ["push", "pull_request", "check_run", "installation", "star"]
    return table(spark, sf_dir, "events").select(
        "event_id", F.element_at(F.array(*map(F.lit, kinds)), (C("event_id") % 5 + 1).cast("int")).alias("event_type"), F.when(C("user_id") % 2 == 0, "closed").otherwise("opened").alias("action"),
        F.concat(F.lit("github:"), _text("user_id")).alias("repository"), F.when(C("user_id") % 3 > 0, F.concat(F.lit("refs/heads/"), "event_type")).alias("ref"), (C("user_id") % 9 + 1).alias("pull_request"),
    )


def webhook_route(spark, sf_dir):
    return queues.route(_webhooks(spark, sf_dir), analyze.WORKSPACE)


SECRET = b"a shared secret"


def webhook_receive(spark, sf_dir):
    sha = lambda c: F.substring(F.sha2(c.cast("string"), 256), 1, 40)
    head = F.format_string('"installation":{"id":%d},"repository":{"id":%d}', C("user_id") + 1, C("event_id") + 1)
    push = F.format_string('{"before":"%s","after":"%s","ref":"refs/heads/main",%s}', sha(C("event_id")), F.when(C("event_id") % 7 == 0, "none").otherwise(sha(C("event_id") + 1)), head)
    pull = F.format_string('{"action":"%s","number":%d,"pull_request":{"base":{"sha":"%s"},"head":{"sha":"%s","repo":{"fork":%s}}},%s}', F.when(C("event_id") % 4 == 1, "opened").otherwise("labeled"), C("user_id") + 1, sha(C("user_id")), sha(C("event_id")), (C("user_id") % 2 == 0).cast("string"), head)
    kind = F.when(C("event_id") % 3 == 0, "push").when(C("event_id") % 3 == 1, "pull_request").otherwise("star")
    body = F.when(C("event_id") % 3 == 0, push).otherwise(pull).cast("binary")
    signed = F.concat(F.lit("sha256="), F.when(C("event_id") % 10 == 9, F.sha2(body, 256)).otherwise(canonical.hmac_sha256(SECRET, body)))
    taken, refused = records.receive(table(spark, sf_dir, "events").select(_text("event_id").alias("delivery_id"), kind.alias("event_type"), body.alias("body"), signed.alias("signature")), SECRET)
    out = taken.select("delivery_id", "event_type", F.lit(None).cast("string").alias("reason"), "repository", "pull_request", "after", "fork")
    return out.unionByName(refused, allowMissingColumns=True)


def budget_running(spark, sf_dir):
    q = table(spark, sf_dir, "events").select("user_id", "event_id", F.round(C("value") * 100).cast("long").alias("amount"))
    return queues.running_budget(q, ["user_id"], ["event_id"], "amount", 100_000)


def budget_settle(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    log = e.select(
        (C("user_id") % 40).alias("run_id"), F.when(C("user_id") % 2 == 0, "index").otherwise("reasoning").alias("lane"), C("event_id").alias("step"), F.when(C("event_type") == "signup", "release").otherwise("reserve").alias("kind"),
        F.element_at(F.array(*map(F.lit, queues.DIMENSIONS)), (C("event_id") % 6 + 1).cast("int")).alias("dimension"), F.round("value").cast("long").alias("amount"),
    )
    limits = spark.createDataFrame([(lane, d, 300 + 100 * i) for lane in ("index", "reasoning") for i, d in enumerate(queues.DIMENSIONS)], "lane string, dimension string, limit long")
    return queues.settle_budgets(log, limits)


def circuit_breaker(spark, sf_dir):
    a = table(spark, sf_dir, "events").select("user_id", "event_id", C("event_type").isin("error", "view").alias("failed"))
    return queues.breaker(a, ["user_id"], ["event_id"], 3).select("event_id", "streak", "open")


def breaker_cooldown(spark, sf_dir):
    outcome = F.when(C("event_type").isin("error", "view", "click"), "provider_failure").when(C("event_type") == "signup", "ok").otherwise("other")
    a = table(spark, sf_dir, "events").select((C("user_id") % 10).alias("provider"), "event_id", (C("event_id") * 10).alias("at_ms"), outcome.alias("outcome"))
    return queues.breaker_with_cooldown(a, ["provider"], ["event_id"], 3, 400).groupBy("provider", "result").agg(F.count("*").alias("n"))


def audit_append(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    held = e.where("event_id % 3 = 0").select("user_id", C("event_id").alias("sequence"))
    return queues.append_numbers(held, e.where("event_id % 3 = 1").select("user_id", "event_id"), "user_id", ["event_id"]).select("user_id", "event_id", "sequence")


def kill_switches(spark, sf_dir):
    jobs = relation(spark, sf_dir, "queue").select("event_id", C("kind").alias("lane"), "state")
    switches = spark.createDataFrame([("click", True), ("view", False), ("error", True)], "lane string, engaged boolean")
    return queues.kill_switch(jobs, switches).groupBy("lane", "state").agg(F.count("*").alias("n"))


def latest_pointer(spark, sf_dir):
    return latest_by_key(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


def stable_ids(spark, sf_dir):
    r = relation(spark, sf_dir, "refs")
    found = canonical.stable_reference_id(C("contract_kind"), C("canonical_key"), C("unresolved_pattern"), F.when(C("consumer") % 2 == 0, _text("consumer")), C("stratum"))
    return r.select("reference_id", found.alias("stable_id"))


def length_prefixed_hashes(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", canonical.hash_parts(C("p_name"), C("p_brand"), F.lit("")).alias("hash"))


def shape_hashes(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    shape = {"type": C("p_type"), "size": canonical.whole(C("p_size")), "names": [C("p_name"), C("p_brand")], "extra": {"none": None, "quoted": F.concat(F.lit('a "b" \\ '), "p_name")}}
    return p.select("p_partkey", canonical.hash_record(shape).alias("hash"))


def secret_references(spark, sf_dir):
    found = canonical.secret_reference(SECRET, F.lit("prod"), C("s_name"), _text("s_suppkey"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", found.alias("reference"))


def npm_specifiers(spark, sf_dir):
    forms = ["lodash", "lodash/fp//x/", "@scope/pkg", "@scope/pkg/sub", "./local", "node:fs", "/abs", "@scope", "", "a/./b"]
    t = table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, forms)), (C("p_partkey") % len(forms) + 1).cast("int")).alias("specifier"))
    found = identity.npm_specifier(C("specifier"))
    return t.select("p_partkey", "specifier", found["package"].alias("package"), found["subpath"].alias("subpath"))


def identifiers(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    value = F.when(C("o_orderkey") % 3 == 0, F.sha2(_text("o_orderkey"), 256)).when(C("o_orderkey") % 3 == 1, F.substring(F.sha2(_text("o_orderkey"), 256), 1, 40)).otherwise(F.substring(F.sha2(_text("o_orderkey"), 256), 1, 39))
    path = F.when(C("o_custkey") % 4 == 0, "/a").when(C("o_custkey") % 4 == 1, "a/../b").when(C("o_custkey") % 4 == 2, "a//b").otherwise(F.concat(F.lit("a/f"), _text("o_custkey")))
    return o.select("o_orderkey", identity.valid_identifier("commit", value).alias("commit"), identity.valid_repo_path(path).alias("path"))


def payload_compatibility(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    kinds = lambda n: F.map_from_arrays(F.transform(F.sequence(F.lit(0), n), lambda i: F.concat(F.lit("p"), i.cast("string"))), F.transform(F.sequence(F.lit(0), n), lambda i: F.concat(F.lit("h"), i.cast("string"))))
    names = lambda n: F.transform(F.sequence(F.lit(0), n), lambda i: i.cast("string"))
    schema = lambda t, props, req, vals: F.struct(t.alias("type"), kinds(props).alias("properties"), names(req).alias("required"), names(vals).alias("values"))
    n = lambda e: F.expr(e).cast("int")
    before = F.when(C("p_partkey") % 17 != 0, schema(F.lit("object"), n("p_partkey % 3"), n("p_partkey % 4"), n("p_partkey % 2")))
    after = schema(F.when(C("p_partkey") % 19 == 0, "array").otherwise("object"), n("p_size % 4"), n("p_size % 5"), n("p_size % 3"))
    return p.select("p_partkey", identity.payload_compatibility(before, after).alias("compatibility"))


def signature_compatibility(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    one = lambda n, h: F.struct(F.transform(F.sequence(F.lit(1), n), lambda i: F.struct((i > 2).alias("optional"), F.lit(False).alias("rest"))).alias("parameters"), h.alias("hash"))
    n = lambda e: F.expr(e).cast("int")
    before = F.when(C("p_partkey") % 13 != 0, F.array(one(n("1 + p_partkey % 2"), _text("p_size")), one(n("1"), F.lit("x"))))
    after = F.array(one(n("1 + p_partkey % 3"), F.when(C("p_partkey") % 3 == 0, _text("p_size")).otherwise("y")), one(n("1 + p_partkey % 4"), F.when(C("p_partkey") % 2 == 0, "x").otherwise("z")))
    return p.select("p_partkey", identity.signature_compatibility(before, after, C("p_partkey") % 5 == 0).alias("compatibility"))


def stratum_keys(spark, sf_dir):
    steps = F.array(C("team").cast("string"), C("month"), C("team").cast("string"))
    return _cases(spark, sf_dir).select("case_id", identity.stratum_key(C("stratum"), C("organization"), C("detector_output"), C("claim_impact"), steps).alias("key"))


def route_extract(spark, sf_dir):
    return extract.routes_of_urls(table(spark, sf_dir, "pages"))


def link_references(spark, sf_dir):
    return extract.links_of_pages(table(spark, sf_dir, "pages")).groupBy("route").agg(F.count("*").alias("n"))


TYPES = ["int2", "integer", "INT8", "numeric", "varchar(10)", "character varying(20)", "text", "varchar", "boolean"]


def type_widening(spark, sf_dir):
    """Every pair of types that parts could change between, with every pair of nullabilities."""
    pick = lambda e: F.element_at(F.array(*map(F.lit, TYPES)), (e % len(TYPES) + 1).cast("int"))
    t = table(spark, sf_dir, "part").select(pick(C("p_partkey")).alias("before"), (C("p_partkey") % 2 == 0).alias("was_null"), (C("p_size") % 3 == 0).alias("is_null")).distinct()
    pairs = t.select("*", F.explode(F.array(*map(F.lit, TYPES))).alias("after"))
    verdict = identity.column_compatibility(C("before"), C("after"), C("was_null"), C("is_null"))
    return pairs.select("before", "after", "was_null", "is_null", identity.widens(C("before"), C("after")).alias("widens"), verdict.alias("compatibility"))


def _sources(spark, sf_dir, text):
    return table(spark, sf_dir, "part").select(F.concat(F.lit("src/p"), _text("p_partkey"), F.lit(".ts")).alias("path"), text.alias("text"), "p_partkey", "p_size")


def _say(form, *columns):
    return F.format_string(form, *(_text(c) if isinstance(c, str) else c for c in columns))


def http_contracts(spark, sf_dir):
    text = F.concat_ws("\n", _say("app.get('/parts//%s/:id?x', h);", "p_partkey"), _say("axios.post(`https://Host%s.io/parts/${id}/`);", "p_size"), F.when(C("p_partkey") % 2 == 0, _say("await fetch('/s/%s', {method: 'put'});", "p_size")), F.when(C("p_partkey") % 3 == 0, "orders.delete('/o'); fetch(url);"))
    return extract.http_contracts(_sources(spark, sf_dir, text))


def configuration_facts(spark, sf_dir):
    text = F.concat_ws("\n", _say("process.env.KEY_%s; config.get('k%s')", "p_partkey", "p_size"), F.when(C("p_partkey") % 2 == 0, _say("defineFeatureFlag('f%s'); flags.variation(\"f%s\")", "p_size", "p_size")), F.when(C("p_partkey") % 3 == 0, _say("secrets.get('vault', 's%s'); process.env[name]", "p_size")))
    return extract.configuration(_sources(spark, sf_dir, text), SECRET, "prod")


def event_bindings(spark, sf_dir):
    text = F.concat_ws("\n", _say("producer.send({ acks: 1, topic: 'orders-%s' })", "p_size"), _say("consumer.subscribe({topic: 'orders-%s'})", "p_partkey"), F.when(C("p_partkey") % 2 == 0, _say("new SendMessageCommand({ QueueUrl: 'https://sqs.eu-west-1.amazonaws.com/%s/jobs' })", "p_partkey")), F.when(C("p_partkey") % 3 == 0, _say("new SubscribeCommand({TopicArn: 'arn:aws:sns:us-east-1:7:t%s'}); pubsub.topic('g%s').publishMessage({})", "p_size", "p_size")))
    return extract.event_destinations(_sources(spark, sf_dir, text))


def module_exports(spark, sf_dir):
    text = F.concat_ws("\n", _say("export async function make%s() {}", "p_partkey"), _say("export { inner as outer%s, plain };", "p_size"), F.when(C("p_partkey") % 2 == 0, _say("export * from './m%s';", "p_size")), F.when(C("p_partkey") % 3 == 0, "export type { A as B } from 'lib';\nimport x from './y';"), F.lit("// export const hidden = 1;\n/* import 'gone';\nexport * from 'gone' */\nconst s = \"export const text = 'import(1)'\";\nconst t = `export class Template {}\nrequire('gone')`;"), F.when(C("p_partkey") % 5 == 0, "const lazy = () => import('./lazy'); const old = require(\"old\"); // import 'no'"))
    return extract.module_symbols(_sources(spark, sf_dir, text))


def reexport_closure(spark, sf_dir):
    text = F.concat_ws("\n", _say("export const own%s = 1;", "p_partkey"), F.when(C("p_partkey") % 10 != 0, "export * from './next';"), F.when(C("p_partkey") % 10 == 5, "export { missing } from './next';"))
    files = _sources(spark, sf_dir, text)
    targets = files.select("path", F.lit("./next").alias("source"), F.concat(F.lit("src/p"), (C("p_partkey") - 1).cast("string"), F.lit(".ts")).alias("target"))
    return extract.reexported_symbols(extract.module_symbols(files), targets).select("path", "name", "declared_in", "steps")


def symbol_overloads(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.lit("m").alias("path"), F.when(C("p_size") % 2 == 0, "type").otherwise("value").alias("space"), C("p_type").alias("name"), C("p_brand").alias("signature")).distinct()
    return extract.overloads(rows).select("space", "name", F.concat_ws(",", "overloads").alias("overloads"))


def api_operations(spark, sf_dir):
    yaml = _say("openapi: 3.0.0\npaths:\n  /parts/{id}/s%s:\n    parameters:\n      - $ref: '#/components/parameters/id'\n    get:\n      operationId: get%s\n    delete:\n      parameters:\n        - {name: force, in: query, required: true}\ncomponents:\n  parameters:\n    id: {name: id, in: path, required: true}\n", "p_size", "p_partkey")
    json = _say('{"paths": {"/j/{x}": {"post": {"operationId": "make%s"}}}}', "p_partkey")
    return extract.api_operations(_sources(spark, sf_dir, F.when(C("p_partkey") % 3 == 0, json).when(C("p_partkey") % 7 == 0, "paths: [").otherwise(yaml)))


def message_schemas(spark, sf_dir):
    text = _say('{"file": [{"package": "p%s", "messageType": [{"name": "M", "field": [{"name": "a", "number": %s, "type": "T", "label": "L"}], "nestedType": [{"name": "N", "field": [{"name": "b", "number": 2, "type": "U"}]}]}], "service": [{"name": "S", "method": [{"name": "Go", "inputType": "I", "outputType": "O"}]}]}]}', "p_partkey", "p_size")
    return extract.message_schemas(_sources(spark, sf_dir, text))


def infrastructure_facts(spark, sf_dir):
    yaml = _say("apiVersion: v1\nkind: Service\nmetadata:\n  name: svc%s\nspec:\n  ports:\n    - port: %s\n    - port: 53\n      protocol: UDP\n---\nkind: Deployment\nmetadata: {name: d%s}\nspec:\n  template:\n    spec:\n      containers:\n        - name: main\n", "p_partkey", "p_size", "p_partkey")
    chart = _say("kind: Service\nmetadata:\n  name: {{ .Values.name }}-%s\n", "p_size")
    module = _say('resource "kubernetes_service" "r%s" {\n  port = %s\n}\noutput "o%s" {}\nx = data.terraform_remote_state.net.outputs.vpc', "p_partkey", "p_size", "p_partkey")
    text = F.when(C("p_partkey") % 4 == 0, chart).when(C("p_partkey") % 4 == 1, module).when(C("p_partkey") % 28 == 2, "{{ include 'x' }}").otherwise(yaml)
    return extract.infrastructure(_sources(spark, sf_dir, text), {"name": "web"})


def sql_references(spark, sf_dir):
    text = F.concat_ws("\n", _say("SELECT * FROM t%s JOIN Public.u ON true; UPDATE v%s SET x = 1", "p_size", "p_partkey"), F.when(C("p_partkey") % 2 == 0, "await prisma.order.findMany({})"))
    return extract.sql_references(_sources(spark, sf_dir, text))


def migrated_schema(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    first = _say("CREATE TABLE t%s (id int4 PRIMARY KEY, name varchar(%s) NOT NULL, gone text); -- ;", "p_partkey", C("p_size") + 1)
    second = _say("ALTER TABLE t%s DROP COLUMN gone, ADD COLUMN note text; CREATE TYPE mood AS ENUM ('a', 'b;%s');", "p_partkey", "p_size")
    third = F.when(C("p_partkey") % 2 == 0, _say("ALTER TABLE t%s RENAME TO u", "p_partkey")).otherwise(_say("DROP TABLE t%s", "p_partkey"))
    files = p.select(_text("p_partkey").alias("namespace"), F.explode(F.array(F.struct(F.lit("1").alias("path"), first.alias("text")), F.struct(F.lit("2").alias("path"), second.alias("text")), F.struct(F.lit("3").alias("path"), third.alias("text")))).alias("f"))
    return extract.replay_migrations(files.select("namespace", "f.*"))


def family_diff(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    kind = F.element_at(F.array(*map(F.lit, ["database.column", "database.enum", "http.route", "event.topic"])), (C("p_partkey") % 4 + 1).cast("int"))
    n = lambda e: F.expr(e).cast("int")
    values = lambda e: F.transform(F.sequence(F.lit(0), n(e)), lambda i: i.cast("string"))
    pick = lambda e: F.element_at(F.array(*map(F.lit, TYPES)), n(f"{e} % {len(TYPES)} + 1"))
    payload = lambda t: F.struct(t.alias("type"), F.lit(None).cast("map<string,string>").alias("properties"), F.lit(None).cast("array<string>").alias("required"), F.lit(None).cast("array<string>").alias("values"))

    def side(kind_of_type, null, vals, event, shape):
        return p.select(
            kind.alias("contract_kind"), _text("p_partkey").alias("canonical_key"), (C("p_partkey") % 9).alias("producer"), F.expr(shape).cast("string").alias("shape"), C("p_size").alias("width"),
            pick(kind_of_type).alias("data_type"), F.expr(null).alias("nullable"), values(vals).alias("values"), payload(F.expr(event)).alias("payload"), F.lit(None).cast(identity.OVERLOADS).alias("overloads"),
        )

    base, head = side("p_partkey", "p_partkey % 8 = 0", "p_size % 3", "'object'", "p_size"), side("p_size", "p_partkey % 3 = 0", "p_size % 4", "if(p_size % 2 = 0, 'object', 'array')", "p_size + p_partkey % 5")
    added = identity.addition_compatibility(C("contract_kind"), C("h_nullable"))
    return contracts.contract_diff(base.where("producer <> 3"), head.where("producer <> 4"), changed=contracts.family_compatibility(), added=added)


def derived_generations(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        C("o_orderkey").alias("generation_id"), F.when(C("o_orderstatus") == "F", "complete").when(C("o_orderstatus") == "O", "partial").otherwise("failed").alias("state"), (C("o_orderkey") % 3).alias("commit"),
        F.lit("w").alias("workspace"), (C("o_orderkey") % 50).alias("repository"), F.lit(1).alias("bundle_version"), F.lit(1).alias("config_revision"), (C("o_orderkey") % 5).alias("registry_revision"),
        F.when(C("o_orderkey") % 6 == 0, C("o_orderkey") - 6).alias("base_generation_id"), F.when(C("o_orderkey") % 6 == 0, C("o_orderkey") - 1).alias("overlay_id"),
    )
    overlays = o.select(C("generation_id").alias("overlay_id"), (C("generation_id") - C("generation_id") % 7).alias("base_generation_id"), "state", ((C("generation_id") - C("generation_id") % 7) % 3).alias("base_commit"), "workspace", ((C("generation_id") - C("generation_id") % 7) % 50).alias("repository"), "bundle_version", "config_revision", ((C("generation_id") - C("generation_id") % 7) % 5).alias("registry_revision"))
    requests = o.select(F.when(C("generation_id") % 12 == 0, C("generation_id")).otherwise(-C("generation_id") - 1).alias("generation_id"), (C("generation_id") - C("generation_id") % 14 % 8).alias("base_generation_id"), C("generation_id").alias("overlay_id"))
    return snapshots.derive_generations(requests, o, overlays)


def generation_ancestry(spark, sf_dir):
    g = table(spark, sf_dir, "part").select(C("p_partkey").alias("generation_id"), F.when(C("p_partkey") % 10 != 0, C("p_partkey") - 1).when(C("p_partkey") % 40 == 30, C("p_partkey") + 3).alias("base_generation_id"), F.when(C("p_partkey") % 10 != 0, C("p_partkey")).alias("overlay_id"))
    return snapshots.ancestry(g, g).groupBy("generation_id").agg(F.count("*").alias("layers"), F.bool_or("cycle").alias("cycle"))


def snapshot_conflicts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    gens = o.select(C("o_orderkey").alias("generation_id"), F.when(C("o_orderstatus") == "P", "failed").otherwise("complete").alias("state"), (C("o_orderkey") % 9).alias("repository"), F.lit(1).alias("config_revision"), (C("o_orderkey") % 4).alias("registry_revision"), F.when(C("o_orderkey") % 5 == 0, C("o_orderkey") - 1).alias("base_generation_id"))
    name = lambda e: F.concat(F.lit("h"), F.expr(e).cast("string"))
    snaps = o.select(name("o_orderkey").alias("output_hash"), C("o_orderkey").alias("generation_id"), F.lit("ts").alias("adapter"), (C("o_orderkey") % 9).alias("repository"), F.lit(1).alias("config_revision"), F.when(C("o_orderkey") % 11 == 0, -1).otherwise(C("o_orderkey") % 4).alias("registry_revision"), F.when(C("o_orderkey") % 10 == 0, name("o_orderkey - 9")).when(C("o_orderkey") % 17 == 0, name("o_orderkey")).alias("base_hash"))
    partitions = o.where("o_orderkey % 13 <> 0").select(name("o_orderkey").alias("output_hash"), (C("o_orderkey") % 3).alias("partition_key"))
    entries = o.select(name("o_orderkey").alias("output_hash"), name("o_orderkey + 1").alias("partition_hash"), F.when(C("o_orderkey") % 19 == 0, -1).otherwise((C("o_orderkey") + 1) % 3).alias("partition_key"), F.when(C("o_orderkey") % 2 == 0, "tombstone").otherwise("replacement").alias("kind"))
    held = o.where("o_orderkey % 23 = 0").select(C("o_orderkey").alias("generation_id"), F.lit("ts").alias("adapter"), F.when(C("o_orderkey") % 46 == 0, "other").otherwise(name("o_orderkey")).alias("output_hash"))
    return snapshots.snapshot_conflicts(snaps, gens, partitions, entries, held).groupBy("conflict").agg(F.count("*").alias("n"))


def registry_sync(spark, sf_dir):
    selected = table(spark, sf_dir, "customer").where("c_custkey % 4 <> 0").select(C("c_custkey").alias("repository"))
    services, aliases = registry.sync_registry(selected, relation(spark, sf_dir, "services"), relation(spark, sf_dir, "aliases"))
    return services.select(C("id").alias("service"), F.lit("service").alias("what")).unionByName(aliases.select("service", F.lit("alias").alias("what")))


def revision_pointers(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((C("o_custkey") % 30).alias("workspace"), C("o_orderkey").cast("string").alias("revision"), (C("o_orderkey") * 7 % 1000).alias("sequence"), F.concat(F.lit("h"), _text("o_orderkey")).alias("hash"))
    held, incoming = o.where("sequence % 2 = 0"), o.where("sequence % 3 = 0").withColumn("hash", F.when(C("sequence") % 5 == 0, "other").otherwise(C("hash")))
    pointers = held.groupBy("workspace").agg(F.max(F.struct("sequence", "revision")).alias("t")).select("workspace", "t.revision", "t.sequence")
    new, conflicts, current = registry.put_revisions(held, incoming, pointers)
    counts = conflicts.groupBy("workspace").agg(F.count("*").alias("conflicts")).join(new.groupBy("workspace").agg(F.count("*").alias("appended")), "workspace", "full_outer")
    return current.join(counts, "workspace", "left").select("workspace", "revision", "sequence", F.coalesce("conflicts", F.lit(0)).alias("conflicts"), F.coalesce("appended", F.lit(0)).alias("appended"))


def manifest_differences(spark, sf_dir):
    return registry.set_differences(table(spark, sf_dir, "orders").select(C("o_custkey").alias("case_id")), table(spark, sf_dir, "customer").where("c_custkey % 5 <> 1").select(C("c_custkey").alias("case_id")), "case_id")


def evidence_plan(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    changes = p.select(C("p_partkey").alias("position"), _text("p_partkey").alias("canonical_key"), C("p_type").alias("family"))
    handle = [F.lit("r").alias("repository"), F.lit("g").alias("generation_id"), F.concat(F.lit("f"), _text("p_partkey")).alias("path"), _text("p_size").alias("content_hash")]
    definitions = p.select(C("p_partkey").alias("position"), _text("p_partkey").alias("canonical_key"), (C("p_partkey") % 3 != 0).alias("has_range"), *handle)
    refs = p.select((C("p_partkey") * 3).alias("position"), F.when(C("p_partkey") % 2 == 0, _text("p_partkey")).alias("canonical_key"), C("p_type").alias("family"), F.lit(True).alias("has_range"), *handle)
    return reasoning.plan_evidence(changes, definitions, refs, 25).select("ordinal", "side", "path")


def citation_check(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    ids = lambda e: F.transform(F.sequence(F.lit(0), F.expr(e).cast("int")), lambda i: (C("o_orderkey") + i).cast("string"))
    candidates = o.select(C("o_orderkey").alias("candidate_id"), ids("o_orderkey % 3").alias("producer_ids"), F.when(C("o_orderkey") % 7 != 0, F.array((C("o_orderkey") + 10).cast("string"))).otherwise(F.array().cast("array<string>")).alias("consumer_ids"))
    supplied = o.where("o_orderkey % 11 <> 0").select(_text("o_orderkey").alias("citation_id"), F.when(C("o_orderkey") % 5 == 0, "consumer").otherwise("producer").alias("side"))
    return reasoning.valid_hypotheses(candidates, supplied)


def resolved_commits(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    commits = o.select(C("o_custkey").alias("repository"), F.substring(F.sha2(_text("o_orderkey"), 256), 1, 40).alias("commit"))
    refs = o.groupBy(C("o_custkey").alias("repository")).agg(F.substring(F.sha2(F.max("o_orderkey").cast("string"), 256), 1, 40).alias("commit")).withColumn("name", F.when(C("repository") % 2 == 0, "refs/heads/main").otherwise("refs/tags/v1"))
    requests = table(spark, sf_dir, "customer").select(C("c_custkey").alias("repository"), F.when(C("c_custkey") % 3 == 0, "v1").otherwise("main").alias("ref"))
    exact = o.where("o_orderkey % 9 = 0").select((C("o_custkey") + F.when(C("o_orderkey") % 18 == 0, 1).otherwise(0)).alias("repository"), F.substring(F.sha2(_text("o_orderkey"), 256), 1, 40).alias("ref"))
    return records.resolve_commits(requests.unionByName(exact), refs, commits)


def blob_reads(spark, sf_dir):
    blobs = table(spark, sf_dir, "documents").select(C("doc_id").alias("blob"), F.encode("text", "utf-8").alias("content"))
    return records.read_blobs(blobs, blobs.where("blob % 3 = 0"), 500).select("blob", F.sha2("content", 256).alias("hash"), "size", "truncated")


def artifact_cache(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(_text("doc_id").alias("key"), F.encode("text", "utf-8").alias("content"))
    empty = d.limit(0).withColumn("hash", F.lit(""))
    held = records.cache_put(empty, d).withColumn("content", F.when(C("key").endswith("7"), F.encode(F.lit("other"), "utf-8")).otherwise(C("content")))
    return records.cache_get(held, d).select("key", "hit", "corrupt")


def incremental_rejoin(spark, sf_dir):
    """Edges after three rounds of changes, kept up to date from a store that knew other inputs: references that were
    heuristic, are new or are gone, and changes that were compatible, are new or are gone. The SQL joins the
    present inputs from scratch."""
    refs = analyze.references(spark, sf_dir)
    refs = contracts.with_alias_state(refs, analyze.resolved(spark, sf_dir, refs).withColumnRenamed("request_id", "reference_id"))
    refs = materialise(refs.select(*incremental.REFERENCE).withColumn("_turn", F.pmod(F.crc32("reference_id"), F.lit(40))), "refs")
    changed = contracts.changed_definitions(analyze.changes(spark, sf_dir), relation(spark, sf_dir, "definitions"))
    changed = materialise(changed.withColumn("_turn", F.pmod(F.crc32("canonical_key"), F.lit(40))), "changes")
    of = lambda df, *turns: df.where(C("_turn").isin(*turns)).drop("_turn")
    none = lambda df: df.where("false").drop("_turn")
    # Turn 1: other values before; 2: not there before; 3: copies under other names that go.
    old_refs = of(refs, 1).withColumns({"context_basis": F.lit("heuristic"), "constrained_key": F.coalesce("canonical_key", "constrained_key")})
    lost_refs = of(refs, 3).withColumn("reference_id", F.concat(F.lit("lost-"), "reference_id"))
    old_changes = of(changed, 1).withColumn("compatibility", F.lit("compatible"))
    lost_changes = of(changed, 3).withColumn("canonical_key", F.concat(F.lit("lost-"), "canonical_key"))
    store = incremental.RejoinStore(spark, f"{shared_dir(spark)}/rejoin-{uuid.uuid4().hex}", analyze.WORKSPACE, analyze.REVISION)
    store.create(
        changed.where("_turn not in (1, 2)").drop("_turn").unionByName(old_changes).unionByName(lost_changes), refs.where("_turn not in (1, 2)").drop("_turn").unionByName(old_refs).unionByName(lost_refs)
    )
    store.refresh(references=(old_refs, of(refs, 1)), changes=(none(changed), of(changed, 2)))
    store.refresh(changes=(old_changes.unionByName(lost_changes), of(changed, 1)))
    store.refresh(references=(lost_refs, of(refs, 2)))
    return store.edges().select("canonical_key", "consumer", "reference_id", "basis", "change_kind", "compatibility")


def _edited_trees(spark, sf_dir):
    """Documents as files, a word a line, in one tree a source: some go, some come under another name with some of their
    words changed, cut off or added, and some are changed where they are."""
    d = table(spark, sf_dir, "documents").where("text is not null").select(C("source").alias("diff"), C("doc_id").alias("k"), F.replace("text", F.lit(" "), F.lit("\n")).alias("t"))
    file = lambda df: df.select("diff", "path", F.sha2("t", 256).alias("content"), F.lit("file").alias("entry_kind"), F.lit(False).alias("binary"), F.encode("t", "UTF-8").alias("data"))
    name = lambda folder: F.concat(F.lit(f"{folder}/f"), (C("k") % 40).cast("string"), F.lit("/"), C("k").cast("string"))
    base = d.withColumn("path", name("src"))
    edit = F.when(C("k") % 5 == 0, C("t")).when(C("k") % 5 == 1, F.replace("t", F.lit("a"), F.lit("4"))).when(C("k") % 5 == 2, F.substring("t", F.lit(1), (F.length("t") * (C("k") % 9 + 1) / 9).cast("int")))
    edit = edit.when(C("k") % 5 == 3, F.concat("t", F.lit("\n"), F.repeat(F.lit("more\n"), (C("k") % 30).cast("int")))).otherwise(F.replace("t", F.lit("the"), F.lit("teh")))
    head = d.where("k % 3 <> 0").withColumn("t", F.when(C("k") % 4 == 1, F.concat("t", F.lit("\nend"))).otherwise(C("t"))).withColumn("path", name("src"))
    moved = d.where("k % 3 = 0 or k % 8 = 1").withColumn("t", edit).withColumn("path", name("lib"))
    return file(base), file(head).unionByName(file(moved))


def rename_scores(spark, sf_dir):
    """Scores of all pairs of a file that is no more with one that is new."""
    base, head = _edited_trees(spark, sf_dir)
    once = lambda df, other: df.join(other.select("diff", "path"), ["diff", "path"], "left_anti").dropDuplicates(["diff", "content"]).select("diff", "content", "binary", "data")
    return renames.similarities(once(base, head), once(head, base))


def tree_renames(spark, sf_dir):
    return renames.find_renames(*_edited_trees(spark, sf_dir))


def queries() -> dict:
    own = {n: f for n, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_") and n not in ("queries", "oracle_sql")}
    return own | adapters.queries() | protocol2.queries() | stores.queries()


def oracle_sql() -> dict:
    return SQL | adapters.SQL | more_sql.SQL | protocol2.SQL | stores.SQL | {"incremental_rejoin": SQL["changed_contract_join"]}
