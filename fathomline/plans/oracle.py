"""The SQL that each registered query is compared with, over the same bound relations."""

from __future__ import annotations

from ..sources.tables import relation_sql


def _with(names: str, body: str) -> str:
    return f"{relation_sql(*names.split())}{body}"


def _json(record) -> str:
    """SQL text of a record's canonical JSON: dicts of SQL expressions of texts, or ("n", expression) for numbers."""
    if isinstance(record, dict):
        inner = ", ',', ".join(f"'\"{k}\":', {_json(record[k])}" for k in sorted(record))
        return f"concat('{{', {inner}, '}}')"
    if isinstance(record, list):
        return "concat('[', " + ", ',', ".join(map(_json, record)) + ", ']')"
    if isinstance(record, tuple):
        return f"CAST({record[1]} AS VARCHAR)"
    return "'null'" if record is None else f"CAST(to_json(CAST({record} AS VARCHAR)) AS VARCHAR)"


def _hash(record) -> str:
    return f"concat('sha256:', sha256({_json(record)}))"


def _hmac(key: bytes, message: str) -> str:
    """SQL text of a keyed hash of a blob."""
    pads = ["unhex('" + bytes(b ^ pad for b in key.ljust(64, b"\0")).hex() + "')" for pad in (0x36, 0x5C)]
    return f"sha256({pads[1]} || unhex(sha256({pads[0]} || {message})))"


#: Sums of four pieces of the hashes of case ids.
_LANES = ", ':', ".join(f"coalesce(sum(CAST(concat('0x', substr(sha256(CAST(case_id AS VARCHAR)), {at}, 15)) AS HUGEINT)), 0)" for at in (1, 16, 31, 46))
_SECRET = b"a shared secret"
AT = "DATE '2000-06-30'"
CHANGES = """, changes AS (
    SELECT coalesce(h.contract_kind, b.contract_kind) AS contract_kind, coalesce(h.canonical_key, b.canonical_key) AS canonical_key, coalesce(h.producer, b.producer) AS producer,
           CASE WHEN b.canonical_key IS NULL THEN 'added' WHEN h.canonical_key IS NULL THEN 'removed' ELSE 'changed' END AS change_kind,
           CASE WHEN b.canonical_key IS NULL THEN 'compatible' WHEN h.canonical_key IS NULL THEN 'breaking' WHEN h.width >= b.width THEN 'compatible' ELSE 'breaking' END AS compatibility
    FROM definitions_base b FULL JOIN definitions_head h ON b.contract_kind = h.contract_kind AND b.canonical_key = h.canonical_key
    WHERE b.shape IS DISTINCT FROM h.shape)"""
_AGE = f"greatest(date_diff('day', CAST(coalesce(o.completed_at, {AT}) AS DATE), {AT}), 0)"
STATES = f""", selected AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repository ORDER BY CASE state WHEN 'complete' THEN 0 WHEN 'partial' THEN 1 ELSE 2 END, started_at DESC, generation_id DESC) AS n FROM generations) WHERE n = 1),
    stated AS (SELECT c_custkey AS repository, s.generation_id, o.coverage_state, {_AGE} AS age,
        CASE WHEN c_custkey % 41 = 0 THEN 'unauthorized' WHEN s.state = 'failed' THEN 'failed' WHEN s.generation_id IS NULL OR o.coverage_state IS NULL THEN 'not_indexed' WHEN o.coverage_state = 'failed' THEN 'failed'
             WHEN o.coverage_state = 'unsupported' THEN 'unsupported' WHEN {_AGE} > 1095 THEN 'stale' ELSE 'current' END AS consumer_state
        FROM customer LEFT JOIN selected s ON c_custkey = s.repository LEFT JOIN observations o ON o.generation_id = s.generation_id WHERE c_custkey <> 5),
    states AS (SELECT repository, CASE WHEN consumer_state IN ('stale', 'current', 'unsupported') THEN generation_id END AS generation_id, consumer_state, CAST(CASE WHEN consumer_state IN ('stale', 'current') THEN age END AS INTEGER) AS age_days,
        CASE WHEN consumer_state IN ('stale', 'current') THEN coverage_state END AS coverage_state FROM stated
        UNION ALL SELECT c_custkey, -1, 'current', 0, 'partial' FROM customer WHERE c_custkey = 5)"""
_NORM = "CASE {k} WHEN 'host' THEN regexp_replace(lower(trim({v})), '\\.$', '') WHEN 'package_coordinate' THEN lower(trim({v})) WHEN 'path_prefix' THEN regexp_replace(regexp_replace(trim({v}), '^/+|/+$', '', 'g'), '/{{2,}}', '/', 'g') ELSE trim({v}) END"
_BARE = "regexp_replace(regexp_replace(q.target_path, '^/+|/+$', '', 'g'), '/{2,}', '/', 'g')"
_LEAD = "regexp_replace(a.path_prefix, '^/+|/+$', '', 'g')"
_BEHIND = f"CASE WHEN a.path_prefix IS NULL THEN {_BARE} WHEN {_BARE} = {_LEAD} THEN '' WHEN starts_with({_BARE}, concat({_LEAD}, '/')) THEN substr({_BARE}, length({_LEAD}) + 2) END"


def _resolved(source: str) -> str:
    return f""", asked AS (SELECT * FROM {source} WHERE target_kind IS NOT NULL),
    fitting AS (SELECT q.reference_id, a.service, a.path_prefix, a.value, {_BEHIND} AS behind FROM asked q JOIN aliases a ON a.kind = q.target_kind AND a.environment = q.target_environment
        AND {_NORM.format(k='a.kind', v='a.value')} = {_NORM.format(k='q.target_kind', v='q.target_value')} AND a.valid_from <= {AT} AND (a.valid_until IS NULL OR {AT} < a.valid_until)
        JOIN services s ON s.id = a.service AND s.valid_from <= {AT} AND (s.valid_until IS NULL OR {AT} < s.valid_until) WHERE q.target_path IS NULL OR {_BEHIND} IS NOT NULL),
    resolved AS (SELECT q.reference_id, CASE count(DISTINCT f.service) WHEN 0 THEN 'not_found' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS state, CASE WHEN count(DISTINCT f.service) = 1 THEN min(f.service) END AS service,
        CASE WHEN count(DISTINCT f.service) = 1 THEN first(f.behind ORDER BY coalesce(length(f.path_prefix), 0) DESC, f.value) END AS rewritten_path FROM asked q LEFT JOIN fitting f ON f.reference_id = q.reference_id GROUP BY q.reference_id)"""


_EDGE = {"workspaceId": "'wsp-1'", "producerRepositoryId": "producer", "consumerRepositoryId": "consumer", "definitionKey": "canonical_key", "stableReferenceId": "reference_id", "basis": "basis", "registryRevision": "'reg-7'"}
_FINDING = {"workspaceId": "'wsp-1'", "producerRepositoryId": "producer", "contractKind": "contract_kind", "canonicalKey": "canonical_key", "changeKind": "change_kind", "consumerRepositoryId": "e.consumer", "stableReferenceId": "reference_id", "policyMajor": ("n", "1")}
SELECTED = STATES + ", refsel AS (SELECT r.* FROM refs r JOIN states s ON s.repository = r.consumer AND s.generation_id = r.generation_id)"
#: Every change of a kind with every reference of that kind, decided in order.
JOINED = CHANGES + SELECTED + _resolved("refsel") + f""", firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY producer, contract_kind, canonical_key ORDER BY position) AS n FROM definitions) WHERE n = 1),
    changed AS (SELECT c.*, d.service, d.generation_id AS producer_generation, d.stratum AS definition_stratum FROM changes c JOIN firsts d ON d.producer = c.producer AND d.contract_kind = c.contract_kind AND d.canonical_key = c.canonical_key),
    decided AS (SELECT c.contract_kind, c.canonical_key, c.producer, c.change_kind, c.compatibility, c.definition_stratum, r.consumer, r.reference_id, r.stratum, CASE
            WHEN r.context_basis IN ('declared_context', 'behavioural_context') THEN CASE WHEN r.unresolved_pattern IS NOT NULL THEN 'unresolved_reference' END
            WHEN x.state = 'ambiguous' THEN 'registry_ambiguity'
            WHEN r.context_basis IS NULL AND r.canonical_key = c.canonical_key THEN CASE WHEN x.state = 'resolved' AND x.service <> c.service THEN 'registry_contradiction' ELSE 'exact' END
            WHEN x.state = 'resolved' AND x.service = c.service AND r.constrained_key = c.canonical_key THEN 'registry_resolved'
            WHEN r.context_basis = 'heuristic' AND r.constrained_key = c.canonical_key THEN 'heuristic'
            WHEN r.unresolved_pattern IS NOT NULL THEN 'unresolved_reference' END AS basis
        FROM changed c JOIN refsel r ON r.contract_kind = c.contract_kind LEFT JOIN resolved x ON x.reference_id = r.reference_id),
    problems AS (SELECT consumer, reference_id, basis AS diagnostic FROM decided WHERE basis IN ('unresolved_reference', 'registry_ambiguity', 'registry_contradiction')),
    named AS (SELECT *, concat('edg_', {_hash(_EDGE)}) AS edge_id, concat_ws('|', contract_kind, definition_stratum, stratum, basis, concat('producer_definition:exact+', CASE basis WHEN 'registry_resolved' THEN 'registry_alias:registry_resolved+' ELSE '' END, 'consumer_reference:', basis), 'v1') AS stratum_key
        FROM decided WHERE basis IN ('exact', 'registry_resolved', 'heuristic')),
    edges AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY canonical_key, consumer, reference_id ORDER BY CASE basis WHEN 'exact' THEN 0 ELSE 1 END, edge_id) AS n FROM named) WHERE n = 1)"""
REASON = "CASE consumer_state WHEN 'stale' THEN 'stale_consumer_generation' WHEN 'unsupported' THEN 'unsupported_language' WHEN 'unauthorized' THEN 'privacy_restricted' WHEN 'failed' THEN 'incomplete_index' WHEN 'not_indexed' THEN 'incomplete_index' END"
FINDINGS = JOINED + f""", findings AS (
    SELECT concat('fnd_', {_hash(_FINDING)}) AS fingerprint, e.contract_kind, e.canonical_key, e.consumer, e.basis, e.change_kind, e.compatibility, s.consumer_state, {REASON} AS reason, CASE WHEN {REASON} IS NULL THEN 'PREVIEW' ELSE 'ABSTAINED' END AS state,
           CASE e.compatibility WHEN 'breaking' THEN 'coordinate' ELSE 'none' END AS action
    FROM edges e JOIN states s ON e.consumer = s.repository)"""
_J = "definitions_base definitions_head definitions refs aliases services generations observations"
_F = _J
EDGES = """, ev AS (SELECT reference_id AS edge_id, reference_id, consumer, CAST(substr(canonical_key, 6) AS BIGINT) % 1500 AS producer, first_observed, last_observed,
    canonical_key AS payload, CASE WHEN generation_id % 9 = 0 THEN last_observed END AS invalidated_at FROM uses)"""

_SEL = "policy_selected AND detector_output = 'candidate' AND NOT suppressed"
_ACT = "label_action IN ('coordinate', 'already_coordinated', 'accepted_risk')"
#: Name: counts, success, indeterminate.
RULES = {
    "edge_precision": (_SEL, "coalesce(label_edge = 'confirmed', false)", "coalesce(label_edge = 'indeterminate', false)"),
    "impact_precision": (_SEL, "coalesce(label_impact = claim_impact, false)", "(coalesce(label_impact = 'indeterminate', false) OR claim_impact = 'unknown')"),
    "actionable_precision": (f"{_SEL} AND claim_action = 'coordinate'", f"coalesce({_ACT}, false)", "coalesce(label_action = 'indeterminate', false)"),
    "consumer_edge_recall": ("label_edge IN ('confirmed', 'indeterminate')", "detector_output IN ('candidate', 'abstained')", "coalesce(label_edge = 'indeterminate', false)"),
    "known_break_recall": ("label_impact IN ('breaking', 'indeterminate')", "detector_output IN ('candidate', 'abstained')", "coalesce(label_impact = 'indeterminate', false)"),
    "false_omission": ("detector_output IN ('no_candidate', 'not_analysed')", f"coalesce(NOT {_ACT}, false)", "coalesce(label_action = 'indeterminate', false)"),
}


def _lower(k: str, n: str, z: float, sign: str = "-") -> str:
    n, p = f"CAST({n} AS DOUBLE)", f"(CAST({k} AS DOUBLE) / nullif({n}, 0))"
    bound = f"({p} + {z * z} / (2 * {n}) {sign} {z} * sqrt({p} * (1 - {p}) / {n} + {z * z} / (4 * {n} * {n}))) / (1 + {z * z} / {n})"
    return f"CASE WHEN {n} = 0 THEN {0.0 if sign == '-' else 1.0} ELSE round({'greatest' if sign == '-' else 'least'}({bound}, {0.0 if sign == '-' else 1.0}), 9) END"


_Z1, _Z2 = 1.6448536269514722, 1.959963984540054


def _metrics(source: str, extra: str = "") -> str:
    group = f"GROUP BY {extra}" if extra else ""
    cols = f"{extra}, " if extra else ""
    parts = []
    for n, (c, s, i) in RULES.items():
        parts.append(f"""SELECT {cols}'{n}' AS metric, count(*) FILTER ({c} AND NOT {i}) AS total, count(*) FILTER ({c} AND NOT {i} AND {s}) AS successes, count(*) FILTER ({c} AND {i}) AS indeterminate,
            round(coalesce(sum(weight) FILTER ({c} AND NOT {i} AND {s}) / nullif(sum(weight) FILTER ({c} AND NOT {i}), 0), 0), 9) AS weighted FROM {source} {group}""")
    inner = " UNION ALL ".join(parts)
    return f"""SELECT *, {_lower('successes', 'total', _Z1)} AS lower95, round(coalesce(CAST(successes AS DOUBLE) / nullif(total + indeterminate, 0), 0), 9) AS worst_case,
        round(coalesce(CAST(successes + indeterminate AS DOUBLE) / nullif(total + indeterminate, 0), 0), 9) AS best_case FROM ({inner})"""


def _ratio(a: str, b: str) -> str:
    return f"round(coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0), 9)"


_AP = RULES["actionable_precision"]
VENDORED, GENERATED = "['node_modules', 'vendor', 'third_party', 'third-party', '.git']", "['dist', 'build', 'coverage', '.next', 'target']"
CLASSIFIED = f""", classified AS (SELECT *, CASE WHEN entry_kind <> 'file' THEN entry_kind WHEN len(list_intersect(string_split(lower(path), '/'), {VENDORED})) > 0 THEN 'vendored'
    WHEN len(list_intersect(string_split(lower(path), '/'), {GENERATED})) > 0 OR regexp_matches(lower(path), '(\\.min\\.js|\\.min\\.css|\\.generated\\.ts|\\.g\\.ts|\\.pb\\.go)$') THEN 'generated'
    WHEN regexp_matches(lower(path), '\\.(zip|tar|tgz|gz|bz2|xz|7z|rar|jar|war)$') THEN 'unsupported' WHEN size > 2097152 THEN 'oversized'
    WHEN regexp_extract(lower(path), '\\.[^./]*$') NOT IN ('.ts', '.py', '.md', '.sql') THEN 'unsupported' ELSE 'source' END AS classification FROM artifacts)"""
_STATE = f""", ev AS (SELECT user_id AS rule_id, event_type = 'error' AS revoked, CASE WHEN event_id % 2 = 0 THEN DATE '2001-01-01' END AS next_expires_at, ts, event_id FROM events WHERE event_type IN ('error', 'view')),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY ts DESC, event_id DESC) AS n FROM ev) WHERE n = 1),
broken AS (SELECT rule_id, array_to_string(list_sort(list(DISTINCT concat(p.kind, '_changed'))), ',') AS reasons, arg_min(concat(p.kind, '_changed'), p.position) AS first FROM rule_predicates p LEFT JOIN rule_versions v ON v.kind = p.kind AND v.subject = p.subject WHERE v.current IS DISTINCT FROM p.expected GROUP BY 1),
ruled AS (SELECT r.*, b.reasons, b.first, CASE WHEN l.revoked THEN 'revoked' WHEN {AT} >= coalesce(l.next_expires_at, r.expires_at) THEN 'expired' WHEN b.reasons IS NOT NULL THEN 'invalidated'
    WHEN {AT} >= r.review_at THEN 'review_due' ELSE 'active' END AS state FROM rules r LEFT JOIN last l ON l.rule_id = r.rule_id LEFT JOIN broken b ON b.rule_id = r.rule_id)"""
_SCOPE = """scoped AS (SELECT q.repository, CASE WHEN q.repository = 5 THEN 'included' WHEN m.c_custkey IS NULL THEN 'unknown' WHEN m.c_nationkey % 4 = 0 THEN 'not_selected' WHEN d.repository IS NOT NULL THEN 'consent_denied' ELSE 'included' END AS standing
    FROM (SELECT o_custkey AS repository FROM orders UNION SELECT n_nationkey + 10000000 FROM nation) q LEFT JOIN customer m ON q.repository = m.c_custkey
    LEFT JOIN (SELECT DISTINCT o_custkey AS repository FROM orders WHERE o_orderkey % 37 = 0) d ON q.repository = d.repository)"""
_EVIDENCE = "SELECT stratum, " + ", ".join(
    f"count(*) FILTER ({RULES[n][0]} AND NOT {RULES[n][2]}) AS {k}_total, count(*) FILTER ({RULES[n][0]} AND NOT {RULES[n][2]} AND {RULES[n][1]}) AS {k}_successes"
    for n, k in (("actionable_precision", "actionable"), ("edge_precision", "edge"), ("false_omission", "audit"))
) + """, count(*) FILTER (team = 9) AS confidentiality_defects, count(*) FILTER (team = 1 AND detector_output = 'abstained') AS removal_defects,
    round(count(*) FILTER (policy_selected) * 1000 / count(*), 6) AS alerted_per_thousand, max(latency_ms) AS p95_latency_ms, count(*) FILTER (suppressed) AS deliveries_without_remedy FROM cases GROUP BY stratum"""
_RULES = "rules rule_predicates rule_versions"
_ROUTE = "CASE WHEN starts_with({0}, '/') AND length({0}) <= 2048 THEN CASE WHEN length({1}) > 1 THEN regexp_replace({1}, '/$', '') ELSE {1} END END"
_CLEAN = "regexp_replace(regexp_replace({0}, '[?#].*$', ''), '/{{2,}}', '/', 'g')"
_TYPES = ["int2", "integer", "INT8", "numeric", "varchar(10)", "character varying(20)", "text", "varchar", "boolean"]
_RANK = "CASE {0} WHEN 'int2' THEN 1 WHEN 'integer' THEN 2 WHEN 'int8' THEN 3 WHEN 'numeric' THEN 4 END"
_LEN = "CASE {0} WHEN 'varchar(10)' THEN 10 WHEN 'character varying(20)' THEN 20 END"


def _widens(a: str, b: str) -> str:
    a, b = f"lower({a})", f"lower({b})"
    ra, rb, la, lb = _RANK.format(a), _RANK.format(b), _LEN.format(a), _LEN.format(b)
    return f"(CASE WHEN {ra} IS NOT NULL AND {rb} IS NOT NULL THEN {rb} >= {ra} WHEN {b} = 'text' AND ({a} = 'varchar' OR {la} IS NOT NULL) THEN true ELSE coalesce({lb} >= {la}, false) END)"


SQL = {
    "contract_diff": _with("definitions_base definitions_head", CHANGES + "\nSELECT * FROM changes"),
    "edge_dedupe": _with("uses", "\nSELECT canonical_key, consumer, 'exact' AS basis, CASE WHEN context_basis IS NULL THEN reference_id ELSE concat('z', reference_id) END AS edge_id FROM uses"),
    "alias_overlap": _with("aliases", "\nSELECT a.service, b.service AS other, a.value FROM aliases a JOIN aliases b ON a.kind = b.kind AND a.value = b.value AND a.environment = b.environment AND a.service < b.service AND a.valid_from < coalesce(b.valid_until, DATE '9999-12-31') AND b.valid_from < coalesce(a.valid_until, DATE '9999-12-31')"),
    "fk_violations": "SELECT 'lineitem_order' AS \"check\", count(*) AS violations FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'order_customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'label_document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)",
    "ambiguous_defs": _with("definitions_base definitions_head", "\nSELECT contract_kind, canonical_key, min(shape) AS shape, count(*) AS copies FROM (SELECT contract_kind, canonical_key, shape FROM definitions_base UNION ALL SELECT contract_kind, canonical_key, shape FROM definitions_head) GROUP BY 1, 2 HAVING count(DISTINCT shape) = 1"),
    "module_resolve": _with("artifacts", "\nSELECT import_id, arg_min(a.path, i) AS path FROM (SELECT p_partkey AS import_id, concat('src/f', CAST(p_partkey AS VARCHAR), unnest(['.ts', '.py', '.md', '/index.ts'])) AS path, unnest([0, 1, 2, 3]) AS i FROM part) c JOIN (SELECT DISTINCT path FROM artifacts) a ON a.path = c.path GROUP BY 1"),
    "current_edges": _with("uses", EDGES + "\nSELECT edge_id, consumer FROM ev WHERE invalidated_at IS NULL AND last_observed <= DATE '2000-06-30' AND date_diff('day', CAST(last_observed AS DATE), DATE '2000-06-30') <= 1095"),
    "edge_upsert": _with("uses", EDGES + "\nSELECT edge_id, strftime(first_observed, '%Y-%m-%d') AS first_observed, strftime(CASE WHEN consumer % 3 = 0 THEN last_observed + INTERVAL 10 DAY ELSE last_observed END, '%Y-%m-%d') AS last_observed, CASE WHEN consumer % 3 = 0 THEN concat('new:', payload) ELSE payload END AS payload, strftime(CASE WHEN consumer % 3 = 0 THEN NULL ELSE invalidated_at END, '%Y-%m-%d') AS invalidated_at FROM ev"),
    "revision_invalidation": _with("uses", EDGES + "\nSELECT CASE WHEN p.c_custkey IS NULL OR c.c_custkey IS NULL THEN 'membership_removed' WHEN producer % 2 = 0 AND producer % 3 <> 1 THEN 'registry_revision_changed' END AS reason, count(*) AS n FROM ev LEFT JOIN customer p ON p.c_custkey = producer AND p.c_custkey % 10 <> 0 LEFT JOIN customer c ON c.c_custkey = consumer AND c.c_custkey % 10 <> 0 GROUP BY 1"),
    "service_graph": _with("uses", EDGES + "\nSELECT producer, consumer, count(*) AS evidence FROM ev GROUP BY 1, 2"),
    "overlay_materialize": _with("artifacts", "\nSELECT path, CASE WHEN blob % 6 = 1 THEN concat('new:', sha256(text)) ELSE sha256(text) END AS payload, CASE WHEN blob % 6 = 1 THEN 'head' ELSE 'base' END AS origin FROM artifacts WHERE blob % 6 <> 0"),
    "ancestry": _with("artifacts", ", l AS (SELECT concat('p', CAST(blob % 300 AS VARCHAR)) AS path, blob % 997 AS depth, CASE WHEN blob % 5 = 0 THEN 'tombstone' ELSE 'replacement' END AS kind, CAST(blob AS VARCHAR) AS payload FROM artifacts)\n SELECT path, depth, payload FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY depth, payload) AS n FROM l) WHERE n = 1 AND kind <> 'tombstone'"),
    "artifact_reuse": _with("artifacts", "\nSELECT CASE WHEN blob % 4 = 0 THEN 'parse' ELSE 'reuse' END AS step, count(*) AS n FROM artifacts GROUP BY 1"),
    "artifact_classify": _with("artifacts", CLASSIFIED + "\nSELECT path, classification, CASE WHEN classification = 'source' THEN CASE regexp_extract(lower(path), '\\.[^./]*$') WHEN '.ts' THEN 'typescript' WHEN '.py' THEN 'python' WHEN '.sql' THEN 'sql' ELSE 'markdown' END WHEN entry_kind <> 'file' THEN entry_kind ELSE 'unknown' END AS language, CAST(CASE WHEN classification = 'source' THEN CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END END AS INTEGER) AS line_count, CASE WHEN classification = 'source' THEN concat('sha256:', sha256(text)) END AS content_hash FROM classified"),
    "coverage_rollup": _with("artifacts", CLASSIFIED + "\nSELECT repository, count(*) AS entries, count(*) FILTER (classification = 'source') AS processed, count(*) FILTER (classification <> 'source') AS skipped, count(*) FILTER (classification IN ('oversized', 'binary')) AS limited, CAST(coalesce(sum(CASE WHEN classification = 'source' THEN CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END ELSE 0 END), 0) AS BIGINT) AS lines, CAST(sum(size) AS BIGINT) AS bytes FROM classified GROUP BY 1"),
    "extraction_state": _with("generations", "\nSELECT repository, CASE WHEN count(*) FILTER (state = 'failed') = count(*) THEN 'failed' WHEN count(*) FILTER (state <> 'complete') > 0 THEN 'partial' ELSE 'complete' END AS state FROM generations GROUP BY 1"),
    "metric_set": _with("cases", "\n" + _metrics("cases")),
    "wilson": _with("cases", f"\nSELECT team, k, n, {_lower('k', 'n', _Z2)} AS low, {_lower('k', 'n', _Z2, '+')} AS high FROM (SELECT team, count(*) FILTER (suppressed) AS k, count(*) AS n FROM cases GROUP BY 1)"),
    "latency_quantiles": _with("cases", "\nSELECT quantile_disc(l, 0.5) AS p50, quantile_disc(l, 0.95) AS p95, quantile_disc(l, 0.99) AS p99 FROM (SELECT max(latency_ms) AS l FROM cases GROUP BY organization, pull_request)"),
    "agreement": "WITH l AS (SELECT quality AS a, 1 - toxic AS b FROM labels), t AS (SELECT count(*) AS n, count(*) FILTER (a = b) AS e FROM l), x AS (SELECT sum((c / (2 * (SELECT n FROM t))) ** 2) AS ex FROM (SELECT v, count(*) AS c FROM (SELECT a AS v FROM l UNION ALL SELECT b FROM l) GROUP BY 1)) SELECT 'edge' AS axis, n AS pairs, e AS equal, round(e / n, 9) AS raw_agreement, round(CASE WHEN ex = 1 THEN 1.0 ELSE 1 - (1 - e / n) / (1 - ex) END, 9) AS alpha FROM t, x",
    "confusion": "SELECT 'edge' AS axis, quality AS a, 1 - toxic AS b, count(*) AS n FROM labels GROUP BY 2, 3",
    "review_chain": "SELECT concat_ws('-', CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR)) AS event_id, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT DISTINCT FROM CASE WHEN turn > 0 THEN turn - CASE WHEN conv_id % 5 = 0 THEN 2 ELSE 1 END END AS valid FROM conversations",
    "scope_prepare": f"WITH {_SCOPE} SELECT * FROM scoped",
    "gate_failures": _with("cases", f", e AS ({_EVIDENCE})\n SELECT stratum, concat_ws(',', CASE WHEN actionable_total < 100 THEN 'insufficient_independent_labels' END, CASE WHEN {_lower('actionable_successes', 'actionable_total', _Z1)} < 0.9 THEN 'actionable_precision_lower_bound_below_gate' END, CASE WHEN {_lower('edge_successes', 'edge_total', _Z1)} < 0.95 THEN 'edge_precision_lower_bound_below_gate' END, CASE WHEN audit_total < 100 THEN 'insufficient_false_omission_audit' END, CASE WHEN confidentiality_defects > 0 THEN 'unresolved_confidentiality_defect' END, CASE WHEN removal_defects > 0 THEN 'unsafe_removal_coverage_defect' END, CASE WHEN alerted_per_thousand > 50 THEN 'alert_budget_exceeded' END, CASE WHEN p95_latency_ms > 600000 THEN 'latency_budget_exceeded' END, CASE WHEN deliveries_without_remedy > 0 THEN 'delivery_without_remedy' END) AS failures FROM e"),
    "adjudication": "SELECT l.doc_id AS case_id, CASE WHEN (quality = 1) = (toxic = 0) THEN CAST(quality = 1 AS VARCHAR) WHEN d.doc_id IS NOT NULL THEN 'true' ELSE 'indeterminate' END AS label, CAST(2 AS BIGINT) AS reviews FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id AND d.doc_id % 3 = 0",
    "inbox_dedupe": _with("queue", "\nSELECT supersession_key, delivery_hash, event_id, deliveries FROM (SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY supersession_key, delivery_hash) AS deliveries FROM queue WINDOW w AS (PARTITION BY supersession_key, delivery_hash ORDER BY available_at, event_id)) WHERE n = 1"),
    "job_claim": _with("queue", "\nSELECT kind, supersession_key, event_id, attempt + 1 AS attempt FROM (SELECT *, row_number() OVER (PARTITION BY kind, supersession_key ORDER BY available_at, event_id) AS n FROM queue WHERE (state = 'available' OR state = 'leased' AND lease_expires_at <= TIMESTAMP '2024-01-20') AND available_at <= TIMESTAMP '2024-01-20' AND attempt < 3) WHERE n = 1"),
    "job_settle": _with("queue", "\nSELECT CASE WHEN state <> 'leased' OR event_id % 3 <> 1 THEN 'stale_claim' WHEN event_id % 5 = 0 THEN 'completed' WHEN attempt < 3 THEN 'retry_scheduled' ELSE 'failed' END AS after, count(*) AS n FROM queue GROUP BY 1"),
    "supersede": _with("queue", "\nSELECT event_id, CASE WHEN n = 1 THEN state ELSE 'superseded' END AS after FROM (SELECT *, row_number() OVER (PARTITION BY supersession_key ORDER BY available_at DESC, event_id DESC) AS n FROM queue WHERE state IN ('available', 'leased'))"),
    "circuit_breaker": "WITH a AS (SELECT user_id, event_id, event_type IN ('error', 'view') AS f FROM events), r AS (SELECT *, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM a), s AS (SELECT event_id, CAST(sum(CASE WHEN f THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY event_id) AS BIGINT) AS streak FROM r) SELECT event_id, streak, streak >= 3 AS open FROM s",
    "latest_pointer": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "stratum_keys": _with("cases", "\nSELECT case_id, concat_ws('|', stratum, organization, detector_output, claim_impact, array_to_string(list_sort([CAST(team AS VARCHAR), month]), '+')) AS key FROM cases"),
    "route_extract": f"SELECT page_id, lower(regexp_extract(url, '^https?://([^/]+)', 1)) AS service, {_ROUTE.format('p', _CLEAN.format('p'))} AS route FROM (SELECT *, coalesce(nullif(regexp_extract(url, '^https?://[^/]+(/.*)?$', 1), ''), '/') AS p FROM pages)",
    "link_references": f"SELECT {_ROUTE.format('p', _CLEAN.format('p'))} AS route, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1)) AS p FROM pages) GROUP BY 1",
}

#: Columns of a metric set's proportion over pull requests.
_PR = f""", pr AS (SELECT organization, pull_request, max(weight) AS w, bool_or({_SEL}) AS alerted, bool_or(coalesce({_ACT}, false)) AS success, bool_and(coalesce(label_action = 'indeterminate', false)) AS open, bool_or(detector_output <> 'not_analysed') AS analysed,
    sum(CASE WHEN {_SEL} THEN weight ELSE 0 END) AS fw, sum(CASE WHEN detector_output IN ('candidate', 'abstained') THEN weight ELSE 0 END) AS dw, sum(CASE WHEN label_action IS NOT NULL THEN weight ELSE 0 END) AS lw, sum(weight) AS cw, sum(weight * cost_microunits) AS cost,
    count(*) AS n, count(*) FILTER (independently_labelled) AS ind, count(*) FILTER (analysis_outcome = 'superseded') AS sup, count(*) FILTER (analysis_outcome = 'timeout') AS tim FROM cases GROUP BY 1, 2)"""


def _arm(name: str, strata: str, impacts: str, respect: bool) -> str:
    sel = f"(detector_output = 'candidate' AND stratum IN ({strata}) AND claim_impact IN ({impacts})" + (" AND NOT suppressed)" if respect else ")")
    real = f"(SELECT * FROM (SELECT * REPLACE ({sel} AS policy_selected) FROM all_cases) WHERE subset <> 'mutation')"
    c, s, i = RULES["actionable_precision"]
    low = _lower("successes", "total", _Z1)
    return f"""SELECT '{name}' AS arm, a.deliveries, a.abstentions, a.suppressions, m.total, m.successes, {low} AS lower95, p.alerted_per_thousand,
        concat_ws(',', CASE WHEN p.alerted_per_thousand > 500 THEN 'alert_budget_exceeded' END, CASE WHEN m.total = 0 THEN 'no_labelled_deliveries' END) AS warnings
        FROM (SELECT count(*) FILTER ({sel}) AS deliveries, count(*) FILTER (detector_output = 'abstained' OR detector_output = 'candidate' AND NOT {sel} AND NOT suppressed) AS abstentions, count(*) FILTER (detector_output = 'candidate' AND suppressed) AS suppressions FROM all_cases) a,
        (SELECT count(*) FILTER ({c} AND NOT {i}) AS total, count(*) FILTER ({c} AND NOT {i} AND {s}) AS successes FROM {real}) m,
        (SELECT {_ratio('sum(w) FILTER (alerted) * 1000', 'sum(w)')} AS alerted_per_thousand FROM (SELECT max(weight) AS w, bool_or({_SEL}) AS alerted FROM {real} GROUP BY organization, pull_request)) p"""


_GROUPED = """(SELECT unnest(['stratum', 'contract_kind', 'language_pair', 'organization', 'month']) AS "grouping", unnest([stratum, contract_kind, language_pair, organization, month]) AS value, * FROM cases)"""
_SUITS = "(active.scope = 'occurrence' AND active.occurrence_id = c.occurrence_id OR active.scope = 'stable_finding' AND active.fingerprint = c.fingerprint OR active.scope = 'contract_consumer' AND active.contract_kind = c.contract_kind AND active.canonical_key = c.canonical_key AND active.consumer = c.consumer OR active.scope = 'repository_pair_kind' AND active.producer = c.producer AND active.consumer = c.consumer AND active.contract_kind = c.contract_kind OR active.scope = 'adapter_rule' AND active.adapter = c.adapter AND active.adapter_rule IN (c.rule_one, c.rule_two) OR active.scope = 'workspace_rule' AND active.adapter_rule IN (c.rule_one, c.rule_two))"
_DIM = ["latency_ms", "provider_requests", "source_bytes", "storage_queries", "artifacts", "model_tokens"]


def _dimensions(files: str, complete: str) -> str:
    """Coverage of generations, a SELECT for each dimension."""
    g = f"""SELECT generation_id, {complete} AS complete, count(*) AS n, count(*) FILTER (parse_state = 'failed') AS f, count(*) FILTER (parse_state = 'skipped') AS k, count(*) FILTER (parse_state = 'parsed') AS p,
        count(*) FILTER (language <> 'unknown') AS l, count(*) FILTER (classification = 'source' AND parse_state = 'parsed') AS ok FROM {files} GROUP BY 1"""
    rows = (
        ("repository", "CASE WHEN complete AND f = 0 THEN 'complete' ELSE 'partial' END", "1", "1", "0", "CASE WHEN complete THEN 0 ELSE 1 END", "CASE WHEN NOT complete THEN 'incomplete_tree' END"),
        ("tree", "CASE WHEN complete THEN 'complete' ELSE 'partial' END", "n", "n", "0", "CASE WHEN complete THEN 0 ELSE 1 END", "CASE WHEN NOT complete THEN 'incomplete_tree' END"),
        ("file", "CASE WHEN f = 0 THEN 'complete' ELSE 'partial' END", "n", "n - f", "k", "f", "NULL"),
        ("language", "CASE WHEN l = n THEN 'complete' ELSE 'partial' END", "n", "l", "n - l", "0", "CASE WHEN l <> n THEN 'unsupported_language' END"),
        ("parser", "CASE WHEN ok = n THEN 'complete' ELSE 'partial' END", "n", "p", "k", "f", "NULL"),
        ("adapter", "'not_analysed'", "0", "0", "0", "0", "NULL"),
    )
    names = ("state", "eligible", "processed", "skipped", "failed", "reason")
    return f", g AS ({g})\n" + " UNION ALL ".join(
        f"SELECT generation_id, '{r[0]}' AS dimension, " + ", ".join(f"CAST({e} AS {'VARCHAR' if n in ('state', 'reason') else 'BIGINT'}) AS {n}" for n, e in zip(names, r[1:], strict=True)) + " FROM g" for r in rows
    )


_EXTENSION = "regexp_extract(lower(path), '\\\\.[^./]*$')"
_PARSED = CLASSIFIED + f""", parsed AS (SELECT *, repository AS generation_id, CASE WHEN classification <> 'source' THEN 'skipped' WHEN blob % 37 = 0 THEN 'failed' ELSE 'parsed' END AS parse_state,
    CASE WHEN classification = 'source' THEN CASE {_EXTENSION} WHEN '.ts' THEN 'typescript' WHEN '.py' THEN 'python' WHEN '.sql' THEN 'sql' ELSE 'markdown' END WHEN entry_kind <> 'file' THEN entry_kind ELSE 'unknown' END AS language FROM classified)"""
_SHA = "substr(sha256(CAST({0} AS VARCHAR)), 1, 40)"
_TREE = ", b AS (SELECT path, sha256(text) AS h, entry_kind AS k, blob % 5 = 0 AS b FROM artifacts WHERE blob % 9 <> 0), d AS (SELECT CASE WHEN blob % 10 = 0 THEN concat('moved/', path) ELSE path END AS path, sha256(text) AS h, CASE WHEN blob % 31 = 0 THEN 'file' ELSE entry_kind END AS k, blob % 5 = 0 AS b FROM artifacts WHERE blob % 8 <> 0 UNION ALL SELECT concat('copy/', path), sha256(text), entry_kind, blob % 5 = 0 FROM artifacts WHERE blob % 7 = 1 AND blob % 8 <> 0 AND blob % 9 <> 0)"
_PATHS = "concat('src/p', CAST(p_partkey AS VARCHAR), '.ts') AS path"


_OWNER = "CASE WHEN consumer % 2 = 0 THEN CAST(consumer AS VARCHAR) ELSE 'module' END"
_SECRETS = "concat('hmac-sha256:', " + _hmac(_SECRET, "encode(concat(CAST(length({n}) AS VARCHAR), ':', {n}, CAST(length({p}) AS VARCHAR), ':', {p}, CAST(length({i}) AS VARCHAR), ':', {i}))") + ")"
_WORDS = ["int2", "integer", "INT8", "numeric", "varchar(10)", "character varying(20)", "text", "varchar", "boolean"]
_COMPATIBLE = f"CASE WHEN b <> a THEN CASE WHEN {_widens('b', 'a')} THEN 'compatible' WHEN {_widens('a', 'b')} THEN 'breaking' ELSE 'potentially_breaking' END WHEN bn IS DISTINCT FROM an THEN CASE WHEN an IS NOT DISTINCT FROM false THEN 'breaking' WHEN bn IS NOT DISTINCT FROM false AND an IS NOT DISTINCT FROM true THEN 'compatible' ELSE 'potentially_breaking' END ELSE 'compatible' END"
_QUOTED = "concat('a \"b\" \\ ', p_name)"

SQL |= {
    "flagship": _with(_F, FINDINGS + "\nSELECT change_kind, compatibility, consumer_state, state, action, basis, count(*) AS findings, count(DISTINCT consumer) AS consumers FROM findings GROUP BY ALL"),
    "changed_contract_join": _with(_J, JOINED + "\nSELECT canonical_key, consumer, reference_id, basis, change_kind, compatibility FROM edges"),
    "join_diagnostics": _with(_J, JOINED + '\nSELECT diagnostic, count(*) AS n, count(DISTINCT concat(consumer, \' \', reference_id)) AS "references" FROM problems GROUP BY 1'),
    "edge_ids": _with(_J, JOINED + "\nSELECT edge_id, stratum_key FROM edges"),
    "first_definitions": _with(_J, JOINED + "\nSELECT canonical_key, producer, change_kind, service, producer_generation FROM changed"),
    "selected_references": _with("generations observations refs", SELECTED + "\nSELECT reference_id, consumer, generation_id FROM refsel"),
    "alias_resolve": _with("refs aliases services", _resolved("refs") + "\nSELECT state, service, rewritten_path, count(*) AS n FROM resolved GROUP BY ALL"),
    "consumer_selection": _with("generations observations", STATES + "\nSELECT * FROM states"),
    "generation_selection": _with("generations observations", STATES + "\nSELECT repository, generation_id, state FROM selected"),
    "findings": _with(_F, FINDINGS + "\nSELECT fingerprint, canonical_key, consumer, basis, change_kind, state, reason, action FROM findings"),
    "analysis_completeness": _with(_F, FINDINGS + "\nSELECT CASE WHEN (SELECT count(*) FROM states WHERE consumer_state <> 'current') + (SELECT count(*) FROM problems) > 0 THEN 'partial' ELSE 'complete' END AS completeness, count(*) AS findings, count(*) FILTER (state = 'ABSTAINED') AS abstained, (SELECT count(*) FROM problems) AS diagnostics FROM findings"),
    "abstentions": _with(_F, FINDINGS + f"\nSELECT consumer, reason FROM findings WHERE state = 'ABSTAINED' UNION SELECT repository, {REASON} FROM states WHERE {REASON} IS NOT NULL"),
    "check_coverage": _with(_F, FINDINGS + f"\nSELECT (SELECT count(*) FROM states WHERE consumer_state = 'current') AS current_consumers, (SELECT count(*) FROM states WHERE consumer_state = 'unauthorized') AS permission_limited_consumers, (SELECT count(*) FROM states WHERE consumer_state = 'failed') AS failed_consumers, (SELECT count(*) FROM (SELECT consumer, reason FROM findings WHERE state = 'ABSTAINED' UNION SELECT repository, {REASON} FROM states WHERE {REASON} IS NOT NULL)) AS abstentions"),
    "finding_dependencies": _with(_F, FINDINGS + "\nSELECT fingerprint, array_to_string(list_sort(['base.all', concat('base.', contract_kind), concat('head.', contract_kind)]), ',') AS dependencies FROM findings"),
    "touched_keys": _with("definitions_base definitions_head aliases", CHANGES + "\nSELECT concat(contract_kind, ':', canonical_key) AS key FROM changes UNION SELECT concat('registry:', kind, ':', value) FROM aliases WHERE service % 3 = 0"),
    "exact_references": _with(_J, CHANGES + SELECTED + "\nSELECT canonical_key, consumer, reference_id FROM (SELECT contract_kind, canonical_key, consumer, reference_id FROM refsel UNION ALL SELECT contract_kind, canonical_key, 5, concat('own-', canonical_key) FROM definitions WHERE producer = 5 AND position = 0) r WHERE EXISTS (SELECT 1 FROM changes c WHERE c.contract_kind = r.contract_kind AND c.canonical_key = r.canonical_key)"),
    "protocol_mismatches": _with("definitions_base definitions_head definitions refs", CHANGES + "\nSELECT c.contract_kind, c.canonical_key, 'definition' AS side, count(*) AS n FROM changes c JOIN definitions d ON d.contract_kind = c.contract_kind AND d.canonical_key = c.canonical_key AND d.service = 3 GROUP BY ALL UNION ALL SELECT c.contract_kind, c.canonical_key, 'reference', count(*) FROM changes c JOIN refs r ON r.contract_kind = c.contract_kind AND r.canonical_key = c.canonical_key AND r.consumer % 7 = 0 GROUP BY ALL"),
    "described_compatibility": "SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 AND p_size % 2 = 0 THEN CASE WHEN p_partkey % 5 = 0 THEN 'compatible' WHEN p_partkey % 3 = 0 THEN 'breaking' WHEN p_partkey % 3 = 1 THEN 'compatible' ELSE 'unknown' END ELSE 'unknown' END AS compatibility FROM part",
    "read_definitions": _with("definitions", "\nSELECT canonical_key, producer, generation_id FROM definitions WHERE contract_kind = 'ECONOMY' AND canonical_key IN (SELECT concat('part:', l_partkey) FROM lineitem WHERE l_linenumber = 7)"),
    "read_references": _with("refs", ", k AS (SELECT concat('part:', p_partkey) AS k FROM part WHERE p_size < 10)\nSELECT reference_id, consumer FROM refs WHERE canonical_key IN (SELECT k FROM k) OR constrained_key IN (SELECT k FROM k)"),
    "exactness_checks": _with("observations definitions_base definitions_head refs", CHANGES + "\nSELECT 'definition_scope' AS \"check\", (SELECT count(*) FROM definitions_head d LEFT JOIN observations o ON o.generation_id = d.producer + 1 WHERE o.repository IS DISTINCT FROM d.producer) AS violations UNION ALL SELECT 'reference_scope', (SELECT count(*) FROM refs r LEFT JOIN observations o ON o.generation_id = r.generation_id WHERE o.repository IS DISTINCT FROM r.consumer) UNION ALL SELECT 'change_scope', (SELECT count(*) FROM changes WHERE producer NOT IN (SELECT producer FROM definitions_head))"),
    "find_findings": "SELECT fingerprint, analysis_id, is_current FROM (SELECT CAST(o_custkey % 97 AS VARCHAR) AS fingerprint, o_orderkey AS analysis_id, o_orderstatus = 'F' AS is_current, row_number() OVER (PARTITION BY o_custkey % 97 ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 ELSE 1 END, o_orderdate DESC, o_orderkey DESC) AS n FROM orders WHERE o_custkey % 97 < 25) WHERE n = 1",
    "path_aliases": _with("artifacts", """\nSELECT import_id, arg_min(path, 10 * far + i) AS path FROM (SELECT p_partkey AS import_id, far, i, concat(t, 'f', p_partkey, e) AS path FROM part, (SELECT unnest([0, 1, 2]) AS i, unnest(['.ts', '.py', '.md']) AS e), (VALUES (0, 'src/'), (1, 'src/vendor/')) AS v(far, t) WHERE far = 1 OR p_partkey % 7 IN (SELECT r_regionkey FROM region)) c WHERE path IN (SELECT path FROM artifacts) GROUP BY 1"""),
    "reconcile": """WITH p AS (SELECT o_custkey AS r, o_custkey % 5 <> 0 AS sel, CAST(max(o_orderkey) AS VARCHAR) AS head FROM orders WHERE o_orderdate < DATE '1999-01-01' GROUP BY 1), s AS (SELECT o_custkey AS r, o_custkey % 7 <> 0 AS sel, CAST(max(o_orderkey) AS VARCHAR) AS head FROM orders WHERE o_orderdate >= DATE '1996-01-01' GROUP BY 1),
        j AS (SELECT coalesce(p.r, s.r) AS r, p.r IS NOT NULL AS there, p.sel AS now, s.sel AS was, p.head AS ph, s.head AS sh, coalesce(s.sel, false) AND NOT coalesce(p.sel, false) AS gone FROM p FULL JOIN s ON p.r = s.r)
        SELECT r AS repository, 'purge_repository' AS action, CAST(NULL AS BIGINT) AS pull_request, CAST(NULL AS VARCHAR) AS head FROM j WHERE gone
        UNION ALL SELECT r, 'sync_scope', NULL, NULL FROM j WHERE there AND NOT gone AND now IS DISTINCT FROM was
        UNION ALL SELECT r, 'index_default_branch', NULL, ph FROM j WHERE there AND now AND ph IS DISTINCT FROM sh
        UNION ALL SELECT j.r, 'analyze_pull_request', o.o_orderkey, CAST(o.o_orderkey % 3 + CASE WHEN o.o_orderkey % 8 = 0 THEN 5 ELSE 0 END AS VARCHAR) FROM j JOIN orders o ON o.o_custkey = j.r AND o.o_orderkey % 4 = 0 AND o.o_orderdate < DATE '1999-01-01' WHERE there AND NOT gone AND (o.o_orderdate < DATE '1996-01-01' OR o.o_orderkey % 8 = 0)""",
    "coverage_compose": _with("generations observations", STATES + """, latest AS (SELECT o_custkey AS r, max(o_orderkey) AS g FROM orders GROUP BY 1)
        SELECT s.repository, r_name AS family, CASE WHEN s.generation_id IS NOT NULL AND (l.r + length(r_name)) % 3 <> 0 AND l.g = s.generation_id THEN CASE WHEN s.repository % 2 = 0 THEN 'complete' ELSE 'partial' END ELSE 'unavailable' END AS state,
        CASE WHEN s.generation_id IS NULL THEN concat('repository_', s.consumer_state) WHEN l.r IS NULL OR (l.r + length(r_name)) % 3 = 0 OR l.g <> s.generation_id THEN 'family_coverage_unavailable' END AS reason FROM states s CROSS JOIN region LEFT JOIN latest l ON l.r = s.repository"""),
    "tree_compare": _with("artifacts", _TREE + """,\nc AS (SELECT coalesce(b.path, d.path) AS path, CASE WHEN b.path IS NULL THEN 'A' WHEN d.path IS NULL THEN 'D' WHEN b.k <> d.k THEN 'T' WHEN b.h <> d.h THEN 'M' ELSE '=' END AS change, b.h AS old, d.h AS new, coalesce(b.b, false) OR coalesce(d.b, false) AS "binary" FROM b FULL JOIN d ON b.path = d.path),
        s AS (SELECT old, min(path) FILTER (change = 'D') AS moved, min(path) FILTER (change = '=') AS copied FROM c WHERE change IN ('D', '=') GROUP BY 1) SELECT path, CASE WHEN change <> 'A' THEN change WHEN moved IS NOT NULL THEN 'R' WHEN copied IS NOT NULL THEN 'C' ELSE 'A' END AS change, CASE WHEN change = 'A' THEN coalesce(moved, copied) END AS previous_path, "binary" FROM c LEFT JOIN s ON c.new = s.old WHERE change <> '='"""),
    "edge_invalidation": _with("uses generations observations", EDGES + STATES + "\nSELECT edge_id, CASE WHEN invalidated_at IS NULL AND s.repository IS NOT NULL AND producer % 5 = 0 THEN '2000-06-30' ELSE strftime(invalidated_at, '%Y-%m-%d') END AS invalidated_at FROM ev LEFT JOIN selected s ON s.repository = consumer AND s.state = 'complete'"),
    "dimension_coverage": _with("artifacts", _PARSED + _dimensions("parsed", "length(generation_id) % 2 = 0")),
    "overlay_coverage": _with("artifacts", _PARSED + _dimensions("(SELECT * FROM parsed WHERE blob % 3 = 0)", "true")),
    "observation_states": "WITH e AS (SELECT o_custkey AS g, CASE o_orderkey % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'failed' ELSE 'unsupported' END AS state, CASE WHEN o_custkey % 4 = 0 THEN 0 ELSE o_orderkey % 2 END AS items FROM orders) SELECT g AS generation_id, CASE WHEN bool_and(state = 'unsupported') AND sum(items) = 0 THEN 'unsupported' WHEN bool_and(state IN ('failed', 'unsupported')) AND sum(items) = 0 THEN 'failed' WHEN bool_and(state = 'complete') THEN 'complete' ELSE 'partial' END AS state FROM e WHERE g % 4 > 0 OR state <> 'complete' GROUP BY 1",
    "limitation_dedupe": "SELECT event_type AS code, user_id % 5 AS scope, count(*) AS times FROM events GROUP BY ALL",
    "pr_level_metrics": _with("cases", _PR + f""",\nx AS (SELECT CAST(sum(n) AS BIGINT) AS sampled_cases, CAST(sum(ind) AS BIGINT) AS independently_labelled, count(*) AS pull_requests, count(*) FILTER (alerted AND NOT open) AS alert_total, count(*) FILTER (alerted AND NOT open AND success) AS alert_successes, count(*) FILTER (alerted AND open) AS alert_indeterminate,
        {_ratio('sum(w) FILTER (alerted AND NOT open AND success)', 'sum(w) FILTER (alerted AND NOT open)')} AS alert_weighted, {_ratio('sum(w) FILTER (analysed)', 'sum(w)')} AS analysis_coverage, {_ratio('sum(fw)', 'sum(dw)')} AS selection_coverage, {_ratio('sum(lw)', 'sum(cw)')} AS label_coverage, {_ratio('sum(fw) * 1000', 'sum(w)')} AS findings_per_thousand,
        {_ratio('sum(w) FILTER (alerted) * 1000', 'sum(w)')} AS alerted_per_thousand, sum(cost) AS total_cost, {_ratio('sum(cost)', 'sum(w)')} AS mean_cost, CAST(sum(sup) AS BIGINT) AS superseded, CAST(sum(tim) AS BIGINT) AS timed_out FROM pr)
        SELECT *, {_lower('alert_successes', 'alert_total', _Z1)} AS alert_lower95, {_ratio('alert_successes', '(alert_total + alert_indeterminate)')} AS alert_worst_case, {_ratio('(alert_successes + alert_indeterminate)', '(alert_total + alert_indeterminate)')} AS alert_best_case FROM x"""),
    "grouped_metrics": _with("cases", "\n" + _metrics(_GROUPED, '"grouping", value')),
    "risk_coverage": _with("cases", f""", strata AS (SELECT DISTINCT stratum FROM cases), total AS (SELECT sum(w) AS population FROM (SELECT max(weight) AS w FROM cases GROUP BY organization, pull_request)), chosen AS (SELECT s.stratum, c.* EXCLUDE (stratum, policy_selected), c.policy_selected AND c.stratum <= s.stratum AS policy_selected FROM strata s CROSS JOIN cases c)
        SELECT stratum, count(*) FILTER ({_AP[0]} AND NOT {_AP[2]}) AS total, count(*) FILTER ({_AP[0]} AND NOT {_AP[2]} AND {_AP[1]}) AS successes, {_ratio(f"sum(weight) FILTER ({_SEL})", "sum(weight) FILTER (detector_output IN ('candidate', 'abstained'))")} AS selection_coverage,
        {_ratio(f'count(*) FILTER ({_AP[0]} AND NOT {_AP[2]} AND {_AP[1]})', f'count(*) FILTER ({_AP[0]} AND NOT {_AP[2]})')} AS actionable_precision, {_ratio(f'sum(weight) FILTER ({_SEL}) * 1000', 'any_value(population)')} AS findings_per_thousand FROM chosen, total GROUP BY 1"""),
    "team_burden": _with("cases", f"\nSELECT team, count(DISTINCT CASE WHEN {_SEL} THEN pull_request END) AS alerted, (SELECT count(DISTINCT opened_on) FROM cases) AS active, round(count(DISTINCT CASE WHEN {_SEL} THEN pull_request END) / (SELECT count(DISTINCT opened_on) FROM cases), 9) AS per_active_day FROM cases GROUP BY 1"),
    "distinct_counts": _with("cases", "\nSELECT count(DISTINCT organization) AS organizations, count(DISTINCT (producer, consumer)) AS pairs FROM cases"),
    "usefulness": _with("cases", f"\nSELECT count(action_observed) AS eligible, count(*) FILTER (action_observed) AS observed_actions, {_ratio('count(*) FILTER (action_observed)', 'count(action_observed)')} AS action_rate, quantile_disc(time_to_action_ms, 0.5) AS median_time_to_action, count(*) FILTER (action_censored) AS censored FROM cases"),
    "suppression_state": _with(_RULES, _STATE + "\nSELECT rule_id, state, CASE state WHEN 'expired' THEN 'fallback_expiry_reached' WHEN 'invalidated' THEN first WHEN 'review_due' THEN 'scheduled_review_due' END AS reason, CASE WHEN state = 'invalidated' THEN reasons ELSE '' END AS reasons FROM ruled"),
    "suppression_audit": _with(_RULES, _STATE + "\nSELECT " + ", ".join(f"count(*) FILTER (scope = '{x}') AS {x}" for x in ("occurrence", "stable_finding", "contract_consumer", "repository_pair_kind", "adapter_rule", "workspace_rule")) + ", count(*) FILTER (scope IN ('adapter_rule', 'workspace_rule')) AS broad_rules, concat_ws(',', CASE WHEN count(*) FILTER (scope IN ('adapter_rule', 'workspace_rule')) >= 3 THEN 'broad_rule_concentration' END, CASE WHEN count(*) FILTER (scope = 'workspace_rule') > 0 THEN 'workspace_rule_active' END) AS anomalies FROM ruled WHERE state = 'active'"),
    "suppression_match": _with(_RULES + " candidates", _STATE + f", active AS (SELECT * FROM ruled WHERE state = 'active'), m AS (SELECT c.occurrence_id, min(active.rule_id) AS rule_id FROM candidates c LEFT JOIN active ON {_SUITS} GROUP BY 1)\n SELECT rule_id, rule_id IS NOT NULL AS suppressed, count(*) AS n FROM m GROUP BY ALL"),
    "authorization": f"WITH {_SCOPE}, l AS (SELECT o_custkey AS repository, arg_max(o_orderkey % 5 = 0, o_orderkey) AS denied, arg_max(o_orderkey % 2, o_orderkey) AS revision FROM orders GROUP BY 1) SELECT s.repository, CASE WHEN l.repository IS NULL THEN 'unavailable' WHEN denied THEN 'denied' WHEN revision <> 1 THEN 'revision_changed' END AS gap FROM scoped s LEFT JOIN l USING (repository) WHERE standing = 'included'",
    "provider_authorization": """WITH q AS (SELECT c_custkey AS repository, CASE WHEN c_custkey % 2 = 0 THEN 'app' ELSE 'user' END AS subject, unnest(['evidence.consume', 'producer_check.write', 'consumer.write']) AS action, c_nationkey FROM customer),
        last AS (SELECT q.repository, q.subject, q.action, arg_max(o_orderkey % 5 = 0, o_orderkey) AS denied FROM q JOIN orders o ON o.o_custkey = q.repository AND ['evidence.consume', 'producer_check.write', 'consumer.write'][o_orderkey % 3 + 1] = q.action AND (o_orderkey % 2 = 0 OR q.subject = 'user') GROUP BY ALL),
        r AS (SELECT q.repository, q.subject, q.action, CASE WHEN q.repository % 11 = 0 THEN 'not_in_current_workspace_scope' WHEN c_nationkey % 4 = 0 THEN 'repository_not_selected' WHEN l.denied IS NULL OR l.denied THEN 'current_consent_denied'
            WHEN q.action = 'consumer.write' OR q.action = 'producer_check.write' AND q.repository % 3 <> 0 OR q.action = 'evidence.consume' AND q.repository % 9 = 0 THEN 'current_provider_grant_denied' ELSE 'current_consent_and_provider_grant' END AS reason FROM q LEFT JOIN last l ON l.repository = q.repository AND l.subject = q.subject AND l.action = q.action)
        SELECT subject, action, repository, reason = 'current_consent_and_provider_grant' AS allowed, reason FROM r""",
    "disclosure": "WITH d AS (SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'static' ELSE 'personalized' END AS audience, CASE WHEN l_partkey % 5 = 0 THEN 'no_explicit_grant' WHEN l_suppkey % 4 = 0 THEN 'app_access_denied' WHEN l_orderkey % 2 = 0 AND l_partkey % 3 = 0 THEN 'whole_audience_safety_unproven' WHEN l_orderkey % 2 = 1 AND l_partkey % 2 = 0 THEN 'viewer_access_denied' END AS omitted FROM lineitem) SELECT audience, omitted IS NULL AS allowed, omitted, count(*) AS n FROM d GROUP BY ALL",
    "promoted_strata": f"WITH {(_PROMOTED := 'promoted AS (SELECT s AS stratum_key, k AS decided_at FROM (SELECT CAST(o_custkey % 60 AS VARCHAR) AS s, max(o_orderkey) AS k FROM orders GROUP BY 1) WHERE k % 3 <> 0 AND k % 2 = 1 AND s IN (SELECT CAST(c_custkey % 60 AS VARCHAR) FROM customer) AND s IN (SELECT CAST(c_custkey % 70 AS VARCHAR) FROM customer))')} SELECT * FROM promoted",
    "delivered_findings": f"WITH {_PROMOTED}, f AS (SELECT concat(l_orderkey, '-', l_linenumber) AS fingerprint, l_orderkey AS o, l_linenumber AS l, CAST(min(l_partkey % 60) AS VARCHAR) AS stratum_key, min(CASE WHEN l_returnflag = 'A' THEN 'ABSTAINED' ELSE 'PREVIEW' END) AS state, bool_or(l_suppkey % 6 = 0) AS suppressed FROM lineitem GROUP BY 1, 2, 3) SELECT fingerprint, stratum_key FROM f WHERE state <> 'ABSTAINED' AND NOT suppressed AND l = 1 AND o % 3 <> 0 AND o IN (SELECT o_orderkey FROM orders) AND stratum_key IN (SELECT stratum_key FROM promoted)",
    "check_annotations": "WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS n FROM lineitem) SELECT CAST(l_partkey AS VARCHAR) AS fingerprint, concat('f', l_orderkey) AS path, l_linenumber AS start_line, CAST(l_linenumber + l_suppkey % 3 AS INTEGER) AS end_line FROM l WHERE n = 1 AND l_partkey IN (SELECT p_partkey FROM part) AND l_linenumber >= 2 AND l_linenumber + l_suppkey % 3 <= l_orderkey % 9 + 2",
    "check_plans": """SELECT o_orderkey AS analysis_id, CASE reason WHEN 'advisory_enabled' THEN 'write' WHEN 'shadow_mode' THEN 'shadow' ELSE 'no_write' END AS mode, reason, CASE WHEN o_orderkey % 13 = 0 THEN 'skipped' WHEN o_orderkey % 23 = 0 OR o_orderstatus <> 'F' OR o_orderkey % 50 > 0 THEN 'neutral' ELSE 'success' END AS conclusion, greatest(o_orderkey % 50 - 20, 0) AS truncated_findings FROM (
        SELECT *, CASE WHEN o_orderkey % 13 = 0 THEN 'repository_out_of_scope' WHEN o_orderkey % 5 = 0 OR o_orderkey % 17 = 0 THEN 'superseded_head' WHEN o_custkey % 6 = 0 THEN 'write_unauthorized' WHEN o_custkey % 19 = 0 THEN 'write_kill_switch' WHEN o_custkey % 4 = 0 THEN 'no_promoted_strata' WHEN o_custkey % 2 <> 0 THEN 'shadow_mode' ELSE 'advisory_enabled' END AS reason FROM orders)""",
    "annotation_batches": "SELECT a AS analysis_id, b AS batch, least(n - 50 * b, 50) AS n FROM (SELECT l_partkey % 20 AS a, count(*) AS n FROM lineitem GROUP BY 1), (SELECT unnest(range(0, 100000)) AS b) WHERE 50 * b < n",
    "policy_arm": _with("all_cases", "\n" + _arm("baseline", "'en'", "'breaking'", True) + " UNION ALL " + _arm("candidate", "'en', 'de', 'fr'", "'breaking', 'behavior_risk'", False)),
    "promotion_fold": _with("generations", """, h AS (SELECT CAST(repository AS VARCHAR) AS stratum, generation_id AS sequence, generation_id % 11 = 0 AS v, state = 'complete' AS ok, generation_id % 4 = 0 AS c FROM generations), o AS (SELECT *, lag(v) OVER w AS before FROM h WINDOW w AS (PARTITION BY stratum ORDER BY sequence)),
        m AS (SELECT *, before IS NOT NULL AND v <> before AND NOT c AS changed FROM o), n AS (SELECT *, coalesce(lag(ok AND NOT changed) OVER (PARTITION BY stratum ORDER BY sequence), false) AS was FROM m)
        SELECT stratum, sequence, CASE WHEN changed THEN 'UNMEASURED' WHEN ok THEN 'PROMOTED' WHEN was THEN 'DEMOTED' ELSE 'PREVIEW' END AS state, CASE WHEN changed THEN 'reset_unmeasured' WHEN ok THEN 'promote' WHEN was THEN 'demote' ELSE 'remain_preview' END AS decision, CASE WHEN changed THEN 'incompatible_version_change' WHEN ok THEN '' ELSE 'x' END AS reasons FROM n"""),
    "population_sample": _with("cases", f"\nSELECT case_id, CASE WHEN detector_output IN ('candidate', 'abstained') THEN 1.0 ELSE 0.5 END::DOUBLE AS inclusion_probability, CASE WHEN detector_output IN ('candidate', 'abstained') THEN 1.0 ELSE 2.0 END::DOUBLE AS sampling_weight FROM cases WHERE detector_output IN ('candidate', 'abstained') OR CAST(concat('0x', substr(sha256(concat('\"seed', '\\u0000', pull_request, '\"')), 1, 13)) AS BIGINT) / 4503599627370496.0 < 0.5"),
    "service_overlaps": _with("services", "\n, v AS (SELECT id, valid_from, coalesce(valid_until, valid_from + 1000) AS valid_until FROM services UNION ALL SELECT id, valid_from + CAST(id % 11 * 250 AS INTEGER), CASE WHEN id % 3 = 0 THEN valid_from + CAST(id % 11 * 250 AS INTEGER) + 400 ELSE DATE '9999-12-31' END FROM services), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY valid_from, valid_until) AS n FROM v)\nSELECT DISTINCT b.id, strftime(b.valid_from, '%Y-%m-%d') AS valid_from FROM n a JOIN n b ON a.id = b.id AND a.n < b.n AND b.valid_from < a.valid_until"),
    "corpus_manifest": _with("all_cases", "\nSELECT " + f"concat('sha256:', sha256(concat(count(*), ':', {_LANES}))) AS case_ids_hash, " + ", ".join(f"count(*) FILTER (subset = '{x}') AS {x}" for x in ("historical", "executable_replay", "mutation", "forward_shadow")) + ", count(*) AS cases, count(*) FILTER (releaseability = 'public' AND research_consent AND evaluation_consent) AS public_cases, count(DISTINCT pull_request) AS pull_requests, count(DISTINCT pull_request) <= 1000 AS population_valid FROM all_cases"),
    "replay_labels": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 1 THEN 'breaking' WHEN o_orderkey % 4 = 0 AND o_custkey % 3 <> 0 THEN 'compatible' ELSE 'indeterminate' END AS label FROM orders",
    "webhook_route": f"""WITH w AS (SELECT event_id, user_id, event_type AS t, CASE event_id % 5 WHEN 0 THEN 'index_generation' WHEN 1 THEN CASE WHEN user_id % 2 = 0 THEN 'reconcile_provider' ELSE 'analyze_pull_request' END WHEN 2 THEN 'record_review' WHEN 3 THEN 'reconcile_provider' END AS job FROM events)
        SELECT event_id, job, CASE job WHEN 'analyze_pull_request' THEN {_hash({"workspaceId": "'wsp-1'", "repositoryId": "concat('github:', user_id)", "kind": "job", "pullRequestNumber": ("n", "user_id % 9 + 1")})}
            WHEN 'index_generation' THEN {_hash({"workspaceId": "'wsp-1'", "repositoryId": "concat('github:', user_id)", "kind": "job", "ref": "CASE WHEN user_id % 3 > 0 THEN concat('refs/heads/', t) ELSE 'unknown' END"})} END AS supersession_key, CASE WHEN job IS NULL THEN 'unsupported_webhook_event' END AS failure FROM w""",
    "webhook_receive": f"""WITH r AS (SELECT *, CAST(event_id AS VARCHAR) AS delivery_id, CASE event_id % 3 WHEN 0 THEN 'push' WHEN 1 THEN 'pull_request' ELSE 'star' END AS kind,
        CASE WHEN event_id % 10 = 9 THEN 'signature_invalid' WHEN event_id % 3 = 2 THEN 'event_unsupported' WHEN event_id % 3 = 1 AND event_id % 4 <> 1 THEN 'action_unsupported' WHEN event_id % 3 = 0 AND event_id % 7 = 0 THEN 'payload_invalid' END AS reason FROM events)
        SELECT delivery_id, kind AS event_type, reason, CASE WHEN reason IS NULL THEN event_id + 1 END AS repository, CASE WHEN reason IS NULL AND kind = 'pull_request' THEN user_id + 1 END AS pull_request, CASE WHEN reason IS NULL AND kind = 'push' THEN {_SHA.format('event_id + 1')} END AS after, CASE WHEN reason IS NULL AND kind = 'pull_request' THEN user_id % 2 = 0 END AS fork FROM r""",
    "budget_running": "SELECT user_id, event_id, amount, CAST(used AS BIGINT) AS used, used <= 100000 AS granted, used > 100000 AND used - amount <= 100000 AS exhausts FROM (SELECT user_id, event_id, amount, sum(amount) OVER (PARTITION BY user_id ORDER BY event_id) AS used FROM (SELECT user_id, event_id, CAST(round(value * 100) AS BIGINT) AS amount FROM events))",
    "audit_append": "SELECT e.user_id, e.event_id, coalesce(h.top, 0) + row_number() OVER (PARTITION BY e.user_id ORDER BY e.event_id) AS sequence FROM events e LEFT JOIN (SELECT user_id, max(event_id) AS top FROM events WHERE event_id % 3 = 0 GROUP BY 1) h ON h.user_id = e.user_id WHERE e.event_id % 3 = 1",
    "kill_switches": _with("queue", "\nSELECT kind AS lane, CASE WHEN state = 'available' AND kind IN ('click', 'error') THEN 'held' ELSE state END AS state, count(*) AS n FROM queue GROUP BY ALL"),
    "stable_ids": _with("refs", f"\nSELECT reference_id, CASE WHEN coalesce(canonical_key, unresolved_pattern) IS NOT NULL THEN concat('ref_', {_hash({'contractKind': 'contract_kind', 'target': 'coalesce(canonical_key, unresolved_pattern)', 'semanticOwner': _OWNER, 'evidenceStratum': 'stratum'})}) END AS stable_id FROM refs"),
    "length_prefixed_hashes": "SELECT p_partkey, concat('sha256:', sha256(unhex(lpad(hex(strlen(p_name)), 16, '0')) || encode(p_name) || unhex(lpad(hex(strlen(p_brand)), 16, '0')) || encode(p_brand) || unhex('0000000000000000'))) AS hash FROM part",
    "shape_hashes": f"SELECT p_partkey, {_hash({'type': 'p_type', 'size': ('n', 'p_size'), 'names': ['p_name', 'p_brand'], 'extra': {'none': None, 'quoted': _QUOTED}})} AS hash FROM part",
    "secret_references": "SELECT s_suppkey, " + _SECRETS.format(n="'prod'", p="s_name", i="CAST(s_suppkey AS VARCHAR)") + " AS reference FROM supplier",
    "npm_specifiers": "WITH f AS (SELECT * FROM (VALUES (0, 'lodash', 'lodash', '.'), (1, 'lodash/fp//x/', 'lodash', './fp/x'), (2, '@scope/pkg', '@scope/pkg', '.'), (3, '@scope/pkg/sub', '@scope/pkg', './sub'), (4, './local', NULL, NULL), (5, 'node:fs', NULL, NULL), (6, '/abs', NULL, NULL), (7, '@scope', NULL, NULL), (8, '', NULL, NULL), (9, 'a/./b', 'a', './b')) AS f(i, specifier, package, subpath)) SELECT p_partkey, specifier, package, subpath FROM part JOIN f ON f.i = p_partkey % 10",
    "identifiers": "SELECT o_orderkey, o_orderkey % 3 < 2 AS \"commit\", o_custkey % 4 = 3 AS path FROM orders",
    "payload_compatibility": "SELECT p_partkey, CASE WHEN p_partkey % 17 = 0 THEN 'unknown' WHEN p_partkey % 19 = 0 OR p_partkey % 3 > p_size % 4 OR p_partkey % 4 > p_size % 5 THEN 'breaking' WHEN p_size % 3 > p_partkey % 2 THEN 'potentially_breaking' ELSE 'compatible' END AS compatibility FROM part",
    "signature_compatibility": """WITH c AS (SELECT p_partkey, p_partkey % 13 <> 0 AS known, least(1 + p_partkey % 2, 2) AS b1, 1 AS b2, least(1 + p_partkey % 3, 2) AS a1, least(1 + p_partkey % 4, 2) AS a2, p_partkey % 2 = 0 AND (p_partkey % 3 = 0) AS kept, p_partkey % 5 = 0 AS impl FROM part)
        SELECT p_partkey, CASE WHEN NOT known THEN 'unknown' WHEN least(a1, a2) > greatest(b1, b2) THEN 'breaking' WHEN kept THEN CASE WHEN impl THEN 'potentially_breaking' ELSE 'compatible' END ELSE 'potentially_breaking' END AS compatibility FROM c""",
    "type_widening": f"WITH f AS (SELECT DISTINCT {_WORDS}[p_partkey % 9 + 1] AS b, p_partkey % 2 = 0 AS bn, p_size % 3 = 0 AS an FROM part), p AS (SELECT b, bn, an, unnest({_WORDS}) AS a FROM f) SELECT b AS before, a AS after, bn AS was_null, an AS is_null, {_widens('b', 'a')} AS widens, {_COMPATIBLE} AS compatibility FROM p",
    "http_contracts": f"""WITH s AS (SELECT p_partkey, p_size, {_PATHS} FROM part) SELECT path, 'definition' AS role, 'GET' AS method, CAST(NULL AS VARCHAR) AS host, concat('/parts/', p_partkey, '/{{param}}') AS route FROM s UNION ALL SELECT path, 'reference', 'POST', concat('host', p_size, '.io'), '/parts/{{param}}' FROM s
        UNION ALL SELECT path, 'reference', 'PUT', NULL, concat('/s/', p_size) FROM s WHERE p_partkey % 2 = 0 UNION ALL SELECT path, 'reference', 'DELETE', NULL, '/o' FROM s WHERE p_partkey % 3 = 0 UNION ALL SELECT path, 'limitation', 'dynamic_url', NULL, NULL FROM s WHERE p_partkey % 3 = 0""",
    "configuration_facts": f"""WITH s AS (SELECT p_partkey, p_size, {_PATHS} FROM part) SELECT path, 'reference' AS role, 'configuration_key' AS kind, concat('KEY_', p_partkey) AS key FROM s UNION ALL SELECT path, 'reference', 'configuration_key', concat('k', p_size) FROM s UNION ALL SELECT path, unnest(['definition', 'reference']), 'feature_flag', concat('f', p_size) FROM s WHERE p_partkey % 2 = 0
        UNION ALL SELECT path, 'reference', 'secret_reference', """ + _SECRETS.format(n="'prod'", p="'vault'", i="concat('s', p_size)") + " FROM s WHERE p_partkey % 3 = 0 UNION ALL SELECT path, 'limitation', 'limitation', 'computed_configuration_key' FROM s WHERE p_partkey % 3 = 0",
    "event_bindings": f"""WITH s AS (SELECT p_partkey, p_size, {_PATHS} FROM part) SELECT path, 'kafka' AS provider, 'producer' AS role, 'topic' AS kind, CAST(NULL AS VARCHAR) AS namespace, concat('orders-', p_size) AS destination FROM s UNION ALL SELECT path, 'kafka', 'consumer', 'topic', NULL, concat('orders-', p_partkey) FROM s
        UNION ALL SELECT path, 'aws_sqs', 'producer', 'queue', concat('aws:eu-west-1:', p_partkey), 'jobs' FROM s WHERE p_partkey % 2 = 0 UNION ALL SELECT path, 'aws_sns', 'consumer', 'topic', 'aws:us-east-1:7', concat('t', p_size) FROM s WHERE p_partkey % 3 = 0 UNION ALL SELECT path, 'gcp_pubsub', 'producer', 'topic', NULL, concat('g', p_size) FROM s WHERE p_partkey % 3 = 0""",
    "module_exports": f"""WITH s AS (SELECT p_partkey, p_size, {_PATHS} FROM part) SELECT path, 'export' AS role, concat('make', p_partkey) AS name, CAST(NULL AS VARCHAR) AS source, CAST(NULL AS VARCHAR) AS imported, CAST(NULL AS VARCHAR) AS kind FROM s UNION ALL SELECT path, 'export', concat('outer', p_size), NULL, NULL, NULL FROM s UNION ALL SELECT path, 'export', 'plain', NULL, NULL, NULL FROM s
        UNION ALL SELECT path, 'reexport', '*', concat('./m', p_size), '*', 'static' FROM s WHERE p_partkey % 2 = 0 UNION ALL SELECT path, 'import', concat('./m', p_size), concat('./m', p_size), NULL, 'static' FROM s WHERE p_partkey % 2 = 0 UNION ALL SELECT path, 'reexport', 'B', 'lib', 'A', 'static' FROM s WHERE p_partkey % 3 = 0
        UNION ALL SELECT path, 'import', x, x, NULL, 'static' FROM (SELECT path, p_partkey, unnest(['lib', './y']) AS x FROM s) WHERE p_partkey % 3 = 0 UNION ALL SELECT path, 'import', x, x, NULL, k FROM (SELECT path, p_partkey, unnest(['./lazy', 'old']) AS x, unnest(['dynamic', 'require']) AS k FROM s) WHERE p_partkey % 5 = 0""",
    "reexport_closure": "SELECT concat('src/p', a.p_partkey, '.ts') AS path, concat('own', b.p_partkey) AS name, concat('src/p', b.p_partkey, '.ts') AS declared_in, CAST(a.p_partkey - b.p_partkey AS INTEGER) AS steps FROM part a JOIN part b ON b.p_partkey <= a.p_partkey AND a.p_partkey // 10 = b.p_partkey // 10",
    "symbol_overloads": "SELECT CASE WHEN p_size % 2 = 0 THEN 'type' ELSE 'value' END AS space, p_type AS name, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS overloads FROM part GROUP BY 1, 2",
    "api_operations": f"""WITH s AS (SELECT p_partkey, p_size, {_PATHS} FROM part) SELECT path, 'operation' AS kind, concat('make', p_partkey) AS name, '' AS detail FROM s WHERE p_partkey % 3 = 0 UNION ALL SELECT path, 'limitation', 'YamlError', NULL FROM s WHERE p_partkey % 3 <> 0 AND p_partkey % 7 = 0
        UNION ALL SELECT path, 'operation', concat('get', p_partkey), 'id' FROM s WHERE p_partkey % 3 <> 0 AND p_partkey % 7 <> 0 UNION ALL SELECT path, 'operation', concat('DELETE /parts/{{}}/s', p_size), 'force,id' FROM s WHERE p_partkey % 3 <> 0 AND p_partkey % 7 <> 0""",
    "message_schemas": f"WITH s AS (SELECT p_partkey, p_size, {_PATHS} FROM part) SELECT path, 'field' AS kind, concat('p', p_partkey, '.M#', p_size) AS name, 'a:T:L' AS detail FROM s UNION ALL SELECT path, 'field', concat('p', p_partkey, '.M.N#2'), 'b:U:None' FROM s UNION ALL SELECT path, 'method', concat('p', p_partkey, '.S/Go'), 'I->O' FROM s",
    "infrastructure_facts": f"""WITH s AS (SELECT p_partkey, p_size, {_PATHS}, CASE WHEN p_partkey % 4 = 0 THEN 'chart' WHEN p_partkey % 4 = 1 THEN 'module' WHEN p_partkey % 28 = 2 THEN 'include' ELSE 'yaml' END AS form FROM part)
        SELECT path, 'service' AS kind, concat('web-', p_size) AS name, '' AS detail FROM s WHERE form = 'chart' UNION ALL SELECT path, 'limitation', 'helm_template_unresolved', '' FROM s WHERE form = 'include'
        UNION ALL SELECT path, 'service', concat('r', p_partkey), '' FROM s WHERE form = 'module' UNION ALL SELECT path, 'endpoint', concat('r', p_partkey), concat(p_size, '/TCP') FROM s WHERE form = 'module' UNION ALL SELECT path, 'output', concat('o', p_partkey), '' FROM s WHERE form = 'module' UNION ALL SELECT path, 'output_reference', 'vpc', 'net' FROM s WHERE form = 'module'
        UNION ALL SELECT path, 'service', concat('svc', p_partkey), '' FROM s WHERE form = 'yaml' UNION ALL SELECT path, 'endpoint', concat('svc', p_partkey), concat(p_size, '/TCP') FROM s WHERE form = 'yaml' UNION ALL SELECT path, 'endpoint', concat('svc', p_partkey), '53/UDP' FROM s WHERE form = 'yaml'
        UNION ALL SELECT path, 'workload', concat('deployment/d', p_partkey), '' FROM s WHERE form = 'yaml' UNION ALL SELECT path, 'container', concat('d', p_partkey, '/main'), '' FROM s WHERE form = 'yaml'""",
    "sql_references": f"WITH s AS (SELECT p_partkey, p_size, {_PATHS} FROM part) SELECT path, 'reads' AS role, concat('t', p_size) AS name FROM s UNION ALL SELECT path, 'reads', 'public.u' FROM s UNION ALL SELECT path, 'writes', concat('v', p_partkey) FROM s UNION ALL SELECT path, 'model', 'order' FROM s WHERE p_partkey % 2 = 0",
    "migrated_schema": """WITH s AS (SELECT CAST(p_partkey AS VARCHAR) AS namespace, p_partkey, p_size FROM part) SELECT namespace, 'enum' AS kind, 'mood' AS name, concat('a,b;', p_size) AS shape FROM s UNION ALL SELECT namespace, 'table', 'u', '' FROM s WHERE p_partkey % 2 = 0 UNION ALL SELECT namespace, 'column', 'u.id', 'int4|not null' FROM s WHERE p_partkey % 2 = 0
        UNION ALL SELECT namespace, 'column', 'u.name', concat('varchar(', p_size + 1, ')|not null') FROM s WHERE p_partkey % 2 = 0 UNION ALL SELECT namespace, 'column', 'u.note', 'text|null' FROM s WHERE p_partkey % 2 = 0""",
    "family_diff": f"""WITH t AS (SELECT p_partkey AS k, p_size AS z, ['database.column', 'database.enum', 'http.route', 'event.topic'][p_partkey % 4 + 1] AS kind, {_WORDS}[p_partkey % 9 + 1] AS b, {_WORDS}[p_size % 9 + 1] AS a, p_partkey % 8 = 0 AS bn, p_partkey % 3 = 0 AS an, p_partkey % 9 AS producer FROM part)
        SELECT kind AS contract_kind, CAST(k AS VARCHAR) AS canonical_key, producer, CASE WHEN producer = 3 THEN 'added' WHEN producer = 4 THEN 'removed' ELSE 'changed' END AS change_kind,
        CASE WHEN producer = 3 THEN CASE WHEN kind = 'database.column' AND NOT an THEN 'potentially_breaking' ELSE 'compatible' END WHEN producer = 4 THEN 'breaking' WHEN kind = 'database.column' THEN {_COMPATIBLE}
             WHEN kind = 'database.enum' THEN CASE WHEN z % 3 > z % 4 THEN 'breaking' WHEN z % 4 > z % 3 THEN 'potentially_breaking' ELSE 'compatible' END WHEN kind = 'event.topic' THEN CASE WHEN z % 2 = 1 THEN 'breaking' ELSE 'compatible' END ELSE 'compatible' END AS compatibility
        FROM t WHERE producer IN (3, 4) OR k % 5 <> 0""",
    "derived_generations": """WITH g AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'partial' ELSE 'failed' END AS state, o_orderkey % 3 AS c, o_orderkey % 50 AS r, o_orderkey % 5 AS v, CASE WHEN o_orderkey % 6 = 0 THEN o_orderkey - 6 END AS base, CASE WHEN o_orderkey % 6 = 0 THEN o_orderkey - 1 END AS over FROM orders),
        q AS (SELECT CASE WHEN k % 12 = 0 THEN k ELSE -k - 1 END AS id, k - k % 14 % 8 AS base, k AS over, k - k % 7 AS obase FROM g), d AS (SELECT * FROM g WHERE state <> 'failed')
        SELECT q.id AS generation_id, CASE WHEN refused IS NULL THEN CASE WHEN bs = 'partial' OR os = 'partial' THEN 'partial' ELSE 'complete' END END AS state, refused FROM (
            SELECT q.*, b.state AS bs, o.state AS os, CASE WHEN h.k IS NOT NULL THEN CASE WHEN h.base IS DISTINCT FROM q.base OR h.over IS DISTINCT FROM q.over THEN 'generation_id_reused' END WHEN q.id = q.base THEN 'own_base' WHEN b.k IS NULL THEN 'base_not_completed' WHEN o.k IS NULL THEN 'overlay_not_completed'
                WHEN q.obase <> q.base OR q.obase % 3 <> b.c OR q.obase % 50 <> b.r OR q.obase % 5 <> b.v THEN 'overlay_incompatible' END AS refused
            FROM q LEFT JOIN g h ON h.k = q.id LEFT JOIN d b ON b.k = q.base LEFT JOIN d o ON o.k = q.over) q""",
    "generation_ancestry": "SELECT p_partkey AS generation_id, p_partkey % 10 + 1 + CASE WHEN p_partkey // 10 % 4 = 3 AND p_partkey - p_partkey % 10 + 3 <= (SELECT max(p_partkey) FROM part) THEN CASE WHEN p_partkey % 10 >= 3 THEN 1 ELSE 4 - p_partkey % 10 END ELSE 0 END AS layers, p_partkey // 10 % 4 = 3 AND p_partkey - p_partkey % 10 + 3 <= (SELECT max(p_partkey) FROM part) AS cycle FROM part",
    "snapshot_conflicts": """WITH s AS (SELECT o_orderkey AS k, o_orderstatus AS st, CASE WHEN o_orderkey % 10 = 0 THEN o_orderkey - 9 WHEN o_orderkey % 17 = 0 THEN o_orderkey END AS b, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey - 1 END AS gb FROM orders),
        c AS (SELECT CASE WHEN st = 'P' THEN 'generation_not_completed' WHEN k % 11 = 0 AND k % 4 <> -1 THEN 'generation_incompatible' WHEN b = k THEN 'own_base' WHEN b IS NOT NULL AND (b NOT IN (SELECT k FROM s) OR b % 9 <> k % 9) THEN 'base_missing_or_incompatible' WHEN b IS NOT NULL AND gb IS NOT NULL AND b <> gb THEN 'not_the_exact_base' WHEN b IS NULL AND gb IS NOT NULL THEN 'base_required'
            WHEN k % 2 = 1 AND ((k + 1) % 13 = 0 OR k + 1 NOT IN (SELECT k FROM s)) THEN 'partition_missing' WHEN k % 2 = 1 AND k % 19 = 0 THEN 'partition_key_mismatch' WHEN k % 46 = 0 THEN 'generation_has_another' END AS conflict FROM s) SELECT conflict, count(*) AS n FROM c GROUP BY 1""",
    "registry_sync": _with("services aliases", ", k AS (SELECT id FROM services WHERE repository % 4 <> 0 AND repository IN (SELECT c_custkey FROM customer))\nSELECT id AS service, 'service' AS what FROM k UNION ALL SELECT service, 'alias' FROM aliases WHERE service IN (SELECT id FROM k)"),
    "revision_pointers": """WITH o AS (SELECT o_custkey % 30 AS w, CAST(o_orderkey AS VARCHAR) AS r, o_orderkey * 7 % 1000 AS q FROM orders), top AS (SELECT w, r, q FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY q DESC, r DESC) AS n FROM o WHERE q % 2 = 0 OR q % 3 = 0) WHERE n = 1)
        SELECT t.w AS workspace, t.r AS revision, t.q AS sequence, count(*) FILTER (o.q % 6 = 0 AND o.q % 5 = 0) AS conflicts, count(*) FILTER (o.q % 3 = 0 AND o.q % 2 = 1) AS appended FROM top t JOIN o ON o.w = t.w GROUP BY ALL""",
    "manifest_differences": "SELECT DISTINCT o_custkey AS case_id, 'left' AS side FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 1) UNION ALL SELECT c_custkey, 'right' FROM customer WHERE c_custkey % 5 <> 1 AND c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "citation_check": """WITH c AS (SELECT o_orderkey AS k FROM orders), p AS (SELECT k, unnest(range(0, k % 3 + 1)) + k AS id FROM c) SELECT c.k AS candidate_id, c.k % 7 <> 0 AND (SELECT bool_and(p.id % 11 <> 0 AND p.id % 5 <> 0 AND p.id IN (SELECT k FROM c)) FROM p WHERE p.k = c.k) AND ((c.k + 10) % 11 <> 0 AND (c.k + 10) % 5 = 0 AND c.k + 10 IN (SELECT k FROM c)) AS valid FROM c""",
    "resolved_commits": f"""WITH r AS (SELECT o_custkey AS c, {_SHA.format('max(o_orderkey)')} AS s FROM orders GROUP BY 1) SELECT c_custkey AS repository, CASE WHEN c_custkey % 3 = 0 THEN 'v1' ELSE 'main' END AS ref, CASE WHEN (c_custkey % 3 = 0) = (c_custkey % 2 = 1) THEN r.s END AS "commit" FROM customer LEFT JOIN r ON r.c = c_custkey
        UNION ALL SELECT o_custkey + CASE WHEN o_orderkey % 18 = 0 THEN 1 ELSE 0 END, {_SHA.format('o_orderkey')}, CASE WHEN o_orderkey % 18 <> 0 THEN {_SHA.format('o_orderkey')} END FROM orders WHERE o_orderkey % 9 = 0""",
    "artifact_cache": "SELECT CAST(doc_id AS VARCHAR) AS key, strlen(text) <= 65536 AND doc_id % 10 <> 7 AS hit, strlen(text) <= 65536 AND doc_id % 10 = 7 AS corrupt FROM documents",
    "clopper_pearson": "WITH RECURSIVE " + _with("cases", """, t AS (SELECT team, count(*) FILTER (NOT suppressed) AS k, count(*) AS n FROM cases GROUP BY 1),
        b(team, k, n, low, high, step) AS (SELECT team, k, n, CAST(0 AS DOUBLE), k / n, 0 FROM t UNION ALL SELECT team, k, n, CASE WHEN tail < 0.05 THEN mid ELSE low END, CASE WHEN tail < 0.05 THEN high ELSE mid END, step + 1 FROM (
            SELECT *, (low + high) / 2 AS mid, list_sum(list_transform(range(k, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln((low + high) / 2) + (n - i) * ln(1 - (low + high) / 2)))) AS tail FROM b WHERE step < 60 AND k BETWEEN 1 AND n - 1))
        SELECT team, k, n, round(CASE WHEN k = 0 OR n = 0 THEN 0 WHEN k = n THEN pow(0.05, 1.0 / n) ELSE max((low + high) / 2) FILTER (step = 60) END, 9) AS low FROM b GROUP BY team, k, n""")[len("WITH "):],
}
