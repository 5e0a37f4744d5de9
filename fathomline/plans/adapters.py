"""Queries over what adapters give: validation by kind of record, finalised results, generations observed of them, and
the SQL each is compared with. The records are made of the tables, about one in twenty with one of the faults that
a rule is for."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import validation as v
from ..sources.tables import BINDINGS, relation, relation_sql, shared_dir, table

C = F.col
_KIND = "CASE {k} % 4 WHEN 0 THEN 'typescript_symbol' WHEN 1 THEN 'openapi_operation' WHEN 2 THEN 'protobuf_method' ELSE 'protobuf_field' END"
_STAMP = "CASE WHEN {r} % 2 = 0 THEN 'acme.typescript' ELSE 'acme.open-api' END AS adapter_id, CASE WHEN {f} = 16 THEN '9.9.9' ELSE '1.2.3' END AS adapter_version, CAST(1 AS BIGINT) AS identity_version, concat('cfg_sha256:', md5(CAST({r} AS STRING)), CASE WHEN {f} = 17 THEN md5('other') ELSE md5('config') END) AS config_revision"
_PATH = "CASE {f} WHEN 5 THEN '/abs.ts' WHEN 6 THEN 'a//b.ts' WHEN 7 THEN 'a/../b.ts' WHEN 8 THEN 'C:b.ts' WHEN 9 THEN concat('a', chr(92), 'b.ts') WHEN 10 THEN 'cafe\u0301.ts' ELSE concat('src/caf\u00e9', CAST({k} % 50 AS STRING), '.ts') END AS path"
_RANGE = "CASE WHEN {k} % 3 = 0 THEN NULL WHEN {f} = 11 THEN 0 ELSE 5 END AS start_line, CASE WHEN {k} % 3 <> 0 THEN 4 END AS start_column, CASE WHEN {k} % 3 <> 0 THEN CASE WHEN {f} = 12 THEN 4 ELSE 5 END END AS end_line, CASE WHEN {k} % 3 <> 0 THEN 4 + {k} % 2 END AS end_column"

BINDINGS.update({
    "result_headers": """
        SELECT s_suppkey AS result_id, CASE s_suppkey % 37 WHEN 6 THEN 'acme' ELSE CASE WHEN s_suppkey % 2 = 0 THEN 'acme.typescript' ELSE 'acme.open-api' END END AS adapter_id,
               CASE WHEN s_suppkey % 37 = 7 THEN '1.02.3' ELSE '1.2.3' END AS adapter_version, CAST(CASE WHEN s_suppkey % 37 = 8 THEN 0 ELSE 1 END AS BIGINT) AS identity_version,
               concat(CASE WHEN s_suppkey % 37 = 9 THEN 'sha256:' ELSE 'cfg_sha256:' END, md5(CAST(s_suppkey AS STRING)), md5('config')) AS config_revision,
               concat('sha256:', md5(s_name), CASE WHEN s_suppkey % 37 = 10 THEN 'x' ELSE md5('source') END) AS source_fingerprint,
               CASE WHEN s_suppkey % 3 = 0 THEN 'complete' ELSE 'partial' END AS state, CAST(CASE WHEN s_suppkey % 37 = 0 THEN -1 ELSE 9 END AS BIGINT) AS eligible,
               CAST(CASE WHEN s_suppkey % 37 = 1 THEN 10 WHEN s_suppkey % 3 = 0 THEN 8 ELSE 3 END AS BIGINT) AS processed, CAST(CASE WHEN s_suppkey % 37 IN (2, 12) THEN 0 ELSE 1 END AS BIGINT) AS skipped, CAST(0 AS BIGINT) AS failed,
               CASE WHEN s_suppkey % 37 = 3 THEN repeat('m', 257) ELSE 'parse failed' END AS safe_message, CASE WHEN s_suppkey % 37 = 4 THEN 'src/' WHEN s_suppkey % 2 = 0 THEN 'src/a.ts' ELSE '' END AS scope,
               CASE WHEN s_suppkey % 37 = 5 THEN 'sha256:0' WHEN s_suppkey % 5 = 0 THEN concat('sha256:', md5('a'), md5('b')) END AS detail_hash
        FROM {supplier}""",
    "given_definitions": f"""
        SELECT CAST(floor(k / 20) AS BIGINT) AS result_id, k AS position, CASE WHEN f = 0 THEN 'graphql_field' ELSE {_KIND.format(k="k")} END AS contract_kind,
               CASE f WHEN 1 THEN '' WHEN 2 THEN repeat('k', 2049) ELSE concat('part:', CAST(k AS STRING)) END AS canonical_key, CASE f WHEN 3 THEN '  ' WHEN 4 THEN repeat('n', 513) ELSE p_name END AS display_name,
               {_PATH.format(f="f", k="k")}, {_RANGE.format(f="f", k="k")}, CASE WHEN f = 13 THEN 'sha256:XYZ' ELSE concat('sha256:', md5(p_name), md5(p_brand)) END AS content_hash,
               concat(chr(123), '"brand":"', p_brand, '","size":', CAST(p_size AS STRING), chr(125)) AS shape, CASE WHEN f = 14 THEN 'other' ELSE '' END AS salt, CASE WHEN f = 15 THEN repeat('s', 129) ELSE 'exact' END AS evidence_stratum,
               {_STAMP.format(r="CAST(floor(k / 20) AS BIGINT)", f="f")}
        FROM (SELECT p_partkey AS k, p_partkey % 211 AS f, p_name, p_brand, p_size FROM {{part}}) p""",
    "given_references": f"""
        SELECT r AS result_id, k AS position, CASE WHEN f = 0 THEN 'graphql_field' ELSE {_KIND.format(k="l_partkey")} END AS contract_kind,
               CASE WHEN k % 9 = 0 OR f = 3 THEN NULL WHEN f = 1 THEN '' WHEN f = 2 THEN repeat('k', 2049) ELSE concat('part:', CAST(l_partkey AS STRING)) END AS canonical_key,
               CASE WHEN k % 9 = 0 OR f = 4 THEN CASE WHEN f = 14 THEN repeat('p', 2049) ELSE 'computed key' END END AS unresolved_pattern, CASE WHEN k % 9 = 0 OR f = 4 THEN CASE WHEN f = 18 THEN ' ' ELSE 'dynamic' END END AS unresolved_reason,
               {_PATH.format(f="f", k="k")}, {_RANGE.format(f="f", k="k")}, CASE WHEN f = 13 THEN md5('x') ELSE concat('sha256:', md5(CAST(l_partkey AS STRING)), md5('r')) END AS content_hash,
               CASE WHEN f = 19 THEN 'soon' WHEN k % 2 = 0 THEN 'on_deploy' ELSE 'current_runtime' END AS activation, CASE WHEN f = 15 THEN '' ELSE 'call' END AS evidence_stratum, CASE WHEN k % 4 = 0 THEN 'owner' END AS semantic_owner,
               {_STAMP.format(r="r", f="f")}
        FROM (SELECT l_suppkey AS r, l_orderkey * 8 + l_linenumber AS k, (l_orderkey * 7 + l_linenumber) % 5003 AS f, l_partkey FROM {{lineitem}}) l""",
    "given_changes": f"""
        SELECT CAST(floor(k / 20) AS BIGINT) AS result_id, k AS position, CASE WHEN f = 0 THEN 'graphql_field' ELSE {_KIND.format(k="k")} END AS contract_kind, CASE f WHEN 1 THEN '' ELSE concat('part:', CAST(k AS STRING)) END AS canonical_key,
               CASE f WHEN 2 THEN '' ELSE 'operation_changed' END AS change_kind, CASE f WHEN 3 THEN 'fine' ELSE CASE WHEN k % 2 = 0 THEN 'breaking' ELSE 'unknown' END END AS compatibility, CASE f WHEN 4 THEN '' ELSE 'on_upgrade' END AS activation,
               CASE WHEN f = 5 THEN 'sha256:1' WHEN k % 3 = 0 THEN concat('sha256:', md5(p_name), md5('b')) ELSE '' END AS base_shape_hash, CASE WHEN f = 6 THEN 'x' WHEN k % 3 = 1 THEN concat('sha256:', md5(p_name), md5('h')) END AS head_shape_hash,
               CASE WHEN f = 7 THEN ' ' ELSE 'coverage:a' END AS first_dependency, CASE WHEN f = 8 THEN repeat('d', 257) ELSE 'coverage:b' END AS second_dependency, CASE f WHEN 9 THEN '' ELSE 'edit' END AS remedy_kind,
               CASE f WHEN 10 THEN repeat('t', 1025) ELSE 'update the caller' END AS remedy_text, CASE f WHEN 11 THEN '' ELSE 'differ' END AS tool_id, CASE f WHEN 12 THEN '' ELSE '1' END AS tool_version,
               CASE f WHEN 13 THEN 'none' ELSE concat('sha256:', md5('t'), md5('d')) END AS tool_digest, CASE f WHEN 14 THEN '' ELSE 'MIT' END AS tool_license, CASE f WHEN 15 THEN repeat('c', 257) ELSE 'schema' END AS category
        FROM (SELECT p_partkey AS k, p_partkey % 211 AS f, p_name FROM {{part}}) p""",
    "given_manifests": """
        SELECT c_custkey AS manifest_id, c_custkey % 61 AS f, c_name, CASE c_custkey % 61 WHEN 0 THEN '2.0' ELSE '1.0' END AS schema_version, CASE c_custkey % 61 WHEN 1 THEN 'Acme.x' ELSE 'acme.x' END AS id,
               CASE c_custkey % 61 WHEN 2 THEN '1.0' WHEN 60 THEN '1.0.0-rc.1' ELSE '1.0.0' END AS version, CAST(CASE c_custkey % 61 WHEN 3 THEN 0 ELSE 2 END AS BIGINT) AS identity_version,
               CASE c_custkey % 61 WHEN 4 THEN 'openapi_operation' WHEN 5 THEN 'soap' ELSE 'typescript_symbol' END AS second_kind, CASE c_custkey % 61 WHEN 6 THEN 'gold' ELSE 'preview' END AS tier, CASE c_custkey % 61 WHEN 7 THEN '' ELSE '*.ts' END AS tier_input,
               CASE c_custkey % 61 WHEN 8 THEN 'Exact' WHEN 9 THEN 'first' ELSE 'second' END AS second_stratum, CASE c_custkey % 61 WHEN 10 THEN 'MEASURED' ELSE 'UNMEASURED' END AS stratum_state,
               CASE c_custkey % 61 WHEN 11 THEN '' WHEN 12 THEN 'tool' ELSE 'tool-2' END AS second_tool, CASE c_custkey % 61 WHEN 13 THEN 'sha1:0' ELSE concat('sha256:', md5('t'), md5('d')) END AS second_digest, c_custkey % 61 = 14 AS second_network,
               CASE c_custkey % 61 WHEN 15 THEN ' ' ELSE 'bounded forms' END AS limitation, CASE c_custkey % 61 WHEN 16 THEN repeat('m', 257) ELSE c_name END AS maintainer, CAST(CASE c_custkey % 61 WHEN 17 THEN 0 ELSE 100 END AS BIGINT) AS memory
        FROM {customer}""",
})


def _headers(spark, sf_dir):
    diagnostic = F.struct("safe_message", "scope", "detail_hash")
    return relation(spark, sf_dir, "result_headers").withColumn("diagnostics", F.array(diagnostic)).drop("safe_message", "scope", "detail_hash")


def _definitions(spark, sf_dir):
    shape_hash = F.concat(F.lit("sha256:"), F.sha2(F.concat("shape", "salt"), 256))
    return relation(spark, sf_dir, "given_definitions").withColumn("shape_hash", shape_hash).drop("salt")


def _changes(spark, sf_dir):
    tool = F.struct("tool_id", "tool_version", "tool_digest", "tool_license", "category")
    return relation(spark, sf_dir, "given_changes").withColumns({"coverage_dependencies": F.array("first_dependency", "second_dependency"), "differ": tool})


def _manifests(spark, sf_dir):
    stratum = lambda name, state: F.struct(name.alias("id"), state.alias("state"), F.array(F.lit("schema")).alias("evidence"))
    tool = lambda name, digest, network: F.struct(name.alias("id"), F.lit("1").alias("version"), digest.alias("digest"), F.lit("MIT").alias("license"), network.alias("network"))
    good = F.concat(F.lit("sha256:"), F.md5(F.lit("t")), F.md5(F.lit("d")))
    return relation(spark, sf_dir, "given_manifests").withColumns({
        "contract_kinds": F.array(F.lit("openapi_operation"), "second_kind"), "tiers": F.array(F.struct(C("tier_input").alias("input"), "tier")),
        "strata": F.array(stratum(F.lit("first"), F.lit("UNMEASURED")), stratum(C("second_stratum"), C("stratum_state"))), "tools": F.array(tool(F.lit("tool"), good, F.lit(False)), tool(C("second_tool"), C("second_digest"), C("second_network"))),
        "limitations": F.array("limitation"), "budget": F.create_map(F.lit("memory"), "memory"),
    })


def validate_definitions(spark, sf_dir):
    return v.violations(v.with_violation(_definitions(spark, sf_dir), v.definition_violation))


def validate_references(spark, sf_dir):
    return v.violations(v.with_violation(relation(spark, sf_dir, "given_references"), v.reference_violation))


def validate_changes(spark, sf_dir):
    return v.violations(v.with_violation(_changes(spark, sf_dir), v.change_violation))


def validate_coverage(spark, sf_dir):
    return v.violations(v.with_violation(relation(spark, sf_dir, "result_headers"), v.coverage_violation))


def validate_diagnostics(spark, sf_dir):
    return v.violations(v.with_violation(relation(spark, sf_dir, "result_headers"), v.diagnostic_violation))


def validate_manifests(spark, sf_dir):
    return v.violations(v.with_violation(_manifests(spark, sf_dir), v.manifest_violation))


def finalised_extractions(spark, sf_dir):
    return v.finalise_extractions(_headers(spark, sf_dir), _definitions(spark, sf_dir), relation(spark, sf_dir, "given_references"))


def finalised_diffs(spark, sf_dir):
    return v.finalise_diffs(_headers(spark, sf_dir), _changes(spark, sf_dir))


def comparable_extractions(spark, sf_dir):
    h = relation(spark, sf_dir, "result_headers")
    stamp = F.concat("adapter_id", F.lit("@"), "adapter_version", F.lit("#"), C("identity_version").cast("string"))
    side = lambda shift, name, config: h.select((C("result_id") + shift).alias("pair_id"), stamp.alias(name), C("config_revision").alias(config))
    pairs = side(0, "base_stamp", "base_config").join(side(2, "head_stamp", "_head"), "pair_id")
    pairs = pairs.withColumns({"expected": F.concat(F.when(C("pair_id") % 2 == 0, "acme.typescript").otherwise("acme.open-api"), F.lit("@1.2.3#1")), "head_config": F.when(C("pair_id") % 4 < 2, C("base_config")).otherwise(C("_head"))})
    return v.comparable(pairs.withColumn("expected_config", F.when(C("pair_id") % 5 == 0, "cfg_other").when(C("pair_id") % 5 == 1, C("base_config"))))


def checked_write(spark, sf_dir):
    """All references are refused; those without a violation are written, with what was observed on the way."""
    columns, folder = list(v.REFERENCE), f"{shared_dir(spark)}/references-{uuid.uuid4().hex}"
    checked = v.checked_once(relation(spark, sf_dir, "given_references"), v.reference_violation, columns)
    try:
        v.write_checked(checked, columns, folder)
        counts = {}
    except v.Refused as refused:
        counts = refused.counts
    done = v.write_checked(checked.where("violation is null"), columns, folder)
    read = spark.read.parquet(folder).agg(F.count("*").alias("rows_read"))
    return read.select("rows_read", F.lit(done.rows).cast("long").alias("rows_written"), F.lit(done.set_hash).alias("set_hash"), F.lit(sum(counts.values())).cast("long").alias("refused"), F.lit(len(counts)).cast("long").alias("codes"))


def materialised_references(spark, sf_dir):
    return v.materialise_references(relation(spark, sf_dir, "given_references").withColumnRenamed("result_id", "generation_id"), []).select("generation_id", "stable_id", "path", "position")


def observed_generations(spark, sf_dir):
    named = lambda df: df.withColumnRenamed("result_id", "generation_id")
    states = relation(spark, sf_dir, "result_headers").select(C("result_id").alias("generation_id"), "state", C("processed").alias("items"))
    return v.observe_generations(states, named(_definitions(spark, sf_dir)), named(relation(spark, sf_dir, "given_references")))


# The SQL: rules in their order as (code, rule, what must hold).

_HEX = "^sha256:[0-9a-f]{64}$"
_KINDS = "('typescript_symbol', 'openapi_operation', 'protobuf_method', 'protobuf_field')"


def _text(column, name, most=256):
    return [("invalid_manifest", f"{name}_empty", f"trim({column}) <> ''"), ("invalid_manifest", f"{name}_too_long", f"length({column}) <= {most}")]


def _path(column):
    return [("invalid_path", f"path_{n}", h) for n, h in (
        ("empty", f"{column} <> ''"), ("backslash", f"NOT contains({column}, chr(92))"), ("absolute", f"NOT starts_with({column}, '/') AND NOT regexp_matches({column}, '^[A-Za-z]:')"),
        ("not_canonical", f"NOT ends_with({column}, '/') AND NOT contains({column}, '//')"), ("traversal", f"len(list_filter(string_split({column}, '/'), lambda s: s IN ('', '.', '..'))) = 0"), ("not_composed", f"nfc_normalize({column}) = {column}"),
    )]


def _hash_rule(column, name):
    return [("invalid_hash", name, f"regexp_matches({column}, '{_HEX}')")]


def _where(condition, rules):
    return [(c, r, f"NOT coalesce({condition}, false) OR ({h})") for c, r, h in rules]


_RANGES = _where("coalesce(start_line, start_column, end_line, end_column) IS NOT NULL", [
    ("invalid_output", "range_not_positive", "start_line > 0 AND start_column > 0 AND end_line > 0 AND end_column > 0"), ("invalid_output", "range_backwards", "end_line > start_line OR end_line = start_line AND end_column >= start_column"),
])
_KIND_RULE = [("invalid_output", "kind_unknown", f"contract_kind IN {_KINDS}")]
_KEY_RULE = [("invalid_output", "key_not_bounded", "length(canonical_key) BETWEEN 1 AND 2048")]
_DEFINITION = [*_KIND_RULE, *_KEY_RULE, *_text("display_name", "display_name", 512), *_path("path"), *_RANGES, *_hash_rule("content_hash", "content_hash"), *_hash_rule("shape_hash", "shape_hash"),
               ("invalid_output", "shape_hash_differs", "shape_hash = concat('sha256:', sha256(shape))"), *_text("evidence_stratum", "evidence_stratum", 128)]
_REFERENCE = [
    *_KIND_RULE, ("invalid_output", "neither_or_both_resolved", "(canonical_key IS NOT NULL) <> (unresolved_pattern IS NOT NULL AND unresolved_reason IS NOT NULL)"), *_where("canonical_key IS NOT NULL", _KEY_RULE),
    *_where("unresolved_pattern IS NOT NULL", _text("unresolved_pattern", "unresolved_pattern", 2048)), *_where("unresolved_reason IS NOT NULL", _text("unresolved_reason", "unresolved_reason")), *_path("path"), *_RANGES,
    *_hash_rule("content_hash", "content_hash"), ("invalid_output", "activation_unknown", "activation IN ('current_runtime', 'on_upgrade', 'on_deploy', 'unknown')"), *_text("evidence_stratum", "evidence_stratum", 128),
]
_CHANGE = [
    *_KIND_RULE, *_KEY_RULE, *_text("change_kind", "change_kind", 128), ("invalid_output", "compatibility_unknown", "compatibility IN ('breaking', 'potentially_breaking', 'compatible', 'unknown')"),
    ("invalid_output", "activation_unknown", "activation IN ('current_runtime', 'on_upgrade', 'on_deploy', 'unknown')"), *_where("base_shape_hash <> ''", _hash_rule("base_shape_hash", "base_shape_hash")), *_where("head_shape_hash <> ''", _hash_rule("head_shape_hash", "head_shape_hash")),
    *_text("first_dependency", "coverage_dependency"), *_text("second_dependency", "coverage_dependency"), *_text("remedy_kind", "remedy_kind", 128), *_text("remedy_text", "remedy_text", 1024), *_text("tool_id", "tool_id"), *_text("tool_version", "tool_version"),
    *_hash_rule("tool_digest", "tool_digest"), *_text("tool_license", "tool_license"), *_text("category", "category"),
]
_COVERAGE = [
    ("invalid_coverage", "counts_not_whole", "eligible >= 0 AND processed >= 0 AND skipped >= 0 AND failed >= 0"), ("invalid_coverage", "counts_exceed_eligible", "processed + skipped + failed <= eligible"),
    *_where("state = 'complete'", [("invalid_coverage", "complete_leaves_some_out", "failed = 0 AND processed + skipped = eligible")]),
]
_DIAGNOSTIC = [("invalid_diagnostic", "message_not_bounded", "length(safe_message) BETWEEN 1 AND 256"), *_where("scope <> ''", _path("scope")), *_where("detail_hash <> ''", _hash_rule("detail_hash", "detail_hash"))]
_HEADER = [*_COVERAGE, *_DIAGNOSTIC, ("invalid_id", "adapter_id", "regexp_matches(adapter_id, '^[a-z][a-z0-9]*([.-][a-z0-9]+)+$')"), ("invalid_output", "adapter_version", "regexp_matches(adapter_version, '^(0|[1-9][0-9]*)\\.(0|[1-9][0-9]*)\\.(0|[1-9][0-9]*)(-[0-9A-Za-z.-]+)?$')"), ("invalid_output", "identity_version", "identity_version > 0")]
_EXTRACTION = [*_HEADER, ("invalid_id", "config_revision", "regexp_matches(config_revision, '^cfg_sha256:[0-9a-f]{64}$')"), *_hash_rule("source_fingerprint", "source_fingerprint")]
_MANIFEST = [
    ("unsupported_manifest_schema", "schema", "schema_version = '1.0'"), ("invalid_id", "adapter_id", "regexp_matches(id, '^[a-z][a-z0-9]*([.-][a-z0-9]+)+$')"), ("invalid_manifest", "version", "regexp_matches(version, '^[0-9]+\\.[0-9]+\\.[0-9]+(-[0-9A-Za-z.-]+)?$')"),
    ("invalid_manifest", "identity_version", "identity_version > 0"), ("invalid_manifest", "kinds", f"second_kind <> 'openapi_operation' AND second_kind IN {_KINDS}"), ("invalid_manifest", "tiers", "tier_input <> '' AND tier IN ('contract_grade', 'structural', 'preview')"),
    ("invalid_manifest", "stratum_id", "regexp_matches(second_stratum, '^[a-z][a-z0-9]*([._-][a-z0-9]+)*$')"), ("invalid_manifest", "stratum_twice", "second_stratum <> 'first'"), ("invalid_manifest", "stratum_measured", "stratum_state = 'UNMEASURED'"),
    *_text("second_tool", "tool_id"), *_hash_rule("second_digest", "tool_digest"), ("invalid_manifest", "tool_network", "NOT second_network"), ("invalid_manifest", "tool_twice", "second_tool <> 'tool'"), *_text("limitation", "limitation", 512),
    *_text("maintainer", "maintainer"), ("invalid_manifest", "budget", "memory > 0"),
]


def _case(rules, part=1):
    """The code (0) or rule (1) of the first that does not hold."""
    return "CASE " + " ".join(f"WHEN NOT coalesce({h}, false) THEN '{(c, r)[part]}'" for c, r, h in rules) + " END"


def _shaped(name):
    return f"(SELECT *, concat('sha256:', sha256(concat(shape, salt))) AS shape_hash FROM {name})" if name == "given_definitions" else name


def _counts(name, rules):
    return f"{relation_sql(name)} SELECT code, rule, count(*) AS records FROM (SELECT {_case(rules, 0)} AS code, {_case(rules)} AS rule FROM {_shaped(name)}) GROUP BY 1, 2"


def _digest(columns):
    return "concat('sha256:', sha256(concat_ws(';', " + ", ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen(CAST({c} AS VARCHAR)), ':', {c}) END" for c in sorted(columns)) + ")))"


def _set(digest):
    sums = ", ':', ".join(f"coalesce(sum(CAST(concat('0x', substr({digest}, {7 + at}, 15)) AS HUGEINT)), 0)" for at in (1, 16, 31, 46))
    return f"concat('sha256:', sha256(concat(count({digest}), ':', {sums})))"


def _items(alias, name, rules, columns, stage, stamped):
    late = ""
    own = _case([(c, r, h) for c, r, h in rules])
    if stamped:
        late = "CASE WHEN (i.adapter_id, i.adapter_version, i.identity_version) IS DISTINCT FROM (h.adapter_id, h.adapter_version, h.identity_version) THEN 'stamp_differs' WHEN i.config_revision IS DISTINCT FROM h.config_revision THEN 'config_revision_differs' END"
        rows = f"SELECT i.*, {late} AS late FROM (SELECT *, {own} AS own, {_case(rules, 0)} AS code, {_digest(columns)} AS dg FROM {_shaped(name)}) i JOIN result_headers h USING (result_id)"
    else:
        rows = f"SELECT *, NULL AS late FROM (SELECT *, {own} AS own, {_case(rules, 0)} AS code, {_digest(columns)} AS dg FROM {_shaped(name)})"
    first = f"min(CASE WHEN own IS NOT NULL THEN struct_pack(stage := {stage}, position := position, code := code, rule := own) WHEN late IS NOT NULL THEN struct_pack(stage := {stage + 2}, position := position, code := 'incompatible_output_version', rule := late) END)"
    return f"{alias} AS (SELECT result_id, count(*) AS n, {_set('dg')} AS hash, {first} AS first FROM ({rows}) GROUP BY result_id)"


_OWN = "concat('sha256:', sha256(concat('{', " + ", ',', ".join(f"'\"{c}\":', CAST(to_json(CAST({c} AS VARCHAR)) AS VARCHAR)" for c in sorted(("adapter_id", "adapter_version", "identity_version", "state", "eligible", "processed", "skipped", "failed"))) + ", '}')))"


def _finalised(names, rules, items, tables):
    parts = ", ".join(_items(*i) for i in items)
    joins = " ".join(f"LEFT JOIN {i[0]} ON {i[0]}.result_id = h.result_id" for i in items)
    least = f"least({', '.join(i[0] + '.first' for i in items)})" if len(items) > 1 else f"{items[0][0]}.first"
    counts = ", ".join(f"coalesce({i[0]}.n, 0) AS {n}" for i, n in zip(items, names, strict=True))
    digest = "concat('sha256:', sha256(concat_ws('|', own_hash, " + ", ".join(f"coalesce({i[0]}.hash, 'none')" for i in items) + ")))"
    return f"""{relation_sql("result_headers", *tables)}, h AS (SELECT result_id, {_OWN} AS own_hash, {_case(rules, 0)} AS code, {_case(rules)} AS rule FROM result_headers), {parts},
        j AS (SELECT h.*, {counts}, {least} AS item, {digest} AS digest FROM h {joins})
        SELECT result_id, {", ".join(names)}, coalesce(code, item.code) AS code, coalesce(rule, item.rule) AS rule, CASE WHEN code IS NULL AND item IS NULL THEN digest END AS output_hash FROM j"""


_STABLE = "concat('ref_', 'sha256:', sha256(concat('{\"contractKind\":', to_json(contract_kind), ',\"evidenceStratum\":', to_json(evidence_stratum), ',\"semanticOwner\":', to_json(coalesce(semantic_owner, 'module')), ',\"target\":', to_json(coalesce(canonical_key, unresolved_pattern)), '}')))"
_ONCE = f"(SELECT * FROM (SELECT *, CASE WHEN coalesce(canonical_key, unresolved_pattern) IS NOT NULL THEN {_STABLE} END AS stable_id FROM given_references) QUALIFY row_number() OVER (PARTITION BY result_id, stable_id ORDER BY path, position) = 1)"
_STAMPED = "concat(adapter_id, '@', adapter_version, '#', identity_version)"

SQL = {
    "validate_definitions": _counts("given_definitions", _DEFINITION),
    "validate_references": _counts("given_references", _REFERENCE),
    "validate_changes": _counts("given_changes", _CHANGE),
    "validate_coverage": _counts("result_headers", _COVERAGE),
    "validate_diagnostics": _counts("result_headers", _DIAGNOSTIC),
    "validate_manifests": _counts("given_manifests", _MANIFEST),
    "finalised_extractions": _finalised(["definitions", '"references"'], _EXTRACTION, [("d", "given_definitions", _DEFINITION, v.DEFINITION, 1, True), ("r", "given_references", _REFERENCE, v.REFERENCE, 2, True)], ["given_definitions", "given_references"]),
    "finalised_diffs": _finalised(["changes"], _HEADER, [("c", "given_changes", _CHANGE, v.CHANGE, 1, False)], ["given_changes"]),
    "comparable_extractions": f"""{relation_sql("result_headers")}, p AS (SELECT b.result_id AS pair_id, concat(CASE WHEN b.result_id % 2 = 0 THEN 'acme.typescript' ELSE 'acme.open-api' END, '@1.2.3#1') AS expected, b.stamp AS bs, h.stamp AS hs, b.config_revision AS bc,
            CASE WHEN b.result_id % 4 < 2 THEN b.config_revision ELSE h.config_revision END AS hc, CASE b.result_id % 5 WHEN 0 THEN 'cfg_other' WHEN 1 THEN b.config_revision END AS ec
        FROM (SELECT *, {_STAMPED} AS stamp FROM result_headers) b JOIN (SELECT *, {_STAMPED} AS stamp FROM result_headers) h ON b.result_id = h.result_id + 2)
        SELECT pair_id, CASE WHEN rule IS NOT NULL THEN 'incompatible_extraction' END AS code, rule FROM (SELECT pair_id, CASE WHEN bs <> expected OR hs <> expected THEN 'adapter_or_identity' WHEN bc <> hc OR bc <> ec THEN 'config_revision' END AS rule FROM p)""",
    "checked_write": f"""{relation_sql("given_references")}, c AS (SELECT *, {_case(_REFERENCE, 0)} AS code, {_digest(v.REFERENCE)} AS dg FROM given_references)
        SELECT count(*) AS rows_read, count(*) AS rows_written, {_set("dg")} AS set_hash, (SELECT count(*) FROM c WHERE code IS NOT NULL) AS refused, (SELECT count(DISTINCT code) FROM c) AS codes FROM c WHERE code IS NULL""",
    "materialised_references": f"{relation_sql('given_references')} SELECT result_id AS generation_id, stable_id, path, position FROM {_ONCE}",
    "observed_generations": f"""{relation_sql("result_headers", "given_definitions", "given_references")}, d AS (SELECT result_id, count(*) AS n, {_set("dg")} AS hash FROM (SELECT *, {_digest(["contract_kind", "canonical_key", "path", "content_hash", "shape_hash"])} AS dg FROM {_shaped("given_definitions")}) GROUP BY 1),
        r AS (SELECT result_id, count(*) AS n, {_set("dg")} AS hash FROM (SELECT *, {_digest(["stable_id", "path", "content_hash"])} AS dg FROM {_ONCE}) GROUP BY 1)
        SELECT h.result_id AS generation_id, h.state AS coverage_state, coalesce(d.n, 0) AS definitions, coalesce(r.n, 0) AS "references", concat('sha256:', sha256(concat_ws('|', h.result_id, h.state, coalesce(d.hash, 'none'), coalesce(r.hash, 'none')))) AS output_hash
        FROM result_headers h LEFT JOIN d ON d.result_id = h.result_id LEFT JOIN r ON r.result_id = h.result_id""",
}


def queries() -> dict:
    return {n: f for n, f in globals().items() if n in SQL and callable(f)}
