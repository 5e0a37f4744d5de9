"""Validation and finalisation of what adapters give (X10), and what is made of it for a generation (X11).

Every rule is a column that is null where it holds and else a struct of code and rule; a record's violation is
the first of its rules, in the published order, that does not hold. So records are checked in the pass that reads
them, and the counts come out of that pass: write_checked() writes to a folder beside its target with the counts
and the hash as observed metrics, and only renames it if they are clean.

A result's hash must not depend on the order of its items, which at scale is nobody's: it is the hash of the
result's own record and of the sums of its items' hashes, 240 bits of each, so equal sets of items, and only
those, have equal hashes.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.canonical import hash_record, hash_text, stable_reference_id
from ..functions.text import is_nfc, trimmed, units
from ..sources.tables import materialise
from .artifacts import observation_state

C = F.col

#: Vocabularies and forms.
CONTRACT_KINDS = ("typescript_symbol", "openapi_operation", "protobuf_method", "protobuf_field")
TIERS = ("contract_grade", "structural", "preview")
COMPATIBILITY = ("breaking", "potentially_breaking", "compatible", "unknown")
ACTIVATION = ("current_runtime", "on_upgrade", "on_deploy", "unknown")
MANIFEST_SCHEMA_VERSION = "1.0"
HASH = "^sha256:[0-9a-f]{64}$"
CONFIG_REVISION = "^cfg_sha256:[0-9a-f]{64}$"
ADAPTER_ID = r"^[a-z][a-z0-9]*(?:[.-][a-z0-9]+)+$"
VERSION = r"^(?:0|[1-9]\d*)\.(?:0|[1-9]\d*)\.(?:0|[1-9]\d*)(?:-[0-9A-Za-z.-]+)?$"
STRATUM_ID = "^[a-z][a-z0-9]*(?:[._-][a-z0-9]+)*$"
LARGEST = (1 << 53) - 1


def must(holds: Column, code: str, rule: str) -> Column:
    return F.when(~F.coalesce(holds, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(rule).alias("rule")))


def given(value: Column, check: Column) -> Column:
    """The check where the value is there at all; an empty text is not."""
    return F.when(value.isNotNull() & (value != ""), check)


def each(items: Column, checks) -> Column:
    """The first violation of the first item that has one; checks(item, index) is an item's."""
    found = F.filter(F.transform(items, lambda x, i: checks(x, i)), lambda v: v.isNotNull())
    return F.get(found, F.lit(0))


def bounded(value: Column, name: str, most: int = 256) -> Column:
    return F.coalesce(must(trimmed(value) != "", "invalid_manifest", f"{name}_empty"), must(units(value) <= most, "invalid_manifest", f"{name}_too_long"))


def hashed(value: Column, name: str) -> Column:
    return must(value.rlike(HASH), "invalid_hash", name)


def counted(value: Column, least: int) -> Column:
    return value.between(least, LARGEST)


def repository_path(value: Column, composed: Column | None = None) -> Column:
    """Relative, canonical, composed; each condition on its own. `composed` says whether the text is in NFC; within
    lambdas it must be given, as Python cannot run there."""
    rules = (
        (value != "", "path_empty"), (F.instr(value, "\0") == 0, "path_nul"), (F.instr(value, "\\") == 0, "path_backslash"),
        (~value.startswith("/") & ~value.rlike("^[A-Za-z]:"), "path_absolute"), (~value.endswith("/") & (F.instr(value, "//") == 0), "path_not_canonical"),
        (~F.exists(F.split(value, "/", -1), lambda s: s.isin("", ".", "..")), "path_traversal"), (is_nfc(value) if composed is None else composed, "path_not_composed"),
    )
    return F.coalesce(*(must(holds, "invalid_path", name) for holds, name in rules))


def source_range() -> Column:
    """start_line, start_column, end_line, end_column; without any there is no range."""
    parts = [C(c) for c in ("start_line", "start_column", "end_line", "end_column")]
    there = F.coalesce(*parts).isNotNull()
    positive = parts[0].isNotNull()
    for p in parts:
        positive = positive & counted(p, 1)
    forward = (C("end_line") > C("start_line")) | (C("end_line") == C("start_line")) & (C("end_column") >= C("start_column"))
    return F.when(there, F.coalesce(must(positive, "invalid_output", "range_not_positive"), must(forward, "invalid_output", "range_backwards")))


def contract_key(value: Column) -> Column:
    return must((value != "") & (units(value) <= 2048) & (F.instr(value, "\0") == 0), "invalid_output", "key_not_bounded")


def contract_kind() -> Column:
    return must(C("contract_kind").isin(*CONTRACT_KINDS), "invalid_output", "kind_unknown")


def definition_violation() -> Column:
    """definitions(contract_kind, canonical_key, display_name, path, range columns, content_hash, shape_hash, shape,
    evidence_stratum); shape is canonical JSON."""
    return F.coalesce(
        contract_kind(), contract_key(C("canonical_key")), bounded(C("display_name"), "display_name", 512), repository_path(C("path")), source_range(),
        hashed(C("content_hash"), "content_hash"), hashed(C("shape_hash"), "shape_hash"), must(C("shape_hash") == hash_text(C("shape")), "invalid_output", "shape_hash_differs"),
        bounded(C("evidence_stratum"), "evidence_stratum", 128),
    )


def reference_violation() -> Column:
    """references(contract_kind, canonical_key, unresolved_pattern, unresolved_reason, path, range columns, content_hash,
    activation, evidence_stratum): a key, or a pattern with its reason, and never both."""
    resolved, unresolved = C("canonical_key").isNotNull(), C("unresolved_pattern").isNotNull() & C("unresolved_reason").isNotNull()
    there = lambda c, check: F.when(C(c).isNotNull(), check)
    return F.coalesce(
        contract_kind(), must(resolved != unresolved, "invalid_output", "neither_or_both_resolved"), there("canonical_key", contract_key(C("canonical_key"))),
        there("unresolved_pattern", bounded(C("unresolved_pattern"), "unresolved_pattern", 2048)), there("unresolved_reason", bounded(C("unresolved_reason"), "unresolved_reason", 256)),
        repository_path(C("path")), source_range(), hashed(C("content_hash"), "content_hash"), must(C("activation").isin(*ACTIVATION), "invalid_output", "activation_unknown"),
        bounded(C("evidence_stratum"), "evidence_stratum", 128),
    )


def change_violation() -> Column:
    """changes(contract_kind, canonical_key, change_kind, compatibility, activation, base_shape_hash, head_shape_hash,
    coverage_dependencies, remedy_kind, remedy_text, differ struct of tool_id, tool_version, tool_digest, tool_license,
    category)."""
    differ = lambda f: C("differ")[f]
    return F.coalesce(
        contract_kind(), contract_key(C("canonical_key")), bounded(C("change_kind"), "change_kind", 128), must(C("compatibility").isin(*COMPATIBILITY), "invalid_output", "compatibility_unknown"),
        must(C("activation").isin(*ACTIVATION), "invalid_output", "activation_unknown"), given(C("base_shape_hash"), hashed(C("base_shape_hash"), "base_shape_hash")),
        given(C("head_shape_hash"), hashed(C("head_shape_hash"), "head_shape_hash")), each(C("coverage_dependencies"), lambda d, _: bounded(d, "coverage_dependency")),
        bounded(C("remedy_kind"), "remedy_kind", 128), bounded(C("remedy_text"), "remedy_text", 1024), bounded(differ("tool_id"), "tool_id"), bounded(differ("tool_version"), "tool_version"),
        hashed(differ("tool_digest"), "tool_digest"), bounded(differ("tool_license"), "tool_license"), bounded(differ("category"), "category"),
    )


def coverage_violation() -> Column:
    """Counters (state, eligible, processed, skipped, failed) that do not add up."""
    seen = C("processed") + C("skipped") + C("failed")
    whole_numbers = counted(C("eligible"), 0) & counted(C("processed"), 0) & counted(C("skipped"), 0) & counted(C("failed"), 0)
    complete = (C("failed") == 0) & (C("processed") + C("skipped") == C("eligible"))
    return F.coalesce(
        must(whole_numbers, "invalid_coverage", "counts_not_whole"), must(seen <= C("eligible"), "invalid_coverage", "counts_exceed_eligible"),
        F.when(C("state") == "complete", must(complete, "invalid_coverage", "complete_leaves_some_out")),
    )


def diagnostic_violation(of: Column | None = None, composed: Column | None = None) -> Column:
    """Diagnostics (safe_message, scope, detail_hash)."""
    at = (lambda c: of[c]) if of is not None else C
    return F.coalesce(
        must((at("safe_message") != "") & (units(at("safe_message")) <= 256), "invalid_diagnostic", "message_not_bounded"),
        given(at("scope"), repository_path(at("scope"), composed)), given(at("detail_hash"), hashed(at("detail_hash"), "detail_hash")),
    )


def manifest_violation() -> Column:
    """manifests(schema_version, id, version, identity_version, contract_kinds, tiers(input, tier), strata(id, state,
    evidence), tools(id, version, digest, license, network), limitations, maintainer, budget: map to numbers)."""
    kinds, strata, tools = C("contract_kinds"), C("strata"), C("tools")
    bad = "invalid_manifest"
    before = lambda items, i, name: F.exists(F.slice(items, F.lit(1), i), lambda x: x["id"] == name)
    stratum = lambda s, i: F.coalesce(
        must(s["id"].rlike(STRATUM_ID), bad, "stratum_id"), must(~before(strata, i, s["id"]), bad, "stratum_twice"), must(s["state"] == "UNMEASURED", bad, "stratum_measured"),
        must(F.size(s["evidence"]) > 0, bad, "stratum_without_evidence"),
    )
    tool = lambda t, i: F.coalesce(
        bounded(t["id"], "tool_id"), bounded(t["version"], "tool_version"), hashed(t["digest"], "tool_digest"), bounded(t["license"], "tool_license"), must(~t["network"], bad, "tool_network"),
        must(~before(tools, i, t["id"]), bad, "tool_twice"),
    )
    return F.coalesce(
        must(C("schema_version") == MANIFEST_SCHEMA_VERSION, "unsupported_manifest_schema", "schema"), must(C("id").rlike(ADAPTER_ID), "invalid_id", "adapter_id"),
        must(C("version").rlike(VERSION), bad, "version"), must(counted(C("identity_version"), 1), bad, "identity_version"), must(F.size(kinds) > 0, bad, "no_kinds"),
        must((F.size(F.array_distinct(kinds)) == F.size(kinds)) & F.forall(kinds, lambda k: k.isin(*CONTRACT_KINDS)), bad, "kinds"),
        must((F.size("tiers") > 0) & F.forall("tiers", lambda t: (F.char_length(t["input"]) > 0) & t["tier"].isin(*TIERS)), bad, "tiers"),
        each(strata, stratum), must(F.size(strata) > 0, bad, "no_strata"), each(tools, tool), each(C("limitations"), lambda x, _: bounded(x, "limitation", 512)),
        bounded(C("maintainer"), "maintainer"), must(F.forall(F.map_values("budget"), lambda v: counted(v, 1)), bad, "budget"),
    )


def header_violation(extraction: bool = True) -> Column:
    """A result's own columns: adapter_id, adapter_version, identity_version and, of an extraction, config_revision and
    source_fingerprint; coverage and diagnostics(safe_message, scope, detail_hash) go before them. `_composed` says
    whether the scopes are in NFC."""
    checks = [
        coverage_violation(), each(C("diagnostics"), lambda d, _: diagnostic_violation(d, C("_composed"))), must(C("adapter_id").rlike(ADAPTER_ID), "invalid_id", "adapter_id"),
        must(C("adapter_version").rlike(VERSION), "invalid_output", "adapter_version"), must(counted(C("identity_version"), 1), "invalid_output", "identity_version"),
    ]
    if extraction:
        checks += [must(C("config_revision").rlike(CONFIG_REVISION), "invalid_id", "config_revision"), hashed(C("source_fingerprint"), "source_fingerprint")]
    return F.coalesce(*checks)


def with_header_violation(headers: DataFrame, extraction: bool = True) -> DataFrame:
    """headers with `violation`. The scopes of a result's diagnostics are held against NFC in one text, so where one is
    not composed the first one is blamed."""
    scopes = F.concat_ws("/", F.transform("diagnostics", lambda d: d["scope"]))
    return headers.withColumn("_composed", F.coalesce(is_nfc(scopes), F.lit(True))).withColumn("violation", header_violation(extraction)).drop("_composed")


def with_violation(records: DataFrame, check) -> DataFrame:
    """records with `violation`, null where every rule holds."""
    return records.withColumn("violation", check())


def violations(checked: DataFrame) -> DataFrame:
    """How many records each rule refuses; null: none does."""
    return checked.groupBy(C("violation.code").alias("code"), C("violation.rule").alias("rule")).agg(F.count("*").alias("records"))


#: Digits of a hash that are summed: four lanes of fifteen.
_LANES = [(1, 15), (16, 15), (31, 15), (46, 15)]


def _lanes(digest: Column) -> list[Column]:
    hex_digits = F.substring_index(digest, ":", -1)
    return [F.sum(F.conv(F.substring(hex_digits, at, n), 16, 10).cast("decimal(38,0)")) for at, n in _LANES]


def set_hash(digest: Column) -> Column:
    """An aggregate: the hash of how many records there are and of the sums of their hashes; order does not matter."""
    sums = [F.coalesce(x, F.lit(0).cast("decimal(38,0)")).cast("string") for x in _lanes(digest)]
    return hash_text(F.concat_ws(":", F.count(digest).cast("string"), *sums))


def item_digest(columns: list[str]) -> Column:
    """The hash of an item's columns in the order of their names, each behind its length, null as a dash."""
    sized = lambda text: F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    return hash_text(F.concat_ws(";", *(sized(C(c).cast("string")) for c in sorted(columns))))


STAMP = ("adapter_id", "adapter_version", "identity_version", "config_revision")
ITEM = ("contract_kind", "canonical_key", "path", "start_line", "start_column", "end_line", "end_column", "content_hash", "evidence_stratum", *STAMP)
DEFINITION = (*ITEM, "display_name", "shape_hash")
REFERENCE = (*ITEM, "unresolved_pattern", "unresolved_reason", "activation", "semantic_owner")
CHANGE = ("contract_kind", "canonical_key", "change_kind", "compatibility", "activation", "base_shape_hash", "head_shape_hash", "remedy_kind", "remedy_text")


def _stamped(items: DataFrame, headers: DataFrame) -> Column:
    """Items whose stamp is not that of their result (joined as s_ columns)."""
    same = [C(c).cast("string").eqNullSafe(C(f"s_{c}").cast("string")) for c in STAMP]
    return F.coalesce(must(same[0] & same[1] & same[2], "incompatible_output_version", "stamp_differs"), must(same[3], "incompatible_output_version", "config_revision_differs"))


def _finalised(headers: DataFrame, kinds: list[tuple[str, int, DataFrame, Column, tuple, bool]], extraction: bool) -> DataFrame:
    """One row a result. Items give, by result, how many there are, their set's hash and the least violation by
    stage, position and the order of rules; nothing but these sums is joined to the headers."""
    checked = with_header_violation(headers, extraction)
    stamps = headers.select("result_id", *(C(c).alias(f"s_{c}") for c in STAMP if c in headers.columns))
    out = checked.select("result_id", hash_record({c: C(c).cast("string") for c in ("adapter_id", "adapter_version", "identity_version", "state", "eligible", "processed", "skipped", "failed")}).alias("_own"), C("violation").alias("_first"))
    for name, stage, items, violation, columns, stamped in kinds:
        own = items.withColumn("_v", violation)
        found = F.when(C("_v").isNotNull(), F.struct(F.lit(stage).alias("stage"), "position", C("_v.code").alias("code"), C("_v.rule").alias("rule")))
        if stamped:
            own = own.join(stamps, "result_id").withColumn("_s", _stamped(items, headers))
            late = F.when(C("_s").isNotNull(), F.struct(F.lit(stage + 2).alias("stage"), "position", C("_s.code").alias("code"), C("_s.rule").alias("rule")))
            found = F.coalesce(found, late)
        summed = own.withColumns({"_found": found, "_digest": item_digest(list(columns))}).groupBy("result_id")
        out = out.join(summed.agg(F.count("*").alias(name), set_hash(C("_digest")).alias(f"_{name}_hash"), F.min("_found").alias(f"_{name}_first")), "result_id", "left")
    names = [k[0] for k in kinds]
    item = F.least(*(C(f"_{n}_first") for n in names)) if len(names) > 1 else C(f"_{names[0]}_first")
    code, rule = (F.coalesce(C(f"_first.{f}"), item[f]) for f in ("code", "rule"))
    digest = hash_text(F.concat_ws("|", "_own", *(F.coalesce(C(f"_{n}_hash"), F.lit("none")) for n in names)))
    return out.select("result_id", *(F.coalesce(C(n), F.lit(0)).alias(n) for n in names), code.alias("code"), rule.alias("rule"), F.when(code.isNull(), digest).alias("output_hash"))


def finalise_extractions(headers: DataFrame, definitions: DataFrame, references: DataFrame) -> DataFrame:
    """result_id, definitions, references, code and rule of the first violation, output_hash where there is none.
    The order is the published one: the result's own columns, definitions, references, then stamps."""
    kinds = [("definitions", 1, definitions, definition_violation(), DEFINITION, True), ("references", 2, references, reference_violation(), REFERENCE, True)]
    return _finalised(headers, kinds, True)


def finalise_diffs(headers: DataFrame, changes: DataFrame) -> DataFrame:
    """The same of results of comparisons, whose items are changes and bear no stamp."""
    return _finalised(headers, [("changes", 1, changes, change_violation(), CHANGE, False)], False)


def comparable(pairs: DataFrame) -> DataFrame:
    """Whether base and head extractions may be compared: pairs(pair_id, expected, base_stamp, head_stamp, base_config,
    head_config, expected_config); both are of the expected adapter, version and identities, and of one revision
    of the configuration, the expected one if there is any."""
    stamps = (C("base_stamp") == C("expected")) & (C("head_stamp") == C("expected"))
    configs = C("base_config").eqNullSafe(C("head_config")) & (C("expected_config").isNull() | (C("base_config") == C("expected_config")))
    check = F.coalesce(must(stamps, "incompatible_extraction", "adapter_or_identity"), must(configs, "incompatible_extraction", "config_revision"))
    return pairs.select("pair_id", check["code"].alias("code"), check["rule"].alias("rule"))


class Refused(ValueError):
    """A write that was not made; `counts` says how many records each code refuses."""

    def __init__(self, counts: dict[str, int]):
        super().__init__(f"records are not valid: {counts}")
        self.counts = counts


@dataclass(frozen=True)
class Written:
    rows: int
    set_hash: str


CODES = ("invalid_output", "invalid_manifest", "invalid_hash", "invalid_path", "invalid_id", "invalid_coverage", "invalid_diagnostic", "incompatible_output_version", "unsupported_manifest_schema")


def checked_once(records: DataFrame, check, columns: list[str]) -> DataFrame:
    """records with `violation` and `_digest`, written once: for those that are given to write_checked() more than once."""
    return materialise(with_violation(records, check).withColumn("_digest", item_digest(columns)), "checked")


def write_checked(checked: DataFrame, columns: list[str], path: str, partition_by: list[str] | None = None) -> Written:
    """Write records with `violation` as Parquet at a path that does not exist yet. Counts by code and the set's hash
    are observed in the very pass that writes, to a folder beside the path; that is renamed if all are clean and
    deleted, with Refused, if any is not, so a reader never meets a record that was not checked."""
    spark = checked.sparkSession
    counts, hashes = Observation(), Observation()
    rows = checked if "_digest" in checked.columns else checked.withColumn("_digest", item_digest(columns))
    rows = rows.observe(counts, F.count("*").alias("rows"), *(F.count_if(C("violation.code") == c).alias(c) for c in CODES), F.count("violation").alias("any"))
    rows = rows.observe(hashes, *(x.alias(f"lane{i}") for i, x in enumerate(_lanes(C("_digest")))))
    beside = f"{path.rstrip('/')}.unchecked-{uuid.uuid4().hex}"
    writer = rows.drop("violation", "_digest").write
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(beside)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(beside), jvm.org.apache.hadoop.fs.Path(path)
    files = source.getFileSystem(conf)
    seen = counts.get
    if seen["any"] or files.exists(target):
        files.delete(source, True)
        if seen["any"]:
            raise Refused({c: seen[c] for c in CODES if seen[c]})
        raise FileExistsError(path)
    if not files.rename(source, target):
        raise OSError(f"{beside} could not be renamed")
    return Written(seen["rows"], _sealed(seen["rows"], [hashes.get[f"lane{i}"] for i in range(len(_LANES))]))


def _sealed(rows: int, lanes: list) -> str:
    """set_hash() of sums that are on the driver: five numbers."""
    import hashlib

    text = ":".join([str(rows), *(str(int(x or 0)) for x in lanes)])
    return f"sha256:{hashlib.sha256(text.encode()).hexdigest()}"


def materialise_references(references: DataFrame, kept: list[str] | None = None) -> DataFrame:
    """One reference of each generation and stable identity: that of the smallest path, of equals the first (X11), with
    all columns or those that are `kept` beside path and position. References are grouped by what the identity is
    made of, which is shorter than the identity; that is made of one row a group."""
    target = F.coalesce("canonical_key", "unresolved_pattern")
    there = lambda c: F.when(target.isNotNull(), c)
    own = {"_kind": there(C("contract_kind")), "_target": target, "_owner": there(F.coalesce("semantic_owner", F.lit("module"))), "_stratum": there(C("evidence_stratum"))}
    rest = [c for c in (references.columns if kept is None else kept) if c not in ("generation_id", "path", "position")]
    least = references.withColumns(own).groupBy("generation_id", *own).agg(F.min(F.struct("path", "position", *rest)).alias("of"))
    stable = stable_reference_id(C("_kind"), C("_target"), F.lit(None).cast("string"), C("_owner"), C("_stratum"))
    return least.select("generation_id", stable.alias("stable_id"), "of.*")


def observe_generations(extractions: DataFrame, definitions: DataFrame, references: DataFrame) -> DataFrame:
    """What is observed of each generation (X11): extractions(generation_id, state, items), its definitions, and its
    references once each: coverage state, counts and a hash that no order changes."""
    once = materialise_references(references, ["content_hash"])
    state = observation_state(extractions, ["generation_id"]).withColumnRenamed("state", "coverage_state")
    named = ["contract_kind", "canonical_key", "path", "content_hash", "shape_hash"]
    d = definitions.withColumn("_d", item_digest(named)).groupBy("generation_id").agg(F.count("*").alias("definitions"), set_hash(C("_d")).alias("_dh"))
    r = once.withColumn("_d", item_digest(["stable_id", "path", "content_hash"])).groupBy("generation_id").agg(F.count("*").alias("references"), set_hash(C("_d")).alias("_rh"))
    both = state.join(d, "generation_id", "left").join(r, "generation_id", "left")
    digest = hash_text(F.concat_ws("|", C("generation_id").cast("string"), "coverage_state", F.coalesce("_dh", F.lit("none")), F.coalesce("_rh", F.lit("none"))))
    return both.select("generation_id", "coverage_state", F.coalesce("definitions", F.lit(0)).alias("definitions"), F.coalesce("references", F.lit(0)).alias("references"), digest.alias("output_hash"))
