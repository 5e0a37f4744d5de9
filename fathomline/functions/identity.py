"""Column expressions for identities, normal forms and compatibility."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .canonical import hash_record
from .text import is_nfc, nfc, trimmed, units


def identity_segment(value: Column) -> Column:
    """A composed, trimmed, percent-encoded segment of a contract key (F3); null where it is empty, longer than 512
    units or holds a NUL."""
    segment = trimmed(nfc(value))
    out = F.url_encode(segment)
    for code, char in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return F.when(units(segment).between(1, 512) & (F.instr(segment, "\0") == 0), out)


def contract_key(scheme: str, *segments: Column) -> Column:
    """scheme:segment#segment; null where a segment is no identity."""
    parts = [identity_segment(x) for x in segments]
    return F.concat(F.lit(f"{scheme.lower()}:"), *(x for i, p in enumerate(parts) for x in ((F.lit("#"), p) if i else (p,))))


def stratum_key(kind: Column, definition: Column, reference: Column, basis: Column, steps: Column) -> Column:
    """Pipe-joined parts, the steps of the path joined by +."""
    return F.concat_ws("|", kind, definition, reference, basis, F.concat_ws("+", F.array_sort(F.array_distinct(steps))))


def _bare_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "^/+|/+$", ""), "/{2,}", "/")


def alias_value(kind: Column, value: Column) -> Column:
    """Normal form by kind of alias (F8)."""
    bare = trimmed(value)
    return (
        F.when(kind == "host", F.regexp_replace(F.lower(bare), r"\.$", ""))
        .when(kind == "package_coordinate", F.lower(bare))
        .when(kind == "path_prefix", _bare_path(bare))
        .otherwise(bare)
    )


def gateway_rewrite(path: Column, prefix: Column) -> Column:
    """The path behind a gateway prefix, or null where the prefix does not apply."""
    bare, lead = _bare_path(path), F.regexp_replace(prefix, "^/+|/+$", "")
    behind = F.when(bare == lead, "").when(bare.startswith(F.concat(lead, F.lit("/"))), F.substr(bare, F.length(lead) + 2))
    return F.when(prefix.isNull(), bare).otherwise(behind)


def npm_subpath(value: Column) -> Column:
    """A package's subpath: `.` for the package itself, else from `./` on."""
    trimmed = F.trim(value)
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(trimmed, r"^\./", ""), "/{2,}", "/"), "/$", "")
    return F.when(trimmed.isin("", "."), ".").otherwise(F.concat(F.lit("./"), path))


def npm_specifier(specifier: Column) -> Column:
    """Package name and subpath that an import names; null for relative, absolute and built-in ones."""
    parts = F.split(specifier, "/")
    n = F.when(specifier.startswith("@"), 2).otherwise(1)
    name = F.slice(parts, F.lit(1), n)
    sound = (specifier != "") & ~specifier.rlike("^(?:[./]|node:)") & (F.size(parts) >= n) & ~F.exists(name, lambda p: p == "")
    rest = F.array_join(F.slice(parts, n + 1, F.greatest(F.size(parts) - n, F.lit(0))), "/")
    return F.when(sound, F.struct(F.array_join(name, "/").alias("package"), npm_subpath(rest).alias("subpath")))


def module_path(value: Column) -> Column:
    """A module's path within a repository, without extension, index and steps up."""
    parts = F.filter(F.split(F.trim(value), "/"), lambda p: ~p.isin("", "."))
    empty = F.array().cast("array<string>")
    up = lambda acc, p: F.when((p == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.size(acc) - 1)).when(p == "..", acc).otherwise(F.concat(acc, F.array(p)))
    path = F.array_join(F.aggregate(parts, empty, up), "/")
    path = F.regexp_replace(F.regexp_replace(path, r"(?:\.d)?\.(?:[mc]?ts|tsx|[mc]?js|jsx)$", ""), "/index$", "")
    return F.when(path == "", ".").otherwise(F.concat(F.lit("./"), path))


def route_template(path: Column) -> Column:
    """A route's template: no query or fragment, single slashes, parameters as {param}, no trailing slash.
    Fixed values: a parameter is :name, {name} or <name>; a route has 2,048 characters at most."""
    value = F.regexp_replace(F.regexp_replace(path, "[?#].*$", ""), "/{2,}", "/")
    parts = F.transform(F.split(value, "/"), lambda s: F.when(s.rlike(r"^:[A-Za-z_][A-Za-z0-9_]*$|^\{[^{}]+\}$|^<[^<>]+>$"), "{param}").otherwise(s))
    joined = F.array_join(parts, "/")
    out = F.when((F.length(joined) > 1) & joined.endswith("/"), F.regexp_replace(joined, "/$", "")).otherwise(joined)
    return F.when(path.startswith("/") & (F.length(path) <= 2048), out)


#: Ranks of integer types, narrow to wide.
TYPE_RANKS = {"smallint": 1, "integer": 2, "bigint": 3, "numeric": 4, "decimal": 4}
_SYNONYMS = {"int2": "smallint", "int4": "integer", "int8": "bigint"}


def column_type(value: Column) -> Column:
    v = F.trim(F.regexp_replace(F.lower(value), r"\s+", " "))
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in _SYNONYMS.items() for x in kv)), v), v)


def widens(before: Column, after: Column) -> Column:
    """Whether a column type change only widens (F13). The two names of a text of bounded length."""
    a, b = column_type(before), column_type(after)
    ranks = F.create_map(*(F.lit(x) for kv in TYPE_RANKS.items() for x in kv))
    ra, rb = F.element_at(ranks, a), F.element_at(ranks, b)
    pattern = r"^(?:character varying|varchar)\((\d+)\)$"
    la, lb = (F.regexp_extract(x, pattern, 1) for x in (a, b))
    text = (b == "text") & a.rlike(r"^(?:character varying|varchar)(?:\(\d+\))?$")
    return F.when(ra.isNotNull() & rb.isNotNull(), rb >= ra).when(text, True).otherwise((la != "") & (lb != "") & (lb.cast("long") >= la.cast("long")))


def column_compatibility(type_before: Column, type_after: Column, null_before: Column, null_after: Column) -> Column:
    """Compatibility of a changed column, type first, then nullability."""
    kind = F.when(widens(type_before, type_after), "compatible").when(widens(type_after, type_before), "breaking").otherwise("potentially_breaking")
    null = F.when(null_after.eqNullSafe(False), "breaking").when(null_before.eqNullSafe(False) & null_after.eqNullSafe(True), "compatible").otherwise("potentially_breaking")
    return F.when(type_before != type_after, kind).when(~null_before.eqNullSafe(null_after), null).otherwise("compatible")


def enum_compatibility(before: Column, after: Column) -> Column:
    """A lost value breaks, a new one may."""
    return F.when(F.size(F.array_except(before, after)) > 0, "breaking").when(F.size(F.array_except(after, before)) > 0, "potentially_breaking").otherwise("compatible")


def addition_compatibility(kind: Column, nullable: Column) -> Column:
    """An added column breaks writers that don't fill it, unless it may be null."""
    return F.when((kind == "database.column") & ~F.coalesce(nullable, F.lit(False)), "potentially_breaking").otherwise("compatible")


#: What is compared of an event's payload: its type, properties (name to the hash of what they are), required
#: names, and values of an enumeration.
PAYLOAD = "struct<type:string,properties:map<string,string>,required:array<string>,values:array<string>>"


def payload_compatibility(before: Column, after: Column) -> Column:
    """Compatibility of event payloads (F15): unknown without a schema on either side; another type, a lost or
    changed property or a name no longer required breaks; a value more of an enumeration may; a property
    more does not."""
    none, empty = F.create_map().cast("map<string,string>"), F.array().cast("array<string>")
    old, new = (F.coalesce(x["properties"], none) for x in (before, after))
    lost = F.exists(F.map_keys(old), lambda k: ~F.coalesce(F.try_element_at(new, k) == F.element_at(old, k), F.lit(False)))
    less = F.size(F.array_except(F.coalesce(before["required"], empty), F.coalesce(after["required"], empty))) > 0
    was = F.coalesce(before["values"], empty)
    more = (F.size(F.array_except(F.coalesce(after["values"], empty), was)) > 0) & (F.size(was) > 0)
    return (
        F.when(before.isNull() | after.isNull(), "unknown")
        .when(~before["type"].eqNullSafe(after["type"]) | lost | less, "breaking")
        .when(more, "potentially_breaking")
        .otherwise("compatible")
    )


#: A callable's overloads: parameters, and the hash of the whole signature.
OVERLOADS = "array<struct<parameters:array<struct<optional:boolean,rest:boolean>>,hash:string>>"


def signature_compatibility(before: Column, after: Column, implementation_changed: Column | None = None) -> Column:
    """Compatibility of overload lists (F16): unknown where parameters aren't known; breaking if every overload
    now needs more parameters than any did; compatible if all signatures are still there, potentially
    breaking then only for a changed implementation; potentially breaking otherwise."""
    known = lambda xs: xs.isNotNull() & F.forall(xs, lambda o: o["parameters"].isNotNull())
    flag = lambda p, f: F.coalesce(p[f], F.lit(False))
    counts = lambda xs: F.transform(xs, lambda o: F.size(F.filter(o["parameters"], lambda p: ~flag(p, "optional") & ~flag(p, "rest"))))
    kept = F.size(F.array_except(F.transform(before, lambda o: o["hash"]), F.transform(after, lambda o: o["hash"]))) == 0
    changed = implementation_changed if implementation_changed is not None else F.lit(False)
    return (
        F.when(~(known(before) & known(after)), "unknown")
        .when(F.array_min(counts(after)) > F.array_max(counts(before)), "breaking")
        .when(kept, F.when(changed, "potentially_breaking").otherwise("compatible"))
        .otherwise("potentially_breaking")
    )


def uniform(seed: str, subject: Column, compat: bool = False) -> Column:
    """A deterministic draw from 13 hexadecimal digits of the hash of seed and subject, as JSON text with a NUL
    between them: in [0, 1), or as wide as published, [0, 16), with compat (F17)."""
    digest = hash_record(F.concat(F.lit(f"{seed}\0"), subject.cast("string")))
    return F.conv(F.substring(digest, 8, 13), 16, 10).cast("double") / float(16**12 if compat else 16**13)


def line_of(text: Column, offset: Column) -> Column:
    """Line number (from 1) of a code-point offset."""
    return F.size(F.split(F.substr(text, F.lit(1), offset), "\n", -1))


def column_of(text: Column, offset: Column) -> Column:
    """Column (from 1) of a code-point offset in its line."""
    return F.length(F.element_at(F.split(F.substr(text, F.lit(1), offset), "\n", -1), -1)) + 1


#: Names whose values are masked.
SECRETS = r"(?i)\b(password|passwd|secret|token|private[_-]?key|api[_-]?key)\b\s*[:=]\s*(?:\"[^\"\r\n]*\"|'[^'\r\n]*'|[^\s,;]+)"


def minimise_excerpt(text: Column, limit: int) -> Column:
    """An excerpt without comment lines and NULs, with secrets and long tokens masked, cut to so many bytes at a
    whole character (P18)."""
    lines = F.split(F.replace(F.substring(text, 1, limit), F.lit("\0"), F.lit("")), "\r?\n", -1)
    kept = F.array_join(F.filter(lines, lambda s: ~s.rlike(r"^\s*(?://|#|/\*|\*|<!--|--)")), "\n")
    masked = F.regexp_replace(F.regexp_replace(kept, SECRETS, "$1=[REDACTED]"), r"\b[A-Za-z0-9+/_=-]{40,}\b", "[REDACTED]")
    # A cut within a character leaves bytes that decode to U+FFFD; at most three of them stand at the end.
    cut = F.regexp_replace(F.make_valid_utf8(F.substring(masked.cast("binary"), 1, limit).cast("string")), "\ufffd+$", "")
    return F.when(F.octet_length(masked) <= limit, masked).otherwise(cut)


def bounded_text(value: Column, most: int) -> Column:
    """Whether a text is printable, trimmed and of 1 to so many characters."""
    return F.length(value).between(1, most) & (F.trim(value) == value) & ~value.rlike(r"[\x00-\x1f\x7f]")


def elapsed_ms(start: Column, end: Column) -> Column:
    """Milliseconds from one time to another, none if it is earlier."""
    return F.greatest(F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp")), F.lit(0).cast("long"))


_UUID = "[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}"
_SHA = "sha256:[0-9a-f]{64}"
#: Forms of identifiers (P9): those made of a time-ordered identifier, those made of a hash, others.
IDENTIFIERS = {
    **{name: f"^{prefix}_{_UUID}$" for name, prefix in (("workspace", "wsp"), ("generation", "gen"), ("lease", "lea"), ("overlay", "ovl"), ("evidence", "evd"), ("job", "job"), ("analysis", "ana"), ("review", "rev"))},
    **{name: f"^{prefix}_{_SHA}$" for name, prefix in (
        ("registry", "reg"), ("config", "cfg"), ("policy", "pol"), ("edge", "edg"), ("finding", "fnd"), ("occurrence", "occ"), ("reference", "ref"), ("suppression", "sup"), ("case", "cas"), ("promotion", "pro"), ("reasoning", "rrn"),
    )},
    "commit": "^(?:[0-9a-f]{40}|[0-9a-f]{64})$", "content_hash": f"^{_SHA}$", "repository": f"^(?:github:[1-9][0-9]*|local:{_SHA})$", "adapter": r"^[a-z][a-z0-9]*(?:[.-][a-z0-9]+)+$",
    "instant": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$",
}


def valid_identifier(kind: str, value: Column) -> Column:
    """Whether a text has its kind's form; an instant must be one of the calendar as well."""
    fits = value.rlike(IDENTIFIERS[kind])
    if kind == "instant":
        fits = fits & F.try_to_timestamp(F.when(fits, value)).isNotNull()
    return F.coalesce(fits, F.lit(False))


def valid_repo_path(path: Column) -> Column:
    """A path within a repository: relative, composed, without steps up or empty ones, backslashes and NULs."""
    parts = F.split(path, "/", -1)
    return F.coalesce((path != "") & ~path.rlike(r"[\\\x00]|^[A-Za-z]:") & ~F.exists(parts, lambda p: p.isin("", ".", "..")) & is_nfc(path), F.lit(False))


def valid_at(start: Column, end: Column, at: Column) -> Column:
    """Half-open validity; an open end never ends."""
    return (start <= at) & (end.isNull() | (at < end))
