"""Canonical JSON, content hashes and the identities made of them, as column expressions.

A record is a dict of parts: columns of text, `whole(...)` for numbers, nested dicts and lists. Keys are in
the order of their characters, and nothing stands between tokens, so equal records have equal hashes whatever
the order in which they were put together. A null column is JSON null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: JSON's own escapes of control characters; the others are written by their number.
_SHORT = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}
#: Characters, each followed by its escape.
_ESCAPES = ["\\", "\\\\", '"', '\\"', *(x for c in map(chr, range(32)) for x in (c, _SHORT.get(c, f"\\u{ord(c):04x}")))]


@dataclass(frozen=True)
class Whole:
    """A whole number in a record."""

    column: Column


def whole(column: Column) -> Whole:
    return Whole(column)


def json_text(value: Column) -> Column:
    """A text as a JSON string."""
    # One look-up a character, and not a replacement for each of 34: where many texts make a record, the code of those is
    # too long for the JVM to compile.
    escaped = F.array_join(F.transform(F.split(value, ""), lambda c: F.coalesce(F.try_element_at(F.create_map(*map(F.lit, _ESCAPES)), c), c)), "")
    plain = ~value.rlike(r'[\x00-\x1f"\\]')
    return F.concat(F.lit('"'), F.when(plain, value).otherwise(escaped), F.lit('"'))


def canonical_json(value) -> Column:
    """The canonical JSON of a record (F1)."""
    if isinstance(value, dict):
        fields = [F.concat(F.lit(f'"{k}":'), canonical_json(value[k])) for k in sorted(value)]
        return F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    if isinstance(value, (list, tuple)):
        return F.concat(F.lit("["), F.concat_ws(",", *map(canonical_json, value)), F.lit("]"))
    if isinstance(value, Whole):
        return F.coalesce(value.column.cast("long").cast("string"), F.lit("null"))
    if isinstance(value, Column):
        return F.coalesce(json_text(value.cast("string")), F.lit("null"))
    return F.lit("null") if value is None else F.lit(str(value).lower()) if isinstance(value, (bool, int)) else json_text(F.lit(value))


def json_list(values: Column) -> Column:
    """The canonical JSON of an array of texts."""
    return F.concat(F.lit("["), F.array_join(F.transform(values, json_text), ","), F.lit("]"))


def hash_text(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def hash_record(value) -> Column:
    """The hash of a record's canonical JSON."""
    return hash_text(canonical_json(value))


def hash_parts(*parts: Column) -> Column:
    """The hash of parts that each follow their length in bytes, eight of them: no two lists of parts make the
    same bytes (F2)."""
    sized = [F.concat(F.unhex(F.lpad(F.hex(F.octet_length(p)), 16, "0")), p.cast("binary")) for p in parts]
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(*sized), 256))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """The keyed hash of a binary message, in hexadecimal: two plain hashes over the padded key."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


def stable_reference_id(kind: Column, key: Column, pattern: Column, owner: Column, stratum: Column) -> Column:
    """A reference's identity: what it points at, a key or a pattern, and who owns it."""
    record = {"contractKind": kind, "target": F.coalesce(key, pattern), "semanticOwner": F.coalesce(owner, F.lit("module")), "evidenceStratum": stratum}
    return F.when(F.coalesce(key, pattern).isNotNull(), F.concat(F.lit("ref_"), hash_record(record)))


def edge_id(workspace: Column, producer: Column, consumer: Column, key: Column, reference: Column, basis: Column, revision: Column) -> Column:
    """An evidence edge's identity."""
    record = {
        "workspaceId": workspace, "producerRepositoryId": producer, "consumerRepositoryId": consumer, "definitionKey": key, "stableReferenceId": reference, "basis": basis,
        "registryRevision": revision,
    }
    return F.concat(F.lit("edg_"), hash_record(record))


def finding_fingerprint(workspace: Column, producer: Column, kind: Column, key: Column, change: Column, consumer: Column, reference: Column, policy_major: Column) -> Column:
    """A finding's identity over analyses."""
    record = {
        "workspaceId": workspace, "producerRepositoryId": producer, "contractKind": kind, "canonicalKey": key, "changeKind": change, "consumerRepositoryId": consumer,
        "stableReferenceId": reference, "policyMajor": whole(policy_major),
    }
    return F.concat(F.lit("fnd_"), hash_record(record))


def occurrence_id(analysis: Column, fingerprint: Column, base: Column, head: Column) -> Column:
    """A finding's identity within one analysis."""
    return F.concat(F.lit("occ_"), hash_record({"analysisId": analysis, "fingerprint": fingerprint, "baseSha": base, "headSha": head}))


def secret_reference(salt: bytes, namespace: Column, provider: Column, identifier: Column) -> Column:
    """A secret's reference without its name: a keyed hash over parts that follow their lengths."""
    parts = F.concat(*(F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in (namespace, provider, identifier)))
    return F.concat(F.lit("hmac-sha256:"), hmac_sha256(salt, parts.cast("binary")))
