"""Sources and sinks of records: refs and trees, signed deliveries, caches, configuration, bundles, backups."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import hmac_sha256
from ..functions.identity import valid_identifier

C = F.col

# Repositories, exported as tables: Git itself stays outside.


def resolve_commits(requests: DataFrame, refs: DataFrame, commits: DataFrame) -> DataFrame:
    """The exact commit that each request(repository, ref) means: a full hash of a known commit is itself, a
    name is the ref's, by its full name or as a branch or tag (S1). No row's commit is guessed: none is null."""
    full = F.array("ref", F.concat(F.lit("refs/heads/"), "ref"), F.concat(F.lit("refs/tags/"), "ref"))
    named = requests.select("repository", "ref", F.posexplode(full).alias("rank", "name")).join(refs.select("repository", "name", C("commit").alias("_named")), ["repository", "name"])
    first = named.groupBy("repository", "ref").agg(F.min_by("_named", "rank").alias("_named"))
    known = commits.select("repository", C("commit").alias("ref"), C("commit").alias("_exact"))
    out = requests.join(known, ["repository", "ref"], "left").join(first, ["repository", "ref"], "left")
    return out.select("repository", "ref", F.coalesce(F.when(valid_identifier("commit", F.lower("ref")), C("_exact")), "_named").alias("commit"))


def list_tree(trees: DataFrame, commits: DataFrame) -> DataFrame:
    """Entries of the trees of commits (S2), by path."""
    return trees.join(commits.select("repository", "commit").distinct(), ["repository", "commit"], "left_semi")


def read_blobs(blobs: DataFrame, wanted: DataFrame, most: int) -> DataFrame:
    """Content of blobs up to so many bytes, and whether more was there (S3)."""
    held = blobs.join(wanted.select("blob").distinct(), "blob", "left_semi")
    size = F.octet_length("content")
    return held.select("blob", F.substring("content", 1, most).alias("content"), size.cast("long").alias("size"), (size > most).alias("truncated"))


# Deliveries of a provider.

#: Events that are taken, and the actions of those that have any.
EVENTS = {
    "push": None, "pull_request": ["opened", "reopened", "synchronize", "ready_for_review", "closed"], "check_run": ["requested_action", "rerequested"],
    "installation": ["created", "deleted", "suspend", "unsuspend"], "installation_repositories": ["added", "removed"],
}
#: Bytes of a body at most.
BODY = 1_048_576


def receive(deliveries: DataFrame, secret: bytes) -> tuple[DataFrame, DataFrame]:
    """Signed deliveries(body: binary, signature, delivery_id, event_type) that are taken, with the hash of their
    body and what they point at, and those that are not, with the first reason (S6). The signature is checked
    by two plain hashes over the body, so no secret and no body leaves the JVM; of the body only numbers,
    hashes and names of refs are kept."""
    text = C("body").cast("string")
    part = lambda path: F.get_json_object(text, path)
    supplied = F.regexp_extract("signature", "^sha256=([0-9a-f]{64})$", 1)
    action = part("$.action")
    listed = F.coalesce(*(F.when(C("event_type") == e, F.array(*map(F.lit, a)) if a else F.array().cast("array<string>")) for e, a in EVENTS.items()))
    known = C("event_type").isin(*EVENTS)
    sha = lambda path: F.when(valid_identifier("commit", part(path)), part(path))
    push, pull = C("event_type") == "push", C("event_type") == "pull_request"
    base, head = sha("$.pull_request.base.sha"), sha("$.pull_request.head.sha")
    number = lambda path: F.when(part(path).rlike("^[1-9][0-9]{0,15}$"), part(path).cast("long"))
    marked = deliveries.withColumns({
        "action": action, "_known": known, "_actions": listed, "before": F.when(push, sha("$.before")), "after": F.when(push, sha("$.after")), "ref": F.when(push, part("$.ref")),
        "pull_request": F.when(pull, number("$.number")), "base": F.when(pull, base), "head": F.when(pull, head), "fork": F.when(pull, F.coalesce(part("$.pull_request.head.repo.fork") == "true", F.lit(False))),
        "installation": number("$.installation.id"), "repository": number("$.repository.id"), "_signed": F.coalesce(supplied == hmac_sha256(secret, C("body")), F.lit(False)),
    })
    missing = push & (C("before").isNull() | C("after").isNull()) | pull & (C("pull_request").isNull() | C("base").isNull() | C("head").isNull())
    why = (
        F.when(F.octet_length("body") > BODY, "body_too_large")
        .when(~C("_signed"), "signature_invalid")
        .when(~F.coalesce(F.length("delivery_id").between(1, 255), F.lit(False)), "delivery_id_invalid")
        .when(~F.coalesce(C("_known"), F.lit(False)), "event_unsupported")
        .when(C("installation").isNull(), "payload_invalid")
        .when((F.size("_actions") > 0) & ~F.coalesce(F.array_contains("_actions", C("action")), F.lit(False)), "action_unsupported")
        .when(missing, "payload_invalid")
    )
    out = marked.withColumn("reason", why)
    pointer = ["installation", "repository", "action", "before", "after", "ref", "pull_request", "base", "head", "fork"]
    taken = out.where("reason is null").select("delivery_id", "event_type", F.concat(F.lit("sha256:"), F.sha2("body", 256)).alias("payload_hash"), *pointer)
    return taken, out.where("reason is not null").select("delivery_id", "event_type", "reason")


# Caches, configuration, bundles.

#: Bytes of a cached artifact at most.
ENTRY = 65_536


def cache_put(held: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries(key, content: binary) to add to a cache: small enough, and not there yet."""
    new = entries.where(F.octet_length("content") <= ENTRY).join(held.select("key"), "key", "left_anti").dropDuplicates(["key"])
    return new.select("key", "content", F.sha2("content", 256).alias("hash"))


def cache_get(held: DataFrame, keys: DataFrame) -> DataFrame:
    """Each key with its content; an entry whose content isn't what its hash says is a miss, and marked."""
    joined = keys.select("key").distinct().join(held, "key", "left")
    sound = F.sha2("content", 256) == C("hash")
    return joined.select("key", F.when(sound, C("content")).alias("content"), F.coalesce(sound, F.lit(False)).alias("hit"), F.coalesce(C("hash").isNotNull() & ~sound, F.lit(False)).alias("corrupt"))


def load_config(spark: SparkSession, path: str, required: list[str], most: int = 1_048_576) -> dict:
    """A workspace's configuration: one JSON file of bounded size with the required keys."""
    rows = spark.read.format("binaryFile").load(path).select("length", F.when(C("length") <= most, C("content")).alias("content")).limit(2).collect()
    if len(rows) != 1 or rows[0].content is None:
        raise ValueError("configuration must be one file of bounded size")
    config = json.loads(bytes(rows[0].content))
    if missing := [k for k in required if k not in config]:
        raise ValueError(f"configuration lacks {', '.join(missing)}")
    return config


BUNDLE = "manifest struct<caseIds:array<string>,revision:string>, cases array<struct<id:string,subset:string,eligiblePullRequestId:string,outputHash:string>>"


def import_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Cases of corpus bundles in JSON, and what doesn't agree with their manifests (S14): an id that is listed but
    not there, or there but not listed."""
    read = spark.read.schema(BUNDLE).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("bundle", C("_metadata.file_path"))
    cases = read.select("bundle", F.explode("cases").alias("case")).select("bundle", "case.*")
    listed = read.select("bundle", F.explode("manifest.caseIds").alias("id"))
    lost = listed.join(cases, ["bundle", "id"], "left_anti").withColumn("problem", F.lit("listed_without_case"))
    more = cases.select("bundle", "id").join(listed, ["bundle", "id"], "left_anti").withColumn("problem", F.lit("case_not_listed"))
    return cases, lost.unionByName(more)


# Backups and versions of tables.


def manifest(df: DataFrame, columns: list[str]) -> DataFrame:
    """Row count and an order-free content hash, for a backup and the check before a restore."""
    row = F.xxhash64(*columns)
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("content_hash"))


def restore(backup: dict[str, DataFrame], manifests: dict[str, tuple[int, str]], tenant, column: str = "workspace") -> dict[str, DataFrame]:
    """A backup's tables, once each is what its manifest says and holds nothing of another tenant (S11); nothing is
    given back before all are checked."""
    for name, df in backup.items():
        found = manifest(df, df.columns).first()
        if (found["rows"], found["content_hash"]) != tuple(manifests.get(name, (None, None))):
            raise ValueError(f"backup of {name} is not what its manifest says")
        if not df.where(~C(column).eqNullSafe(F.lit(tenant))).isEmpty():
            raise ValueError(f"backup of {name} holds rows of another tenant")
    return dict(backup)


def migrate(tables: dict[str, DataFrame], applied: int, steps: list[Callable[[dict[str, DataFrame]], dict[str, DataFrame]]]) -> tuple[dict[str, DataFrame], int]:
    """Tables brought to the newest version by the steps that were not applied yet, in order; never back."""
    if applied > len(steps):
        raise ValueError("tables are of a version that is not known here")
    for step in steps[applied:]:
        tables = step(tables)
    return tables, len(steps)


def append_audit(held: DataFrame, entries: DataFrame) -> DataFrame:
    """Audit entries to append: those whose id isn't there yet (S17). What is there is never changed."""
    return entries.join(held.select("audit_id"), "audit_id", "left_anti").dropDuplicates(["audit_id"])


