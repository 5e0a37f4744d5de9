"""Extraction of contract definitions and references from source text.

Families whose syntax is regular are column expressions; those that need a scanner or a parser are Python
table functions over one file at a time (mapInPandas), which hold a file and no more. Grammars are bounded
subsets: what they do not cover is reported as a limitation, never guessed.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import secret_reference
from ..functions.identity import route_template
from . import yaml_subset
from .tables import materialise

C = F.col


def routes_of_urls(pages: DataFrame) -> DataFrame:
    """Service and normalised route of absolute URLs."""
    path = F.regexp_extract("url", r"^https?://[^/]+(/.*)?$", 1)
    host = F.lower(F.regexp_extract("url", r"^https?://([^/]+)", 1))
    return pages.select("page_id", host.alias("service"), route_template(F.when(path == "", "/").otherwise(path)).alias("route"))


def links_of_pages(pages: DataFrame) -> DataFrame:
    """Relative routes that pages refer to, one row a reference."""
    found = F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1))
    return pages.select("page_id", F.explode(found).alias("href")).select("page_id", route_template(C("href")).alias("route")).where("route is not null")


def _matches(text: Column, pattern: str, *groups: int) -> Column:
    return F.arrays_zip(*(F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{i}") for i, g in enumerate(groups)))


#: Methods that are contracts, and the names of routers.
METHODS, ROUTERS = "delete|get|head|options|patch|post|put", "app|router|server|fastify|hono"
_LITERAL = r"""('[^']*'|"[^"]*"|`(?:[^`\\]|\\.)*`)"""


def _target(literal: Column) -> tuple[Column, Column]:
    """Host and route of a quoted URL; no route where it is computed in a way that a template can't say."""
    body, quote = F.substr(literal, F.lit(2), F.length(literal) - 2), F.substring(literal, 1, 1)
    host = F.nullif(F.lower(F.regexp_extract(body, r"(?i)^https?://([^/${}]+)(?:/.*)?$", 1)), F.lit(""))
    path = F.when(host.isNotNull(), F.regexp_replace(body, r"(?i)^https?://[^/]+", "")).otherwise(body)
    path = F.when(host.isNotNull() & (path == ""), "/").otherwise(path)
    named = F.regexp_replace(path, r"\$\{\s*[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*\s*\}", "{param}")
    template = F.when(quote == "`", named).otherwise(path)
    return host, F.when((quote != "`") | ~F.contains(template, F.lit("${")), route_template(template))


def spread(files: DataFrame, *by: str) -> DataFrame:
    """Files over all tasks of a shuffle. Reading deals out bytes, and millions of small texts are one task's."""
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def http_contracts(files: DataFrame) -> DataFrame:
    """Routes that files(path, text) serve, calls that they make, and limitations (X6): role, method, host, route.
    A route whose path is computed is a limitation, a call whose URL is computed has no route."""
    text = C("text")
    serve = _matches(text, rf"(?i)\b({ROUTERS})\.({METHODS})\s*\(\s*{_LITERAL}", 1, 2, 3)
    axios = _matches(text, rf"(?i)\baxios\.({METHODS})\s*\(\s*{_LITERAL}", 1, 2)
    client = _matches(text, rf"(?i)\b(?!(?:{ROUTERS}|axios)\.)([A-Za-z_$][\w$]*)\.({METHODS})\s*\(\s*{_LITERAL}", 1, 2, 3)
    fetch = _matches(text, rf"(?i)\bfetch\s*\(\s*{_LITERAL}([\s\S]{{0,512}}?)\)", 1, 2)
    chosen = lambda rest: F.regexp_extract(rest, r"""(?i)\bmethod\s*:\s*['"]([A-Za-z]+)['"]""", 1)
    row = lambda role, method, url: F.struct(F.lit(role).alias("role"), F.upper(method).alias("method"), url.alias("url"))
    named = lambda rest: F.when(~rest.rlike(r"\bmethod\s*:"), "GET").otherwise(F.nullif(chosen(rest), F.lit("")))
    found = F.concat(
        F.transform(serve, lambda m: row("definition", m["g1"], m["g2"])), F.transform(axios, lambda m: row("reference", m["g0"], m["g1"])),
        F.transform(client, lambda m: row("reference", m["g1"], m["g2"])), F.transform(fetch, lambda m: row("reference", named(m["g1"]), m["g0"])),
    )
    computed = rf"(?i)\b(?:fetch|axios\.(?:{METHODS})|[A-Za-z_$][\w$]*\.(?:get|post|put|patch|delete))\s*\(\s*(?!['\"`])"
    marks = {
        "dynamic_url": text.rlike(computed), "proxy_rewrite_unsupported": text.rlike(r"(?i)\b(?:use|register)\s*\([^)]*(?:proxy|rewrite)"),
        "mounted_router_prefix_unresolved": text.rlike(r"""(?i)\b(?:app|router)\.use\s*\(\s*['"`][^'"`]+['"`]\s*,"""), "runtime_route_registration": text.rlike(rf"(?i)\b(?:{ROUTERS})\.route\s*\("),
    }
    # A text is looked through once: what is found, and what is found wanting in all of it, are rows of one table.
    nothing = F.lit(None).cast("string")
    marked = F.transform(_marked(marks), lambda m: F.struct(F.lit("limitation").alias("role"), m.alias("method"), nothing.alias("url")))
    host, route = _target(C("url"))
    rows = spread(files, "path").select("path", F.explode(F.concat(found, marked)).alias("m")).select("path", "m.*")
    rows = materialise(rows.select("path", "role", "method", host.alias("host"), route.alias("route")), "http-contracts")
    bad = F.when(C("role") == "limitation", C("method")).when((C("role") == "definition") & (C("route").isNull() | C("host").isNotNull()), "dynamic_route_registration").when(C("method").isNull(), "dynamic_http_method").when(C("route").isNull(), "dynamic_url")
    limits = rows.select("path", bad.alias("limitation")).where("limitation is not null").distinct()
    good = rows.where("role <> 'limitation' and method is not null and (role = 'reference' or route is not null and host is null)")
    return good.unionByName(limits.select("path", F.lit("limitation").alias("role"), C("limitation").alias("method"), nothing.alias("host"), nothing.alias("route")))


def _marked(marks: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in marks.items())))


def configuration(files: DataFrame, salt: bytes = b"", namespace: str = "default") -> DataFrame:
    """Configuration keys, feature flags and secret references that files(path, text) define or read, and
    limitations for computed ones (X7): role, kind, key. A secret's name never comes out, only a keyed hash of
    its provider and name."""
    text, quoted = C("text"), r"""['"]([^'"]+)['"]"""
    one = lambda role, kind, pattern: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda k: F.struct(F.lit(role).alias("role"), F.lit(kind).alias("kind"), F.lit("").alias("provider"), k.alias("key")))
    two = lambda role, pattern: F.transform(_matches(text, pattern, 1, 2), lambda m: F.struct(F.lit(role).alias("role"), F.lit("secret_reference").alias("kind"), m["g0"].alias("provider"), m["g1"].alias("key")))
    template = C("path").rlike(r"(?i)(?:^|/)\.env\.(?:example|sample|template)$")
    declared = one("definition", "configuration_key", r"(?m)^\s*(?:export\s+)?([A-Za-z_]\w*)\s*=")
    managed = F.transform(F.regexp_extract_all(text, F.lit(rf"\bsecretManager\.getSecret\s*\(\s*{quoted}\s*\)"), F.lit(1)), lambda k: F.struct(F.lit("reference").alias("role"), F.lit("secret_reference").alias("kind"), F.lit("host_secret_manager").alias("provider"), k.alias("key")))
    facts = F.concat(
        F.when(template, declared).otherwise(F.slice(declared, 1, 0)),
        one("definition", "configuration_key", rf"\bdefineConfigKey\s*\(\s*{quoted}\s*\)"), one("definition", "feature_flag", rf"\bdefineFeatureFlag\s*\(\s*{quoted}\s*\)"),
        two("definition", rf"\bdefineSecretReference\s*\(\s*{quoted}\s*,\s*{quoted}\s*\)"),
        one("reference", "configuration_key", r"\bprocess\.env\.([A-Za-z_]\w*)"), one("reference", "configuration_key", rf"\bprocess\.env\s*\[\s*{quoted}\s*\]"),
        one("reference", "configuration_key", rf"\b(?:Deno\.env\.get|os\.getenv|getenv|config\.(?:get|require))\s*\(\s*{quoted}\s*\)"),
        one("reference", "feature_flag", rf"\b(?:isFeatureEnabled|featureFlags\.(?:isEnabled|get)|flags\.(?:isEnabled|get|variation))\s*\(\s*{quoted}"),
        two("reference", rf"\bsecrets\.get\s*\(\s*{quoted}\s*,\s*{quoted}\s*\)"), managed,
    )
    rows = files.select("path", F.explode(facts).alias("m")).select("path", "m.*")
    hidden = secret_reference(salt, F.lit(namespace), C("provider"), C("key"))
    known = rows.select("path", "role", "kind", F.when(C("kind") == "secret_reference", hidden).otherwise(C("key")).alias("key")).distinct()
    marks = {
        "computed_configuration_key": text.rlike(r"""\bprocess\.env\s*\[(?!\s*['"])""") | text.rlike(r"""\b(?:config\.(?:get|require)|flags\.(?:get|isEnabled|variation)|featureFlags\.(?:get|isEnabled))\s*\(\s*(?!['"])"""),
        "computed_secret_reference": text.rlike(r"""\b(?:secrets\.get|secretManager\.getSecret)\s*\(\s*(?!['"])"""),
    }
    limits = files.select("path", F.explode(_marked(marks)).alias("key"))
    return known.unionByName(limits.select("path", F.lit("limitation").alias("role"), F.lit("limitation").alias("kind"), "key"))


#: The eight forms of literal event bindings, by provider, role and kind of destination. Of a match
#: the last group names the destination, those before it region and account.
_WITHIN = r"[\s\S]{0,512}?"
_SQS = r"""\s*\(\s*\{""" + _WITHIN + r"""\bQueueUrl\s*:\s*['"]https://sqs\.([a-z0-9-]+)\.amazonaws\.com/([0-9]+)/([^'"/?\n]+)['"]"""
_SNS = r"""\s*\(\s*\{""" + _WITHIN + r"""\bTopicArn\s*:\s*['"]arn:aws:sns:([a-z0-9-]+):([0-9]+):([^'"\n]+)['"]"""
_KAFKA = r"""\s*\(\s*\{""" + _WITHIN + r"""()()\btopic\s*:\s*['"]([^'"\n]+)['"]"""
_TOPIC = r"""()()\.topic\s*\(\s*['"]([^'"\n]+)['"]\s*\)\s*"""
EVENT_FORMS = {
    ("kafka", "producer", "topic"): r"\.send" + _KAFKA, ("kafka", "consumer", "topic"): r"\.subscribe" + _KAFKA,
    ("aws_sqs", "producer", "queue"): "SendMessageCommand" + _SQS, ("aws_sqs", "consumer", "queue"): "ReceiveMessageCommand" + _SQS,
    ("aws_sns", "producer", "topic"): "PublishCommand" + _SNS, ("aws_sns", "consumer", "topic"): "SubscribeCommand" + _SNS,
    ("gcp_pubsub", "producer", "topic"): _TOPIC + r"\.publishMessage\s*\(", ("gcp_pubsub", "consumer", "topic"): _TOPIC + r"\.subscription\s*\(",
}


def event_destinations(files: DataFrame) -> DataFrame:
    """Topics and queues that files(path, text) publish to or consume from (X4), with the broker's namespace where
    the text says it."""

    def tag(provider: str, role: str, kind: str):
        return lambda m: F.struct(
            F.lit(provider).alias("provider"), F.lit(role).alias("role"), F.lit(kind).alias("kind"),
            F.when(m["g0"] != "", F.concat(F.lit("aws:"), m["g0"], F.lit(":"), m["g1"])).alias("namespace"), m["g2"].alias("destination"),
        )

    found = F.concat(*(F.transform(_matches(C("text"), p, 1, 2, 3), tag(*k)) for k, p in EVENT_FORMS.items()))
    return files.select("path", F.explode(found).alias("m")).select("path", "m.*").where(F.length("destination").between(1, 512)).distinct()


#: Keys of a payload's schema that say what it is.
_SCHEMA_KEYS = {"$ref", "type", "format", "properties", "required", "items", "additionalProperties", "enum", "oneOf", "anyOf", "allOf"}


def event_manifests(files: DataFrame, schema: str = "events") -> DataFrame:
    """Bindings of event manifests in JSON or YAML, with the payload's schema in canonical form."""

    def normal(value):
        if isinstance(value, dict):
            return {k: ({n: normal(p) for n, p in sorted(v.items())} if k == "properties" else normal(v)) for k, v in sorted(value.items()) if k in _SCHEMA_KEYS}
        return [normal(x) for x in value] if isinstance(value, list) else value

    def parse(text: str) -> list:
        doc, out = yaml_subset.load(text), []
        if not isinstance(doc, dict) or doc.get("schema") != schema:
            return []
        for b in doc["bindings"]:
            if ("destination" in b) == ("destinationExpression" in b):
                raise ValueError("a destination is a literal or an expression")
            kind = b.get("destinationKind") or ("queue" if b["provider"] == "aws_sqs" else "subscription" if b["provider"] == "gcp_pubsub" and b["role"] == "consumer" else "topic")
            shape = json.dumps(normal((b.get("payloadSchema") or {}).get("schema")), sort_keys=True, separators=(",", ":"))
            out.append((b["role"], f"{b['provider']}:{kind}:{b.get('destination') or '?'}", shape))
        return out

    return _per_file(files, parse, "path string, kind string, name string, detail string")


_IDENTIFIER = r"[A-Za-z_$][\w$]*"


#: Comments and literals of source text, none of which can backtrack: a line, a block (to the end if it is open), quoted
#: text on one line, a template. What stands in a regular expression's literal is not told from code.
_OPAQUE = r"//[^\n]*+|/\*[\s\S]*?(?:\*/|\z)|'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'|\"[^\"\\\n]*+(?:\\[\s\S][^\"\\\n]*+)*+\"|`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`"


def masked(text: Column) -> tuple[Column, Column]:
    """Source text in one pass with comments as a space and every literal as its number in quotes, and the list that the
    numbers mean: nothing inside either can look like code."""
    hits = F.regexp_extract_all(text, F.lit(_OPAQUE), F.lit(0))
    quote = lambda h: F.substring(h, 1, 1)
    told = F.transform(hits, lambda h, i: F.when(quote(h) == "/", F.lit(" ")).otherwise(F.concat(quote(h), i.cast("string"), quote(h))))
    code = F.transform(F.arrays_zip(F.split(text, _OPAQUE, -1).alias("gap"), told.alias("told")), lambda x: F.concat(x["gap"], F.coalesce(x["told"], F.lit(""))))
    return F.array_join(code, ""), F.transform(hits, lambda h: F.substr(h, F.lit(2), F.length(h) - 2))


def module_symbols(files: DataFrame) -> DataFrame:
    """Exported names, re-exports and imports of modules, by a bounded set of forms rather than a grammar (X1):
    role, name, source (of a re-export or import), imported, the name there (`*` for all), and kind: how an import is
    made, static, dynamic or by require. Comments and literals are masked first."""
    code, literals = masked(C("text"))
    files = spread(files.select("path", "text"), "path").select("path", code.alias("text"), literals.alias("literals"))
    text, called = C("text"), lambda n: F.get(C("literals"), n.try_cast("int"))
    own = _matches(text, rf"\bexport\s+(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(function\*?|class|const|let|var|interface|type|enum|namespace)\s+({_IDENTIFIER})", 1, 2)
    default = F.regexp_extract_all(text, F.lit(r"\bexport\s+(default)\b"), F.lit(1))
    stars = F.regexp_extract_all(text, F.lit(r"""\bexport\s*\*\s*from\s*['"](\d+)['"]"""), F.lit(1))
    lists = _matches(text, r"""\bexport\s+(?:type\s+)?\{([^}]*)\}(?:\s*from\s*['"](\d+)['"])?""", 1, 2)
    brought = _matches(text, r"""(\bfrom|\bimport\s*\(|\brequire\s*\(|\bimport)\s*['"](\d+)['"]""", 1, 2)
    none = F.lit(None).cast("string")
    row = lambda role, name, source=none, imported=none, kind=none: F.struct(F.lit(role).alias("role"), name.alias("name"), source.alias("source"), imported.alias("imported"), kind.alias("kind"))
    pairs = lambda m: F.transform(F.filter(F.transform(F.split(m["g0"], ","), lambda x: F.trim(x)), lambda n: n != ""), lambda n: F.struct(n.alias("n"), m["g1"].alias("from")))
    each = F.flatten(F.transform(lists, pairs))
    outer = lambda n: F.regexp_extract(n, rf"({_IDENTIFIER})\s*$", 1)
    inner = lambda n: F.regexp_extract(n, rf"^(?:type\s+)?({_IDENTIFIER})", 1)
    way = lambda m: F.when(m["g0"].startswith("require"), "require").when(m["g0"].endswith("("), "dynamic").otherwise("static")
    static = F.lit("static")
    found = F.concat(
        F.transform(own, lambda m: row("export", m["g1"])), F.transform(default, lambda n: row("export", n)), F.transform(stars, lambda s: row("reexport", F.lit("*"), called(s), F.lit("*"), static)),
        F.transform(F.filter(each, lambda p: p["from"] == ""), lambda p: row("export", outer(p["n"]))),
        F.transform(F.filter(each, lambda p: p["from"] != ""), lambda p: row("reexport", outer(p["n"]), called(p["from"]), inner(p["n"]), static)), F.transform(brought, lambda m: row("import", called(m["g1"]), called(m["g1"]), none, way(m))),
    )
    return files.select("path", F.explode(found).alias("m")).select("path", "m.*").where("name <> ''").distinct()


def reexported_symbols(symbols: DataFrame, targets: DataFrame) -> DataFrame:
    """What each module exports, its own names and those through re-exports (G3): symbols as module_symbols()
    gives them, targets(path, source, target) where a source leads. Names travel from module to module, a
    round for each step, only new ones further, until a round brings none; cycles bring none. A star brings
    all names but `default`. Rows say where a name is declared and how far that is."""
    from itertools import count

    from .tables import shared_dir

    shared_dir(symbols.sparkSession)
    links = symbols.where("role = 'reexport'").join(targets, ["path", "source"]).select("path", "target", "name", "imported").checkpoint()
    out = symbols.where("role = 'export'").select("path", "name", C("path").alias("declared_in"), C("name").alias("declared_as"), F.lit(0).alias("steps")).distinct().checkpoint()
    fresh = out
    for step in count(1):
        arriving = fresh.select(C("path").alias("target"), C("name").alias("_name"), "declared_in", "declared_as").join(links, "target")
        star = C("imported") == "*"
        arriving = arriving.where(star & (C("_name") != "default") | (C("imported") == C("_name")))
        arriving = arriving.select("path", F.when(star, C("_name")).otherwise(C("name")).alias("name"), "declared_in", "declared_as").distinct()
        fresh = arriving.join(out, ["path", "name", "declared_in", "declared_as"], "left_anti").withColumn("steps", F.lit(step)).checkpoint()
        if fresh.isEmpty():
            return out
        out = out.unionByName(fresh)
        if step % 16 == 0:
            out = out.checkpoint()


def overloads(symbols: DataFrame) -> DataFrame:
    """Declarations of one module, space and name as one symbol with its signatures in order."""
    return symbols.groupBy("path", "space", "name").agg(F.array_sort(F.collect_list("signature")).alias("overloads"))


_METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")


def _per_file(files: DataFrame, parse, schema: str) -> DataFrame:
    """parse(path, text) gives rows of schema; a file that cannot be read is one limitation row."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows: list = []
            for path, text in zip(frame["path"], frame["text"], strict=True):
                try:
                    rows += [(path, *r) for r in parse(text or "")]
                except (ValueError, KeyError, TypeError, AttributeError, RecursionError) as e:
                    rows.append((path, "limitation", type(e).__name__, *[None] * (len(names) - 3)))
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "text").mapInPandas(run, schema)


def sql_references(files: DataFrame) -> DataFrame:
    """Tables that SQL in files(path, text) reads or writes, and models that a client's calls name."""
    name = r"""["`]?([A-Za-z_][\w.]*)["`]?"""
    read = F.regexp_extract_all("text", F.lit(rf"(?i)\b(?:from|join)\s+{name}"), F.lit(1))
    write = F.regexp_extract_all("text", F.lit(rf"(?i)\b(?:insert\s+into|update|delete\s+from)\s+{name}"), F.lit(1))
    model = F.regexp_extract_all("text", F.lit(r"\bprisma\.([a-z]\w*)\.(?:find|create|update|delete|upsert|count|aggregate|groupBy)\w*\s*\("), F.lit(1))
    tagged = lambda role, found: F.transform(found, lambda n: F.struct(F.lit(role).alias("role"), F.lower(n).alias("name")))
    rows = files.select("path", F.explode(F.concat(tagged("reads", read), tagged("writes", write), tagged("model", model))).alias("m"))
    return rows.select("path", "m.*").distinct()


def api_operations(files: DataFrame) -> DataFrame:
    """Operations of API descriptions in JSON or YAML: by id, else by method and template; local references
    within parameters are followed with a guard against cycles (X2, F11, F21)."""

    def parse(text: str) -> list:
        doc, out = yaml_subset.load(text), []
        for path, item in sorted((doc.get("paths") or {}).items()):
            item = resolve_pointer(doc, item)
            shared = item.get("parameters", [])
            for method in _METHODS:
                if method in item:
                    op = item[method]
                    template = re.sub(r"\{[^}]*\}", "{}", path)
                    params = sorted(p.get("name", "") for p in (resolve_pointer(doc, p) for p in [*shared, *op.get("parameters", [])]) if p.get("required"))
                    out.append(("operation", op.get("operationId") or f"{method.upper()} {template}", ",".join(params)))
        return out

    return _per_file(files, parse, "path string, kind string, name string, detail string")


def resolve_pointer(doc: dict, node, seen: frozenset = frozenset()):
    """The object that local references lead to."""
    while isinstance(node, dict) and "$ref" in node:
        ref = node["$ref"]
        if ref in seen or not ref.startswith("#/"):
            raise ValueError("unresolvable reference")
        seen, node = seen | {ref}, doc
        for part in ref[2:].split("/"):
            node = node[part.replace("~1", "/").replace("~0", "~")]
    return node


def message_schemas(files: DataFrame) -> DataFrame:
    """Methods and fields by wire number of descriptor sets in JSON, nested messages included."""

    def parse(text: str) -> list:
        out = []

        def message(prefix: str, m: dict) -> None:
            name = f"{prefix}.{m['name']}" if prefix else m["name"]
            out.extend(("field", f"{name}#{f['number']}", f"{f.get('name')}:{f.get('typeName') or f.get('type')}:{f.get('label')}") for f in m.get("field", []))
            for inner in m.get("nestedType", []):
                message(name, inner)

        for file in json.loads(text).get("file", []):
            for m in file.get("messageType", []):
                message(file.get("package", ""), m)
            for s in file.get("service", []):
                out.extend(("method", f"{file.get('package', '')}.{s['name']}/{m['name']}", f"{m.get('inputType')}->{m.get('outputType')}") for m in s.get("method", []))
        return out

    return _per_file(files, parse, "path string, kind string, name string, detail string")


#: Kinds of objects that run workloads.
WORKLOADS = ("Deployment", "StatefulSet", "DaemonSet")


def _objects(doc) -> list[dict]:
    if isinstance(doc, list):
        return [d for x in doc for d in _objects(x)]
    return [d for x in doc["items"] for d in _objects(x)] if isinstance(doc, dict) and "items" in doc and "kind" not in doc else [doc] if isinstance(doc, dict) else []


def _cluster_facts(doc: dict) -> list:
    """Services with their endpoints, ingresses as references to these, workloads with their containers."""
    kind, spec = doc.get("kind"), doc.get("spec") or {}
    name = (doc.get("metadata") or {}).get("name")
    if name is None:
        return []
    if kind == "Service":
        return [("service", name, "")] + [("endpoint", name, f"{p['port']}/{p.get('protocol', 'TCP')}") for p in spec.get("ports") or [] if "port" in p]
    if kind == "Ingress":
        out = []
        for rule in spec.get("rules") or []:
            for path in ((rule.get("http") or {}).get("paths")) or []:
                service = (path.get("backend") or {}).get("service") or {}
                port = service.get("port") or {}
                out += [("service_reference", service["name"], "")] if "name" in service else []
                out += [("endpoint_reference", service["name"], f"{port.get('number', port.get('name'))}/TCP")] if port else []
        return out
    if kind in WORKLOADS:
        containers = ((spec.get("template") or {}).get("spec") or {}).get("containers") or []
        return [("workload", f"{kind.lower()}/{name}", "")] + [("container", f"{name}/{c['name']}", "") for c in containers]
    return []


def render_chart(text: str, values: dict) -> tuple[str, bool]:
    """A chart's template with plain values put in, and whether anything else is left to compute."""
    left = False

    def put(m: re.Match) -> str:
        nonlocal left
        name = re.fullmatch(r"\.Values\.([\w.-]+)", m[1].strip())
        value = values.get(name[1]) if name else None
        left = left or not isinstance(value, (str, int, float, bool))
        return str(value)

    return re.sub(r"\{\{-?\s*([^{}]+?)\s*-?\}\}", put, text), left


def infrastructure(files: DataFrame, values: dict | None = None) -> DataFrame:
    """Services, endpoints, workloads, containers and references of cluster manifests in YAML or JSON, of charts
    whose values are plain, and services, outputs and remote state of declarative modules (X8). A file that
    none of these forms explains is a limitation row."""

    def parse(text: str) -> list:
        if "{{" in text:
            text, left = render_chart(text, values or {})
            if left:
                return [("limitation", "helm_template_unresolved", "")]
        if re.search(r"(?m)^\s*(?:resource|output)\s+\"", text) or "data.terraform_remote_state." in text:
            return _module_facts(text)
        docs = [json.loads(text)] if text.lstrip()[:1] in "{[" else yaml_subset.documents(text)
        out = [f for d in docs for o in _objects(d) for f in _cluster_facts(o)]
        return out or ([("limitation", "infrastructure_syntax_unresolved", "")] if text.strip() else [])

    return _per_file(files, parse, "path string, kind string, name string, detail string")


def _module_facts(text: str) -> list:
    out = []
    for m in re.finditer(r'\bresource\s+"kubernetes_service"\s+"([\w-]+)"\s*\{', text):
        depth, at = 1, m.end()
        for token in re.compile(r'"(?:[^"\\]|\\.)*"|[{}]').finditer(text, m.end()):
            depth += (token[0] == "{") - (token[0] == "}")
            at = token.end()
            if not depth:
                break
        body = text[m.end() : at]
        literal = re.search(r'\bname\s*=\s*"([^"]+)"', body)
        name = literal[1] if literal else m[1]
        out += [("service", name, ""), *(("endpoint", name, f"{p}/TCP") for p in re.findall(r"\bport\s*=\s*(\d+)", body))]
    out += [("output", n, "") for n in re.findall(r'\boutput\s+"([\w-]+)"\s*\{', text)]
    return out + [("output_reference", n, alias) for alias, n in re.findall(r"\bdata\.terraform_remote_state\.([\w-]+)\.outputs\.([\w-]+)", text)]


def split_statements(text: str) -> list[str]:
    """SQL statements of a script: comments masked, quotes and dollar quotes respected."""
    out, start, i = [], 0, 0
    clean = []
    token = re.compile(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|\$(\w*)\$.*?\$\1\$|;", re.S)
    for m in token.finditer(text):
        clean.append(text[i : m.start()])
        piece = m[0]
        if piece == ";":
            out.append("".join(clean).strip())
            clean = []
        elif not piece.startswith(("--", "/*")):
            clean.append(piece)
        i = m.end()
    clean.append(text[i:])
    out.append("".join(clean).strip())
    return [s for s in out[start:] if s]


def _split_top(body: str) -> list[str]:
    depth, out, cur = 0, [], []
    for c in body:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("".join(cur).strip())
            cur = []
        else:
            cur.append(c)
    return [*out, "".join(cur).strip()]


_NAME = r'"?([\w.]+)"?'
_CONSTRAINT = re.compile(r"^(?:primary|foreign|unique|check|constraint|exclude)\b", re.I)


def replay_migrations(files: DataFrame) -> DataFrame:
    """Tables, columns and enums after replaying files(namespace, path, text) in order of path (X5, W6). A
    statement depends on those before it, so a namespace is replayed by one task, which goes through the sorted files
    of many, one text after the other."""

    def replay(batches):
        last, state, rows = None, None, []

        def close():
            rows.extend((last, k, n, v) for (k, n), v in sorted(state.items()))

        def told():
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*rows, strict=True)], names=["namespace", "kind", "name", "shape"])

        for b in batches:
            for namespace, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if state is None or namespace != last:
                    if state is not None:
                        close()
                    last, state = namespace, {}
                for s in split_statements(text or ""):
                    _apply(s, state)
            if rows:
                yield told()
                rows.clear()
        if state is not None:
            close()
        if rows:
            yield told()

    laid = spread(files.select("namespace", "path", "text"), "namespace").sortWithinPartitions("namespace", F.asc_nulls_last("path"), "text")
    return laid.select(C("namespace").cast("string").alias("namespace"), "text").mapInArrow(replay, "namespace string, kind string, name string, shape string")


def _column(table: str, text: str, state: dict) -> None:
    if m := re.match(rf"{_NAME}\s+(.+)$", text, re.S):
        kind = re.split(r"\s+(?:not\s+null|null|default|primary|references|unique|check|constraint)\b", m[2], maxsplit=1, flags=re.I)[0]
        nullable = not re.search(r"\bnot\s+null\b|\bprimary\s+key\b", m[2], re.I)
        state["column", f"{table}.{m[1].lower()}"] = f"{' '.join(kind.lower().split())}|{'null' if nullable else 'not null'}"


def _apply(statement: str, state: dict) -> None:
    """One statement's effect on the state."""
    s = " ".join(statement.split()) if "'" not in statement else statement.strip()
    if m := re.match(rf"create\s+table\s+(?:if\s+not\s+exists\s+)?{_NAME}\s*\((.*)\)", s, re.I | re.S):
        table = m[1].lower()
        state["table", table] = ""
        for part in _split_top(m[2]):
            if part and not _CONSTRAINT.match(part):
                _column(table, part, state)
    elif m := re.match(rf"drop\s+table\s+(?:if\s+exists\s+)?{_NAME}", s, re.I):
        for k in [k for k in state if k[1] == m[1].lower() or k[1].startswith(f"{m[1].lower()}.")]:
            del state[k]
    elif m := re.match(rf"create\s+type\s+{_NAME}\s+as\s+enum\s*\((.*)\)", s, re.I | re.S):
        state["enum", m[1].lower()] = ",".join(re.findall(r"'((?:[^']|'')*)'", m[2]))
    elif m := re.match(rf"alter\s+type\s+{_NAME}\s+add\s+value\s+(?:if\s+not\s+exists\s+)?'([^']*)'", s, re.I):
        state["enum", m[1].lower()] = ",".join(filter(None, [state.get(("enum", m[1].lower()), ""), m[2]]))
    elif m := re.match(rf"alter\s+table\s+(?:if\s+exists\s+)?(?:only\s+)?{_NAME}\s+(.*)$", s, re.I | re.S):
        table = m[1].lower()
        for part in _split_top(m[2]):
            _alter(table, part, state)


def _alter(table: str, part: str, state: dict) -> None:
    if m := re.match(rf"rename\s+to\s+{_NAME}", part, re.I):
        for k in [k for k in state if k[1] == table or k[1].startswith(f"{table}.")]:
            state[k[0], m[1].lower() + k[1][len(table) :]] = state.pop(k)
    elif m := re.match(rf"rename\s+(?:column\s+)?{_NAME}\s+to\s+{_NAME}", part, re.I):
        if (old := ("column", f"{table}.{m[1].lower()}")) in state:
            state["column", f"{table}.{m[2].lower()}"] = state.pop(old)
    elif m := re.match(rf"drop\s+column\s+(?:if\s+exists\s+)?{_NAME}", part, re.I):
        state.pop(("column", f"{table}.{m[1].lower()}"), None)
    elif m := re.match(rf"alter\s+(?:column\s+)?{_NAME}\s+(set\s+not\s+null|drop\s+not\s+null|(?:set\s+data\s+)?type\s+(.+))", part, re.I):
        if (key := ("column", f"{table}.{m[1].lower()}")) in state:
            kind, null = state[key].split("|")
            action = m[2].lower()
            kind = " ".join(m[3].lower().split()) if m[3] else kind
            state[key] = f"{kind}|{'not null' if action.startswith('set not') else 'null' if action.startswith('drop') else null}"
    elif m := re.match(r"add\s+(?:column\s+)?(?:if\s+not\s+exists\s+)?(.+)$", part, re.I | re.S):
        if not _CONSTRAINT.match(m[1]):
            _column(table, m[1], state)
