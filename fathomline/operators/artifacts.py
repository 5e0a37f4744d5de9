"""Classification of source artifacts and the coverage of a snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col

#: Languages by extension, and paths that are not read.
LANGUAGES = {
    ".c": "c", ".cc": "cpp", ".cpp": "cpp", ".cs": "csharp", ".css": "css", ".go": "go", ".graphql": "graphql", ".gql": "graphql", ".h": "c", ".hpp": "cpp",
    ".html": "html", ".java": "java", ".js": "javascript", ".json": "json", ".jsx": "javascript", ".kt": "kotlin", ".kts": "kotlin", ".md": "markdown",
    ".mjs": "javascript", ".mts": "typescript", ".php": "php", ".proto": "protobuf", ".py": "python", ".rb": "ruby", ".rs": "rust", ".sh": "shell",
    ".sql": "sql", ".swift": "swift", ".toml": "toml", ".ts": "typescript", ".tsx": "typescript", ".txt": "text", ".xml": "xml", ".yaml": "yaml", ".yml": "yaml",
}
#: Size beyond which a file is not read: 2 MiB, the default of the published generator.
MAXIMUM = 2 * 1024 * 1024
VENDORED = ["node_modules", "vendor", "third_party", "third-party", ".git"]
GENERATED = ["dist", "build", "coverage", ".next", "target"]
GENERATED_ENDS = [".min.js", ".min.css", ".generated.ts", ".g.ts", ".pb.go"]
ARCHIVE_ENDS = [".zip", ".tar", ".tgz", ".gz", ".bz2", ".xz", ".7z", ".rar", ".jar", ".war"]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def _ends(path: Column, ends: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, ends)), lambda e: path.endswith(e))


def classify(entries: DataFrame, maximum: int) -> DataFrame:
    """Class, language and line count of entries(path, entry_kind, size, text), the first rule that holds
    (P1-P3). Text is null where it could not be decoded."""
    path = F.lower("path")
    segments = F.split(path, "/")
    language = F.element_at(F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv)), extension(C("path")))
    kind = (
        F.when(C("entry_kind").isin("symlink", "submodule"), C("entry_kind"))
        .when(F.arrays_overlap(segments, F.array(*map(F.lit, VENDORED))), "vendored")
        .when(F.arrays_overlap(segments, F.array(*map(F.lit, GENERATED))) | _ends(path, GENERATED_ENDS), "generated")
        .when(_ends(path, ARCHIVE_ENDS), "unsupported")
        .when(C("size") > maximum, "oversized")
        .when(F.instr("text", "\0") > 0, "binary")
        .when(C("text").isNull() | language.isNull(), "unsupported")
        .otherwise("source")
    )
    lines = F.when(C("text") == "", 0).otherwise(F.size(F.split("text", "\n", -1)))
    out = entries.withColumn("classification", kind)
    source = C("classification") == "source"
    return out.withColumns({
        "language": F.when(source, language).when(C("entry_kind") != "file", C("entry_kind")).otherwise("unknown"),
        "line_count": F.when(source, lines),
        "content_hash": F.when(source, F.concat(F.lit("sha256:"), F.sha2("text", 256))),
    })


def coverage(classified: DataFrame, by: list[str]) -> DataFrame:
    """Counters of a snapshot: entries, eligible, processed, skipped, by language known (A1, A2)."""
    source = C("classification") == "source"
    return classified.groupBy(*by).agg(
        F.count("*").alias("entries"),
        F.count_if(source).alias("processed"),
        F.count_if(~source).alias("skipped"),
        F.count_if(C("classification").isin("oversized", "binary")).alias("limited"),
        F.sum(F.when(source, C("line_count")).otherwise(0)).cast("long").alias("lines"),
        F.sum("size").cast("long").alias("bytes"),
    )


#: The dimensions of a snapshot's coverage, in order.
DIMENSIONS = ["repository", "tree", "file", "language", "parser", "adapter"]


def dimension_coverage(classified: DataFrame, trees: DataFrame) -> DataFrame:
    """The six dimensions of each generation's coverage (A1; A2 over the changed files alone): state, counters and
    reason of repository, tree, file, language, parser and adapter. classified(generation_id, classification,
    parse_state, language), trees(generation_id, complete). Counters are one aggregation, dimensions its rows."""
    source, parsed, failed = C("classification") == "source", C("parse_state") == "parsed", C("parse_state") == "failed"
    by = classified.groupBy("generation_id").agg(
        F.count("*").alias("n"), F.count_if(failed).alias("failed"), F.count_if(C("parse_state") == "skipped").alias("skipped"), F.count_if(parsed).alias("parsed"),
        F.count_if(C("language") != "unknown").alias("languages"), F.count_if(source & parsed).alias("sound"),
    )
    one = trees.join(by, "generation_id", "left").fillna(0, ["n", "failed", "skipped", "parsed", "languages", "sound"])
    zero, lost = F.lit(0).cast("long"), F.when(C("complete"), 0).otherwise(1).cast("long")
    whole = lambda ok: F.when(ok, "complete").otherwise("partial")
    incomplete = F.when(~C("complete"), "incomplete_tree")
    spoken = C("languages") == C("n")
    rows = [
        ("repository", whole(C("complete") & (C("failed") == 0)), F.lit(1).cast("long"), F.lit(1).cast("long"), zero, lost, incomplete),
        ("tree", whole(C("complete")), C("n"), C("n"), zero, lost, incomplete),
        ("file", whole(C("failed") == 0), C("n"), C("n") - C("failed"), C("skipped"), C("failed"), F.lit(None)),
        ("language", whole(spoken), C("n"), C("languages"), C("n") - C("languages"), zero, F.when(~spoken, "unsupported_language")),
        ("parser", whole(C("sound") == C("n")), C("n"), C("parsed"), C("skipped"), C("failed"), F.lit(None)),
        ("adapter", F.lit("not_analysed"), zero, zero, zero, zero, F.lit(None)),
    ]
    names = ("dimension", "state", "eligible", "processed", "skipped", "failed", "reason")
    structs = F.array(*(F.struct(F.lit(r[0]).alias(names[0]), *(c.cast("string" if n in ("state", "reason") else "long").alias(n) for n, c in zip(names[1:], r[1:], strict=True))) for r in rows))
    return one.select("generation_id", F.explode(structs).alias("d")).select("generation_id", "d.*")


def observation_state(extractions: DataFrame, by: list[str]) -> DataFrame:
    """Coverage of what adapters observed of each generation: extractions(state, items) (A3, X11). Unsupported or
    failed only where nothing was found at all."""
    n, found = F.count("*"), F.sum("items") > 0
    off = C("state").isin("failed", "unsupported")
    state = (
        F.when((F.count_if(C("state") == "unsupported") == n) & ~found, "unsupported")
        .when((F.count_if(off) == n) & ~found, "failed")
        .when(F.count_if(C("state") == "complete") == n, "complete")
        .otherwise("partial")
    )
    return extractions.groupBy(*by).agg(state.alias("state"))


def limitations(rows: DataFrame) -> DataFrame:
    """Limitations once for each code and scope, with how often they were met."""
    return rows.groupBy("code", "scope").agg(F.count("*").alias("times"))


def extraction_state(files: DataFrame, by: list[str]) -> DataFrame:
    """State of each group of files(state): unsupported, failed, partial or complete (A3)."""
    n = F.count("*")
    state = F.when(F.count_if(C("state") == "unsupported") == n, "unsupported").when(F.count_if(C("state") == "failed") == n, "failed").when(F.count_if(C("state") != "complete") > 0, "partial").otherwise("complete")
    return files.groupBy(*by).agg(state.alias("state"))


def coverage_violations(records: DataFrame) -> DataFrame:
    """Counters that do not add up (A5)."""
    return records.where(C("processed") + C("skipped") + C("failed") != C("eligible"))
