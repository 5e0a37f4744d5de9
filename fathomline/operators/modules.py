"""Module resolution (J21): what file an import means, relative to its own or through the path aliases of the nearest
configurations above it. One equi-join with the configurations of the folders above, on what a pattern starts
with, and one semi-join of all candidate paths with the files there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col
#: The endings that a candidate's path may have, in the order in which they are tried after the path as
#: it stands; endings of run-time files that are taken off first; and bounds of a configuration.
ENDINGS = ("", ".ts", ".tsx", ".mts", ".cts", ".d.ts", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx")
RUNTIME = r"\.(?:mjs|cjs|js|jsx)$"
PATTERNS, TARGETS, LENGTH = 256, 32, 512


def normal_path(path: Column) -> Column:
    """A path without `.`, empty and needless `..` parts; a slash at either end stays, and nothing is `.`."""
    rooted, ended = path.startswith("/"), path.endswith("/")

    def step(kept: Column, part: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        up = F.when(last.isNull(), F.when(rooted, kept).otherwise(F.array(part))).when(last == "..", F.concat(kept, F.array(part))).otherwise(F.slice(kept, F.lit(1), F.size(kept) - 1))
        return F.when(part.isin("", "."), kept).when(part == "..", up).otherwise(F.concat(kept, F.array(part)))

    body = F.array_join(F.aggregate(F.split(path, "/", -1), F.array().cast("array<string>"), step), "/")
    return F.when(body == "", F.when(rooted, "/").when(ended & (path != ""), "./").otherwise(".")).otherwise(F.concat(F.when(rooted, "/").otherwise(""), body, F.when(ended, "/").otherwise("")))


def joined_path(folder: Column, path: Column) -> Column:
    return normal_path(F.when(path == "", folder).otherwise(F.concat(folder, F.lit("/"), path)))


def folder_of(path: Column) -> Column:
    return F.when(F.instr(path, "/") == 0, ".").otherwise(F.regexp_replace(path, "/[^/]*$", ""))


def candidates(base: Column) -> Column:
    """The paths that a module's path may mean, in order."""
    bare = F.regexp_replace(base, RUNTIME, "")
    return F.array(base, *(F.concat(bare, F.lit(e)) for e in ENDINGS))


def parse_configs(files: DataFrame) -> DataFrame:
    """config, folder, base, rank, pattern, targets of configuration files(path, text): the patterns in their order, within
    the published bounds. Text that is no JSON (comments aside) gives none."""
    schema = "compilerOptions struct<baseUrl:string,paths:map<string,array<string>>>"
    options = F.from_json("text", schema, {"allowComments": "true"})["compilerOptions"]
    rows = files.select(C("path").alias("config"), options.alias("o")).where("o is not null")
    fits = lambda t: F.coalesce(F.char_length(t).between(1, LENGTH), F.lit(False))
    entries = F.slice(F.array_sort(F.map_entries(C("o.paths"))), 1, PATTERNS)
    url = F.when(F.coalesce(F.char_length("o.baseUrl") <= LENGTH, F.lit(False)), C("o.baseUrl")).otherwise(".")
    each = rows.select("config", url.alias("url"), F.posexplode(entries).alias("rank", "entry"))
    targets = F.slice(F.filter("entry.value", fits), 1, TARGETS)
    out = each.select("config", folder_of(C("config")).alias("folder"), "url", "rank", C("entry.key").alias("pattern"), targets.alias("targets"))
    return out.where(fits(C("pattern")) & (F.size("targets") > 0)).select("config", "folder", joined_path(C("folder"), C("url")).alias("base"), "rank", "pattern", "targets")


def _start(text: Column) -> Column:
    """Text up to its first slash, with it; nothing if there is none."""
    return F.when(F.instr(text, "/") > 0, F.concat(F.substring_index(text, "/", 1), F.lit("/"))).otherwise("")


def resolve(imports: DataFrame, configs: DataFrame, available: DataFrame) -> DataFrame:
    """import_id and the path that imports(import_id, path, specifier) mean, of available(path); imports without one are
    left out. Relative first; then configurations (parse_configs()) by the longest folder, then path, their patterns
    and targets in order; of each the first candidate that there is. A pattern has one `*` at most, and what it
    captures takes the place of a target's first; what leads out of the repository is passed over."""
    own = imports.select("import_id", "path", "specifier")
    relative = own.where(C("specifier").startswith(".")).select("import_id", F.lit(0).alias("by"), F.lit(0).alias("depth"), F.lit("").alias("config"), F.lit(0).alias("rank"), F.lit(0).alias("place"), joined_path(folder_of(C("path")), C("specifier")).alias("base"))
    parts = F.split("path", "/", -1)
    above = F.concat(F.array(F.lit(".")), F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>")))
    starts = F.array_distinct(F.array(F.lit(""), _start(C("specifier")), F.concat(F.lit("="), "specifier")))
    asked = own.select("import_id", "specifier", F.explode(above).alias("folder"), starts.alias("starts")).select("import_id", "specifier", "folder", F.explode("starts").alias("start"))
    star = F.instr("pattern", "*")
    prefix, suffix = F.substr("pattern", F.lit(1), star - 1), F.substr("pattern", star + 1)
    known = configs.where(F.length("pattern") - F.length(F.replace("pattern", F.lit("*"), F.lit(""))) <= 1)
    known = known.select("config", "folder", "base", "rank", "targets", (star > 0).alias("open"), prefix.alias("prefix"), suffix.alias("suffix"), F.when(star > 0, _start(prefix)).otherwise(F.concat(F.lit("="), "pattern")).alias("start"))
    hit = asked.join(known, ["folder", "start"]).where(~C("open") | C("specifier").startswith(C("prefix")) & C("specifier").endswith(C("suffix")))
    length = F.length("specifier") - F.length("prefix") - F.length("suffix")
    capture = F.when(~C("open") | (length <= 0), "").otherwise(F.substr("specifier", F.length("prefix") + 1, length))
    each = hit.select("import_id", "folder", "config", "base", "rank", capture.alias("capture"), F.posexplode("targets").alias("place", "target"))
    at = F.instr("target", "*")
    mapped = F.when(at > 0, F.concat(F.substr("target", F.lit(1), at - 1), "capture", F.substr("target", at + 1))).otherwise(C("target"))
    aliased = each.select("import_id", F.lit(1).alias("by"), (-F.length("folder")).alias("depth"), "config", "rank", "place", joined_path(C("base"), mapped).alias("base"))
    aliased = aliased.where(~((C("base") == "..") | C("base").startswith("../") | C("base").startswith("/")))
    tried = relative.unionByName(aliased).select("import_id", "by", "depth", "config", "rank", "place", F.posexplode(candidates(C("base"))).alias("nth", "found"))
    there = tried.join(available.select(C("path").alias("found")).distinct(), "found", "left_semi")
    return there.groupBy("import_id").agg(F.min_by("found", F.struct("by", "depth", "config", "rank", "place", "nth")).alias("path"))
