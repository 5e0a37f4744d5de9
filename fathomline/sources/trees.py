"""Trees of commits as a source (S1, S2): dumps of `ls-tree -r -z --long`, one folder a tree.

A dump's records end with NUL, so it is a text whose lines end so: Spark splits large ones, and the folders
`repository=.../commit=...` are columns, so a filter on either reads no file of the others. A tree with a record that
is none is refused as a whole, as published, and told apart from one that is empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_nfc

C = F.col
#: Modes of entries that are no files, and the form of an object's name.
SUBMODULE, SYMLINK = "160000", "120000"
OBJECT = "^[0-9a-f]{40}(?:[0-9a-f]{24})?$"


def _path_fits(path: Column) -> Column:
    plain = ~path.rlike(r"[\\]|^/|^[A-Za-z]:|//|/$")
    return (path != "") & plain & ~F.exists(F.split(path, "/", -1), lambda s: s.isin("", ".", "..")) & is_nfc(path)


def parse_entry(record: Column) -> Column:
    """mode, kind, object_id, size and path of a record `mode type object size<tab>path`, and whether it is one."""
    tab = F.instr(record, "\t")
    path = F.substr(record, tab + 1)
    fields = F.split(F.trim(F.substr(record, F.lit(1), tab - 1)), r"\s+")
    mode, kind, name, size = (F.get(fields, F.lit(i)) for i in range(4))
    sound = (tab > 0) & (mode != "") & (kind != "") & F.coalesce(name.rlike(OBJECT), F.lit(False)) & _path_fits(path)
    return F.struct(
        mode.alias("mode"), F.when((mode == SUBMODULE) | (kind == "commit"), "submodule").when(mode == SYMLINK, "symlink").otherwise("blob").alias("kind"), name.alias("object_id"),
        F.when(size.rlike(r"^\d+$"), size.try_cast("long")).alias("size"), path.alias("path"), F.coalesce(sound, F.lit(False)).alias("sound"),
    )


def read_trees(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Entries (repository, commit, path, mode, kind, object_id, size) of sound trees, and the trees (repository, commit,
    malformed records) that are refused. Repository and commit are folders, so filters on them prune files."""
    schema = "value string, repository string, commit string"
    records = spark.read.schema(schema).option("lineSep", "\0").text(folder).where("value <> ''")
    parsed = records.select("repository", "commit", parse_entry(C("value")).alias("e"))
    refused = parsed.where("not e.sound").groupBy("repository", "commit").agg(F.count("*").alias("malformed"))
    kept = parsed.join(refused, ["repository", "commit"], "left_anti")
    return kept.select("repository", "commit", "e.path", "e.mode", "e.kind", "e.object_id", "e.size"), refused


def write_dumps(entries: DataFrame, folder: str) -> None:
    """Dumps of entries (repository, commit, path, mode, type, object_id, size): what read_trees() reads."""
    digits = F.coalesce(C("size").cast("string"), F.lit("-"))
    size = F.lpad(digits, F.greatest(F.lit(7), F.char_length(digits)), F.lit(" "))  # padding to less would cut it
    record = F.concat(F.concat_ws(" ", "mode", "type", "object_id", size), F.lit("\t"), C("path"))
    rows = entries.select("repository", "commit", record.alias("value"))
    rows.write.partitionBy("repository", "commit").option("lineSep", "\0").text(folder)
