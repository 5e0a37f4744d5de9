"""Scoped reads of definitions, references and findings, and the checks that their inputs agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col


def read_definitions(definitions: DataFrame, keys: DataFrame | None = None, generation: Column | None = None, repository: Column | None = None, kind: Column | None = None) -> DataFrame:
    """Definitions of a generation, repository and kind, whichever are given, with a key among `keys`.
    What is compared with columns reaches the scan; keys are a semi-join."""
    out = definitions
    for column, value in (("generation_id", generation), ("producer", repository), ("contract_kind", kind)):
        if value is not None:
            out = out.where(C(column) == value)
    return out if keys is None else out.join(keys.select("canonical_key").distinct(), "canonical_key", "left_semi")


def read_references(references: DataFrame, keys: DataFrame) -> DataFrame:
    """References with one of `keys` as their key or as what they are constrained to (P5). An OR of two keys
    would be a nested loop; a reference has two at most, so it is dealt by each and met by an equi-join."""
    wanted = keys.select("canonical_key").distinct()
    own = references.select("*", F.explode(F.array_distinct(F.array_compact(F.array("canonical_key", "constrained_key")))).alias("_key"))
    hit = own.join(wanted.withColumnRenamed("canonical_key", "_key"), "_key", "left_semi").drop("_key")
    return hit.dropDuplicates(["consumer", "reference_id", "generation_id"])


def exactness_violations(observations: DataFrame, definitions: DataFrame, references: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows that don't belong to what they are analysed as, counted by check (P16): contracts of another
    repository than their generation's, references of a generation that wasn't observed, changes of a
    producer that defines nothing. An analysis goes on only where all counts are 0."""
    own = observations.select("generation_id", C("repository").alias("_repository"))
    at = lambda df, column: df.join(own, "generation_id", "left").where(~C("_repository").eqNullSafe(C(column)))
    orphan = changes.join(definitions.select("producer").distinct(), "producer", "left_anti")
    checks = {"definition_scope": at(definitions, "producer"), "reference_scope": at(references, "consumer"), "change_scope": orphan}
    out = None
    for name, rows in checks.items():
        one = rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")
        out = one if out is None else out.unionByName(one)
    return out


def snake_case(rows: DataFrame) -> DataFrame:
    """Records with keys in camel case as rows with columns in snake case."""
    import re

    return rows.withColumnsRenamed({c: re.sub(r"(?<=[a-z0-9])([A-Z])", lambda m: f"_{m[1].lower()}", c) for c in rows.columns})


def camel_case(rows: DataFrame) -> DataFrame:
    """The inverse of snake_case()."""
    import re

    return rows.withColumnsRenamed({c: re.sub(r"_([a-z0-9])", lambda m: m[1].upper(), c) for c in rows.columns})


#: What telemetry may carry.
TELEMETRY = ["type", "event", "duplicate", "durationMs", "kind", "outcome", "costMicrounits", "mode", "conclusion", "findingCount", "redactionCount"]


def telemetry(events: DataFrame) -> DataFrame:
    """Events as they may be sent: a column that isn't on the list is refused, not dropped."""
    more = sorted(set(events.columns) - set(TELEMETRY))
    if more:
        raise ValueError(f"telemetry holds what it must not: {', '.join(more)}")
    return events.select(*(c for c in TELEMETRY if c in events.columns))


def find_findings(findings: DataFrame, analyses: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """The finding of each fingerprint in the analysis that is current, else in the latest."""
    asked = findings.join(fingerprints.select("fingerprint").distinct(), "fingerprint", "left_semi")
    of = asked.join(analyses.select("analysis_id", "is_current", "completed_at"), "analysis_id")
    best = of.groupBy("fingerprint").agg(F.max(F.struct("is_current", "completed_at", "analysis_id")).alias("best"))
    return best.select("fingerprint", "best.analysis_id", C("best.is_current").alias("is_current"))
