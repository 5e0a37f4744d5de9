"""The registry of services and their aliases: resolution at a time, overlaps, integrity, revisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import alias_value, gateway_rewrite, valid_at
from ..sources.tables import insert_if_absent

C = F.col


def first_by(rows: DataFrame, key: list[str], *order) -> DataFrame:
    """The first row of each key (W2): a least struct, combined before the shuffle, where a window would move
    every row."""
    named = [o.alias(f"_o{i}") if isinstance(o, Column) else C(o) for i, o in enumerate(order)]
    rest = [c for c in rows.columns if c not in key]
    held = [o for o in order if isinstance(o, str)]
    least = rows.groupBy(*key).agg(F.min(F.struct(*named, *(c for c in rest if c not in held))).alias("_first"))
    return least.select(*key, *(C(f"_first.{c}").alias(c) for c in rest)).select(*rows.columns)


def resolve_aliases(requests: DataFrame, aliases: DataFrame, services: DataFrame) -> DataFrame:
    """requests(request_id, kind, value, environment, path, at) with the state of each, not_found, ambiguous or
    resolved, and, where one service is meant, that service and the path behind its longest gateway prefix (J3).

    An alias counts if it is of the request's kind and environment, has its value in normal form, is valid
    then and belongs to a service that is, and, for a request with a path, if its prefix leads there. The
    join is on kind, environment and normal form; validity and prefix are residual conditions."""
    owned = aliases.join(services.select(C("id").alias("service"), C("valid_from").alias("_from"), C("valid_until").alias("_until")), "service")
    owned = owned.select(
        "service", "kind", "environment", alias_value(C("kind"), C("value")).alias("_value"), C("value").alias("_raw"), C("path_prefix").alias("_prefix"),
        F.struct("valid_from", "valid_until").alias("_alias"), F.struct("_from", "_until").alias("_service"),
    )
    # Of aliases that hold under the same conditions, however many, the least and the greatest service say all.
    owned = owned.groupBy(*(c for c in owned.columns if c != "service")).agg(F.min("service").alias("_low"), F.max("service").alias("_high"))
    asked = requests.select("request_id", "kind", "environment", alias_value(C("kind"), C("value")).alias("_value"), "path", "at")
    hit = asked.join(owned, ["kind", "environment", "_value"], "left")
    live = valid_at(C("_alias.valid_from"), C("_alias.valid_until"), C("at")) & valid_at(C("_service._from"), C("_service._until"), C("at"))
    behind = gateway_rewrite(C("path"), C("_prefix"))
    fits = C("_low").isNotNull() & live & (C("path").isNull() | behind.isNotNull())
    best = F.struct((-F.coalesce(F.length("_prefix"), F.lit(0))).alias("_rank"), C("_raw").alias("_tie"), F.when(C("path").isNotNull(), behind).alias("rewritten_path"))
    found = hit.groupBy("request_id").agg(
        F.min(F.when(fits, C("_low"))).alias("low"), F.max(F.when(fits, C("_high"))).alias("high"), F.min(F.when(fits, best)).alias("best")
    )
    state = F.when(C("low").isNull(), "not_found").when(C("low") != C("high"), "ambiguous").otherwise("resolved")
    one = C("low") == C("high")
    return found.select("request_id", state.alias("state"), F.when(one, C("low")).alias("service"), F.when(one, C("best.rewritten_path")).alias("rewritten_path"))


def overlapping_aliases(aliases: DataFrame) -> DataFrame:
    """Pairs of services whose aliases of one kind, value and environment hold at a common time."""
    a, b = aliases.alias("a"), aliases.alias("b")
    end = lambda s: F.coalesce(F.col(f"{s}.valid_until"), F.lit("9999-12-31").cast("date"))
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("kind", "value", "environment")]
    meets = (F.col("a.service") < F.col("b.service")) & (F.col("a.valid_from") < end("b")) & (F.col("b.valid_from") < end("a"))
    return a.join(b, [*same, meets]).select(F.col("a.service").alias("service"), F.col("b.service").alias("other"), F.col("a.value").alias("value"))


def overlapping_services(services: DataFrame) -> DataFrame:
    """Versions of a service (id, valid_from, valid_until) that begin before one that began earlier, or at the same
    time, has ended, each once (J5). Published, a version is held against the one listed before it alone; here
    against all."""
    end = F.coalesce("valid_until", F.lit("9999-12-31").cast("date"))
    before = Window.partitionBy("id").orderBy("valid_from", end).rowsBetween(Window.unboundedPreceding, -1)
    return services.withColumn("_before", F.max(end).over(before)).where(C("valid_from") < C("_before")).select("id", "valid_from").distinct()


def empty_intervals(rows: DataFrame) -> DataFrame:
    """Rows whose validity ends before, or when, it begins."""
    return rows.where(C("valid_until") <= C("valid_from"))


def dangling(child: DataFrame, parent: DataFrame, key: list[tuple[str, str]], name: str) -> DataFrame:
    """Rows of child without their parent, as counted violations."""
    on = [child[c] == parent[p] for c, p in key]
    return child.join(parent, on, "left_anti").agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")


def set_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """What one set of keys has and the other lacks, on either side; no rows where they are equal (U8)."""
    one, two = left.select(key).distinct(), right.select(key).distinct()
    return one.join(two, key, "left_anti").withColumn("side", F.lit("left")).unionByName(two.join(one, key, "left_anti").withColumn("side", F.lit("right")))


def sync_registry(selected: DataFrame, services: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Services whose repository is still selected, and the aliases of these."""
    kept = services.join(selected.select("repository").distinct(), "repository", "left_semi")
    return kept, aliases.join(kept.select(C("id").alias("service")), "service", "left_semi")


def put_revisions(held: DataFrame, incoming: DataFrame, pointers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Revisions(workspace, revision, sequence, hash) to append, those that conflict with a held one of their
    name, and each workspace's current pointer, which only moves to a higher sequence (S18)."""
    new, conflicts = insert_if_absent(held, incoming, ["workspace", "revision"], "hash")
    every = pointers.select("workspace", "revision", "sequence").unionByName(new.select("workspace", "revision", "sequence"))
    current = every.groupBy("workspace").agg(F.max(F.struct("sequence", "revision")).alias("top")).select("workspace", "top.revision", "top.sequence")
    return new, conflicts, current
