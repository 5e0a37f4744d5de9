"""Derived generations: how they come about, what they consist of, and what may be written for them."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import shared_dir

C = F.col
#: What an overlay and its base generation must agree on.
SAME = ("workspace", "repository", "bundle_version", "config_revision", "registry_revision")


def derive_generations(requests: DataFrame, generations: DataFrame, overlays: DataFrame) -> DataFrame:
    """requests(generation_id, base_generation_id, overlay_id) with the state of what they derive, or why they
    are refused (G7): an id that stands for another derivation, its own base, a base or an overlay that
    isn't completed, or an overlay of another base."""
    done = C("state").isin("complete", "partial")
    held = generations.select("generation_id", C("base_generation_id").alias("_held_base"), C("overlay_id").alias("_held_overlay"), F.lit(True).alias("_held"))
    base = generations.where(done).select(C("generation_id").alias("base_generation_id"), C("state").alias("_base_state"), C("commit").alias("_commit"), *(C(c).alias(f"_b_{c}") for c in SAME))
    over = overlays.where(done).select("overlay_id", C("state").alias("_overlay_state"), C("base_generation_id").alias("_over_base"), C("base_commit").alias("_over_commit"), *(C(c).alias(f"_o_{c}") for c in SAME))
    joined = requests.join(held, "generation_id", "left").join(base, "base_generation_id", "left").join(over, "overlay_id", "left")
    same = C("_over_base") == C("base_generation_id")
    for c in SAME:
        same = same & C(f"_b_{c}").eqNullSafe(C(f"_o_{c}"))
    same = same & C("_commit").eqNullSafe(C("_over_commit"))
    again = C("_held_base").eqNullSafe(C("base_generation_id")) & C("_held_overlay").eqNullSafe(C("overlay_id"))
    refused = (
        F.when(C("_held") & ~again, "generation_id_reused")
        .when(C("_held"), None)
        .when(C("generation_id") == C("base_generation_id"), "own_base")
        .when(C("_base_state").isNull(), "base_not_completed")
        .when(C("_overlay_state").isNull(), "overlay_not_completed")
        .when(~F.coalesce(same, F.lit(False)), "overlay_incompatible")
    )
    state = F.when((C("_base_state") == "partial") | (C("_overlay_state") == "partial"), "partial").otherwise("complete")
    out = joined.withColumn("refused", refused)
    return out.select("generation_id", F.when(C("refused").isNull(), state).alias("state"), "refused")


def ancestry(generations: DataFrame, wanted: DataFrame) -> DataFrame:
    """Each wanted generation with its chain of bases: depth 0 is itself (J10, J11). Only the ends of chains that
    still have a base are joined in a round; a chain that comes back to one of its own is marked, and its
    rows stop there."""
    shared_dir(generations.sparkSession)
    base = generations.select(C("generation_id").alias("ancestor"), C("base_generation_id").alias("next"), C("overlay_id").alias("overlay")).checkpoint()
    at = wanted.select(C("generation_id"), C("generation_id").alias("ancestor"), F.lit(0).alias("depth")).distinct()
    at = at.join(base, "ancestor").withColumn("cycle", F.lit(False)).checkpoint()
    out = at
    for depth in count(1):
        ends = at.where("next is not null and not cycle").select("generation_id", C("next").alias("ancestor"))
        step = ends.join(base, "ancestor").withColumn("depth", F.lit(depth))
        seen = out.select("generation_id", "ancestor", F.lit(True).alias("_seen"))
        step = step.join(seen, ["generation_id", "ancestor"], "left").withColumn("cycle", F.coalesce("_seen", F.lit(False))).drop("_seen")
        at = step.checkpoint()
        if at.isEmpty():
            return out.select("generation_id", "ancestor", "depth", "overlay", "cycle")
        out = out.unionByName(at)
        if depth % 16 == 0:
            out = out.checkpoint()


def derived_artifacts(chains: DataFrame, artifacts: DataFrame, entries: DataFrame) -> DataFrame:
    """Artifacts of each generation through its chain (J9, J10): the entry of the topmost layer that has the
    path wins, a tombstone removes it. Entries are those of overlays, artifacts those of the last base."""
    layers = chains.where("not cycle")
    over = layers.where("overlay is not null").join(entries, layers["overlay"] == entries["overlay_id"]).select("generation_id", "path", "depth", "kind", "payload")
    own = layers.where("overlay is null").join(artifacts.withColumnRenamed("generation_id", "ancestor"), "ancestor").select("generation_id", "path", "depth", F.lit("base").alias("kind"), "payload")
    top = over.unionByName(own).groupBy("generation_id", "path").agg(F.min(F.struct("depth", "kind", "payload")).alias("top"))
    return top.select("generation_id", "path", "top.depth", "top.kind", "top.payload").where("kind <> 'tombstone'")


def snapshot_conflicts(snapshots: DataFrame, generations: DataFrame, partitions: DataFrame, entries: DataFrame, held: DataFrame) -> DataFrame:
    """Why each adapter snapshot can't be written, or nothing (G8): its generation isn't completed or isn't its
    own; it is its own base; its base is missing, incompatible, or not that of its generation; a partition
    that it lists is missing or another; or its generation has another snapshot already."""
    gen = generations.select("generation_id", C("state").alias("_state"), C("repository").alias("_repository"), C("config_revision").alias("_config"), C("registry_revision").alias("_registry"), C("base_generation_id").alias("_base"))
    base = snapshots.select(C("output_hash").alias("base_hash"), C("generation_id").alias("_base_generation"), C("adapter").alias("_base_adapter"), C("repository").alias("_base_repository"))
    named = entries.where("kind <> 'tombstone'").join(partitions.select(C("output_hash").alias("partition_hash"), C("partition_key").alias("_key")), "partition_hash", "left")
    bad = named.groupBy("output_hash").agg(F.bool_or(C("_key").isNull()).alias("_missing"), F.bool_or(C("_key") != C("partition_key")).alias("_other"))
    other = held.select("generation_id", "adapter", C("output_hash").alias("_held"))
    joined = snapshots.join(gen, "generation_id", "left").join(base, "base_hash", "left").join(bad, "output_hash", "left").join(other, ["generation_id", "adapter"], "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    matches = (C("_repository") == C("repository")) & (C("_config") == C("config_revision")) & (C("_registry") == C("registry_revision"))
    why = (
        F.when(~yes(C("_state").isin("complete", "partial")), "generation_not_completed")
        .when(~yes(matches), "generation_incompatible")
        .when(yes(C("base_hash") == C("output_hash")), "own_base")
        .when(C("base_hash").isNotNull() & ~yes((C("_base_adapter") == C("adapter")) & (C("_base_repository") == C("repository"))), "base_missing_or_incompatible")
        .when(C("base_hash").isNotNull() & C("_base").isNotNull() & (C("_base_generation") != C("_base")), "not_the_exact_base")
        .when(C("base_hash").isNull() & C("_base").isNotNull(), "base_required")
        .when(yes(C("_missing")), "partition_missing")
        .when(yes(C("_other")), "partition_key_mismatch")
        .when(yes(C("_held") != C("output_hash")), "generation_has_another")
    )
    return joined.select("output_hash", why.alias("conflict"))
