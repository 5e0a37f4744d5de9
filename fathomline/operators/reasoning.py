"""Evidence for reasoning about changes, and whether what was reasoned cites it rightly."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import hash_record

C = F.col
#: What a citation is made of.
HANDLE = ("origin", "side", "repository", "generation_id", "path", "content_hash")


def plan_evidence(changes: DataFrame, definitions: DataFrame, references: DataFrame, most: int) -> DataFrame:
    """Up to `most` citations for the first `most` changes (J17): definitions of changed keys and the references
    related to them, by key or, without one, by family, each once. A producer's and a consumer's come first,
    then the other producers', then the other consumers'; nothing if either side has none. All inputs are cut
    to the first `most` rows by their position, so a plan is small whatever the corpus."""
    head = lambda df: df.orderBy("position").limit(most)
    chosen = head(changes)
    keys, families = chosen.select("canonical_key").distinct(), chosen.select("family").distinct()
    own = head(definitions).where("has_range").join(keys, "canonical_key", "left_semi").withColumns({"origin": F.lit("changed_definition"), "side": F.lit("producer")})
    refs = head(references)
    near = refs.join(keys, "canonical_key", "left_semi").unionByName(refs.where("canonical_key is null").join(families, "family", "left_semi"))
    near = near.where("has_range").withColumns({"origin": F.lit("deterministic_neighbor"), "side": F.lit("consumer")})
    rows = own.select(*HANDLE).unionByName(near.select(*HANDLE))
    cited = rows.withColumn("citation_id", F.concat(F.lit("cit_"), hash_record({c: C(c) for c in HANDLE}))).dropDuplicates(["citation_id"])
    # At most twice `most` rows are numbered here.
    n = F.row_number().over(Window.partitionBy("side").orderBy("citation_id"))
    rank = cited.withColumn("n", n).withColumn("turn", F.when(C("n") == 1, 0).when(C("side") == "producer", 1).otherwise(2))
    sides = F.broadcast(cited.agg(F.count_distinct("side").alias("sides")))
    order = Window.orderBy("turn", F.desc("side"), "n")
    both = rank.join(sides).where(C("sides") == 2).withColumn("ordinal", F.row_number().over(order))
    return both.where(C("ordinal") <= (most if most >= 2 else 0)).select("ordinal", "side", "citation_id", *HANDLE[2:])


def valid_hypotheses(candidates: DataFrame, supplied: DataFrame) -> DataFrame:
    """candidates(candidate_id, producer_ids, consumer_ids) and whether each cites both sides, and only what was
    supplied on that side (J18)."""
    side = lambda name, ids: F.transform(ids, lambda i: F.struct(F.lit(name).alias("as"), i.alias("citation_id")))
    cited = candidates.select("candidate_id", F.explode(F.concat(side("producer", C("producer_ids")), side("consumer", C("consumer_ids")))).alias("c"))
    met = cited.select("candidate_id", "c.*").join(supplied.select("citation_id", "side"), "citation_id", "left")
    wrong = met.groupBy("candidate_id").agg(F.count_if(~C("as").eqNullSafe(C("side"))).alias("wrong"))
    both = (F.size("producer_ids") > 0) & (F.size("consumer_ids") > 0)
    return candidates.join(wrong, "candidate_id", "left").select("candidate_id", (both & (F.coalesce("wrong", F.lit(0)) == 0)).alias("valid"))


def scrub_run(analyses: DataFrame, runs: DataFrame, run_id) -> tuple[DataFrame, DataFrame]:
    """Analyses and runs after a reasoning run is purged: the analysis keeps its deterministic result alone."""
    gone = runs.where(C("run_id") == F.lit(run_id)).select("analysis_id").distinct().withColumn("_gone", F.lit(True))
    left = analyses.join(gone, "analysis_id", "left")
    clean = left.withColumn("reasoning_hash", F.when(C("_gone"), None).otherwise(C("reasoning_hash"))).drop("_gone")
    return clean, runs.where(~C("run_id").eqNullSafe(F.lit(run_id)))
