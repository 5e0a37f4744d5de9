"""The analysis end to end: which consumers do changed contracts affect, and what should be done."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import contracts as c
from ..operators import registry
from ..sources.tables import materialise, relation, table

#: The instant as of which the bound tables are analysed, how long evidence stays fresh, the workspace, the
#: revision of its registry, and the repository whose head is analysed.
AS_OF, TTL_DAYS, WORKSPACE, REVISION, PRODUCER = "2000-06-30", 3 * 365, "wsp-1", "reg-7", 5


def at():
    return F.lit(AS_OF).cast("date")


def changes(spark, sf_dir) -> DataFrame:
    return c.contract_diff(relation(spark, sf_dir, "definitions_base"), relation(spark, sf_dir, "definitions_head"))


def states(spark, sf_dir) -> DataFrame:
    """Every consumer's selection, the producer's own head among them. A row a consumer, which most analyses read
    several times, so it is written once."""
    members = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("repository"))
    denied = members.where("repository % 41 = 0")
    others = members.where(F.col("repository") != PRODUCER)
    own = members.where(F.col("repository") == PRODUCER).select("repository", F.lit(-1).cast("long").alias("generation_id"), F.lit("partial").alias("coverage_state"))
    selections = c.select_generations(relation(spark, sf_dir, "generations"))
    consumers = c.consumer_states(others, selections, relation(spark, sf_dir, "observations"), at(), TTL_DAYS, denied)
    return materialise(consumers.unionByName(c.producer_state(own, denied)), "states")


def requests(references: DataFrame) -> DataFrame:
    """What the references that name a service ask the registry."""
    return references.where("target_kind is not null").select(
        F.col("reference_id").alias("request_id"), F.col("target_kind").alias("kind"), F.col("target_value").alias("value"), F.col("target_environment").alias("environment"),
        F.col("target_path").alias("path"), at().alias("at"),
    )


def asked_lines(lineitem: DataFrame, orders: DataFrame, chosen: DataFrame) -> DataFrame:
    """Lines, with the order's consumer, of all that may be in a reference of a chosen generation(repository,
    generation_id). A reference is a consumer's use of a part, of the latest order that has it, so it is selected only if
    the chosen order has the part. What parts that has is told by a mask of 64 bits, which goes with the
    consumer's orders: a line is left out if its part's bit is not set, and few others stay."""
    bit = F.expr("shiftleft(1L, CAST(pmod(xxhash64(l_partkey), 64) AS INT))")
    picked = chosen.where("generation_id is not null").select(F.col("repository").alias("o_custkey"), F.col("generation_id").alias("l_orderkey"))
    had = lineitem.where("l_partkey is not null").groupBy("l_orderkey").agg(F.bit_or(bit).alias("_bits"))
    masks = had.join(picked, "l_orderkey").groupBy("o_custkey").agg(F.bit_or("_bits").alias("_mask"))
    own = orders.select("o_orderkey", "o_custkey").join(masks, "o_custkey")
    lines = lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate")
    return lines.join(own, lines["l_orderkey"] == own["o_orderkey"]).where(F.col("_mask").bitwiseAND(bit) != 0).drop("_mask")


def references(spark, sf_dir, selections: DataFrame | None = None) -> DataFrame:
    """References of the selected generations. Lines of which none can come go before they are joined to parts and grouped,
    and what is left, a tenth of all references, is written once: it is joined to the registry and to the changes."""
    chosen = selections if selections is not None else states(spark, sf_dir)
    lines = materialise(asked_lines(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"), chosen), "lines")
    own = lines.select("o_orderkey", "o_custkey").distinct()
    return materialise(c.selected_references(relation(spark, sf_dir, "refs", lineitem=lines.drop("o_orderkey", "o_custkey"), orders=own), chosen), "references")


def resolved(spark, sf_dir, refs: DataFrame) -> DataFrame:
    return registry.resolve_aliases(requests(refs), relation(spark, sf_dir, "aliases"), relation(spark, sf_dir, "services"))


def joined(spark, sf_dir, selections: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges, one of each key, consumer and reference, and the diagnostics; selections are states() if they are known."""
    refs = references(spark, sf_dir, selections)
    known = resolved(spark, sf_dir, refs).withColumnRenamed("request_id", "reference_id")
    changed = c.changed_definitions(changes(spark, sf_dir), relation(spark, sf_dir, "definitions"))
    edges, problems = c.join_changed_contracts(changed, refs, known, WORKSPACE, REVISION)
    return c.dedupe_edges(edges), problems


def findings(spark, sf_dir) -> DataFrame:
    selections = states(spark, sf_dir)
    edges, _ = joined(spark, sf_dir, selections)
    return c.findings(edges, selections, WORKSPACE)
