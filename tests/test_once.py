"""Inputs that several steps read are read from the tables once."""

import json
import os

import pytest
from pyspark.sql import functions as F

from fathomline.functions import canonical
from fathomline.operators import contracts, governance
from fathomline.plans import analyze
from fathomline.plans import queries as plans
from fathomline.sources.tables import relation, table

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def from_tables(df):
    return [f for f in df.inputFiles() if "lineitem" in f or "orders" in f]


@needs_tables
def test_findings_are_read_once_for_all_scopes(spark):
    rows = relation(spark, SF, "candidates").withColumn("adapter_rule_ids", F.array_distinct(F.array("rule_one", "rule_two")))
    assert not from_tables(governance.match_suppressions(rows, plans._rules(spark, SF)))


def test_texts_are_escaped_by_one_look_up(spark):
    """A replacement for each of 34 characters made the code of a record too long to be compiled."""
    texts = [chr(i) for i in range(32)] + ['a"b\\c', "\\u000B", "", "é\U0001f600\x0b\\", None, "plain"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", canonical.json_text(F.col("t")).alias("j"))
    assert "replace(" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert all(r.j == (None if r.t is None else json.dumps(r.t, ensure_ascii=False)) for r in df.collect())


@needs_tables
def test_faults_are_counted_over_evidence_joined_once(spark):
    assert not from_tables(plans.protocol2.v2_violations(spark, SF))


@needs_tables
def test_records_written_twice_are_checked_once(spark):
    from fathomline.operators import validation as v

    checked = v.checked_once(relation(spark, SF, "given_references"), v.reference_violation, list(v.REFERENCE))
    assert not from_tables(checked) and {"violation", "_digest"} <= set(checked.columns)


def test_lines_that_no_selected_reference_has_go_first(spark):
    lines = [(o, i, p, 1, "A", None) for i, (o, p) in enumerate([(1, 7), (1, 8), (2, 7), (2, 9), (3, 7), (4, 5), (5, 6), (1, None), (2, 5)])]
    lines += [(2, i, i, 1, "A", None) for i in range(1000, 2000)]
    lineitem = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_shipdate date")
    orders = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 2), (5, 3)], "o_orderkey long, o_custkey long")
    chosen = spark.createDataFrame([(1, 1), (2, 4), (3, None)], "repository long, generation_id long")
    kept = [(r.o_custkey, r.l_orderkey, r.l_partkey) for r in analyze.asked_lines(lineitem, orders, chosen).collect()]
    assert {(1, 1, 7), (1, 1, 8), (1, 2, 7), (2, 4, 5)} <= set(kept)
    assert len(kept) == len(set(kept)) < 200 and all(c in (1, 2) and p is not None for c, _, p in kept)


@needs_tables
def test_references_are_those_of_all_lines(spark):
    states = analyze.states(spark, SF)
    whole = contracts.selected_references(relation(spark, SF, "refs"), states)
    got = analyze.references(spark, SF, states)
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.select(*got.columns).collect())) and got.count()
    lines = analyze.asked_lines(table(spark, SF, "lineitem"), table(spark, SF, "orders"), states)
    assert lines.count() < table(spark, SF, "lineitem").count() / 3


@needs_tables
def test_edges_are_sorted_once_and_made_once(spark):
    """Combined before they were dealt out, edges were sorted in the tasks that made them, and each copy's lines were read anew."""
    plan = plans.edge_dedupe(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1
    above = plan[: plan.index("Generate explode")]
    assert above.count("Sort [") == 1 and above.count("Exchange ") == 1


def test_dedupe_keeps_ties_and_nulls(spark):
    rows = [("k", 1, "r", "heuristic", "a"), ("k", 1, "r", "exact", "z"), ("k", 1, "r", "exact", "y"), ("k", None, "r", None, "b"), (None, 1, "s", "registry_resolved", "d"), (None, 1, "s", "heuristic", "c")]
    edges = spark.createDataFrame(rows, "canonical_key string, consumer long, reference_id string, basis string, edge_id string")
    got = contracts.dedupe_edges(edges)
    assert got.columns == edges.columns and {tuple(r) for r in got.collect()} == {rows[2], rows[3], rows[5]}
