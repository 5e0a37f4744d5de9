"""Reading tables and binding them to the relations that the operators work on, and the sinks."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share, set on the context; in a local session without one
    (tests), a folder of our own. On a cluster a local folder is another one on each machine, so there it
    must be named."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(given or f"file://{tempfile.mkdtemp(prefix='fathomline-')}")
    return context._jsc.sc().getCheckpointDir().get()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back: computed once, and a lost executor costs its tasks."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Relations as ANSI SQL over {table} placeholders; one text serves Spark and the SQL it is compared with.
BINDINGS = {
    "definitions_base": """
        SELECT p_type AS contract_kind, concat('part:', CAST(p_partkey AS STRING)) AS canonical_key,
               p_partkey % 100 AS producer, p_brand AS data_type, p_size AS width,
               concat_ws('|', p_brand, CAST(p_size AS STRING), CAST(CAST(round(p_retailprice * 100) AS BIGINT) AS STRING)) AS shape
        FROM {part}""",
    "definitions_head": """
        SELECT p_type AS contract_kind, concat('part:', CAST(p_partkey AS STRING)) AS canonical_key,
               p_partkey % 100 AS producer, p_brand AS data_type, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 WHEN p_partkey % 11 = 0 THEN p_size - 1 ELSE p_size END AS width,
               concat_ws('|', p_brand, CAST(CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 WHEN p_partkey % 11 = 0 THEN p_size - 1 ELSE p_size END AS STRING), CAST(CAST(round(p_retailprice * 100) AS BIGINT) AS STRING)) AS shape
        FROM {part} WHERE p_partkey % 10 <> 0
        UNION ALL
        SELECT p_type, concat('part:', CAST(p_partkey + 1000000 AS STRING)), p_partkey % 100, p_brand, p_size, concat_ws('|', p_brand, CAST(p_size AS STRING), 'new')
        FROM {part} WHERE p_partkey % 50 = 3""",
    "uses": """
        SELECT o_custkey AS consumer, concat('part:', CAST(l_partkey AS STRING)) AS canonical_key,
               CASE max(l_returnflag) WHEN 'A' THEN 'heuristic' WHEN 'N' THEN NULL ELSE 'declared_context' END AS context_basis,
               CASE WHEN max(l_linenumber) > 5 THEN concat('svc-', CAST(min(l_suppkey) % 40 AS STRING)) END AS alias,
               min(l_shipdate) AS first_observed, max(l_shipdate) AS last_observed, max(o_orderkey) AS generation_id,
               md5(concat_ws('|', CAST(o_custkey AS STRING), CAST(l_partkey AS STRING))) AS reference_id
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey""",
    "generations": """
        SELECT o_orderkey AS generation_id, o_custkey AS repository,
               CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'partial' ELSE 'failed' END AS state,
               o_orderdate AS started_at, o_totalprice AS cost
        FROM {orders}""",
    "definitions": """
        SELECT contract_kind, canonical_key, producer, 0 AS position, 1 + part % 10 AS service, concat('gen-head-', CAST(producer AS STRING)) AS generation_id, concat('typescript@1#1.', contract_kind) AS stratum
        FROM (SELECT p_type AS contract_kind, concat('part:', CAST(p_partkey AS STRING)) AS canonical_key, p_partkey % 100 AS producer, p_partkey AS part FROM {part} WHERE p_partkey % 10 <> 0 AND p_partkey % 23 <> 0) h
        UNION ALL
        SELECT p_type, concat('part:', CAST(p_partkey AS STRING)), p_partkey % 100, 1, 1 + p_partkey % 9, concat('gen-base-', CAST(p_partkey % 100 AS STRING)), concat('typescript@1#1.', p_type)
        FROM {part} WHERE p_partkey % 29 <> 0""",
    "refs": """
        SELECT consumer, generation_id, contract_kind, basis AS context_basis,
               CASE WHEN seed % 4 = 0 OR basis = 'heuristic' THEN NULL ELSE part_key END AS canonical_key,
               CASE WHEN seed % 3 <> 0 THEN part_key END AS constrained_key,
               CASE WHEN line % 3 = 0 THEN 'computed key' END AS unresolved_pattern,
               CASE WHEN line > 2 THEN CASE seed % 3 WHEN 0 THEN 'package_coordinate' WHEN 1 THEN 'path_prefix' ELSE 'host' END END AS target_kind,
               CASE WHEN line > 2 THEN concat(' svc-', CAST(1 + part % 10 AS STRING), ' ') END AS target_value,
               CASE WHEN line > 2 THEN CASE WHEN part % 2 = 0 THEN 'prod' ELSE 'test' END END AS target_environment,
               CASE WHEN part % 5 = 0 THEN '/api//v1/items' WHEN part % 5 = 1 THEN 'other' END AS target_path,
               first_observed, last_observed, stratum, reference_id
        FROM (SELECT o_custkey AS consumer, l_partkey AS part, max(o_orderkey) AS generation_id, max(l_linenumber) AS line, min(l_suppkey) AS seed,
                     CASE max(l_returnflag) WHEN 'A' THEN 'heuristic' WHEN 'R' THEN CASE WHEN max(l_linenumber) % 2 = 0 THEN 'declared_context' ELSE 'heuristic' END END AS basis,
                     CASE WHEN min(l_suppkey) % 17 = 3 THEN 'OTHER' ELSE max(p_type) END AS contract_kind,
                     concat('part:', CAST(l_partkey AS STRING)) AS part_key, min(l_shipdate) AS first_observed, max(l_shipdate) AS last_observed, 'http@2#1.call' AS stratum,
                     concat('ref-', CAST(o_custkey AS STRING), '-', CAST(l_partkey AS STRING)) AS reference_id
              FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON p_partkey = l_partkey GROUP BY o_custkey, l_partkey) x""",
    "observations": """
        SELECT o_orderkey AS generation_id, o_custkey AS repository, CASE o_orderkey % 11 WHEN 0 THEN 'failed' WHEN 1 THEN 'unsupported' WHEN 2 THEN 'partial' ELSE 'complete' END AS coverage_state, o_orderdate AS completed_at
        FROM {orders} WHERE o_orderkey % 11 <> 3""",
    "services": """
        SELECT s_suppkey AS id, s_suppkey % 100 AS repository, date_add_days(CAST('1993-01-01' AS DATE), CAST(s_suppkey % 5 AS INT) * 300) AS valid_from,
               CASE WHEN s_suppkey % 7 = 6 THEN date_add_days(CAST('1993-01-01' AS DATE), 2000) END AS valid_until
        FROM {supplier}""",
    "aliases": """
        SELECT s_suppkey AS service, CASE s_suppkey % 4 WHEN 0 THEN 'package_coordinate' WHEN 1 THEN 'path_prefix' ELSE 'host' END AS kind,
               CASE s_suppkey % 4 WHEN 0 THEN concat('Svc-', CAST(s_suppkey % 40 AS STRING)) WHEN 1 THEN concat('/svc-', CAST(s_suppkey % 40 AS STRING), '/') ELSE concat('SVC-', CAST(s_suppkey % 40 AS STRING), '.') END AS value,
               CASE WHEN s_suppkey % 3 = 0 THEN '/api/v1/' WHEN s_suppkey % 3 = 1 THEN 'api' END AS path_prefix,
               CASE WHEN s_suppkey % 2 = 0 THEN 'prod' ELSE 'test' END AS environment,
               date_add_days(CAST('1995-01-01' AS DATE), CAST(s_suppkey % 9 AS INT) * 200) AS valid_from,
               CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE date_add_days(CAST('1995-01-01' AS DATE), CAST(s_suppkey % 9 AS INT) * 200 + 1500) END AS valid_until
        FROM {supplier}""",
    "artifacts": """
        SELECT doc_id AS blob, source AS repository, text, CAST(length(text) AS BIGINT) AS size,
               concat(CASE doc_id % 13 WHEN 0 THEN 'node_modules/' WHEN 1 THEN 'dist/' WHEN 2 THEN 'src/vendor/' ELSE 'src/' END, 'f', CAST(doc_id AS STRING),
                      CASE doc_id % 11 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' WHEN 2 THEN '.zip' WHEN 3 THEN '.min.js' WHEN 4 THEN '.dat' WHEN 5 THEN '.SQL' ELSE '.md' END) AS path,
               CASE doc_id % 29 WHEN 0 THEN 'symlink' WHEN 1 THEN 'submodule' ELSE 'file' END AS entry_kind
        FROM {documents}""",
    "all_cases": """
        SELECT d.doc_id AS case_id, d.source AS organization, concat(d.source, '-', CAST(d.doc_id % 50 AS STRING)) AS pull_request,
               d.lang AS stratum, d.doc_id % 7 AS team, concat('2024-0', CAST(1 + d.doc_id % 6 AS STRING)) AS month, concat('2024-0', CAST(1 + d.doc_id % 6 AS STRING), '-1', CAST(d.doc_id % 9 AS STRING)) AS opened_on,
               CASE d.doc_id % 5 WHEN 0 THEN 'no_candidate' WHEN 1 THEN 'abstained' WHEN 2 THEN 'not_analysed' ELSE 'candidate' END AS detector_output,
               d.doc_id % 3 <> 0 AS policy_selected, d.doc_id % 17 = 0 AS suppressed,
               CASE d.doc_id % 4 WHEN 0 THEN 'breaking' WHEN 1 THEN 'unknown' WHEN 2 THEN 'behavior_risk' ELSE 'compatible' END AS claim_impact,
               CASE WHEN d.doc_id % 4 < 3 THEN 'coordinate' ELSE 'none' END AS claim_action,
               CASE WHEN l.toxic IS NULL THEN NULL WHEN d.doc_id % 19 = 0 THEN 'indeterminate' WHEN l.quality = 1 THEN 'confirmed' ELSE 'rejected' END AS label_edge,
               CASE WHEN l.toxic IS NULL THEN NULL WHEN d.doc_id % 23 = 0 THEN 'indeterminate' WHEN l.quality = 0 THEN 'breaking' ELSE 'compatible' END AS label_impact,
               CASE WHEN l.toxic IS NULL THEN NULL WHEN d.doc_id % 31 = 0 THEN 'indeterminate' WHEN l.quality = 1 THEN 'coordinate' ELSE 'none' END AS label_action,
               CAST(1 + d.doc_id % 3 AS DOUBLE) AS weight, d.n_chars AS latency_ms, d.doc_id % 6 AS consumer, d.doc_id % 11 AS producer,
               CASE d.doc_id % 10 WHEN 0 THEN 'mutation' WHEN 1 THEN 'executable_replay' WHEN 2 THEN 'forward_shadow' ELSE 'historical' END AS subset,
               CASE d.doc_id % 3 WHEN 0 THEN 'openapi_operation' WHEN 1 THEN 'typescript_symbol' ELSE 'event.topic' END AS contract_kind,
               concat('tier', CAST(d.doc_id % 2 AS STRING), '->tier', CAST(d.doc_id % 3 AS STRING)) AS language_pair, CAST(d.doc_id % 1000 AS DOUBLE) AS cost_microunits,
               CASE d.doc_id % 21 WHEN 0 THEN 'superseded' WHEN 1 THEN 'timeout' ELSE 'completed' END AS analysis_outcome, l.toxic IS NOT NULL AND d.doc_id % 3 = 0 AS independently_labelled,
               CASE d.doc_id % 5 WHEN 0 THEN true WHEN 1 THEN false END AS action_observed, CASE WHEN d.doc_id % 5 = 0 THEN d.doc_id % 777 END AS time_to_action_ms, d.doc_id % 13 = 0 AS action_censored,
               CASE WHEN d.doc_id % 4 = 0 THEN 'public' ELSE 'restricted' END AS releaseability, d.doc_id % 3 <> 1 AS research_consent, d.doc_id % 7 <> 2 AS evaluation_consent
        FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    "queue": """
        SELECT event_id, user_id AS supersession_key, event_type AS kind, ts AS available_at,
               CASE WHEN value < 5 THEN 'leased' WHEN value < 40 THEN 'available' ELSE 'completed' END AS state,
               CAST(event_id % 4 AS INT) AS attempt, 3 AS maximum_attempts, md5(props) AS delivery_hash,
               CASE WHEN value < 5 THEN ts END AS lease_expires_at
        FROM {events}""",
    "rules": """
        SELECT c_custkey AS rule_id,
               CASE c_custkey % 6 WHEN 0 THEN 'occurrence' WHEN 1 THEN 'stable_finding' WHEN 2 THEN 'contract_consumer' WHEN 3 THEN 'repository_pair_kind' WHEN 4 THEN 'adapter_rule' ELSE 'workspace_rule' END AS scope,
               concat('occ-', CAST(c_custkey AS STRING), '-1') AS occurrence_id, concat('fnd-', CAST(c_custkey % 200 AS STRING), '-', CAST(c_nationkey % 10 AS STRING)) AS fingerprint,
               CASE c_nationkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS contract_kind, concat('part:', CAST(c_custkey % 200 AS STRING)) AS canonical_key,
               c_nationkey % 20 AS producer, CAST(c_nationkey AS BIGINT) AS consumer, CASE WHEN c_nationkey % 2 = 0 THEN 'F' ELSE 'O' END AS adapter, concat('r', CAST(c_custkey % 97 AS STRING)) AS adapter_rule,
               date_add_days(CAST('1999-01-01' AS DATE), CAST(c_custkey % 900 AS INT)) AS review_at,
               date_add_days(CAST('1999-06-01' AS DATE), CAST(c_custkey % 1200 AS INT)) AS expires_at
        FROM {customer}""",
    "rule_predicates": """
        SELECT c_custkey AS rule_id, CASE (c_custkey + i) % 9 WHEN 0 THEN 'producer_code' WHEN 1 THEN 'consumer_code' WHEN 2 THEN 'consumer_reference' WHEN 3 THEN 'contract_shape' WHEN 4 THEN 'identity_version'
                    WHEN 5 THEN 'adapter_version' WHEN 6 THEN 'evidence_stratum' WHEN 7 THEN 'policy_revision' ELSE 'registry_revision' END AS kind,
               concat('s', CAST(c_nationkey AS STRING)) AS subject, CASE WHEN c_custkey % 8 = 5 THEN 'old' ELSE concat('v', CAST(c_nationkey % 3 AS STRING)) END AS expected, i AS position
        FROM {customer} CROSS JOIN (VALUES (0), (4)) AS k(i)""",
    "rule_versions": """
        SELECT kind, concat('s', CAST(n_nationkey AS STRING)) AS subject, concat('v', CAST(n_nationkey % 3 AS STRING)) AS current
        FROM {nation} CROSS JOIN (VALUES ('producer_code'), ('consumer_code'), ('consumer_reference'), ('contract_shape'), ('identity_version'), ('adapter_version'), ('evidence_stratum'), ('policy_revision'), ('registry_revision')) AS k(kind)
        WHERE n_nationkey <> 24""",
    "candidates": """
        SELECT concat('occ-', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS occurrence_id, min(concat('fnd-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING))) AS fingerprint,
               min(l_returnflag) AS contract_kind, min(concat('part:', CAST(l_partkey AS STRING))) AS canonical_key, min(l_suppkey % 20) AS producer, min(l_orderkey % 25) AS consumer, min(l_linestatus) AS adapter,
               min(concat('r', CAST(l_linenumber AS STRING))) AS rule_one, min(concat('r', CAST(CAST(l_quantity AS INT) AS STRING))) AS rule_two
        FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
}
#: Cases of the real world: what is mutated on purpose is measured apart.
BINDINGS["cases"] = BINDINGS["all_cases"] + " WHERE d.doc_id % 10 <> 0"
_HOLE = re.compile(r"\{(\w+)\}")


def tables_of(relation: str) -> list[str]:
    return sorted(set(_HOLE.findall(BINDINGS[relation])))


def relation(spark: SparkSession, sf_dir: str, name: str, **instead: DataFrame) -> DataFrame:
    """A bound relation as a DataFrame; Catalyst sees through it down to the scans. `instead` stands for tables of these
    names, as for one without the rows that an analysis drops in any case."""
    text = BINDINGS[name].replace("date_add_days(", "date_add(")
    return spark.sql(text, **{t: instead[t] if t in instead else table(spark, sf_dir, t) for t in tables_of(name)})


def relation_sql(*names: str) -> str:
    """The same relations as a WITH clause for the comparing engine."""
    bound = []
    for name in names:
        text = _HOLE.sub(r"\1", BINDINGS[name])
        text = re.sub(r"date_add_days\((.+?AS DATE\)), ", r"(\1 + ", text)
        bound.append(f"{name} AS ({text})")
    return "WITH " + ",\n".join(bound)


def insert_if_absent(existing: DataFrame, incoming: DataFrame, key: list[str], content: str) -> tuple[DataFrame, DataFrame]:
    """Rows to append, one a key, and conflicts (S7, S18): incoming rows whose key is held with other content, or
    comes with several contents at once; of the latter none is appended. A null content is a content."""
    rest = [c for c in incoming.columns if c not in (*key, content)]
    own = F.struct(F.col(content).isNull().alias("none"), F.col(content).alias("content"))
    once = incoming.groupBy(*key).agg(F.min(F.struct(own.alias("own"), *rest)).alias("_row"), F.max(own).alias("_last"))
    once = once.join(existing.select(*key, own.alias("_held")).dropDuplicates(key), key, "left")
    agree = F.col("_row.own") == F.col("_last")
    new = once.where(agree & F.col("_held").isNull()).select(*(c if c in key else F.col("_row.own.content" if c == content else f"_row.{c}").alias(c) for c in incoming.columns))
    bad = once.where(~agree | (F.col("_held") != F.col("_last"))).select(*key)
    return new, incoming.join(bad, key, "left_semi")


def latest_by_key(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Pointer semantics: the last row of each key (S8, W1), as a greatest struct, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in (*key, *order)]
    last = rows.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("_last"))
    return last.select(*key, *(F.col(f"_last.{c}").alias(c) for c in (*order, *rest))).select(*rows.columns)


def purge(tables: dict[str, DataFrame], column: str, repository) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables without a repository's rows, and the ledger of what went."""
    ledger = None
    for name, df in tables.items():
        gone = df.where(F.col(column) == F.lit(repository)).agg(F.count("*").alias("deleted")).select(F.lit(name).alias("relation"), "deleted")
        ledger = gone if ledger is None else ledger.unionByName(gone)
    return {n: df.where(~F.col(column).eqNullSafe(F.lit(repository))) for n, df in tables.items()}, ledger


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """A page of a canonical order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def tree_compare(base: DataFrame, head: DataFrame) -> DataFrame:
    """Two trees (path, content_hash, entry_kind, binary) to changes A, D, M, T (of type), R (renamed) and C
    (copied), with the path before and whether either side is binary (S4). An added path is a rename if a
    deleted path had its content, else a copy if an unchanged one has; the least such path is the one before.
    Content is compared whole: what is moved and edited at once is a deletion and an addition."""
    side = lambda df, n: df.select("path", F.col("content_hash").alias(n), F.col("entry_kind").alias(f"{n}_kind"), F.col("binary").alias(f"{n}_binary"))
    both = side(base, "old").join(side(head, "new"), "path", "full_outer")
    kind = (
        F.when(F.col("old").isNull(), "A").when(F.col("new").isNull(), "D").when(F.col("old_kind") != F.col("new_kind"), "T").when(F.col("old") != F.col("new"), "M").otherwise("=")
    )
    marked = both.withColumns({"change": kind, "binary": F.coalesce("old_binary", F.lit(False)) | F.coalesce("new_binary", F.lit(False))})
    # One row a content, so an added path meets one, however many files hold it.
    source = marked.where("change in ('D', '=')").groupBy(F.col("old").alias("new")).agg(
        F.min(F.when(F.col("change") == "D", F.col("path"))).alias("_moved"), F.min(F.when(F.col("change") == "=", F.col("path"))).alias("_copied")
    )
    added = marked.where("change = 'A'").join(source, "new", "left")
    change = F.when(F.col("_moved").isNotNull(), "R").when(F.col("_copied").isNotNull(), "C").otherwise("A")
    moved = added.select("path", change.alias("change"), F.coalesce("_moved", "_copied").alias("previous_path"), "binary")
    rest = marked.where("change in ('D', 'M', 'T')").select("path", "change", F.lit(None).cast("string").alias("previous_path"), "binary")
    return moved.unionByName(rest)
