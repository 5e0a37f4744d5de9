"""The changed-contract join kept up to date (G9): after a change of inputs only the edges of touched keys are joined
again, and they equal the same slice of a join from scratch.

An edge depends on one contract key alone: on the change of that key and on the references that may mean it. So
changes, references (a row for each key they may mean) and edges lie in as many buckets of the key's hash, as
partitions on disk. A refresh takes what was and what is of the inputs that changed. Their keys are the touched
ones; only the buckets of these are read, within them only touched keys are joined, and only they are
written back, by dynamic partition overwrite. The work follows the change, not the store.

A dynamic overwrite leaves a partition alone that gets no row, so each rewritten bucket holds one row without a
key, which readers skip. A refresh that broke off is repeated: it takes away what was and puts what is, both by key
and id, so doing it twice does nothing more; repair() joins whole buckets anew from the inputs that are stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .contracts import asked_keys, decide, decided_edges, dedupe_edges

C = F.col
BUCKETS = 64
KEY = ["contract_kind", "canonical_key"]
#: What edges are made of; a store holds no more of a reference.
REFERENCE = [
    "reference_id", "consumer", "generation_id", "contract_kind", "canonical_key", "constrained_key", "context_basis", "first_observed", "last_observed", "stratum", "alias_state", "alias_service", "_only", "_ambiguous",
]
_ID = {"changes": KEY, "references": [*KEY, "reference_id"], "edges": KEY}


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int")


def keyed(references: DataFrame) -> DataFrame:
    """References with their alias's state (with_alias_state()) as they are stored: by the keys they may mean."""
    return asked_keys(references.select(*REFERENCE)).withColumnRenamed("key", "canonical_key").drop("_only", "_ambiguous")


def joined(changes: DataFrame, references: DataFrame, workspace: str, revision: str) -> DataFrame:
    """Edges of stored changes and stored references."""
    return dedupe_edges(decided_edges(decide(changes, references.withColumnRenamed("canonical_key", "key")), workspace, revision))


class RejoinStore:
    """Changes (with their definitions), references and edges in buckets under one folder."""

    def __init__(self, spark: SparkSession, path: str, workspace: str, revision: str, buckets: int = BUCKETS):
        self.spark, self.path, self.workspace, self.revision, self.buckets = spark, path.rstrip("/"), workspace, revision, buckets
        self.schemas: dict = {}

    def create(self, changes: DataFrame, references: DataFrame) -> None:
        """Store the inputs, and the edges of a join from scratch."""
        every = list(range(self.buckets))
        self._write("changes", changes, every)
        self._write("references", keyed(references), every)
        self._write("edges", joined(self.read("changes"), self.read("references"), self.workspace, self.revision), every)

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """What is stored, of some buckets or of all; which files are read is decided by their folders."""
        rows = self.spark.read.schema(self.schemas[name]).parquet(f"{self.path}/{name}")
        rows = rows.where(C("bucket").isin(*buckets)) if buckets is not None else rows
        return rows.where("canonical_key is not null").drop("bucket")

    def edges(self) -> DataFrame:
        return self.read("edges")

    def refresh(self, changes: tuple[DataFrame, DataFrame] | None = None, references: tuple[DataFrame, DataFrame] | None = None) -> list[int]:
        """Apply changed inputs, each as rows that were and rows that are (either may be empty): a changed row is
        in both, a new one in the second and one that is gone in the first. The buckets that were rewritten."""
        deltas = {}
        if changes is not None:
            deltas["changes"] = changes
        if references is not None:
            deltas["references"] = tuple(keyed(x) for x in references)
        touched = None
        for was, now in deltas.values():
            for side in (was, now):
                keys = side.select(*KEY)
                touched = keys if touched is None else touched.unionByName(keys)
        if touched is None:
            return []
        touched = touched.where(" and ".join(f"{k} is not null" for k in KEY)).distinct()
        buckets = sorted(r["b"] for r in touched.select(bucket_of(self.buckets).alias("b")).distinct().collect())  # `buckets` of them at most
        if not buckets:
            return []
        for name, (was, now) in deltas.items():
            held = self.read(name, buckets)
            gone = was.select(*_ID[name]).unionByName(now.select(*_ID[name])).distinct()
            self._write(name, held.join(gone, _ID[name], "left_anti").unionByName(now.select(*held.columns)), buckets)
        self._rejoin(touched, buckets)
        return buckets

    def _rejoin(self, touched: DataFrame | None, buckets: list[int]) -> None:
        """Edges of touched keys anew, those of the other keys of these buckets as they are."""
        held, changes, references = (self.read(n, buckets) for n in ("edges", "changes", "references"))
        if touched is not None:
            changes, references = (x.join(touched, KEY, "left_semi") for x in (changes, references))
        edges = joined(changes, references, self.workspace, self.revision)
        if touched is not None:
            edges = held.join(touched, KEY, "left_anti").unionByName(edges.select(*held.columns))
        self._write("edges", edges, buckets)

    def repair(self, buckets: list[int]) -> None:
        """Join whole buckets anew from the stored inputs, whatever their edges are."""
        self._rejoin(None, buckets)

    def _write(self, name: str, rows: DataFrame, buckets: list[int]) -> None:
        dealt = rows.withColumn("bucket", bucket_of(self.buckets))
        self.schemas.setdefault(name, dealt.schema)
        mark = self.spark.range(self.buckets).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in dealt.schema.fields if f.name != "bucket"), C("id").cast("int").alias("bucket")).where(C("bucket").isin(*buckets))
        # Rebalanced: a bucket goes to one file, and a large one to several, however its keys are.
        dealt.unionByName(mark).hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/{name}")
