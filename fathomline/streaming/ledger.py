"""Streams into tables that take every record once (S7, S17): a batch that is played again appends nothing.

A batch's rows go to a folder of the batch's own, over whatever an earlier attempt left there, and are held against
the batches before it alone; last comes the batch's line in the ledger. So a run that dies anywhere between is
repeated to the same end, and readers take the batches of the ledger only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import insert_if_absent


class LedgerSink:
    """A sink for foreachBatch: records with a key and an immutable content under one folder."""

    def __init__(self, spark: SparkSession, path: str, schema, key: list[str], content: str):
        self.spark, self.path, self.key, self.content = spark, path.rstrip("/"), key, content
        self.schema = spark.createDataFrame([], schema).schema

    def _read(self, name: str, columns: str) -> DataFrame:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        schema = self.spark.createDataFrame([], columns).schema
        if not folder.getFileSystem(conf).exists(folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")

    def batches(self) -> DataFrame:
        """batch, appended, conflicts of every batch that is done."""
        return self._read("ledger", "appended long, conflicts long, batch long")

    def _of(self, name: str, before: int | None) -> DataFrame:
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
        done = self.batches().select("batch")
        done = done if before is None else done.where(F.col("batch") < before)
        return self._read(name, f"{fields}, batch long").join(F.broadcast(done), "batch", "left_semi")  # a number a batch

    def records(self) -> DataFrame:
        return self._of("records", None).drop("batch")

    def conflicts(self) -> DataFrame:
        """Records that were refused, with their batch."""
        return self._of("conflicts", None)

    def write(self, batch: DataFrame, number: int) -> None:
        """Take a batch: for foreachBatch."""
        if not self.batches().where(F.col("batch") == number).isEmpty():
            return
        batch = batch.select(*self.schema.names).persist()  # read three times; lost parts are computed again
        try:
            new, conflicts = insert_if_absent(self._of("records", number).drop("batch"), batch, self.key, self.content)
            counts = []
            for name, rows in (("records", new), ("conflicts", conflicts)):
                rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={number}")
                counts.append(self.spark.read.schema(self.schema).parquet(f"{self.path}/{name}/batch={number}").count())
        finally:
            batch.unpersist()
        self._commit(number, *counts)

    def _commit(self, number: int, appended: int, conflicts: int) -> None:
        line = self.spark.range(1).select(F.lit(appended).cast("long").alias("appended"), F.lit(conflicts).cast("long").alias("conflicts"))
        line.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/ledger/batch={number}")

    def start(self, stream: DataFrame, checkpoint: str):
        """The stream's query, taking what there is and ending."""
        return stream.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
