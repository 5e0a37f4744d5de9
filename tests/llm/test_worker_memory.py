"""What a worker, and the executor for it, holds at a time does not grow with texts or the words in them."""

import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from fathomline.llm import common, tokens


def test_batches_are_bounded_in_bytes(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    texts = spark.range(0, 60, 1, 1).select(F.repeat(F.concat(F.lit("word "), F.col("id").cast("string")), 50_000).alias("text"))
    found = common.materialise(texts.mapInArrow(sizes, "n long, bytes long"), "sizes")
    assert found.agg(F.sum("n")).first()[0] == 60
    assert found.agg(F.max("bytes")).first()[0] < common.BATCH + (1 << 20)


def test_smaller_batches_stay(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "100000")
    common.bounded_batches(spark)
    assert spark.conf.get(key).rstrip("b") == "100000"
    spark.conf.set(key, before)


def test_memo_is_bounded():
    path = public_tokenizers.path("byte_bpe_50k.json")
    bounded, ample = tokens.Encoder(path, False, limit=300), tokens.Encoder(path, False)
    for k in range(3):
        chunks = [f" some{i}thing" for i in range(700 * k, 700 * k + 1400)]
        assert bounded.runs(chunks) == ample.runs(chunks)
        assert len(bounded.memo) <= 300 and len(bounded.old) <= 300
