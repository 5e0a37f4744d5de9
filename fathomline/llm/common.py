"""Helpers shared by the text operators: shared storage, bounded samples and per-worker memo tables."""

from __future__ import annotations

import ctypes
import gc
import pickle
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; in a local session without one (tests), a folder of our own.
    On a cluster a local folder would be another one on each machine, so there it must be named."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        given = f"file://{tempfile.mkdtemp(prefix='fathomline-')}"
        spark.conf.set("spark.checkpoint.dir", given)
    return given.rstrip("/")


#: Bytes of rows that Spark gathers for a Python worker at a time. Its bound on rows alone lets a batch grow with
#: its texts, and executor and worker each hold a batch of every running task, in memory they seldom give back.
BATCH = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """From now on batches for Python workers close at BATCH bytes, or earlier if the session says so."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = re.fullmatch(r"(\d+)b?", spark.conf.get(key))
    if not given or int(given[1]) > BATCH:
        spark.conf.set(key, str(BATCH))


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: a later stage that loses an
    executor re-reads the table rather than the whole lineage, and nothing is computed twice."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialised tables that nothing reads any more; other folders are left alone. The driver
    then collects its garbage, so broadcasts and shuffles of what is gone go too, and its heap shrinks between
    the rounds of an iteration."""
    for df in tables:
        spark = df.sparkSession
        jvm, conf, root = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), shared_dir(spark)
        under = jvm.org.apache.hadoop.fs.Path(root).toUri().getPath()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            if path.getParent().toUri().getPath() == under:
                path.getFileSystem(conf).delete(path, True)
    if tables:
        tables[0].sparkSession.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def residue(column: str, modulus: int) -> Column:
    """crc32 of a column's text form, modulo `modulus`; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


#: Bounds of a training sample: rows, and characters of all of them together.
SAMPLE_ROWS, SAMPLE_CHARS = 4000, 1 << 26
_DRAWS = 1 << 30


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, modulus: int = 5, held_out: int = 0, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, each: bool = False
) -> DataFrame:
    """doc_id, text, y of at most `rows` labelled documents (of each label, if `each`), the first by a hash of
    doc_id, as a written table; ids whose crc32 leaves `held_out` modulo `modulus` are never among them.

    An id with several labels is left out, of several texts of an id the one that hashes lowest is taken, so
    the sample does not depend on the order of rows. What is ranked is first thinned to about twice `rows`,
    so no more travels from a large table than from a small one, and the picked ids are broadcast, so no text
    is shuffled but theirs. Texts are whole. Where they exceed `chars` together, fewer are taken, from the same order,
    whose draw knows nothing of lengths. Null texts and labels teach nothing; empty
    tables give an empty sample."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (residue("doc_id", modulus) != held_out))
    known = known.select("doc_id", F.col(label).alias("y")).withColumn("of", F.col("y") if each else F.lit(0))
    sizes = known.groupBy("of").agg(F.approx_count_distinct("doc_id").alias("n"))  # one row, or one a label
    draw = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(_DRAWS))
    thin = known.join(F.broadcast(sizes), "of").where(draw * F.col("n") < 2.0 * rows * _DRAWS)
    agreed = thin.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("_high"), F.first("of").alias("of")).where("y = _high")
    ranked = agreed.withColumn("rank", F.row_number().over(Window.partitionBy("of").orderBy(draw, "doc_id")))
    picked = ranked.where(F.col("rank") <= rows).select("doc_id", "y", "rank")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(picked), "doc_id")
    found = materialise(texts.groupBy("doc_id", "y", "rank").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "sample")
    total, last = 0, 0
    for r in found.groupBy("rank").agg(F.sum(F.length("text")).alias("n")).orderBy("rank").collect():  # at most `rows`
        total += r["n"]
        if last and total > chars:
            break
        last = r["rank"]
    return found.where(F.col("rank") <= last).select("doc_id", "text", "y")


def trained(sample: DataFrame, make):
    """make() of the sample's rows (doc_id, text, y) in the order of their ids, by one task on an executor: the
    driver gets the model and never a text, and a lost executor costs the training."""

    def run(batches):
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        rows.sort(key=lambda r: r[0])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(make(rows), protocol=5)], pa.binary())], names=["model"])

    cell = sample.coalesce(1).mapInArrow(trimmed(run), "model binary").first()
    discard(sample)
    return pickle.loads(bytes(cell["model"])) if cell else make([])


def slices(texts: pa.Array, most: int = 4 << 20):
    """Slices (start, rows) of an array of texts of about `most` bytes each, one text at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + most, "right")))
        yield start, end - start
        start = end


#: Characters of a stretch of a long text.
STRETCH = 1 << 18
_SPACE = re.compile(r"\s")


def stretches(text: str | None, size: int = STRETCH, space: re.Pattern = _SPACE):
    """(start, stretch) of a text, cut at white space after `size` characters each, so that what is made of
    its words at a time is bounded."""
    at, n = 0, len(text or "")
    while at < n:
        cut = space.search(text, at + size) if at + size < n else None
        end = cut.start() if cut else n
        yield at, text[at:end] if at or end < n else text
        at = end


#: A key with more than one in so many of the rows is hot; there are at most so many hot keys.
HOT = 1000


def join_spread(rows: DataFrame, to: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined to(key, n, ...), one row a key, whose n counts the key's rows among `total`. The rows of hot
    keys, HOT keys at most, meet a broadcast where they lie, so no key's rows land in one task; the others are
    shuffled."""
    hot = to.where(F.col("n") * HOT > total).drop("n")
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(cold.join(to.where(F.col("n") * HOT <= total).drop("n"), key, how))


class VectorMemo(dict):
    """Chunk to row of `matrix`. `key` names what decides a chunk's vector (chunks of one key share a row),
    `make` gives a key's vector. Both are forgotten between documents once there are more than `limit`, so
    a worker's memory does not grow with the corpus, only with the longest document."""

    def __init__(self, make, width: int, limit: int = 300_000, key=None):
        super().__init__()
        self.make, self.limit, self.key, self.shared = make, limit, key, {}
        self.matrix = np.zeros((1024, width), np.float32)

    def __missing__(self, chunk):
        key = self.key(chunk) if self.key else chunk
        row = self.shared.get(key)
        if row is None:
            row = self.shared[key] = len(self.shared)
            if row >= len(self.matrix):
                self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
            self.matrix[row] = self.make(key)
        self[chunk] = row
        return row

    def rows(self, chunks: list) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
            if len(self.shared) > self.limit // 2:
                self.shared.clear()
                self.matrix = self.matrix[:1024].copy()
        return np.fromiter(map(self.__getitem__, chunks), np.int64, len(chunks))


_KEPT: dict = {}


def release() -> None:
    """Give memory that is free in this process back to the machine: workers wait for their next task, and on an
    executor what they hold meanwhile is missing elsewhere."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def trimmed(made):
    """A function over Arrow batches that leaves no free memory behind when its task ends."""

    def run(batches):
        try:
            yield from made(batches)
        finally:
            release()

    return run


def forget() -> None:
    """Drop what an earlier operator left in this worker process."""
    if _KEPT:
        _KEPT.clear()
        release()


def per_worker(token: str, make):
    """make(), once per worker process for a token; only the latest token's value is kept."""
    if token not in _KEPT:
        _KEPT.clear()
        _KEPT[token] = make()
        release()  # what was kept before, and what the making took
    return _KEPT[token]
