"""Vector codes by heap Lloyd: vectors are cut into parts, each part is replaced by the number of its nearest
codebook entry, and entries move to the means of their parts, round after round.

A shard is a slice of the table where it lies; it holds its vectors as integers and, for each part position and
each entry, a heap of that entry's parts. A part's key is its slack, the distance to the second nearest entry less
that to its own, plus the drift its entry had gathered when the part was put in. An entry's drift grows each
round by how far it moved and by how far any other did. While the least key of a heap exceeds the drift, no part in
it can have got another nearest entry, so only the violated ones are popped, measured exactly in integers
against all entries, and pushed again; a margin above the rounding of the keys is popped too, so ties are always
measured and go to the lower index. Sums and counts of entries change by the moved parts alone: a task adds its
changes up, Spark adds the tasks' up, and the driver holds the codebooks, parts x entries x width numbers.

A round reads the shards and writes them anew in the shared folder, and the round before is deleted, so a lost
executor costs a round's tasks.

Defined results: vectors that are null, hold null or non-finite components, or lack an id take no part, nor do
those whose length is not the commonest (of equally common ones the shortest) or no multiple of `parts`.
Components are floor(scale * x), held within what keeps every squared distance a long. Repeated rows each
count; the first codebook takes the rows that come first by id, then by components. With fewer rows than entries
the codebook has as many as there are rows. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_spread, materialise

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Vectors of a shard at most.
SHARD = 1 << 14
_SHARD_SCHEMA = "ids array<long>, labels array<string>, q binary, keys binary, members binary, sizes binary, entry array<int>, n array<long>, sums array<array<long>>"
_NARROW = (np.int16, np.int32, np.int64)


def of_one_length(rows: DataFrame, column: str) -> tuple[DataFrame, int]:
    """The rows whose array has the commonest length above 0 (of equally common ones the least), and it; 0: none."""
    sizes = rows.groupBy(F.size(column).alias("size")).count().where("size > 0")
    first = sizes.orderBy(F.desc("count"), "size").first()
    size = first["size"] if first else 0
    return rows.where(F.size(column) == size), size


def finite(vectors: DataFrame) -> DataFrame:
    """vec_id, label as text, embedding as doubles, of the vectors that take part."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(sound)
    label = F.col("label").cast("string") if "label" in vectors.columns else F.lit(None).cast("string")
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), x.alias("embedding"))


def integers(vectors: DataFrame, scale: int = SCALE, parts: int = PARTS) -> tuple[DataFrame, int]:
    """vec_id, label, q: whole components of the vectors that take part, and their number."""
    rows, size = of_one_length(finite(vectors), "embedding")
    if not size or size % parts:
        return rows.where("false").select("vec_id", "label", F.lit(None).cast("array<long>").alias("q")), 0
    most = math.isqrt((1 << 61) // size)
    hold = lambda v: F.greatest(F.least(F.floor(v * scale), F.lit(most)), F.lit(-most)).cast("long")
    return rows.select("vec_id", "label", F.transform("embedding", hold).alias("q")), size


def narrow(x: np.ndarray) -> np.ndarray:
    """The same integers in the smallest of three types."""
    top = max(int(x.max()), -int(x.min())) if x.size else 0
    return x.astype(next(t for t in _NARROW if top <= np.iinfo(t).max))


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to rows of book, exact: as doubles where all of it fits 53 bits."""
    top = max(int(np.abs(m).max(initial=0)) for m in (x, book))
    kind = np.float64 if 4 * top * top * x.shape[1] < 1 << 53 else np.int64
    x, book = x.astype(kind), book.astype(kind)
    return (x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)[None, :]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row its nearest entry, the lower of equals, and its slack, not above the true one."""
    every = np.arange(len(x))
    square = distances(x, book)
    own = square.argmin(1)
    least = np.sqrt(square[every, own].astype(np.float64))
    if len(book) == 1:
        return own, np.full(len(x), np.inf)
    square = square.astype(np.float64)
    square[every, own] = np.inf
    second = np.sqrt(square.min(1))
    return own, (second - least) - 1e-9 * (second + least + 1)


class Heaps:
    """For one part position, a heap of (key, row) for each entry."""

    def __init__(self, entries: int):
        self.of = [[] for _ in range(entries)]

    @classmethod
    def load(cls, keys: np.ndarray, rows: np.ndarray, sizes: np.ndarray):
        made, at = cls(0), 0
        for n in sizes.tolist():
            made.of.append(list(zip(keys[at : at + n].tolist(), rows[at : at + n].tolist(), strict=True)))
            at += n
        return made

    def dump(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, rows and sizes; a heap's order is kept, so it is a heap again when loaded."""
        flat = [x for heap in self.of for x in heap]
        return np.array([k for k, _ in flat], np.float64), np.array([r for _, r in flat], np.int32), np.array([len(h) for h in self.of], np.int32)

    def fill(self, own: np.ndarray, keys: np.ndarray) -> None:
        for row, (entry, key) in enumerate(zip(own.tolist(), keys.tolist(), strict=True)):
            self.of[entry].append((key, row))
        for heap in self.of:
            heapq.heapify(heap)

    def violated(self, drift: list[float]) -> tuple[list[int], list[int]]:
        """Pop each part whose key no longer exceeds its entry's drift: rows and the entries they had."""
        rows, had = [], []
        for entry, heap in enumerate(self.of):
            most = drift[entry] * (1 + 1e-9) + 1e-9
            while heap and heap[0][0] <= most:
                rows.append(heapq.heappop(heap)[1])
                had.append(entry)
        return rows, had

    def push(self, rows: list[int], own: list[int], keys: list[float]) -> None:
        for row, entry, key in zip(rows, own, keys, strict=True):
            heapq.heappush(self.of[entry], (key, row))

    def owners(self, n: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        for entry, heap in enumerate(self.of):
            out[[row for _, row in heap]] = entry
        return out


class Changes:
    """What a task adds to and takes from the sums and counts of entries."""

    def __init__(self, parts: int, entries: int, width: int):
        self.n, self.sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)

    def add(self, part: int, x: np.ndarray, entry: np.ndarray, sign: int) -> None:
        order = np.argsort(entry, kind="stable")
        first, starts, count = np.unique(entry[order], return_index=True, return_counts=True)
        self.n[part, first] += sign * count
        if len(first):
            self.sums[part, first] += sign * np.add.reduceat(x[order].astype(np.int64), starts, axis=0)

    def row(self) -> tuple:
        parts, entries = np.nonzero((self.n != 0) | (self.sums != 0).any(2))
        return (parts * self.n.shape[1] + entries).tolist(), self.n[parts, entries].tolist(), self.sums[parts, entries].tolist()


def _batch(ids=None, labels=None, q=None, keys=None, members=None, sizes=None, entry=None, n=None, sums=None) -> pa.RecordBatch:
    types = (pa.list_(pa.int64()), pa.list_(pa.string()), *[pa.binary()] * 4, pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64())))
    cells = (ids, labels, q, keys, members, sizes, entry, n, sums)
    return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types, strict=True)], names=["ids", "labels", "q", "keys", "members", "sizes", "entry", "n", "sums"])


def _packed(q: np.ndarray, heaps: list[Heaps]) -> dict:
    dumped = [h.dump() for h in heaps]
    return {"q": bytes([q.dtype.itemsize]) + q.tobytes(), "keys": b"".join(d[0].tobytes() for d in dumped), "members": b"".join(d[1].tobytes() for d in dumped), "sizes": b"".join(d[2].tobytes() for d in dumped)}


def _vectors(cell: bytes, size: int) -> np.ndarray:
    kind = next(t for t in _NARROW if np.dtype(t).itemsize == cell[0])
    return np.frombuffer(cell, kind, offset=1).reshape(-1, size)


def begin(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """Shards with full heaps: every part is measured against the first codebooks."""
    parts, entries, width = books.shape

    def made(batches):
        changes = Changes(parts, entries, width)

        def close(ids, labels, x):
            q, heaps = narrow(x), []
            for p in range(parts):
                cut = q[:, p * width : (p + 1) * width]
                own, slack = nearest(cut, books[p])
                heap = Heaps(entries)
                heap.fill(own, slack)
                heaps.append(heap)
                changes.add(p, cut, own, 1)
            return _batch(ids, labels, **_packed(q, heaps))

        ids, labels, held = [], [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            labels += b.column(1).to_pylist()
            held.append(b.column(2).flatten().to_numpy().reshape(-1, parts * width))
            if len(ids) >= SHARD:
                x = np.concatenate(held)
                for at in range(0, len(ids) - SHARD + 1, SHARD):
                    yield close(ids[at : at + SHARD], labels[at : at + SHARD], x[at : at + SHARD])
                done = len(ids) // SHARD * SHARD
                ids, labels, held = ids[done:], labels[done:], [x[done:]]
        if ids:
            yield close(ids, labels, np.concatenate(held))
        entry, n, sums = changes.row()
        yield _batch(entry=entry, n=n, sums=sums)

    return materialise(rows.select("vec_id", "label", "q").mapInArrow(made, _SHARD_SCHEMA), "codes")


def again(shards: DataFrame, books: np.ndarray, drift: np.ndarray) -> DataFrame:
    """The shards after one more assignment: parts whose bounds the drift has violated are measured anew."""
    parts, entries, width = books.shape

    def made(batches):
        changes = Changes(parts, entries, width)
        for b in batches:
            for shard in b.to_pylist():
                q, heaps, at = _vectors(shard["q"], parts * width), [], 0
                sizes = np.frombuffer(shard["sizes"], np.int32).reshape(parts, entries)
                keys, members = np.frombuffer(shard["keys"], np.float64), np.frombuffer(shard["members"], np.int32)
                for p in range(parts):
                    heap = Heaps.load(keys[at : at + len(q)], members[at : at + len(q)], sizes[p])
                    at += len(q)
                    rows, had = heap.violated(drift[p].tolist())
                    if rows:
                        cut, had = q[rows, p * width : (p + 1) * width], np.array(had)
                        own, slack = nearest(cut, books[p])
                        heap.push(rows, own.tolist(), (slack + drift[p][own]).tolist())
                        moved = own != had
                        changes.add(p, cut[moved], had[moved], -1)
                        changes.add(p, cut[moved], own[moved], 1)
                    heaps.append(heap)
                yield _batch(shard["ids"], shard["labels"], **_packed(q, heaps))
        entry, n, sums = changes.row()
        yield _batch(entry=entry, n=n, sums=sums)

    kept = shards.where("ids is not null").select("ids", "labels", "q", "keys", "members", "sizes")
    return materialise(kept.mapInArrow(made, _SHARD_SCHEMA), "codes")


def changed(shards: DataFrame, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Counts and sums of all tasks' changes, as Python integers; a row an entry comes to the driver."""
    parts, entries, width = shape
    rows = shards.where("entry is not null").select(F.explode(F.arrays_zip("entry", "n", "sums")).alias("of")).select("of.*")
    added = rows.groupBy("entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)))
    n, sums = np.zeros((parts, entries), object), np.zeros((parts, entries, width), object)
    for r in added.collect():
        n[divmod(r["entry"], entries)] = r["n"]
        sums[divmod(r["entry"], entries)] = [int(r[f"s{i}"]) for i in range(width)]
    return n, sums


def moved_books(books: np.ndarray, n: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Entries as the floors of their parts' means; an entry without parts stays."""
    out = books.copy()
    for p, e in zip(*np.nonzero(n), strict=True):
        out[p, e] = [int(s) // int(n[p, e]) for s in sums[p, e]]
    return out


def gathered(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """By how much each entry's slack may have shrunk: its own move and the longest of any other."""
    moves = np.sqrt(((after - before).astype(np.float64) ** 2).sum(2)) * (1 + 1e-9)
    if moves.shape[1] == 1:
        return moves
    top = np.sort(moves, axis=1)
    others = np.repeat(top[:, -1:], moves.shape[1], axis=1)
    others[np.arange(len(moves)), moves.argmax(1)] = top[:, -2]
    return moves + others


def fit(rows: DataFrame, size: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Shards after the last assignment, and the codebooks (parts, entries, width) they are assigned to."""
    first = rows.orderBy("vec_id", "q").limit(entries).select("q").collect()
    books = np.array([r["q"] for r in first], np.int64).reshape(-1, parts, size // parts).transpose(1, 0, 2).copy()
    shards = begin(rows, books)
    drift, n, sums = np.zeros(books.shape[:2]), *changed(shards, books.shape)
    for _ in range(rounds):
        after = moved_books(books, n, sums)
        drift, books = drift + gathered(books, after), after
        later = again(shards, books, drift)
        discard(shards)
        shards = later
        more, added = changed(shards, books.shape)
        n, sums = n + more, sums + added
    return shards, books


def coded(shards: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code, error of every vector."""
    parts, entries, width = books.shape

    def made(batches):
        for b in batches:
            for shard in b.to_pylist():
                q, at = _vectors(shard["q"], parts * width), 0
                sizes = np.frombuffer(shard["sizes"], np.int32).reshape(parts, entries)
                keys, members = np.frombuffer(shard["keys"], np.float64), np.frombuffer(shard["members"], np.int32)
                codes, error = np.zeros((len(q), parts), np.int64), np.zeros(len(q), np.int64)
                for p in range(parts):
                    codes[:, p] = Heaps.load(keys[at : at + len(q)], members[at : at + len(q)], sizes[p]).owners(len(q))
                    at += len(q)
                    apart = q[:, p * width : (p + 1) * width].astype(np.int64) - books[p][codes[:, p]]
                    error += (apart * apart).sum(1)
                text = ["".join(f"{c:02x}" for c in row) for row in codes.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(shard["ids"], pa.int64()), pa.array(shard["labels"], pa.string()), pa.array(text, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    kept = shards.where("ids is not null").select("ids", "labels", "q", "keys", "members", "sizes")
    return kept.mapInArrow(made, "vec_id long, label string, code string, error long")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label (as text), code, error as a written table, and the codebooks; None without vectors."""
    rows, size = integers(vectors, scale, parts)
    if not size:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), None
    shards, books = fit(rows, size, parts, entries, rounds)
    out = materialise(coded(shards, books), "coded")
    discard(shards)
    return out, books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def digest(vectors: DataFrame) -> DataFrame:
    """What op12 returns. Errors are summed by label before they meet the rows; the rows of a common label stay where
    they are. Sums beyond a long are held at its end."""
    out, books = compress(vectors)
    label = F.coalesce(F.concat(F.lit("="), F.col("label")), F.lit(""))
    rows = out.select("vec_id", "code", "error", label.alias("of"))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")
    sums = rows.groupBy("of").agg(F.count("*").alias("n"), total.alias("label_error"))
    told = join_spread(rows, sums, "of", out.count())
    return told.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books) if books is not None else None).cast("string").alias("codebooks_sha256"))


def _oracle() -> str:
    """The same by plain Lloyd: in each round every part is held against every entry."""
    rounds = []
    for k in range(ROUNDS + 1):
        rounds.append(f"""
a{k} AS MATERIALIZED (
    SELECT r, p, min(struct_pack(d := d, e := e)) AS best FROM (
        SELECT x.r, x.p, b.e, sum((x.v - b.v) * (x.v - b.v)) AS d FROM x JOIN b{k} b ON x.p = b.p AND x.i = b.i GROUP BY x.r, x.p, b.e
    ) GROUP BY r, p
)""")
        if k < ROUNDS:
            rounds.append(f"""
b{k + 1} AS MATERIALIZED (
    SELECT b.p, b.e, b.i, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN (
        SELECT x.p, a.best.e AS e, x.i, CAST(floor(CAST(sum(x.v) AS DOUBLE) / count(*)) AS BIGINT) AS v
        FROM x JOIN a{k} a ON x.r = a.r AND x.p = a.p GROUP BY x.p, a.best.e, x.i
    ) m ON b.p = m.p AND b.e = m.e AND b.i = m.i
)""")
    last = ROUNDS
    return f"""
WITH v AS MATERIALIZED (
    SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS r,
           list_transform(embedding, lambda c: CAST(floor({SCALE} * CAST(c AS DOUBLE)) AS BIGINT)) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), x AS MATERIALIZED (
    SELECT r, (g - 1) // (len(q) // {PARTS}) AS p, (g - 1) % (len(q) // {PARTS}) AS i, q[g] AS v
    FROM v, unnest(range(1, len(q) + 1)) AS u(g)
), b0 AS MATERIALIZED (
    SELECT p, r - 1 AS e, i, v FROM x WHERE r <= {ENTRIES}
), {", ".join(rounds)}, o AS (
    SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d) AS error FROM a{last} GROUP BY r
), c AS (
    SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM b{last}
)
SELECT v.vec_id, o.code, CAST(o.error AS BIGINT) AS error,
       CAST(sum(o.error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error, c.codebooks_sha256
FROM v JOIN o ON v.r = o.r, c
"""


ORACLE_SQL = _oracle()
