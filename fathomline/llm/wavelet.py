"""Token ids of a corpus in wavelet-matrix shard files.

A shard file is one byte string: a header, the doc_ids, a bit plane that marks the last id of each document,
and the bit planes of the ids, most significant first. A plane is cut into frames of 65,536 bits, each kept
compressed where that is shorter, beside a directory of where they lie and how many bits are set before
them. A question (the id at a place, how often an id occurs before a place, its k-th place, the document at
a place, the ids of the k-th document) unpacks one frame or two of each plane, whatever the shard's size.

Documents lie in ascending order of doc_id (nulls first, equal ids by a hash of the text, equal rows as
they come), each followed by the end id, and no document is split between shards. Null and empty texts are
the end id alone; a document longer than a shard has a shard to itself, so a task's memory is that of a
shard or of the longest document. Without documents there are no shards. Extra columns are ignored. Shards
travel as binary cells of a Parquet table in the shared folder, so that any store Spark can write will do
and a lost executor's shards are written again by Spark's own commit protocol.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, slices, trimmed
from .tokens import encoder

#: Ids of a shard, unless one document alone has more; bytes of a frame; the id that ends a document.
SHARD_IDS, FRAME, END_ID = 1 << 18, 8192, 1
_MAGIC = b"WVM2"
_HEAD = struct.Struct("<4sBQQI")
_PLANE = struct.Struct("<QQI")


def _write_plane(bits: np.ndarray, ones: int) -> bytes:
    """A plane from its bits, packed from the lowest: set bits, bytes, frames; directories; frames."""
    raw, pack = bits.tobytes(), zstandard.ZstdCompressor(level=1).compress
    frames = [raw[a : a + FRAME] for a in range(0, len(raw), FRAME)]
    frames = [c if len(c := pack(f)) < len(f) else f for f in frames]
    each = [int(np.bitwise_count(bits[a : a + FRAME]).sum()) for a in range(0, len(raw), FRAME)]
    offsets = np.cumsum([0, *map(len, frames)]).astype("<u4").tobytes()
    before = np.cumsum([0, *each]).astype("<u8").tobytes()
    return b"".join([_PLANE.pack(ones, len(raw), len(frames)), offsets, before, *frames])


def build(ids: np.ndarray, names: list | None = None, ends: np.ndarray | None = None) -> bytes:
    """The shard file of a sequence of unsigned ids; `ends` are the places of the documents' last ids and
    `names` their doc_ids, None for a null."""
    width, n = (max(1, int(ids.max()).bit_length()) if len(ids) else 1), len(ids)
    kind, arrow = (np.uint16, pa.uint16()) if width <= 16 else (np.uint32, pa.uint32())
    cur = np.ascontiguousarray(ids, kind)
    marks = np.zeros(n, bool)
    marks[[] if ends is None else ends] = True
    planes = [_write_plane(np.packbits(marks, bitorder="little"), int(marks.sum()))]
    for b in range(width - 1, -1, -1):
        bits = np.packbits((cur & kind(1 << b)) != 0, bitorder="little")
        mask = [pa.BooleanArray.from_buffers(pa.bool_(), n, [None, pa.py_buffer(x)]) for x in (~bits, bits)]
        rows = pa.Array.from_buffers(arrow, n, [None, pa.py_buffer(cur)])
        low, high = (pc.filter(rows, m).to_numpy() for m in mask)
        cur = np.concatenate([low, high])
        planes.append(_write_plane(bits, len(high)))
    names = names or []
    known = np.packbits(np.array([i is not None for i in names], bool), bitorder="little").tobytes()
    listed = zstandard.ZstdCompressor(level=1).compress(known + np.array([i or 0 for i in names], "<i8").tobytes())
    return b"".join([_HEAD.pack(_MAGIC, width, n, len(names), len(listed)), listed, *planes])


class Plane:
    """One bit plane of a file: its bits, ranks and selects."""

    def __init__(self, data: memoryview, at: int, n: int):
        self.data, self.n = data, n
        self.ones, self.size, frames = _PLANE.unpack_from(data, at)
        at += _PLANE.size
        self.offsets = np.frombuffer(data, "<u4", frames + 1, at)
        at += 4 * (frames + 1)
        self.before = np.frombuffer(data, "<u8", frames + 1, at).astype(np.int64)
        self.at = at + 8 * (frames + 1)
        self.end = self.at + int(self.offsets[-1])
        self.frame = lru_cache(maxsize=4)(self._frame)

    def _frame(self, k: int) -> np.ndarray:
        part = self.data[self.at + int(self.offsets[k]) : self.at + int(self.offsets[k + 1])]
        whole = min(FRAME, self.size - k * FRAME)
        return np.frombuffer(part if len(part) == whole else zstandard.ZstdDecompressor().decompress(part), np.uint8)

    def bit(self, i: int) -> int:
        return int(self.frame(i // 8 // FRAME)[i // 8 % FRAME]) >> i % 8 & 1

    def rank(self, i: int) -> int:
        """Set bits before place i."""
        k = i // 8 // FRAME
        if k >= len(self.before) - 1:
            return self.ones
        bits, at = self.frame(k), i // 8 % FRAME
        return int(self.before[k]) + int(np.bitwise_count(bits[:at]).sum()) + ((int(bits[at]) & ((1 << i % 8) - 1)).bit_count() if i % 8 else 0)

    def select(self, bit: int, j: int) -> int:
        """The place of the j-th (from 0) bit of that value."""
        before = self.before if bit else np.minimum(np.arange(len(self.before)) * FRAME * 8, self.n) - self.before
        k = int(np.searchsorted(before, j, "right")) - 1
        start = k * FRAME * 8
        chunk = np.unpackbits(self.frame(k), bitorder="little", count=min(FRAME * 8, self.n - start))
        return start + int(np.flatnonzero(chunk == bit)[j - int(before[k])])

    def all(self) -> np.ndarray:
        whole = np.concatenate([np.zeros(0, np.uint8), *map(self._frame, range(len(self.offsets) - 1))])
        return np.unpackbits(whole, bitorder="little", count=self.n).view(bool)


class WaveletMatrix:
    """Questions to one shard file. Places count from 0; ranges are half open."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        magic, self.width, self.n, self.documents, listed = _HEAD.unpack_from(view)
        if magic != _MAGIC:
            raise ValueError("not a shard file")
        self._names = view[_HEAD.size : _HEAD.size + listed]
        at, planes = _HEAD.size + listed, []
        for _ in range(self.width + 1):
            planes.append(Plane(view, at, self.n))
            at = planes[-1].end
        self.marks, *self.planes = planes
        self.zeros = [self.n - p.ones for p in self.planes]

    def names(self) -> list:
        """The doc_ids, in the order of the documents."""
        raw, flags = zstandard.ZstdDecompressor().decompress(self._names), -(-self.documents // 8)
        known = np.unpackbits(np.frombuffer(raw, np.uint8, flags), bitorder="little", count=self.documents).astype(bool)
        ids = np.frombuffer(raw, "<i8", self.documents, flags)
        return ids.tolist() if known.all() else [i if k else None for i, k in zip(ids.tolist(), known.tolist(), strict=True)]

    def access(self, i: int) -> int:
        """The id at a place."""
        value = 0
        for plane, zeros in zip(self.planes, self.zeros, strict=True):
            one, ones = plane.bit(i), plane.rank(i)
            value = value << 1 | one
            i = zeros + ones if one else i - ones
        return value

    def _descend(self, value: int, i: int, j: int) -> tuple[int, int]:
        for k, (plane, zeros) in enumerate(zip(self.planes, self.zeros, strict=True)):
            a, b = plane.rank(i), plane.rank(j)
            i, j = (zeros + a, zeros + b) if value >> self.width - 1 - k & 1 else (i - a, j - b)
        return i, j

    def count(self, value: int, start: int = 0, end: int | None = None) -> int:
        """How often an id occurs in a range."""
        if value < 0 or value >> self.width:
            return 0
        i, j = self._descend(value, start, self.n if end is None else end)
        return j - i

    def select(self, value: int, j: int) -> int:
        """The place of an id's j-th occurrence (from 0)."""
        if not 0 <= j < self.count(value):
            raise IndexError(j)
        at = self._descend(value, 0, 0)[0] + j
        for k in range(self.width - 1, -1, -1):
            one = value >> self.width - 1 - k & 1
            at = self.planes[k].select(one, at - self.zeros[k] if one else at)
        return at

    def occurrences(self, value: int) -> list[int]:
        """All places of an id, ascending."""
        return [self.select(value, j) for j in range(self.count(value))]

    def document_at(self, i: int) -> int:
        """The number of the document that a place belongs to."""
        return self.marks.rank(i)

    def extent(self, k: int) -> tuple[int, int]:
        """Where the k-th document's ids begin and end."""
        return (self.marks.select(1, k - 1) + 1 if k else 0), self.marks.select(1, k) + 1

    def document(self, k: int) -> list[int]:
        """The ids of the k-th document, its end id with them."""
        return [self.access(i) for i in range(*self.extent(k))]

    def ends(self) -> np.ndarray:
        """For each document the place after its last id."""
        return np.flatnonzero(self.marks.all()) + 1

    def all(self) -> np.ndarray:
        """The whole sequence, restored plane by plane from the last."""
        cur = np.zeros(self.n, np.uint16 if self.width <= 16 else np.uint32)
        for k in range(self.width - 1, -1, -1):
            one = self.planes[k].all()
            before = np.empty_like(cur)
            before[np.flatnonzero(~one)] = cur[: self.zeros[k]]
            before[np.flatnonzero(one)] = cur[self.zeros[k] :] | cur.dtype.type(1 << self.width - 1 - k)
            cur = before
        return cur


SHARDS = "part int, shard int, part_start long, n_ids long, file binary"


def _ended(ids: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of documents that begin `at`, each with the end id after it, and the documents' lengths so."""
    n = len(at) - 1
    out = np.empty(len(ids) + n, np.uint32)
    last = at[1:] + np.arange(n)
    kept = np.ones(len(out), bool)
    kept[last] = False
    out[kept], out[last] = ids, end_id
    return out, np.diff(at) + 1


def write_shards(docs: DataFrame, path: str, word_ends: bool = True, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """The shard table, written to the shared folder: `file` holds the shard file, `part` and `shard` order
    the shards, part_start counts the ids before it in its part."""

    def made(batches):
        known, part = encoder(path, word_ends), TaskContext.get().partitionId()
        names, parts, sizes, size, shard, start = [], [], [], 0, 0, 0

        def close():
            nonlocal names, parts, sizes, size, shard, start
            file = build(np.concatenate(parts), names, np.cumsum(np.concatenate(sizes)) - 1)
            columns = [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([start], pa.int64()), pa.array([size], pa.int64()), pa.array([file], pa.binary())]
            names, parts, sizes, start, shard, size = [], [], [], start + size, shard + 1, 0
            return pa.RecordBatch.from_arrays(columns, names=["part", "shard", "part_start", "n_ids", "file"])

        for b in batches:
            for first, rows in slices(b.column(1)):
                ids, lengths = _ended(*known.encode_all(b.column(1).slice(first, rows)), end_id)
                of, upto, at = b.column(0).slice(first, rows).to_pylist(), np.concatenate([[0], np.cumsum(lengths)]), 0
                while at < rows:
                    fit = int(np.searchsorted(upto, upto[at] + shard_ids - size, "right")) - 1
                    if fit <= at and size:
                        yield close()
                        continue
                    fit = max(fit, at + 1)
                    names += of[at:fit]
                    parts.append(ids[upto[at] : upto[fit]])
                    sizes.append(lengths[at:fit])
                    size += int(upto[fit] - upto[at])
                    at = fit
        if size:
            yield close()

    # The last key deals equal rows, however many, over parts; it comes after all that decides a row's place.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    order = ("doc_id", F.xxhash64("text"), "row")
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return materialise(placed.mapInArrow(trimmed(made), SHARDS), "wavelet")


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of each document, from the files."""
    # One row for each part: the running sum and the broadcast are bounded by the number of partitions.
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    upto = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", before)

    def read(batches):
        for b in batches:
            for at, file in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = WaveletMatrix(file.as_buffer().to_pybytes())
                raw, ends = memoryview(found.all().astype("<u4").tobytes()), found.ends()
                starts = np.concatenate([[0], ends[:-1]])
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.names(), pa.int64()), pa.array(starts + at), pa.array(ends - starts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    placed = shards.join(F.broadcast(upto), "part").select((F.col("before") + F.col("part_start")).alias("at"), "file")
    return placed.mapInArrow(trimmed(read), "doc_id long, start long, n_tokens long, ids_crc32 long")
