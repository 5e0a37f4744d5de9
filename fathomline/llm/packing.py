"""Best-fit packing of tokenised documents into sequences of fixed length.

Each document's ids, with an end id, are cut only where they exceed a sequence: full-length pieces at its
end, what is left over first. Full pieces are sequences by themselves. The others are packed by
hierarchical residual packing: they are dealt at random into groups of bounded size, each group is packed
best-fit decreasing, bins that are nearly full are emitted, and the underfull bins travel on as items,
fewer groups a round, until one group is left or a round no longer merges any. Groups hold lengths only,
at most GROUP items of them, so a task's memory is bounded at every size of the corpus.

Null text counts as empty: one piece of the end id. Repeated rows are packed as documents of their own, a
null doc_id stays null. A very long text is cut into many pieces like any other. Without documents there are
no pieces. Extra columns are ignored. Items of equal length are taken in the order of their numbers.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialise, slices, trimmed
from .tokens import encoder

#: Tokens of a sequence, the id that ends a document, items dealt to one group, groups joined in a round.
CAPACITY, END_ID, GROUP, FAN_IN = 2048, 0, 8_000, 16
#: A bin with at most this many free tokens is emitted before the last round.
NEARLY = 2

#: Bytes of texts that a worker encodes together, and chunks of each generation that it remembers: what it holds
#: beside its vocabulary is some 70 MB.
TOGETHER, REMEMBERED = 1 << 19, 50_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    first = n % capacity
    return [(0, first)] * bool(first) + [(s, capacity) for s in range(first, n, capacity)]


def tokenised_pieces(docs: DataFrame, path: str, word_ends: bool = False, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece. Text is read once, where it lies; only lengths and checksums go on."""
    end = np.array([end_id], "<u4").tobytes()

    def made(batches):
        known = encoder(path, word_ends, REMEMBERED)
        for b in batches:
            for first, rows in slices(b.column(1), TOGETHER):
                ids, at = known.encode_all(b.column(1).slice(first, rows))
                raw, at = memoryview(ids.tobytes()), (4 * at).tolist()
                out = []
                for doc_id, s, e in zip(b.column(0).slice(first, rows).to_pylist(), at, at[1:], strict=False):
                    data = bytes(raw[s:e]) + end
                    for k, (start, n) in enumerate(cut(len(data) // 4, capacity)):
                        out.append((doc_id, k, start, n, zlib.crc32(data[4 * start : 4 * (start + n)])))
                yield _batch(pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"]))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(made), PIECES)


def _batch(frame: pd.DataFrame) -> pa.RecordBatch:
    types = {"piece": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(frame[c], types.get(c, pa.int64()), from_pandas=True) for c in frame], names=list(frame))


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best-fit decreasing: each item's bin and offset, and the fill of each bin. The open bins are kept by
    free space; a bit set of the spaces that occur gives the tightest that fits in a few machine words."""
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    fills: list[int] = []
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    present = 0
    order = np.argsort(-sizes, kind="stable")
    for i, s in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fitting = present >> s
        if fitting:
            space = s + (fitting & -fitting).bit_length() - 1
            k = by_space[space].pop()
            if not by_space[space]:
                present ^= 1 << space
        else:
            k, space = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = k, fills[k]
        fills[k] += s
        if left := space - s:
            by_space[left].append(k)
            present |= 1 << left
    return bins, offsets, fills


def pack(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP, fan_in: int = FAN_IN, nearly: int = NEARLY) -> DataFrame:
    """items(item long, unique; length long, 1 to capacity) with sequence_id and offset."""

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        forget()
        frame = frame.sort_values("item")
        bins, offsets, fills = best_fit(frame["length"].to_numpy(), capacity)
        first = frame["item"].to_numpy()[np.unique(bins, return_index=True)[1]]  # a bin is named for one of its items
        return pd.DataFrame({"item": frame["item"], "bin": first[bins], "at": offsets, "fill": np.asarray(fills, np.int64)[bins]})

    schema = "item long, bin long, at long, fill long"
    count = items.count()
    groups = max(1, -(-count // group))
    where = lambda n: F.pmod(F.xxhash64(F.col("item"), F.lit(n)), F.lit(n))
    deal = lambda df, n: df.select("item", "length", where(n).alias("g")).groupBy("g").applyInPandas(packed, schema)
    placed = materialise(deal(items, groups), "packed")
    open_bins, rounds = placed.where((F.col("fill") < capacity - nearly) & (F.col("item") == F.col("bin"))), []
    while groups > 1:
        open_bins = open_bins.select("item", F.col("fill").alias("length"))
        before, groups = open_bins.count(), -(-groups // fan_in)
        if not before:
            break
        groups = max(groups, -(-before // group))
        merged = materialise(deal(open_bins, groups), "packed")
        rounds.append(merged.select(F.col("item").alias("old"), F.col("bin").alias("new"), F.col("at").alias("shift")))
        # A bin is named for one of its items, so what travels on are the rows that kept their name.
        heads = merged.where("item = bin")
        if groups > 1 and heads.count() >= before:
            break
        open_bins = heads.where(F.col("fill") < capacity - nearly)
    if not rounds:
        return placed.select("item", F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    # Where each bin ends up: the rounds are joined from the last back, over ever more bins but never over items.
    moved = rounds[-1]
    for earlier in reversed(rounds[:-1]):
        later = moved.select(F.col("old").alias("new"), F.col("new").alias("_new"), F.col("shift").alias("_shift"))
        moved = earlier.join(later, "new", "left").select("old", F.coalesce("_new", "new").alias("new"), (F.col("shift") + F.coalesce("_shift", F.lit(0))).alias("shift"))
    placed = placed.join(moved, placed["bin"] == moved["old"], "left")
    return placed.select("item", F.coalesce("new", "bin").alias("sequence_id"), (F.col("at") + F.coalesce("shift", F.lit(0))).alias("offset"))


def pack_documents(docs: DataFrame, path: str, word_ends: bool = False, end_id: int = END_ID, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = tokenised_pieces(docs, path, word_ends, end_id, capacity)
    pieces = materialise(pieces.withColumn("item", F.monotonically_increasing_id()), "pieces")
    whole = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": F.col("item"), "offset": F.lit(0).cast("long")})
    rest = pieces.where(F.col("length") < capacity)
    placed = pack(rest.select("item", "length"), capacity, group)
    return whole.unionByName(rest.join(placed, "item")).drop("item")
