"""Exact top-k search by inner product, with a KD-tree for each shard of the vectors.

A shard is a slice of the table where it lies, so building shuffles nothing. Its tree splits at medians
along the widest side; every node keeps its tight bounding box, which bounds the inner product of a query
with all that is below. A query walks a tree best first: the node of the highest bound next, until no bound
reaches its k-th score. Boxes are nested, so leaves come up in the order of their own bounds, and the walks
of many queries advance side by side, a leaf at a time.

A query's k-th score is known from its own shard before the others are searched. A tile is a group of shards
and a group of queries, both bounded; within it the shards are searched one after another and every query
takes its k-th score along from shard to shard. Tiles are dealt to as many partitions, so the work spreads
over the cluster, and all pairs of a query with a shard are met, which the stated query set makes necessary.

Components are floor(scale * x). Vectors that are null, hold null or non-finite components, or lack an id
take no part; vectors meet those of their own length alone. A query's own rows are those of its id; repeated
rows each count, as candidates and as queries. Ties go to the smaller id. Scores beyond a long are held at
its ends. An empty table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

SCALE, TOP, EVERY = 256, 5, 50
#: Vectors of a shard, of a leaf, queries of a block at most; shards and blocks of a tile at most.
SHARD, LEAF, BLOCK = 4096, 64, 512
TILE_SHARDS, TILE_BLOCKS = 64, 1024
_LEAST = np.iinfo(np.int64).min


class Tree:
    """Vectors in leaf order; for every node its slice, its children (0: a leaf) and its box."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.arange(len(ids))
        self.slices, self.children = [(0, len(ids))], [0]
        todo = [0]
        while todo:
            node = todo.pop()
            a, b = self.slices[node]
            if b - a <= LEAF:
                continue
            part = vectors[order[a:b]]
            middle = (b - a) // 2
            if part.shape[1]:
                axis = int(np.argmax(part.max(0) - part.min(0)))
                order[a:b] = order[a:b][np.argpartition(part[:, axis], middle)]
            self.children[node] = len(self.slices)
            todo += [len(self.slices), len(self.slices) + 1]
            self.slices += [(a, a + middle), (a + middle, b)]
            self.children += [0, 0]
        self.ids, self.vectors = ids[order], _narrow(vectors[order])
        self.low = np.stack([self.vectors[a:b].min(0) for a, b in self.slices])
        self.high = np.stack([self.vectors[a:b].max(0) for a, b in self.slices])
        self.leaves = np.array([i for i, c in enumerate(self.children) if not c])

    def _bounds(self, nodes, q: np.ndarray) -> np.ndarray:
        """What the inner product of each query with anything in each node's box is at most."""
        high, low = self.high[nodes].astype(q.dtype), self.low[nodes].astype(q.dtype)
        return _long(np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T)

    def search(self, best: Best) -> None:
        """Take what this tree has for the queries into their best."""
        kind = _exact(self.vectors, best.queries)
        asked = np.arange(len(best.queries))
        # The root's box first: it alone cuts off most queries whose k-th score is high already.
        asked = asked[self._bounds([0], best.queries.astype(kind))[:, 0] >= best.floors()]
        if not len(asked):
            return
        vectors, q = self.vectors.astype(kind), best.queries[asked].astype(kind)
        bounds = self._bounds(self.leaves, q)
        order = np.argsort(-np.maximum(bounds, _LEAST + 1), axis=1, kind="stable")
        widest = max(b - a for a, b in (self.slices[i] for i in self.leaves))
        for step in range(len(self.leaves)):
            leaf = order[:, step]
            rows = np.flatnonzero(bounds[np.arange(len(leaf)), leaf] >= best.floors()[asked])
            if not len(rows):
                break
            rows = rows[np.argsort(leaf[rows], kind="stable")]
            cuts = np.flatnonzero(np.diff(leaf[rows])) + 1
            scores = np.full((len(rows), widest), _LEAST)
            ids = np.zeros((len(rows), widest), np.int64)
            at = 0
            for part in np.split(rows, cuts):
                a, b = self.slices[self.leaves[leaf[part[0]]]]
                scores[at : at + len(part), : b - a] = _long(q[part] @ vectors[a:b].T)
                ids[at : at + len(part), : b - a] = self.ids[a:b]
                at += len(part)
            best.take(asked[rows], scores, ids)


class Best:
    """The best scores of a block of queries, descending, ties to the smaller id; `floors` at first are what a
    query's k-th score is known to be at least."""

    def __init__(self, names: np.ndarray, queries: np.ndarray, known: np.ndarray, top: int):
        self.names, self.queries, self.known = names, queries, known
        self.scores = np.full((len(names), top), _LEAST)
        self.ids = np.full((len(names), top), np.iinfo(np.int64).max)

    def floors(self) -> np.ndarray:
        return np.maximum(self.known, self.scores[:, -1])

    def take(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores and ids of candidates (the least score: none) of some of the queries."""
        last, tie = self.scores[rows, -1][:, None], self.ids[rows, -1][:, None]
        better = (scores > last) | (scores == last) & (ids < tie)
        better &= (scores >= self.known[rows][:, None]) & (scores > _LEAST) & (ids != self.names[rows][:, None])
        at, which = np.nonzero(better)
        if not len(at):
            return
        # Few candidates are better: they are ranked with what their queries have, all in one sort.
        new, top = np.unique(at), self.scores.shape[1]
        of = np.concatenate([at, np.repeat(new, top)])
        scores = np.concatenate([scores[at, which], self.scores[rows[new]].ravel()])
        ids = np.concatenate([ids[at, which], self.ids[rows[new]].ravel()])
        order = np.lexsort((ids, -np.maximum(scores, _LEAST + 1), of))
        of, starts = of[order], np.searchsorted(of[order], new)
        rank = np.arange(len(of)) - starts[np.searchsorted(new, of)]
        order, kept = order[rank < top], rows[new]
        self.scores[kept], self.ids[kept] = scores[order].reshape(-1, top), ids[order].reshape(-1, top)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query ids, ids and scores of all that was taken and reaches what is known."""
        real = (self.scores > _LEAST) & (self.scores >= self.known[:, None])
        return np.broadcast_to(self.names[:, None], real.shape)[real], self.ids[real], self.scores[real]


def _long(x: np.ndarray) -> np.ndarray:
    """Exact values as longs, held at the ends of their range; the least long itself stands for none."""
    if x.dtype == object:
        return np.clip(x, _LEAST + 1, np.iinfo(np.int64).max).astype(np.int64)
    return x.astype(np.int64)


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same integers in the smallest type that holds them."""
    top = max(int(x.max()), -int(x.min())) if x.size else 0
    return x.astype(np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64)


def _exact(*parts: np.ndarray):
    """A type in which inner products of these are exact."""
    top = [max(int(p.max()), -int(p.min())) if p.size else 0 for p in parts]
    product = top[0] * top[1] * max(1, parts[0].shape[1])
    return np.float64 if product < 1 << 53 else np.int64 if product < 1 << 63 else object


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and whole components of the vectors that take part."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(sound)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("q"))


_UNITS = "dim int, shard long, tree binary, ids array<long>, queries binary, floors array<long>"


def build(vectors: DataFrame, every: int = EVERY, top: int = TOP) -> DataFrame:
    """Rows with a tree, one a shard, and rows with a block of queries and their floors: what their k-th
    score in their own shard is, or the least long if the shard has fewer."""

    def made(batches):
        part, number, held = TaskContext.get().partitionId(), 0, {}

        def close(dim):
            nonlocal number
            ids, rows = held.pop(dim)
            ids, matrix = np.array(ids, np.int64), np.array(rows, np.int64).reshape(len(ids), dim)
            tree, shard = Tree(ids, matrix), part << 33 | number
            number += 1
            yield (dim, shard, pickle.dumps(tree), None, None, None)
            asks = np.flatnonzero(ids % every == 0)
            for at in range(0, len(asks), BLOCK):
                names, q = ids[asks[at : at + BLOCK]], matrix[asks[at : at + BLOCK]]
                best = Best(names, q, np.full(len(q), _LEAST), top)
                tree.search(best)
                yield (dim, shard, None, names.tolist(), pickle.dumps(_narrow(q)), best.scores[:, -1].tolist())

        def batch(rows):
            types = (pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()))
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=["dim", "shard", "tree", "ids", "queries", "floors"])

        for b in batches:
            for i, q in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                q = q.values.to_numpy()
                ids, rows = held.setdefault(len(q), ([], []))
                ids.append(i)
                rows.append(q)
                if len(ids) == SHARD:
                    yield batch(list(close(len(q))))
        for dim in list(held):
            yield batch(list(close(dim)))

    return materialise(vectors.mapInArrow(made, _UNITS), "kdtree")


def search(units: DataFrame, top: int = TOP) -> DataFrame:
    """query_id, vec_id, score: the best of each query among the shards of each tile."""
    ways = max(1, int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # One row for each length of vectors: groups of queries, and groups of shards, more where tiles are few.
    plan = units.groupBy("dim").agg(F.count("tree").alias("trees"), F.count("queries").alias("blocks"))
    plan = plan.withColumn("h", F.ceil(F.col("blocks") / TILE_BLOCKS)).where("h > 0")
    plan = plan.select("dim", "h", F.greatest(F.ceil(F.col("trees") / TILE_SHARDS), F.least(F.col("trees"), F.ceil(F.lit(ways) / F.col("h")))).alias("g"))
    plan = materialise(plan, "kdtree-plan")
    tiles = plan.agg(F.sum(F.col("g") * F.col("h"))).first()[0] or 1
    which = lambda n, *parts: F.pmod(F.xxhash64(*parts), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    asks = units.where("queries is not null").join(plan, "dim").withColumns({"y": which(F.col("h"), "shard", "ids"), "x": every(F.col("g"))})
    trees = units.where("tree is not null").join(plan, "dim").withColumns({"x": which(F.col("g"), "shard"), "y": every(F.col("h"))})
    dealt = asks.unionByName(trees).select(F.xxhash64("dim", "x", "y").alias("tile"), "dim", "x", "y", "shard", "tree", "ids", "queries", "floors")
    order = ("dim", "x", "y", F.col("tree").isNotNull(), "shard")

    def searched(batches):
        tile, held, best = None, [], None

        def out():
            arrays = [pa.array(c, pa.int64()) for c in best.found()]
            return pa.RecordBatch.from_arrays(arrays, names=["query_id", "vec_id", "score"])

        for b in batches:
            keys = list(zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
            for k, key in enumerate(keys):
                if key != tile:
                    if best is not None:
                        yield out()
                    tile, held, best = key, [], None
                if b.column(4)[k].is_valid:  # queries of a tile come before its trees
                    held.append((b.column(4)[k].as_py(), pickle.loads(b.column(5)[k].as_py()), b.column(6)[k].as_py()))
                elif held:
                    if best is None:
                        names, queries, floors = zip(*held, strict=True)
                        best = Best(np.concatenate(names).astype(np.int64), np.concatenate(queries), np.concatenate(floors).astype(np.int64), top)
                    pickle.loads(b.column(3)[k].as_py()).search(best)
        if best is not None:
            yield out()

    pairs = dealt.repartition(int(tiles), "tile").sortWithinPartitions(*order).select("dim", "x", "y", "tree", "ids", "queries", "floors")
    return pairs.mapInArrow(searched, "query_id long, vec_id long, score long")


def nearest(vectors: DataFrame, every: int = EVERY, top: int = TOP, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for every id divisible by `every`, against all rows."""
    found = search(build(integers(vectors, scale), every, top), top)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
    SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), r AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank" FROM p
)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 5
"""
