"""Near-duplicate documents by MinHash, with odd sketches between the bands and the full sets.

A document's set holds its distinct shingles of three words, words being runs of anything but ASCII white
space, in lower case for A-Z; fewer words make one shingle, no words an empty set, linked with nothing.
Documents are linked where 100 * |intersection| >= 85 * |union|.

Equal sets are one node, so copies cost nothing further; a node is named by the smallest doc_id that has it
and a fingerprint, so the least name of a component gives its smallest doc_id. Nodes meet in MinHash bands.
Within a band's bucket their odd sketches are compared: MinHash samples folded into a parity bitmap, whose
exclusive or counts the samples that differ. What passes is confirmed on the full sets, which are recomputed
for the nodes in question alone. A bucket proposes stars, not all pairs, and is dealt into tiles of bounded
size, other tiles in each band. A second round covers every pair between the components that are left in a
bucket: all its nodes, by tiles, meet those outside of its largest component. Few pairs are confirmed one by
one, and a bucket with many of them is compared block against block on the full sets, which gives links that
connect it and never a row a pair. So a link is missed only if no band brings its documents together (under
one in a million at the threshold) or its sketches differ by more than five standard deviations. Bands and
that bound follow from the threshold.

Rows of one doc_id may differ in text: they are nodes of their own, but where one of them is the document
that stays of its group, drop_near_duplicates() keeps that row alone. Repeated rows get repeated results. Null
text has no words; a null doc_id has no smaller one and names no group that has another. A very long text is
hashed stretch by stretch. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, forget, join_spread, materialise, release, stretches, trimmed

#: Words of a shingle, threshold in percent, least bands and most MinHash samples of each, bits of the odd sketch.
WORDS, PERCENT, BANDS, BAND, BITS = 3, 85, 25, 5, 512
#: Chance of a link at the threshold that no band may bring together, bands from which shorter ones are taken,
#: standard deviations over the mean of pairs at the threshold up to which sketches let a pair pass.
MISS, MOST_BANDS, DEVIATIONS = 1e-6, 64, 5.7
#: Pairs between components, for each node of a tile, beyond which its bucket is compared by blocks; nodes of a
#: tile and sets of a group of two blocks, and the items of these; items in up to so many of its sets are counted
#: pair by pair.
PAIRS_PER_NODE, BLOCK, ITEMS, RARE = 2, 4096, 4_000_000, 24
#: Bits for each wanted id of the filter that says which documents' sets are wanted, and bits at most (32 MiB):
#: beyond, the filter lets more documents pass, and the join after it still takes what is wanted alone.
FILTER_BITS, FILTER_MOST = 16, 1 << 28
#: Items whose samples are taken together.
_CHUNK = 1 << 12
_WHITE = re.compile(r"[\x20\x09-\x0D]")

_SAMPLES = BANDS * BAND
_ODD = np.random.default_rng(85).integers(1, 1 << 63, _SAMPLES + 8, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _ODD[_SAMPLES:]


@cache
def _multipliers(n: int) -> np.ndarray:
    more = np.random.default_rng(86).integers(1, 1 << 63, max(n - _SAMPLES, 0), np.uint64) * np.uint64(2) + np.uint64(1)
    return np.concatenate([_ODD[:_SAMPLES], more])[:n]


@cache
def plan(percent: int) -> tuple[int, int, int]:
    """Bands, samples of each, and differing bits up to which a pair is confirmed on its sets, for a threshold.
    A pair's bits are those in which an odd number of its differing samples, two each, fall together."""
    share = min(max(percent / 100, 0.01), 1 - 1e-9)
    for band in range(BAND, 0, -1):
        bands = max(BANDS, math.ceil(math.log(MISS) / math.log1p(-(share**band))))
        if bands <= MOST_BANDS:
            break
    balls = 2 * bands * band * (1 - share)
    still = math.exp(-2 * balls / BITS)
    odd = (1 - still) / 2
    spread = 4 * bands * band * share * (1 - share) * still**2 + max(BITS * odd * (1 - odd) - balls * still**2, 0)
    return bands, band, round(BITS * odd + DEVIATIONS * math.sqrt(spread))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int = WORDS) -> np.ndarray:
    """The document's set, as sorted 64-bit hashes."""
    hashed, few = [np.zeros(0, np.uint64)], []
    for _, stretch in stretches(text, space=_WHITE):
        words = stretch.encode("utf-8", "surrogatepass").lower().split()
        hashed.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
        few += words[:width]
    h = np.concatenate(hashed)
    if not len(h):
        return h
    if len(h) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(few), len(h))], np.uint64)
    n = len(h) - width + 1
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += _mixed(h[k : k + n] + _MIX[4]) * _MIX[k % 4] + np.uint64(k)
        total = _mixed(total)
    return np.unique(total)


def signature(s: np.ndarray, percent: int = PERCENT) -> tuple[list[int], bytes]:
    """Band keys and odd sketch of a set that is not empty."""
    bands, band, _ = plan(percent)
    samples = np.full(bands * band, np.iinfo(np.uint64).max)
    for at in range(0, len(s), _CHUNK):
        np.minimum(samples, (s[at : at + _CHUNK, None] * _multipliers(bands * band)).min(0), out=samples)
    grid = _mixed(samples.reshape(bands, band) * _MIX[:band])
    keys = _mixed(grid.sum(1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * _MIX[5])
    places = (_mixed(samples + np.arange(bands * band, dtype=np.uint64) * _MIX[6]) % np.uint64(BITS)).astype(np.int64)
    parity = np.bincount(places, minlength=BITS) & 1
    return keys.astype(np.int64).tolist(), np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def _fingerprint(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def signatures(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash, n_shingles, node (128-bit fingerprint of the set; null for none), bands, sketch."""

    def made(batches):
        forget()
        for b in batches:
            n, nodes, bands, sketches = [], [], [], []
            for text in b.column(2):
                s = shingles(text.as_py(), width)
                keys, sketch = signature(s, percent) if len(s) else (None, None)
                n.append(len(s))
                nodes.append(_fingerprint(s) if len(s) else None)
                bands.append(keys)
                sketches.append(sketch)
            arrays = [pa.array(n, pa.int64()), pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *arrays], names=["doc_id", "text_hash", "n_shingles", "node", "bands", "sketch"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(trimmed(made), "doc_id long, text_hash long, n_shingles long, node binary, bands array<long>, sketch binary")


_PAIR = "a binary, b binary, key long"


def _stars(nodes: np.ndarray, near) -> list[tuple]:
    """Each node with the first leader it is near to, in order; a node near to none leads."""
    pairs, left = [], np.arange(len(nodes))
    while len(left) > 1:
        found = near(left[0], left[1:])
        pairs += [(nodes[left[0]], nodes[i], None) for i in found]
        left = left[1:][~np.isin(left[1:], found)]
    return pairs


def _between(key: int, nodes: np.ndarray, group: np.ndarray, outer: np.ndarray, near) -> list[tuple]:
    """Pairs of an outer node with a node of another component that the sketches let pass; where these
    outgrow the tile, its nodes that have any instead, each once with the key, for comparing by blocks."""
    pairs, asked = [], np.zeros(len(nodes), bool)
    for i in np.flatnonzero(outer).tolist():
        found = near(i, np.flatnonzero(group != group[i]))
        asked[i] |= len(found) > 0
        asked[found] = True
        if len(pairs) <= PAIRS_PER_NODE * len(nodes):
            pairs += [(nodes[i], nodes[j], None) for j in found]
    if len(pairs) > PAIRS_PER_NODE * len(nodes):
        return [(n, None, key) for n in nodes[asked]]
    return pairs


def _propose(tiles: DataFrame, stars: bool, percent: int) -> DataFrame:
    """Pairs (a < b) to confirm, or nodes (a, key) to compare by blocks, from tiles(tile, key, node, n,
    sketch, component, outer), each of which is compared by itself."""
    near_bits = plan(percent)[2]
    order = tiles.select("tile", "key", "node", "n", "sketch", "component", "outer").repartition("tile").sortWithinPartitions("tile", "key", F.xxhash64("node"))

    def scanned(batches):
        kept = None
        for b in batches:
            nodes = np.array(b.column(2).to_pylist(), object)
            part = (
                b.column(0).to_numpy(), b.column(1).to_numpy(), nodes, b.column(3).to_numpy(), np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint64).reshape(len(nodes), -1),
                np.array(b.column(5).to_pylist(), object), b.column(6).to_numpy(zero_copy_only=False),
            )
            kept = part if kept is None else tuple(np.concatenate(x) for x in zip(kept, part, strict=True))
            cut = int(np.argmax((kept[0] == kept[0][-1]) & (kept[1] == kept[1][-1])))
            done, kept = tuple(x[:cut] for x in kept), tuple(x[cut:] for x in kept)
            yield from compared(done)
        if kept is not None:
            yield from compared(kept)

    def compared(rows):
        tiles, keys, nodes, sizes, sketches, group, outer = rows
        edges = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (tiles[1:] != tiles[:-1]), True]) if len(keys) else np.zeros(1, np.int64)
        out = set()
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            n, k = sizes[s:e], sketches[s:e]

            def near(i: int, others: np.ndarray, n=n, k=k) -> np.ndarray:
                bits = np.bitwise_count(k[others] ^ k[i]).sum(1, dtype=np.int64)
                low, high = np.minimum(n[others], n[i]), np.maximum(n[others], n[i])
                return others[(bits <= near_bits) & (100 * low >= percent * high)]

            if e - s > 1:
                found = _stars(nodes[s:e], near) if stars else _between(int(keys[s]), nodes[s:e], np.unique(group[s:e], return_inverse=True)[1], outer[s:e], near)
                out.update((min(p[:2]), max(p[:2]), None) if p[2] is None else p for p in found)
        if out:
            a, b, k = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(k, pa.int64())], names=["a", "b", "key"])

    return order.mapInArrow(trimmed(scanned), _PAIR).distinct()


def _star_tiles(members: DataFrame) -> DataFrame:
    """members(key, m: nodes of the bucket, node, ...) by tiles of about BLOCK nodes, other ones in each band."""
    tile = F.xxhash64("key", F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("m") / BLOCK)))
    return members.withColumns({"tile": tile, "component": F.col("node"), "outer": F.lit(True)})


def _open_tiles(members: DataFrame) -> DataFrame:
    """Of buckets with several components: all nodes by tiles, each meeting the nodes outside of the bucket's
    largest component, which are dealt into groups of bounded size as well."""
    by = members.groupBy("key", "component").agg(F.count("*").alias("c"))
    by = by.groupBy("key").agg(F.max_by("component", F.struct("c", "component")).alias("major"), F.sum("c").alias("m"), (F.sum("c") - F.max("c")).alias("minor")).where("minor > 0")
    open_ = members.drop("m").join(by, "key").withColumn("outer", F.col("component") != F.col("major"))
    side = lambda n: F.ceil(F.col(n) / BLOCK)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), side(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("node", "key"), side(n))
    # An outer node meets, in every tile of its group, the tile's nodes; to other groups it is one of these.
    inner = open_.where("not outer").withColumns({"x": mine("m"), "y": every("minor")})
    outer = open_.where("outer").withColumns({"x": every("m"), "y": mine("minor")})
    other = open_.where("outer").withColumns({"x": mine("m"), "y": every("minor")}).where(F.col("y") != mine("minor")).withColumn("outer", F.lit(False))
    return inner.unionByName(outer).unionByName(other).withColumn("tile", F.xxhash64("key", "x", "y"))


def _linked(sets: list, percent: int) -> np.ndarray:
    """Which of these sets are linked, as a boolean matrix: intersections counted exactly, frequent items by
    a matrix product and rare ones pair by pair."""
    n, sizes = len(sets), np.array([len(x) for x in sets], np.int64)
    rows = np.repeat(np.arange(n), sizes)
    _, columns, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    both = np.zeros((n, n), np.float32)
    rare = df[columns] <= RARE
    r, c = rows[rare], columns[rare]
    for k in range(1, RARE):
        same = np.flatnonzero(c[k:] == c[:-k])
        if not len(same):
            break
        np.add.at(both, (r[same], r[same + k]), 1)
        np.add.at(both, (r[same + k], r[same]), 1)
    frequent = np.flatnonzero(df > RARE)
    place = np.full(len(df), -1)
    place[frequent] = np.arange(len(frequent))
    r, c = rows[~rare], place[columns[~rare]]
    for at in range(0, len(frequent), 2048):
        x = np.zeros((n, min(2048, len(frequent) - at)), np.float32)
        inside = (c >= at) & (c < at + 2048)
        x[r[inside], c[inside] - at] = 1
        both += x @ x.T
    linked = 100 * both.astype(np.int64) >= percent * (sizes[:, None] + sizes[None, :] - both.astype(np.int64))
    np.fill_diagonal(linked, False)
    return linked


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links that span the components of a boolean matrix."""
    left, out = np.ones(len(linked), bool), []
    for i in range(len(linked)):
        if left[i]:
            left[i], todo = False, [i]
            while todo:
                k = todo.pop()
                fresh = np.flatnonzero(linked[k] & left)
                left[fresh] = False
                out += [(k, j) for j in fresh.tolist()]
                todo += fresh.tolist()
    return out


def _compare_blocks(docs: DataFrame, asked: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """Links that connect asked(a, key) within each key, on the full sets. A bucket is dealt into blocks, by
    the number of its nodes and of their items, and every two blocks meet in one group, so a task holds two
    blocks' sets, whatever the bucket's size."""
    asked = materialise(asked.select(F.col("a").alias("node"), "key").distinct().join(nodes.select("node", "n"), "node"), "dedup-blocks")
    wanted = materialise(asked.select("node").distinct(), "dedup-asked")
    sets = materialise(_full_sets(docs, wanted, width), "dedup-sets")
    blocks = F.greatest(F.ceil(F.count("*") / (BLOCK // 2)), F.ceil(F.sum("n") / (ITEMS // 2)))
    counts = asked.groupBy("key").agg(blocks.cast("int").alias("blocks"))
    dealt = asked.join(counts, "key").withColumn("g", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("h", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("node", F.xxhash64("key", F.least("g", "h"), F.greatest("g", "h")).alias("pair"))

    def compared(batches):
        held: list = []
        for b in batches:
            for pair, node, items in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if held and held[0][0] != pair:
                    yield links(held)
                    held = []
                held.append((pair, node, items.values.to_numpy()))
        if held:
            yield links(held)

    def links(held):
        found = _forest(_linked([x[2] for x in held], percent)) if len(held) > 1 else []
        ends = [sorted((held[i][1], held[j][1])) for i, j in found]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in ends], pa.binary()) for k in (0, 1)], names=["a", "b"])

    rows = dealt.join(sets, "node").select("pair", "node", "items")
    out = materialise(rows.repartition("pair").sortWithinPartitions("pair").mapInArrow(trimmed(compared), "a binary, b binary").distinct(), "dedup-links")
    discard(asked, wanted, sets)
    return out


def _wanted(ids: DataFrame) -> bytes:
    """A Bloom filter of a column of ids, made up of words counted on the executors."""
    size = 1 << min(max(20, (FILTER_BITS * ids.count()).bit_length()), FILTER_MOST.bit_length() - 1)

    def words(batches):
        for b in batches:
            places = np.unique(np.concatenate(_places(b.column(0).to_numpy(zero_copy_only=False), size)))
            starts, at = np.unique(places >> 5, return_index=True)
            bits = np.bitwise_or.reduceat(np.int64(1) << (places & 31), at) if len(places) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(starts), pa.array(bits)], names=["word", "bits"])

    rows = ids.mapInArrow(trimmed(words), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size // 32, np.uint32)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().astype(np.uint32)
    del rows
    release()
    return out.tobytes()


def _places(ids: np.ndarray, size: int) -> list[np.ndarray]:
    x = ids.astype(np.int64).view(np.uint64)
    return [(_mixed(x * _MIX[k] + _MIX[7]) % np.uint64(size)).astype(np.int64) for k in range(3)]


def _full_sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """node, items: the full sets of nodes(node). Only documents that the filter lets pass are hashed, and
    only sets that are asked for are kept."""
    nodes = nodes.select("node", F.substring("node", 10, 16).alias("print"), _id_of(F.col("node")).alias("id"))
    wanted = docs.sparkSession.sparkContext.broadcast(_wanted(nodes.select(F.coalesce("id", F.lit(0)).alias("id"))))

    def made(batches):
        bits = np.frombuffer(wanted.value, np.uint32)
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            hit = np.ones(len(ids), bool)
            for p in _places(ids, 32 * len(bits)):
                hit &= (bits[p >> 5] >> (p & 31).astype(np.uint32) & 1).astype(bool)
            sets = [shingles(b.column(1)[i].as_py(), width) for i in np.flatnonzero(hit).tolist()]
            sets = [s for s in sets if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_fingerprint(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["print", "items"]
            )

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(trimmed(made), "print binary, items array<long>").dropDuplicates(["print"]).join(nodes.select("print", "node"), "print").select("node", "items")


def _confirm(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose full sets are as similar as asked."""
    asked = materialise(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "dedup-asked")
    sets = materialise(_full_sets(docs, asked, width), "dedup-sets")
    release()
    one, two = sets.select(F.col("node").alias("a"), F.col("items").alias("s")), sets.select(F.col("node").alias("b"), F.col("items").alias("t"))
    both = F.size(F.array_intersect("s", "t")).cast("long")
    union = F.size("s").cast("long") + F.size("t") - both
    links = materialise(pairs.join(one, "a").join(two, "b").where(100 * both >= percent * union).select("a", "b"), "dedup-links")
    discard(asked, sets)
    return links


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (the least node reachable) of links(a, b), by alternating large-star and small-star
    rounds; each halves the depth of what is left and touches every edge a fixed number of times. A node with
    very many neighbours gathers their least before the shuffle and meets it again by a broadcast."""
    edges = materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "dedup-edges")
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        large = join_spread(both, least, "a", 2 * before[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = join_spread(large, least, "a", 2 * before[0]).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        done, edges = edges, materialise(small.select("e.*").where("a <> b").distinct(), "dedup-edges")
        discard(done)
        after = mark(edges)
        if after == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = after


def _name(id_: Column, print_: Column) -> Column:
    """A node's name: its smallest doc_id so written that names are in the order of ids (none: last), then
    its fingerprint."""
    written = F.unhex(F.lpad(F.hex(id_.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
    return F.concat(F.when(id_.isNull(), F.unhex(F.lit("01" + 16 * "0"))).otherwise(F.concat(F.unhex(F.lit("00")), written)), print_)


def _id_of(name: Column) -> Column:
    """The doc_id of a node's name."""
    digits = F.hex(F.substring(name, 2, 8))
    high, low = (F.conv(F.substring(digits, k, 8), 16, 10).cast("long") for k in (1, 9))
    id_ = F.shiftleft(high, 32).bitwiseOR(low).bitwiseXOR(F.lit(-(1 << 63)))
    return F.when(F.hex(F.substring(name, 1, 1)) == "00", id_)


def find_components(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id of each row; component_id is the smallest doc_id that links reach."""
    signed = materialise(signatures(docs, width, percent).withColumnRenamed("node", "print"), "dedup-signatures")
    # One row a distinct set, combined before the shuffle: a group of copies of any size is one node.
    nodes = signed.where("n_shingles > 0").groupBy("print", F.col("n_shingles").alias("n"), "bands", "sketch").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"))
    nodes = materialise(nodes.withColumn("node", _name(F.col("id"), F.col("print"))).drop("id"), "dedup-nodes")
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    members = materialise(keyed.join(shared, "key").join(nodes.select("node", "n", "sketch"), "node"), "dedup-members")
    stars = materialise(_propose(_star_tiles(members), True, percent), "dedup-pairs").select("a", "b")
    links = _confirm(docs, stars, width, percent)
    components = connected_components(links)
    grouped = members.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    grouped = materialise(grouped, "dedup-grouped")
    found = materialise(_propose(_open_tiles(grouped), False, percent), "dedup-pairs")
    more = _confirm(docs, found.where("key is null").select("a", "b").join(stars, ["a", "b"], "left_anti"), width, percent)
    asked = found.where("key is not null")
    if not asked.isEmpty():
        more = more.unionByName(_compare_blocks(docs, asked, nodes, width, percent))
    if not more.isEmpty():
        components = connected_components(links.unionByName(more))
    discard(members, grouped, stars, found)
    # Only sets that have copies or links can belong to another document; copies of one set may be very many.
    of = nodes.select("node", "print", "copies").join(components, "node", "left").where("copies > 1 or component is not null")
    of = of.select("print", F.col("copies").alias("n"), _id_of(F.coalesce("component", "node")).alias("component_id"))
    of = materialise(of, "dedup-components")
    rows = signed.select("doc_id", "text_hash", "n_shingles", "print")
    placed = join_spread(rows.where("print is not null"), of, "print", max(1, rows.count()), "left")
    placed = placed.unionByName(rows.where("print is null").withColumn("component_id", F.col("doc_id")))
    return placed.select("doc_id", "text_hash", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def digest(docs: DataFrame) -> DataFrame:
    """The columns that op7 is compared by."""
    return find_components(docs).drop("text_hash").withColumn("kept", F.col("doc_id") == F.col("component_id"))


def drop_near_duplicates(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs, with its own columns, one row of each component: that of the smallest doc_id and, where rows
    share it, of the least text hash. Rows without words or without an id all stay."""
    found = materialise(find_components(docs, width, percent).where("n_shingles > 0 and doc_id is not null"), "dedup-found")
    groups = found.where("doc_id = component_id").groupBy("doc_id", "text_hash").agg(F.count("*").alias("copies"))
    first = groups.groupBy("doc_id").agg(F.min("text_hash").alias("first"), F.count("*").alias("texts"))
    other = groups.join(first.where("texts > 1"), "doc_id").where("text_hash <> first")
    gone = found.where("doc_id <> component_id").select("doc_id", "text_hash").distinct().unionByName(other.select("doc_id", "text_hash"))
    key = ["doc_id", "text_hash"]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = rows.withColumns({"doc_id": F.col("row.doc_id").cast("long"), "text_hash": F.xxhash64(F.col("row.text").cast("string"))})
    nameless, rows = rows.where("doc_id is null"), rows.where("doc_id is not null")
    rows = rows.join(gone, key, "left_anti")
    again = groups.where("copies > 1").select(*key)
    if not again.isEmpty():
        rows = rows.join(again, key, "left_anti").unionByName(rows.join(again, key, "left_semi").dropDuplicates(key))
    return rows.unionByName(nameless).select(*(F.col(f"row.`{c}`") for c in docs.columns))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (
    SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY 1, 2) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
    WHERE 100 * k >= 85 * (p.n + q.n - k)
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON edges.a = reach.r),
root AS (SELECT doc_id, min(r) AS r FROM reach GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(root.r, w.doc_id) AS component_id, w.doc_id = coalesce(root.r, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN root USING (doc_id)
"""
