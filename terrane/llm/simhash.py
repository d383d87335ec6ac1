"""Near-duplicate groups by SimHash fingerprints linked through sharded BK-trees.

A document's 64-bit fingerprint is the majority vote, bit by bit, over the hashes of its word
shingles. Fingerprints that differ in at most ``radius`` bits are linked. The search is exact: cut the
64 bits into ``radius + extra`` blocks; two linked fingerprints agree on at least ``extra`` of them, so they
meet in a shard named by the places and values of those blocks. ``extra`` grows with the number of fingerprints so that a shard
keeps a few members on average. A shard that holds more than ``HOT`` is split in the same way: members that are linked agree on one of
``radius + 1`` blocks of the bits not yet in its name, so these deal it into smaller shards, up to ``LEVELS`` times.

Every shard holds a BK-tree, whose children are keyed by their integer Hamming distance to the parent; a search follows only
edges whose distance lies within the radius of the query's. Trees are not broadcast: a broadcast tree of everything grows with the
data, and a tree of one shard is wanted only where the shard's members are.

What is dealt out are distinct fingerprints: a group of exact copies is one row before any shard is formed. A shard reports a
spanning forest, at most one edge a member, not its pairs.

Defined cases: a null text is an empty text; a text without words has fingerprint zero; shorter texts than a
shingle are one shingle; a very long text is hashed shingle by shingle and voted in parts; rows repeated, and equal fingerprints, share
a component; a null doc_id links like any other, but is never a component's smallest: a component of null ids alone is null;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches
from .components import components
from .wordarrays import mix

#: The seed of the shingles' XXH64.
SEED = 42
#: Values up to which a part of a tree is a leaf, which is scanned, and members up to which a shard is one leaf.
LEAF, FEW = 32, 24
#: Members of a shard that is split, and how often a shard is split at most.
HOT, LEVELS = 4096, 3
#: Names of hot shards up to which they are broadcast.
SOME = 1_000_000


def shingle_hashes(text: str | None, words: int = 3) -> list[int]:
    from xxhash import xxh64_intdigest

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only ASCII letters and white space count
    if not tokens:
        return []
    if len(tokens) <= words:
        return [xxh64_intdigest(b" ".join(tokens), SEED)]
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    line, starts = b" ".join(tokens), ends - np.fromiter(map(len, tokens), np.int64, len(tokens))
    return [xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[: len(tokens) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]


def fingerprint(hashes: list[int] | np.ndarray) -> int:
    """The unsigned fingerprint: a bit is 1 if it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = np.array(hashes[i : i + 65536], "<u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, text: str = "text", doc_id: str = "doc_id", key: Column | None = None) -> DataFrame:
    """(doc_id, key, fp), fp the fingerprint as a signed long, key a long to carry along (0 unless given)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.lit(0).cast("long") if key is None else key).alias("key"), F.col(text).cast("string").alias("text"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            fps = np.array([fingerprint(shingle_hashes(t.as_py(), words)) for t in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fps, pa.int64())], names=["doc_id", "key", "fp"])

    return rows.mapInArrow(batches, "doc_id long, key long, fp long")


class BKTree:
    """Distinct values by Hamming distance: a node has a value and its children by their distance to it; small parts are leaves."""

    def __init__(self, values: np.ndarray, leaf: int = LEAF) -> None:
        self.values, self.compared = values, 0
        self.root: list = [None]
        todo = [(np.arange(len(values)), self.root, 0)]
        while todo:
            places, parent, key = todo.pop()
            if len(places) <= leaf:
                parent[key] = places
                continue
            pivot, rest = int(places[0]), places[1:]
            apart = np.bitwise_count(values[rest] ^ values[pivot])
            children: dict[int, object] = {}
            parent[key] = (pivot, children)
            todo += [(rest[apart == d], children, int(d)) for d in np.unique(apart)]

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """All (place of a query, place of a value) that are at most ``radius`` apart."""
        found_q, found_v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        todo = [(self.root[0], np.arange(len(queries)))]
        while todo:
            part, q = todo.pop()
            if isinstance(part, tuple):
                pivot, children = part
                apart = np.bitwise_count(queries[q] ^ self.values[pivot]).astype(np.int64)
                self.compared += len(q)
                near = q[apart <= radius]
                found_q.append(near)
                found_v.append(np.full(len(near), pivot))
                for edge, child in children.items():
                    on = q[(apart >= edge - radius) & (apart <= edge + radius)]
                    if len(on):
                        todo.append((child, on))
            else:
                self.compared += len(q) * len(part)
                a, b = np.nonzero(np.bitwise_count(queries[q][:, None] ^ self.values[part][None, :]) <= radius)
                found_q.append(q[a])
                found_v.append(part[b])
        return np.concatenate(found_q), np.concatenate(found_v)


def forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges between places of ``values``, distinct, that connect what the radius links: one less than members a component."""
    n, edges = len(values), []
    root = list(range(n))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(a: int, b: int) -> None:
        x, y = top(a), top(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            edges.append((a, b))

    if n <= FEW:
        own = values.tolist()
        for i in range(1, n):
            for j in range(i):
                if (own[i] ^ own[j]).bit_count() <= radius:
                    join(i, j)
        return edges
    tree, label, at, step = BKTree(values), np.arange(n), 0, 1
    while at < n:  # a few queries first: in a dense shard they join most of it
        q, v = tree.within(values[at : at + step], radius)
        q += at
        apart = np.flatnonzero(label[q] != label[v])
        if len(apart):
            _, first = np.unique(label[q[apart]] * n + label[v[apart]], return_index=True)
            for k in apart[first].tolist():
                join(int(q[k]), int(v[k]))
            label = np.fromiter(map(top, range(n)), np.int64, n) if len(first) > 8 or at + step >= n else _relabelled(label, top)
        at, step = at + step, min(2 * step, 256)
    return edges


def _relabelled(label: np.ndarray, top) -> np.ndarray:
    kinds, inverse = np.unique(label, return_inverse=True)
    return np.array([top(k) for k in kinds.tolist()], np.int64)[inverse]


def blocks(count: int) -> list[tuple[int, int]]:
    """(shift, width) of ``count`` blocks that cover 64 bits."""
    bounds = [round(64 * i / count) for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(bounds, bounds[1:], strict=False)]


def extra_blocks(distinct: int, radius: int, fill: int = 32) -> int:
    """How many blocks a shard's name takes, so that ``distinct`` random fingerprints leave up to ``fill`` in a shard."""
    extra = 1
    while extra < 64 - radius and distinct > fill * 2 ** (64 * extra // (radius + extra)) and extra < 4:
        extra += 1
    return extra


def masks(count: int, radius: int, levels: int = LEVELS) -> list[list[list[tuple[int, int]]]]:
    """By level and path, the (mask, next path) of the shards that a member goes to: at the first level by blocks of all
    bits, then by blocks of the bits that the path has not used. A path is the number of a set of used bits."""
    bits = [[b for b in range(a, a + w)] for a, w in blocks(radius + count)]
    used = [set().union(*chosen) for chosen in combinations(bits, count)]
    mask = lambda some: sum(1 << b for b in some)
    out = [[[(mask(u), i) for i, u in enumerate(used)]]]
    for _ in range(levels):
        level, below = [], []
        for u in used:
            free = sorted(set(range(64)) - u)
            parts = [free[len(free) * k // (radius + 1) : len(free) * (k + 1) // (radius + 1)] for k in range(radius + 1)]
            level.append([(mask(p), len(below) + k) for k, p in enumerate(parts)])
            below += [u | set(p) for p in parts]
        out.append(level)
        used = below
    return out


def dealt(rows: DataFrame, places: list[list[tuple[int, int]]]) -> DataFrame:
    """Rows (shard, path, fp) to those of the shards below theirs."""
    table = np.array([[m for m, _ in p] for p in places], np.uint64)
    paths = np.array([[n for _, n in p] for p in places], np.int32)
    spice = np.arange(1, table.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            shard, path, fp = (c.to_numpy() for c in batch.columns)
            value = fp.view(np.uint64)[:, None] & table[path]
            name = mix(mix(value + spice[None, :]) ^ (shard.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93))[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(name.reshape(-1).view(np.int64)), pa.array(paths[path].reshape(-1)), pa.array(np.repeat(fp, table.shape[1]))], names=["shard", "path", "fp"])

    return rows.mapInArrow(deal, "shard long, path int, fp long")


def links(nodes: DataFrame, radius: int = 3, distinct: int | None = None, hot: int = HOT) -> DataFrame:
    """Nodes (fp), distinct, to edges (a, b) of fingerprints that connect what the radius links."""
    small_batches(nodes.sparkSession, 20_000)
    levels = masks(extra_blocks(nodes.count() if distinct is None else distinct, radius), radius)
    rows = dealt(nodes.select(F.lit(0).cast("long").alias("shard"), F.lit(0).alias("path"), "fp"), levels[0])
    whole: list[DataFrame] = []
    for places in levels[1:]:
        large = cut(rows.groupBy(F.col("shard").alias("of")).count().where(F.col("count") > hot).select("of"))
        n = large.count()
        if not n:
            break
        large = F.broadcast(large) if n <= SOME else large
        whole.append(rows.join(large, F.col("shard") == F.col("of"), "left_anti"))
        rows = cut(dealt(rows.join(large, F.col("shard") == F.col("of"), "left_semi"), places))
    for part in whole:
        rows = rows.unionByName(part)

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        held: list[np.ndarray] = []  # of a shard that may go on in the next batch
        last = None

        def take(parts: list[np.ndarray]) -> None:
            own = np.unique(np.concatenate(parts))
            for x, y in forest(own.view(np.uint64), radius):
                a.append(own[x])
                b.append(own[y])

        for batch in it:
            shard, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(shard):
                continue
            starts = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)]]).tolist()
            for x, y in zip(starts[:-1], starts[1:], strict=True):
                if held and shard[x] != last:
                    if len(held) > 1 or len(held[0]) > 1:
                        take(held)
                    held = []
                if y == len(shard) or held:
                    held.append(fp[x:y])
                    last = shard[x]
                elif y - x > 1:
                    take([fp[x:y]])
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        if held and (len(held) > 1 or len(held[0]) > 1):
            take(held)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.select("shard", "fp").repartition("shard").sortWithinPartitions("shard", "fp").mapInArrow(search, "a long, b long")


def fingerprint_components(prints: DataFrame, radius: int) -> DataFrame:
    """Rows (doc_id, fp) to (of, component_id): each fingerprint with the smallest doc_id of its component."""
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = components(links(nodes.select("fp"), radius))
    joined = nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    joined = cut(joined)
    least = joined.groupBy(F.col("component").alias("c")).agg(F.min("rep").alias("component_id"))
    return joined.join(least, F.col("component") == F.col("c")).select(F.col("fp").alias("of"), "component_id")


def near_groups(docs: DataFrame, words: int = 3, radius: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    prints = cut(fingerprints(docs, words, text, doc_id))
    found = fingerprint_components(prints, radius)
    return prints.join(found, F.col("fp") == F.col("of")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def survivors(docs: DataFrame, words: int = 3, radius: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, with all their columns, but those whose component has a smaller doc_id; a null doc_id stays.

    Rows are told apart by doc_id and text."""
    key = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    prints = cut(fingerprints(docs, words, text, doc_id, key))
    found = fingerprint_components(prints, radius)
    gone = prints.join(found, F.col("fp") == F.col("of")).where("doc_id <> component_id").select(F.col("doc_id").alias("__gone"), F.col("key").alias("__key")).distinct()
    return docs.join(gone, (docs[doc_id] == gone["__gone"]) & (key == gone["__key"]), "left_anti")
