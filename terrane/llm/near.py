"""Near-duplicate groups of five-word Jaccard similarity 4/5 or more: SimHash links, each confirmed, then what they miss.

Two texts are linked if the sets of their shingles have a Jaccard similarity of 4/5 or more. Fingerprints of such texts differ in up to
11 of 64 bits at sf0.1, a radius that neither blocks of equal bits nor BK-trees can search without looking at most of the data. So
:mod:`~terrane.llm.simhash` gives the first candidates, within its radius, and the sets themselves the rest:

* *SimHash.* Fingerprints of five-word shingles are linked through sharded BK-trees, three bits apart at most.
* *Minimum hashes* link each set to one likely copy a list, which joins large groups in linear time.
* *Prefixes.* In any one order of all shingles, two linked sets share one among their first ``size // 5 + 1``. The order
  puts shingles that a sample shows to be common last, so that boilerplate deals out few documents. Only sets of different components
  are compared.
* *Places.* The first shingle that two linked sets share is so early in both that enough of each follows. A pair is looked at only where
  that holds, and not where both sets have a shingle that they share among the last few before: there it was looked at already. So a pair
  comes up once or a few times, not once for each shingle of its prefixes.
* *Parity bits.* Every shingle flips one of 512 to 2,048 bits, about as many as there are shingles. Two linked sets differ in at most a
  ninth of their summed sizes, hence in no more bits; nearly all other pairs do. They are a fingerprint whose radius loses nothing. Pairs of
  larger sets are looked at again with as many bits as they have shingles, before a text is fetched.
* *Confirmation.* Every link, wherever it comes from, is decided by the shingles of the two texts themselves.

No step drops, caps or samples pairs: the sample fixes an order, and every order gives the same result.

Sets are known by 64-bit digests, shingles by their XXH64 until they are confirmed.

Defined cases: a null text is an empty text; texts without words are equal; shorter texts than a shingle are one shingle; a null doc_id
stays and makes no other go; of rows under one doc_id each is judged by its own text; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, enclosed, small_batches, text_of
from .components import components
from .simhash import SEED, fingerprint, links, shingle_hashes

WORDS = 5
#: Longs of parity bits that all sets have, bytes of them at most in a list, and lists of minimum hashes.
BITS, WIDE, LISTS = 8, 256, 6
#: So many shared shingles before a place are looked at to tell a pair that came up before.
BEFORE = 4
#: Documents in the sample that tells common shingles, and common shingles at most.
SAMPLE, COMMON = 5_000, 100_000
#: Up to so many eight-byte keys are broadcast.
FEW = 2_000_000
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def shingles(text: str | None) -> set[bytes]:
    """The shingles themselves, as :func:`simhash.shingle_hashes` cuts them."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return {b" ".join(tokens[i : i + WORDS]) for i in range(max(1, len(tokens) - WORDS + 1))} if tokens else set()


def similar(a: str | None, b: str | None) -> bool:
    """Whether the Jaccard similarity is 4/5 or more."""
    x, y = shingles(a), shingles(b)
    return 9 * len(x & y) >= 4 * (len(x) + len(y))


def hashes_of(text: str | None) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, WORDS), np.uint64))


def wide_parity(hashes: np.ndarray) -> bytes:
    """Parity bits, a power of two of them, as many as shingles or more. Halves that are XORed give those of half the number."""
    bits = max(64 * BITS, 1 << max(0, len(hashes) - 1).bit_length())
    flips = np.bincount((hashes >> np.uint64(7)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def folded(wide: bytes, most: int = WIDE) -> bytes:
    """Parity bits, ``most`` bytes of them at most."""
    bits = np.frombuffer(wide, np.uint8)
    return wide if len(wide) <= most else np.bitwise_xor.reduce(bits.reshape(-1, most), axis=0).tobytes()


def narrow(wide: pa.Array) -> np.ndarray:
    """Parity bits of any number to a row of ``BITS`` longs each."""
    every = wide.to_pylist()
    lengths, out = np.array([len(w) for w in every]), np.empty((len(every), BITS), np.uint64)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        out[at] = np.bitwise_xor.reduce(np.frombuffer(b"".join([every[i] for i in at]), "<u8").reshape(len(at), -1, BITS), axis=1)
    return out


def near_wide(a: bytes, b: bytes, sizes: int) -> bool:
    """Whether sets of these parity bits can be linked."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return 9 * int(np.bitwise_count(x ^ y).sum(dtype=np.int64)) <= sizes


def prefix(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set, rare ones before common ones; ``common`` is sorted."""
    often = np.zeros(len(hashes), np.int64)
    if len(common) and len(hashes):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        often = np.where(common[at] == hashes, counts[at], 0)
    return hashes[np.lexsort((hashes, often))[: len(hashes) // 5 + 1]]


def common_shingles(docs: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """The commonest shingles of a sample, sorted, and how many of its documents have them."""
    step = max(1, docs.count() // SAMPLE)
    sample = docs.select(text_of(text).cast("string").alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(step)) == 0)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(hashes_of(t.as_py()).view(np.int64))], names=["h"])

    found = sample.mapInArrow(batches, "h long").groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(COMMON).toArrow()
    h, n = found.column("h").to_numpy().view(np.uint64), found.column("count").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def described(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(doc_id, sha, node, fp, size, wide, bits, least, first) by row: the text's digest, the set's digest, fingerprint, size, parity bits, minimum hashes and prefix."""
    small_batches(docs.sparkSession)
    common, counts = common_shingles(docs, text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), digest(text).alias("sha"), text_of(text).cast("string").alias("text"))

    def lists(arrays: list[np.ndarray]) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.zeros(0, np.uint64)]).view(np.int64)))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in it:
            every = [np.array(shingle_hashes(t.as_py(), WORDS), np.uint64) for t in batch.column(2)]
            fps = np.array([fingerprint(h) for h in every], np.uint64).view(np.int64)
            sets = [np.unique(h) for h in every]
            node = np.array([xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            least = [np.array([(s * m).min() for m in ODD], np.uint64) if len(s) else np.zeros(0, np.uint64) for s in sets]
            columns = [batch.column(0), batch.column(1), pa.array(node), pa.array(fps), pa.array([len(s) for s in sets], pa.int64()), pa.array([wide_parity(s) for s in sets], pa.binary())]
            columns += [pa.array([folded(wide_parity(s)) for s in sets], pa.binary()), lists(least), lists([prefix(s, common, counts) if len(s) else s for s in sets])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "sha", "node", "fp", "size", "wide", "bits", "least", "first"])

    return rows.mapInArrow(batches, "doc_id long, sha binary, node long, fp long, size long, wide binary, bits binary, least array<long>, first array<long>")


def digest(text: str | Column) -> Column:
    return F.unhex(F.sha2(text_of(text).cast("string").cast("binary"), 256))


def near_bits(size: np.ndarray, bits: np.ndarray, of_size: int, of_bits: np.ndarray) -> np.ndarray:
    """Which sets can be linked to the one given, by their sizes and parity bits."""
    apart = np.bitwise_count(bits ^ of_bits).sum(axis=1, dtype=np.int64)
    return (9 * apart <= size + of_size) & (5 * np.minimum(size, of_size) >= 4 * np.maximum(size, of_size))


def enough_follows(size: np.ndarray, pos: np.ndarray, of_size: np.ndarray, of_pos: np.ndarray) -> np.ndarray:
    """Whether sets can be linked whose first common shingle is at these places, by what follows."""
    return 9 * np.minimum(size - pos, of_size - of_pos) >= 4 * (size + of_size)


def found_pairs(rows: DataFrame, every: bool) -> DataFrame:
    """Lists (key, node, component, size, bits) to pairs (a, b) that the bits don't rule out: of each list, all pairs of different
    components, or each set with the one before it in an order that changes from list to list. For all pairs the lists also have each
    set's place and the shared keys before it (pos, b1, b2, ...)."""

    def columns_of(batch: pa.RecordBatch) -> list[np.ndarray]:
        wide = np.empty(batch.num_rows, object)
        wide[:] = batch.column(4).to_pylist()
        columns = [*(batch.column(i).to_numpy() for i in (0, 1, 2, 3)), narrow(batch.column(4)), wide]
        if every:
            columns += [batch.column(5).to_numpy(), np.stack([batch.column(6 + i).to_numpy() for i in range(BEFORE)], axis=1)]
        return columns

    def groups(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        """The rows of each list; those of a list that spans batches are put together."""
        held: list[list[np.ndarray]] = []
        for batch in it:
            n = batch.num_rows
            if not n:
                continue
            columns = columns_of(batch)
            key = columns[0]
            starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [n]])
            if held and held[0][0][0] != key[0]:
                yield tuple(map(np.concatenate, zip(*held, strict=True)))
                held = []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if b == n:
                    held.append([c[a:b] for c in columns])
                elif held:
                    held.append([c[a:b] for c in columns])
                    yield tuple(map(np.concatenate, zip(*held, strict=True)))
                    held = []
                elif b - a > 1:
                    yield tuple(c[a:b] for c in columns)
        if held:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, n = [], [], 0
        for key, node, component, size, bits, wide, *places in groups(it):
            if len(node) < 2 or every and (component == component[0]).all():
                continue
            if every:
                order = np.unique(node, return_index=True)[1]  # a set that several rows have
                order = order[np.argsort(size[order], kind="stable")]
                node, component, size, bits, wide, pos, before = (c[order] for c in (node, component, size, bits, wide, *places))
                lowest = np.searchsorted(size, -(-4 * size // 5))  # only these are long enough
                for i in range(1, len(node)):
                    part = slice(int(lowest[i]), i)
                    found = np.flatnonzero(component[part] != component[i]) + part.start
                    if not len(found):
                        continue
                    found = found[near_bits(size[found], bits[found], size[i], bits[i])]
                    if not len(found):
                        continue
                    found = found[enough_follows(size[found], pos[found], size[i], pos[i])]
                    earlier = before[i][before[i] != key[0]]
                    found = found[~np.isin(before[found], earlier).any(axis=1)]
                    found = found[np.array([near_wide(wide[j], wide[i], int(size[j] + size[i])) for j in found], bool)]
                    a.append(np.full(len(found), node[i]))
                    b.append(node[found])
                    n += len(found)
            else:
                apart = np.bitwise_count(bits[1:] ^ bits[:-1]).sum(axis=1, dtype=np.int64)
                low, high = np.minimum(size[1:], size[:-1]), np.maximum(size[1:], size[:-1])
                found = np.flatnonzero((9 * apart <= low + high) & (5 * low >= 4 * high))
                a.append(node[found + 1])
                b.append(node[found])
                n += len(found)
            if n > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
                a, b, n = [], [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    places = ["pos", *[f"b{i}" for i in range(1, BEFORE + 1)]] if every else []
    dealt = rows.select("key", "node", "component", "size", "bits", *places).repartition("key").sortWithinPartitions("key", F.xxhash64("key", "node"))
    return dealt.mapInArrow(search, "a long, b long")


def candidates(rows: DataFrame, every: bool) -> DataFrame:
    """The distinct pairs (a, b), a < b, of :func:`found_pairs`."""
    pairs = found_pairs(rows, every)
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The pairs of ``pairs`` whose texts are similar."""
    a, b = (nodes.select(F.col("node").alias(i), F.col("size").alias(f"s{i}"), F.col("wide").alias(f"w{i}")) for i in "ab")

    def sieve(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            stay = [near_wide(x, y, n) for x, y, n in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(stay, pa.bool_()))

    pairs = pairs.join(a, "a").join(b, "b").select("a", "b", "wa", "wb", (F.col("sa") + F.col("sb")).alias("n"))
    pairs = cut(pairs.mapInArrow(sieve, "a long, b long"))
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "sha"), "node"))
    texts = docs.select(digest(text).alias("sha"), text_of(text).cast("string").alias("text"))
    if wanted.count() <= FEW:  # then only texts that are needed are shuffled
        texts = texts.withColumn("short", F.xxhash64("sha")).join(F.broadcast(wanted.select(F.xxhash64("sha").alias("short"))), "short", "left_semi")
    texts = texts.join(wanted, "sha").dropDuplicates(["node"])
    texts = cut(texts.select("node", "text"))
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")

    def check(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            stay = pa.array([similar(x.as_py(), y.as_py()) for x, y in zip(batch.column(2), batch.column(3), strict=True)], pa.bool_())
            yield batch.select([0, 1]).filter(stay)

    return cut(both.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long"))


def shared(rows: DataFrame) -> DataFrame:
    """Rows (key, node, size, pos) without repeated ones and the most that no other set of their key can be linked with, by sizes and,
    where there are two, by places."""

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            key, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            batch = batch.filter(pa.array(new))
            key, size, pos = (batch.column(i).to_numpy() for i in (0, 2, 3))
            if not len(key):
                continue
            same = key[1:] == key[:-1]
            pair = same.copy()  # lists of two rows; those at the ends may be longer
            pair[1:] &= ~same[:-1]
            pair[:-1] &= ~same[1:]
            pair[:1] = pair[-1:] = False
            # sizes ascend: if any other is near enough, the next or the one before is
            linked = same & (5 * size[:-1] >= 4 * size[1:]) & (~pair | enough_follows(size[1:], pos[1:], size[:-1], pos[:-1]))
            stay = np.zeros(len(key), bool)
            stay[1:] |= linked
            stay[:-1] |= linked
            stay[[0, -1]] = True  # the batches before and after may have more of it
            yield batch.filter(pa.array(stay)).select([0, 1, 3])

    dealt = rows.select("key", "node", "size", "pos").repartition("key").sortWithinPartitions("key", "size", "node")
    return dealt.mapInArrow(search, "key long, node long, pos int")


def prefix_lists(rows: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Lists of the sets that share a key of their prefixes, for :func:`found_pairs`; ``found`` has the components (of, component) known."""
    places = cut(shared(rows.select(F.posexplode("first").alias("pos", "key"), "node", "size")))
    along = Window.partitionBy("node").orderBy("pos")
    # a key stands for what isn't there, as no set has it twice
    places = places.select("key", "node", "pos", *[F.lag("key", i).over(along).alias(f"b{i}") for i in range(1, BEFORE + 1)])
    places = places.select("key", "node", "pos", *[F.coalesce(f"b{i}", "key").alias(f"b{i}") for i in range(1, BEFORE + 1)])
    about = nodes.join(found, F.col("node") == F.col("of"), "left").select(F.col("node").alias("of"), F.coalesce("component", "node").alias("component"), "size", "bits")
    return places.join(about, F.col("node") == F.col("of")).drop("of")


def simhash_pairs(nodes: DataFrame, radius: int = 3) -> DataFrame:
    """Nodes (node, fp, ...) to pairs (a, b): of fingerprints that op8's search links, and of sets that share a fingerprint."""
    prints = cut(nodes.groupBy("fp").agg(F.min("node").alias("rep")))
    linked = links(prints.select("fp"), radius)
    x, y = (prints.select(F.col("fp").alias(f"f{i}"), F.col("rep").alias(f"r{i}")) for i in "xy")
    between = linked.join(x, F.col("a") == F.col("fx")).join(y, F.col("b") == F.col("fy")).select("rx", "ry")
    within = nodes.join(x, F.col("fp") == F.col("fx")).where("node <> rx").select("rx", F.col("node"))
    return between.union(within).select(F.least("rx", "ry").alias("a"), F.greatest("rx", "ry").alias("b")).distinct()


def node_components(rows: DataFrame, nodes: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """Rows as described, and their distinct nodes (node, sha, fp, size, wide, bits), to (node, component); nodes without links have no row."""
    lists = rows.select("node", F.col("node").alias("component"), "size", "bits", F.posexplode("least").alias("i", "h"))
    lists = lists.withColumn("key", F.xxhash64("i", "h"))
    linked = confirmed(candidates(lists, every=False).union(simhash_pairs(nodes)).distinct(), nodes, docs, text)
    found = cut(components(linked)).select(F.col("node").alias("of"), "component")
    return components(linked.unionByName(confirmed(candidates(prefix_lists(rows, nodes, found), every=True), nodes, docs, text)))


def survivors(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, with all their columns, but those of whose group another has a smaller doc_id; a null doc_id stays.

    Rows are told apart by doc_id and text; of two texts of one group under its smallest doc_id one stays."""
    rows = cut(described(docs, text, doc_id)).where("doc_id is not null")
    nodes = cut(rows.groupBy("node").agg(F.min("sha").alias("sha"), *[F.first(c).alias(c) for c in ("fp", "size", "wide", "bits")]))
    found = node_components(rows, nodes, docs, text).select(F.col("node").alias("of"), "component")
    member = rows.join(found, F.col("node") == F.col("of"), "left").select(F.coalesce("component", "node").alias("component"), F.struct("doc_id", "sha").alias("row"))
    member = cut(member)
    kept = member.groupBy(F.col("component").alias("group")).agg(F.min("row").alias("kept"))
    gone = member.join(kept, F.col("component") == F.col("group")).where("row <> kept").select(F.col("row.doc_id").alias("gone"), F.col("row.sha").alias("sha")).distinct()
    rows, column, laid_out = enclosed(docs)
    return laid_out(rows.join(gone, (column(doc_id) == F.col("gone")) & (digest(column(text)) == F.col("sha")), "left_anti"))
