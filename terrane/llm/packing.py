"""Packing documents into token sequences along a space-filling curve.

A document's vector of token counts, hashed by id, is projected to a few dimensions by random signs; its place on the
Hilbert curve through that space is its key. Documents are range-sorted by key, so that neighbours
on the curve, which are alike, are packed together. Full sequences are cut off a document's front and
stand alone; what is left of each is packed, in small windows along the curve, by best fit in
decreasing length, and a few sequences that a window leaves open go on to the next. Windows are small so that what shares a
sequence stood close together on the curve. A rest is never
cut, so each cut point is known when a text is tokenized, and every text is tokenized once.

Ties on the curve, such as a group of copies, are told apart by a hash of the doc_id in the range-sort, and repeated rows by a
number of the row, so that no partition has to take a whole group. Rows that are range-sorted hold lengths and checksums, no text.

Tokenizing goes through a memo of words, split at ASCII white space, which the tokenizer drops and never joins over.
The memo is emptied when it holds ``MEMO`` words.

Defined cases: a null text is an empty text, of which the end token is left; rows repeated are further documents;
a null doc_id stays null; a very long text is cut into as many whole sequences as it fills; an empty table gives an empty result.
Which of equal rows gets which place is not defined; they have the same ids.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches
from .wordarrays import lay_out, word_table

MEMO = 600_000
#: Longer words are tokenized without being remembered.
LONG = 60


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    """The path of a vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Tokenize:
    """Texts to the bytes of their ids as little-endian unsigned 32-bit numbers."""

    _made: dict[str, Tokenize] = {}

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        #: Whether an id ends a word, by id.
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.mark, self.alnum = np.zeros(256, bool), np.zeros(256, bool)
        self.mark[list(b".,")] = self.alnum[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    @classmethod
    def at(cls, path: str) -> Tokenize:
        """The one of this process, with what it remembers."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _encode(self, words: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _encode_all(self, words: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Words with their ids. Words of letters alone are tokenized in lines: each ends at the next id that ends a word."""
        plain, other = [], []
        for w in words:
            text = w.decode("utf-8", "replace")
            (plain if text.isalpha() and text.lower().isalpha() else other).append((w, text))
        lines = [plain[i : i + 256] for i in range(0, len(plain), 256)]
        out = []
        for line, e in zip(lines, self.tokenizer.encode_batch_fast([" ".join([text for _, text in line]) for line in lines], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(line):
                data, ends = ids.tobytes(), (4 * cuts).tolist()
                out += [(w, data[a:b]) for (w, _), a, b in zip(line, [0, *ends], ends, strict=False)]
            else:
                other += line
        out += zip([w for w, _ in other], self._encode([w for w, _ in other]), strict=True)
        return out

    def _split(self, texts: list[str | None]) -> list[list[bytes]]:
        """The texts' words, A-Z in lower case as the tokenizer has it, a point or comma after a letter or digit set apart."""
        data, offsets = lay_out(texts)
        at = np.flatnonzero(self.mark[data])
        at = at[(at > 0) & (at < len(data) - 1)]
        at = at[self.alnum[data[at - 1]] & (word_table()[data[at + 1]] == 0)]
        line = np.insert(data, at, 32).tobytes()
        offsets = (offsets + np.searchsorted(at, offsets)).tolist()
        return [line[a:b].split() for a, b in zip(offsets, offsets[1:], strict=False)]

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        # names of special tokens, of which case matters, are left to the tokenizer alone
        special = {i for i, t in enumerate(texts) if t and "<|" in t}
        split = self._split([None if i in special else t for i, t in enumerate(texts)] if special else texts)
        memo = self.memo
        missing = set().union(*split).difference(memo)
        if len(memo) + len(missing) > MEMO:
            memo.clear()
            missing = set().union(*split)
        new = sorted(w for w in missing if len(w) <= LONG)
        for i in range(0, len(new), 16_384):
            memo.update(self._encode_all(new[i : i + 16_384]))
        if len(new) == len(missing):
            out = [b"".join(map(memo.__getitem__, words)) for words in split]
        else:
            rare = [w for w in missing if len(w) > LONG]
            rare = dict(zip(rare, self._encode(rare), strict=True))
            out = [b"".join([memo[w] if w in memo else rare[w] for w in words]) for words in split]
        for i in special:
            out[i] = self._encode([texts[i].encode("utf-8", "replace")])[0]
        return out


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert indices of rows of unsigned coordinates below 2**bits (Skilling, 2004); dims * bits up to 62."""
    x = points.astype(np.int64).T.copy()
    dims, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t, q = np.zeros(x.shape[1], np.int64), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[dims - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    index = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            index = index << 1 | (x[i] >> b & 1)
    return index


def curve_keys(ids: list[bytes], dims: int, bits: int, seed: int) -> np.ndarray:
    """The texts' places on the curve, from the mean of their ids' sign vectors."""
    features = 1 << 12
    signs = np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (dims, features))
    means = np.zeros((len(ids), dims), np.float32)
    for i, one in enumerate(ids):
        if one:
            n = np.bincount(np.frombuffer(one, "<u4") & (features - 1), minlength=features)
            means[i] = signs @ n.astype(np.float32) / (len(one) // 4)
    cells = (2**bits / (1 + np.exp(-np.clip(means * 16, -60, 60)))).astype(np.int64)
    return hilbert(np.minimum(cells, 2**bits - 1), bits)


def measure(docs: DataFrame, tokenizer: str, end: int, length: int, dims: int, bits: int, seed: int, text: str, doc_id: str) -> DataFrame:
    """doc_id, text_hash, tie, curve_key, doc_tokens, and the checksums of the pieces, the rest last."""
    small_batches(docs.sparkSession)
    body = F.col(text).cast("string")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_key(text).alias("text_hash"), F.xxhash64(F.col(doc_id)).alias("tie"), body.alias("text"))
    last, size = np.array([end], "<u4").tobytes(), 4 * length

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenize = Tokenize.at(tokenizer)
        for batch in it:
            ids = tokenize(batch.column(3).to_pylist())
            keys = curve_keys(ids, dims, bits, seed)
            ids = [x + last for x in ids]
            sums = [[zlib.crc32(x[i : i + size]) for i in range(0, len(x), size)] for x in ids]
            tokens = pa.array([len(x) // 4 for x in ids], pa.int64())
            columns = [*batch.columns[:3], pa.array(keys), tokens, pa.array(sums, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "tie", "curve_key", "doc_tokens", "sums"])

    return rows.mapInArrow(batches, "doc_id long, text_hash long, tie long, curve_key long, doc_tokens long, sums array<long>")


def text_key(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


class Packer:
    """Packs rests along the curve; holds a window of rests and at most ``most`` sequences still open."""

    def __init__(self, length: int, window: int, most: int, first: int) -> None:
        self.length, self.window, self.most, self.next = length, window, most, first
        self.waiting: list[tuple[int, int, int]] = []  # size, order, row
        self.open: list[tuple[int, int]] = []  # room left, sequence

    def new(self) -> int:
        self.next += 1
        return self.next - 1

    def add(self, size: int, row: int) -> list[tuple[int, int, int]]:
        """Rests that were placed: (row, sequence, offset)."""
        self.waiting.append((-size, len(self.waiting), row))
        return self.place() if len(self.waiting) >= self.window else []

    def place(self) -> list[tuple[int, int, int]]:
        placed, room = [], self.open
        for minus, _, row in sorted(self.waiting):
            size = -minus
            i = bisect_left(room, (size, -1))
            left, sequence = room.pop(i) if i < len(room) else (self.length, self.new())
            placed.append((row, sequence, self.length - left))
            if left > size:
                insort(room, (left - size, sequence))
        self.waiting = []
        # the emptiest go on; what is nearly full stays as it is
        self.open = [x for x in room if x[0] * 64 >= self.length][-self.most :]
        return placed


def pack(docs: DataFrame, tokenizer: str | None = None, end: int = 2, length: int = 4096, window: int = 64, most_open: int = 16, per_partition: int = 32_768, dims: int = 4, bits: int = 8, seed: int = 10, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, curve_key, text_hash, copy.

    ``copy`` numbers, in a task, the rows of one doc_id and text; with ``text_hash`` it serves :func:`sequences`.
    """
    measured = measure(docs, tokenizer or public_tokenizer(), end, length, dims, bits, seed, text, doc_id)
    measured = cut(measured.withColumn("row", F.monotonically_increasing_id()))
    parts = max(1, min(20_000, -(-measured.count() // per_partition)))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "curve_key", "text_hash", "copy"]

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(length, window, most_open, (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40)
        rests: list[tuple] = []
        last, copy = None, 0
        for batch in it:
            out = []
            for doc, text_hash, _, key, tokens, sums, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                copy = copy + 1 if last == (doc, text_hash) else 0  # equal rows follow each other
                last = doc, text_hash
                about = key, text_hash, copy
                for k in range(tokens // length):
                    out.append((doc, k * length, length, sums[k], tokens, packer.new(), 0, *about))
                if rest := tokens % length:
                    rests.append((doc, tokens - rest, rest, sums[-1], tokens, *about))
                    if placed := packer.add(rest, len(rests) - 1):
                        out += _placed(rests, placed)
                        rests = []
            yield _batch(out, names)
        yield _batch(_placed(rests, packer.place()), names)

    order = ["curve_key", "tie", "doc_id", "text_hash", "row"]
    sorted_ = measured.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return sorted_.mapInArrow(rows, ", ".join(f"`{n}` long" for n in names))


def _placed(rests: list[tuple], placed: list[tuple[int, int, int]]) -> list[tuple]:
    return [(*rests[row][:5], sequence, offset, *rests[row][5:]) for row, sequence, offset in placed]


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def sequences(docs: DataFrame, pieces: DataFrame, tokenizer: str | None = None, end: int = 2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The packed ids: sequence_id, ids array<int>, docs array<long> (the document of each piece), starts array<int>.

    ``docs`` are the rows that were packed. Rows of one doc_id and text have the same ids, so one of them serves the pieces of
    all. Pieces go to their documents, never a sequence to the driver.
    """
    path = tokenizer or public_tokenizer()
    small_batches(docs.sparkSession)
    # the pieces of at most 64 equal rows of a task at once, so that a row repeated without end is no single list
    wanted = pieces.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.shiftright("copy", 6).alias("__part"))
    wanted = wanted.agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), text_key(text).alias("hash"), F.col(text).cast("string").alias("text")).groupBy("id", "hash").agg(F.first("text").alias("text"))
    rows = texts.join(wanted, F.col("id").eqNullSafe(F.col("__id")) & (F.col("hash") == F.col("__hash"))).select("id", "text", "pieces")
    last = np.array([end], "<u4").tobytes()

    def slices(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenize = Tokenize.at(path)
        for batch in it:
            out = []
            for doc, ids, own in zip(batch.column(0).to_pylist(), tokenize(batch.column(1).to_pylist()), batch.column(2).to_pylist(), strict=True):
                ids = np.frombuffer(ids + last, "<u4")
                out += [(p["sequence_id"], p["offset"], doc, ids[p["start"] : p["start"] + p["length"]].tolist()) for p in own]
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=True)], names=["sequence_id", "offset", "doc", "ids"])

    cuts = rows.mapInArrow(slices, "sequence_id long, offset long, doc long, ids array<int>")
    whole = cuts.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc", "ids"))).alias("p"))
    return whole.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc").alias("docs"), F.transform("p.offset", lambda x: x.cast("int")).alias("starts"))
