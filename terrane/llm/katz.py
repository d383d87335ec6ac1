"""A bigram language model with Katz backoff: counted, normalised, stored and evaluated in partitions.

Seen n-grams get Good-Turing discounted probabilities; what the discount frees in a context goes, through the context's exactly
normalised backoff weight, to the words not seen in it, in proportion to their unigram
probabilities, and the unigrams' own free mass goes to the one unknown word. The probability of a token is evaluated
recursively: bigram, else weight times unigram, else unknown.

Neither n-grams nor texts are shuffled token by token. A task turns its documents into batches of word numbers; a batch sends each of
its *distinct* words, with their training counts, to the partition that owns the word, and gets global counts and
numbers back; then the same with distinct word pairs, which are owned by context. Owners merge counts into the
model's tables and answer. An answer on a context is all that its backoff weight needs: how many
successors were seen once, twice, ... and the unigram mass they hold. A context with more than a set share of all
tokens is dealt over several owners by successor; such contexts are of bounded number, and their sums meet at the driver.
The exchange is the same at every size. A very common word or pair is asked for by every batch, so that its owner gets a row from each: an
owner reads its rows as a stream and keeps plain numbers of them, some 32 bytes for a row of one word, and writes its answers as a stream.

A kept model scores further tables (:func:`scores_from`): its tables take part in the same exchange as one more sender to each owner. As
owners are as many as the model needs, the batches of a larger table are dealt over shares of an owner, each of which gets the owner's tables.

What is passed on are written tables in the shared folder, so a lost executor costs its tasks and nothing else.

Defined cases: a null text is an empty text, which is one end token; a null doc_id is learned from; without training documents
every token is the unknown word with probability 1; counts on which Good-Turing estimates fail (too few data)
are discounted by a constant instead; a very long text lies whole in one batch, which is the larger for it; rows repeated are learned from
and scored one by one, alike; words tied in a count are told apart by number, which shows in no result; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordarrays as W
from .common import Workspace, cut, held_out_of, small_batches

END = np.uint64(1)
#: The number of the context at a text's start; words have numbers from 0.
START = np.uint64(2**63)
#: Counts above are not discounted.
K = 5
#: Tokens in a batch, about.
BATCH = 1_500_000
#: Pairs an owner gets, about.
OWNED = 3_000_000
#: A context with over 1/HOT of all tokens has several owners.
HOT = 512
#: Bytes of answers in a frame, about.
FRAME = 8 << 20
#: The sender, in place of a batch, of a kept model's tables.
MODEL = -1


def squeeze(x: np.ndarray) -> bytes:
    """An array of unsigned numbers, small ones few bytes: byte planes, compressed."""
    import zstandard

    x = np.ascontiguousarray(x, "<u8")
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    planes = x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes)


def unsqueeze(b: bytes) -> np.ndarray:
    import zstandard

    width, planes = b[0], zstandard.ZstdDecompressor().decompress(b[1:])
    out = np.zeros((len(planes) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, -1).T
    return out.view("<u8").reshape(-1)


class Discount:
    """Multipliers of counts: Good-Turing up to K where the counts of counts allow it, else a constant subtracted."""

    def __init__(self, of: list[int]) -> None:
        """``of[r]``: how many n-grams were seen r times, r from 1 to K + 1 (of[0] is not used).

        The discounts are those of the largest cut-off, K at most, for which all lie between 0 and 1.
        """
        n = [float(x) for x in of]
        self.low = np.ones(K + 1)
        self.constant = 0.0
        for k in range(K, 1, -1):
            if all(n[1 : k + 2]) and (common := (k + 1) * n[k + 1] / n[1]) < 1:
                d = [((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) for r in range(1, k + 1)]
                if all(0 < x < 1 for x in d):
                    self.low[1 : k + 1] = d
                    break
        else:
            self.constant = min(0.9, max(0.1, n[1] / (n[1] + 2 * n[2]))) if n[1] else 0.5
            self.low[1:] = [(r - self.constant) / r for r in range(1, K + 1)]
        #: Mass, in counts, that one n-gram seen r times frees; beyond K it is ``constant``.
        self.freed = (1 - self.low) * np.arange(K + 1)

    def counts(self, c: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        c = c.astype(np.float64)
        return np.where(c > K, c - self.constant, c * self.low[np.minimum(c, K).astype(np.int64)])


class Unigrams:
    def __init__(self, tokens: int, types: int, of: list[int]) -> None:
        self.tokens, self.types, self.discount = tokens, types, Discount(of)
        freed = sum(self.discount.freed[r] * of[r] for r in range(1, K + 1)) + self.discount.constant * (types - sum(of[1 : K + 1]))
        self.unknown = freed / tokens if tokens else 1.0

    def p(self, c: np.ndarray) -> np.ndarray:
        """Probabilities of words by their counts; 0 means the unknown word."""
        return np.where(c > 0, self.discount.counts(c) / max(1, self.tokens), self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c.astype(np.float64) + 1) / (self.tokens + self.types + 1))


def _by_owner(owner: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each owner with the places of its entries, ascending."""
    order = np.argsort(owner, kind="stable")
    bounds = np.flatnonzero(np.diff(owner[order], prepend=-1, append=-1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield int(owner[order[a]]), order[a:b]


BATCHES = "batch long, docs binary, sizes binary, tokens binary, vocab binary, trained binary, n_tokens long, n_learned long, learned_docs long"


def _batch_row(number: int, ids: list, held: list, texts: list) -> dict:
    data, offsets = W.lay_out(texts)
    starts, ends = W.spans(data, W.word_table())
    owner = W.owners(starts, offsets)
    sizes = np.bincount(owner, minlength=len(texts)) + 1
    tokens = np.full(len(starts) + len(texts), END, np.uint64)
    tokens[np.arange(len(starts)) + owner] = W.hashes(data, starts, ends)
    vocab, local, count = np.unique(tokens, return_inverse=True, return_counts=True)
    order = np.argsort(-count, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    local = rank[local]
    learned = np.repeat(~np.array(held, bool), sizes)
    docs = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held, pa.bool_())], names=["id", "held"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, docs.schema) as out:
        out.write_batch(docs)
    return {
        "batch": number,
        "docs": sink.getvalue().to_pybytes(),
        "sizes": squeeze(sizes),
        "tokens": squeeze(local),
        "vocab": vocab[order].tobytes(),
        "trained": squeeze(np.bincount(local[learned], minlength=len(vocab))),
        "n_tokens": len(tokens),
        "n_learned": int(learned.sum()),
        "learned_docs": int(len(held) - np.sum(held)),
    }


def batches_of(docs: DataFrame, modulus: int | None, text: str, doc_id: str) -> DataFrame:
    """Rows of word numbers, each for some whole documents; see :data:`BATCHES`. Without a modulus, no document is learned from."""
    small_batches(docs.sparkSession)
    held = held_out_of(F.col(doc_id), modulus) if modulus else F.lit(True)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held.alias("held"), F.col(text).cast("string").alias("text"))
    schema = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in BATCHES.split(", "))])

    def make(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        ids, held, texts, size = [], [], [], 0
        for batch in it:
            for i, h, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids.append(i)
                held.append(h)
                texts.append(t)
                size += len(t or "")
                if size >= 6 * BATCH:
                    yield pa.RecordBatch.from_pylist([_batch_row(at, ids, held, texts)], schema)
                    at, ids, held, texts, size = at + 1, [], [], [], 0
        if ids:
            yield pa.RecordBatch.from_pylist([_batch_row(at, ids, held, texts)], schema)

    return rows.mapInArrow(make, BATCHES)


#: kind 0 answers a batch, kind 1 is the model's table of an owner; stats go with kind 1.
ANSWERS = "kind int, batch long, owner int, a binary, b binary, c binary, d binary, e binary, f binary, stats array<long>"


def _frames(rows: Iterable[dict]) -> Iterator[pd.DataFrame]:
    """Rows in frames of about FRAME bytes."""
    names = [x.split()[0] for x in ANSWERS.split(", ")]

    def frame(held: list[list]) -> pd.DataFrame:
        made = pd.DataFrame(held, columns=names)
        made["batch"] = made["batch"].astype("Int64")
        return made

    held, size = [], 0
    for r in rows:
        held.append([r.get(n) for n in names])
        size += 100 + sum(len(x) for x in held[-1] if isinstance(x, bytes))
        if size >= FRAME:
            yield frame(held)
            held, size = [], 0
    if held:
        yield frame(held)


def _packed(chunks: Iterable[pd.DataFrame], unpack: dict[str, Callable[[bytes], np.ndarray]]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """The rows of a group as numbers: ``batch``, and of each field the values of all rows, one after the other; and the fields' lengths in each row."""
    values: dict[str, list[np.ndarray]] = {n: [] for n in ("batch", *unpack)}
    sizes: dict[str, list[np.ndarray]] = {n: [] for n in unpack}
    for rows in chunks:
        values["batch"].append(rows["batch"].to_numpy(np.int64))
        for name, read in unpack.items():
            arrays = [read(x) for x in rows[name]]
            sizes[name].append(np.fromiter(map(len, arrays), np.int64, len(arrays)))
            values[name].append(np.concatenate(arrays))
    return {n: np.concatenate(x) for n, x in values.items()}, {n: np.concatenate(x) for n, x in sizes.items()}


class Words:
    """What several senders ask of one owner: their words once each, with training counts summed."""

    FIELDS = "words binary, counts binary"

    def __init__(self, owner: int, chunks: Iterable[pd.DataFrame]) -> None:
        got, sizes = _packed(chunks, {"words": lambda b: np.frombuffer(b, "<u8"), "counts": unsqueeze})
        self.owner, self.senders, self.sizes = owner, got["batch"], sizes["words"]
        self.keys, self.at = np.unique(got["words"], return_inverse=True)
        self.counts = np.bincount(self.at, got["counts"], len(self.keys)).astype(np.int64)

    def _answer(self, ranks: np.ndarray, counts: np.ndarray) -> Iterator[dict]:
        start = 0
        for sender, size in zip(self.senders, self.sizes, strict=True):
            mine, start = self.at[start : start + size], start + size
            if sender != MODEL:
                yield {"kind": 0, "batch": int(sender), "owner": self.owner, "a": squeeze(ranks[mine]), "b": squeeze(counts[mine])}

    def own(self, tables: bool) -> Iterator[dict]:
        """The senders' answers and, with ``tables``, the owner's part of the model."""
        order = np.argsort(-self.counts, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        seen = order[: int((self.counts > 0).sum())]
        of = np.bincount(np.minimum(self.counts[seen], K + 2), minlength=K + 3)[1 : K + 2].tolist()
        table = {"kind": 1, "owner": self.owner, "a": self.keys[seen].tobytes(), "b": squeeze(self.counts[seen]), "stats": [int(self.counts.sum()), len(seen), *of]}
        yield from self._answer(rank, self.counts)
        if tables:
            yield table


class Pairs:
    """What several senders ask of one owner: their contexts and pairs once each, with training counts summed."""

    FIELDS = "contexts binary, hot binary, per binary, successors binary, counts binary, trained binary"

    def __init__(self, owner: int, chunks: Iterable[pd.DataFrame]) -> None:
        got, sizes = _packed(chunks, {n.split()[0]: unsqueeze for n in self.FIELDS.split(", ")})
        self.owner, self.senders = owner, got["batch"]
        self.sizes = list(zip(sizes["contexts"].tolist(), sizes["successors"].tolist(), strict=True))
        self.names, self.context_at = np.unique(got["contexts"], return_inverse=True)
        self.hot = np.zeros(len(self.names), bool)
        # the rows of a context agree
        self.hot[self.context_at] = got["hot"].astype(bool)
        context, word = np.repeat(self.context_at, got["per"].astype(np.int64)), got["successors"]
        order = np.lexsort((word, context))
        new = np.ones(len(word), bool)
        new[1:] = (context[order][1:] != context[order][:-1]) | (word[order][1:] != word[order][:-1])
        self.pair_at = np.empty(len(word), np.int64)
        self.pair_at[order] = np.cumsum(new) - 1
        first = order[new]
        self.context, self.word, self.word_count = context[first], word[first], got["counts"][first]
        self.count = np.bincount(self.pair_at, got["trained"], len(first)).astype(np.int64)

    def _answer(self, count: np.ndarray, sums: np.ndarray, mass: np.ndarray) -> Iterator[dict]:
        c0 = p0 = 0
        for sender, (contexts, pairs) in zip(self.senders, self.sizes, strict=True):
            c, p, c0, p0 = self.context_at[c0 : c0 + contexts], self.pair_at[p0 : p0 + pairs], c0 + contexts, p0 + pairs
            if sender != MODEL:
                yield {"kind": 0, "batch": int(sender), "owner": self.owner, "a": squeeze(count[p]), "b": squeeze(sums[c].reshape(-1)), "c": mass[c].tobytes()}

    def own(self, tables: bool, unigrams: Unigrams, keep: bool) -> Iterator[dict]:
        """The senders' answers and, with ``tables``, the owner's part of the model and what it knows of contexts of several owners."""
        size, seen = len(self.names), self.count > 0
        sums = np.zeros((size, K + 1), np.int64)
        for r in range(1, K + 1):
            sums[:, r - 1] = np.bincount(self.context[self.count == r], minlength=size)
        per = sums[:, K] = np.bincount(self.context[seen], minlength=size)
        mass = np.bincount(self.context, np.where(seen, unigrams.p(self.word_count.astype(np.int64)), 0.0), size)
        stats = np.bincount(np.minimum(self.count[seen], K + 2), minlength=K + 3)[1 : K + 2].tolist()
        table = {"kind": 1, "owner": self.owner, "a": squeeze(self.names[per > 0]), "b": squeeze(per[per > 0]), "c": squeeze(self.word[seen]), "d": squeeze(self.count[seen]), "stats": stats}
        if keep:
            table |= {"e": squeeze(self.word_count[seen]), "f": squeeze(self.hot[per > 0])}
        yield from self._answer(self.count, sums, mass)
        if tables:
            yield table
        if tables and self.hot.any():
            yield {"kind": 2, "owner": self.owner, "a": self.names[self.hot].tobytes(), "b": squeeze(sums[self.hot].reshape(-1)), "c": mass[self.hot].tobytes()}


def through_owners(space: Workspace, name: str, asked: DataFrame, shares: int, pool: type, own: Callable[..., Iterator[dict]], model: DataFrame | None) -> DataFrame:
    """The table of what owners answer to ``asked`` (owner, batch and the pool's fields), by kind.

    An owner that only looks up in a ``model``'s tables may have several ``shares``, each with the tables and some of the batches; the first gives the tables back.
    """
    rows = asked.withColumn("share", F.pmod(F.xxhash64("batch"), F.lit(shares)).cast("int"))
    if model is not None:
        rows = rows.unionByName(model.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))))

    def met(key: tuple, chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _frames(own(pool(int(key[0]), chunks), int(key[1]) == 0))

    return space.table(rows.groupBy("owner", "share").applyInPandas(met, ANSWERS), name, "kind")


def words_asked(batches: DataFrame, owners: int) -> DataFrame:
    """What each batch asks of the owners of its words.

    Answers, kind 0: a the words' ranks, b their counts. kind 1: a the words' hashes by rank, b their counts; stats tokens, types
    and types seen 1 to K + 1 times. The number of a word is rank * owners + owner.
    """

    def ask(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for number, vocab, trained in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, counts = np.frombuffer(vocab, "<u8"), unsqueeze(trained)
                rows = [(o, number, words[at].tobytes(), squeeze(counts[at])) for o, at in _by_owner((words % np.uint64(owners)).astype(np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["owner", "batch", "words", "counts"])

    return batches.select("batch", "vocab", "trained").mapInArrow(ask, f"owner int, batch long, {Words.FIELDS}")


class Batch:
    """A batch with the global counts and numbers of its words, and its distinct pairs of known words."""

    def __init__(self, row: pd.Series, answers: pd.DataFrame, owners: int, start_count: int) -> None:
        vocab = np.frombuffer(row["vocab"], "<u8")
        owner = (vocab % np.uint64(owners)).astype(np.int64)
        self.count, self.number = np.zeros(len(vocab) + 1, np.int64), np.zeros(len(vocab) + 1, np.uint64)
        given = {int(o): (a, b) for o, a, b in zip(answers["owner"], answers["a"], answers["b"], strict=True)}
        for o, at in _by_owner(owner):
            ranks, counts = given[o]
            self.count[at] = unsqueeze(counts)
            self.number[at] = unsqueeze(ranks) * np.uint64(owners) + np.uint64(o)
        self.count[-1], self.number[-1] = start_count, START
        self.tokens = unsqueeze(row["tokens"]).astype(np.int64)
        self.sizes = unsqueeze(row["sizes"]).astype(np.int64)
        docs = pa.ipc.open_stream(row["docs"]).read_all()
        self.ids, self.held = docs.column("id"), docs.column("held").to_numpy()
        self.first = np.concatenate(([0], np.cumsum(self.sizes)[:-1])).astype(np.int64)
        before = np.empty(len(self.tokens), np.int64)
        before[1:] = self.tokens[:-1]
        before[self.first] = len(vocab)
        self.before = before
        # pairs of known words, in order of (context, word), and the known contexts
        self.known = (self.count[before] > 0) & (self.count[self.tokens] > 0)
        code = before * (len(vocab) + 1) + self.tokens
        self.pairs, self.at = np.unique(code[self.known], return_inverse=True)
        self.pair_context, self.pair_word = np.divmod(self.pairs, len(vocab) + 1)
        learned = ~np.repeat(self.held, self.sizes)[self.known]
        self.pair_trained = np.bincount(self.at[learned], minlength=len(self.pairs)).astype(np.int64)
        used = np.zeros(len(vocab) + 1, bool)
        used[before] = True
        self.contexts = np.flatnonzero(used & (self.count > 0))

    def deal(self, owners: int, hot: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each owner with the contexts asked of it and the places of its pairs; the same however often it is asked."""
        shares = self.count // hot + 1

        def owner(context: np.ndarray, share: np.ndarray) -> np.ndarray:
            return (W.mix(self.number[context] * np.uint64(0x9E3779B97F4A7C15) + share.astype(np.uint64)) % np.uint64(owners)).astype(np.int64)

        of_pair = owner(self.pair_context, (self.number[self.pair_word] % shares[self.pair_context].astype(np.uint64)).astype(np.int64))
        alone = self.contexts[shares[self.contexts] == 1]
        pairs, contexts = dict(_by_owner(of_pair)), dict(_by_owner(owner(alone, np.zeros(len(alone), np.int64))))
        for o in sorted(pairs.keys() | contexts.keys()):
            mine = pairs.get(o, np.zeros(0, np.int64))
            yield o, np.union1d(alone[contexts[o]] if o in contexts else alone[:0], self.pair_context[mine]), mine


def pairs_asked(batches: DataFrame, words: DataFrame, owners: int, hot: int, start_count: int) -> DataFrame:
    """What each batch asks of the owners of its pairs.

    Answers, kind 0: a the pairs' counts, b the contexts' successors seen 1 to K times and at all (row by row), c the unigram mass
    that the successors hold. kind 1: a contexts' numbers, b their numbers of successors, c successors' numbers, d
    counts, and, of a model that is kept, e the successors' counts as words, f which contexts have several owners; stats pairs seen 1 to
    K + 1 times. kind 2: the same sums as b and c of contexts, in a, with several owners.
    """

    def ask(key: tuple, row: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        b, out = Batch(row.iloc[0], answers, owners, start_count), []
        for o, contexts, pairs in b.deal(owners, hot):
            per = np.bincount(np.searchsorted(contexts, b.pair_context[pairs]), minlength=len(contexts))
            w = b.pair_word[pairs]
            out.append((o, key[0], squeeze(b.number[contexts]), squeeze(b.count[contexts] >= hot), squeeze(per), squeeze(b.number[w]), squeeze(b.count[w]), squeeze(b.pair_trained[pairs])))
        return pd.DataFrame(out, columns=["owner", "batch", "contexts", "hot", "per", "successors", "counts", "trained"])

    rows = batches.select("batch", "docs", "sizes", "tokens", "vocab").groupBy("batch").cogroup(words.groupBy("batch"))
    return rows.applyInPandas(ask, f"owner int, batch long, {Pairs.FIELDS}")


class Bigrams:
    def __init__(self, unigrams: Unigrams, of: list[int], shared: dict[int, tuple[np.ndarray, float]]) -> None:
        """``shared``: sums and held mass of contexts with several owners, by number."""
        self.unigrams, self.discount, self.shared = unigrams, Discount(of), shared

    def context(self, total: np.ndarray, sums: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The divisors of counts in contexts seen ``total`` times, and the contexts' backoff weights.

        Where no successor's count is discounted, one more occurrence of the context is assumed, so that some
        mass is left.
        """
        freed = sums[:, :K] @ self.discount.freed[1:] + self.discount.constant * (sums[:, K] - sums[:, :K].sum(axis=1))
        divisor = np.where(freed > 0, total, total + 1).astype(np.float64)
        return divisor, np.where(freed > 0, freed, 1.0) / divisor / (1 - held)


def scores(batches: DataFrame, words: DataFrame, pairs: DataFrame, model: Bigrams, owners: int, hot: int, start_count: int) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    unigrams = model.unigrams

    def evaluate(key: tuple, row: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        b = Batch(row.iloc[0], answers[answers["of"] == "word"], owners, start_count)
        given = answers[answers["of"] == "pair"].set_index("owner")
        size = len(b.count)
        divisor, weight, count = np.ones(size), np.ones(size), np.zeros(len(b.pairs), np.int64)
        for o, contexts, at in b.deal(owners, hot):
            a = given.loc[o]
            count[at] = unsqueeze(a["a"])
            divisor[contexts], weight[contexts] = model.context(b.count[contexts], unsqueeze(a["b"]).astype(np.int64).reshape(-1, K + 1), np.frombuffer(a["c"], np.float64))
        for c in b.contexts[b.count[b.contexts] >= hot].tolist():
            sums, held = model.shared[int(b.number[c])]
            (divisor[c],), (weight[c],) = model.context(b.count[[c]], sums[None, :], np.array([held]))
        word = unigrams.p(b.count)
        p = weight[b.before] * word[b.tokens]
        seen = count > 0
        pair = np.where(seen, model.discount.counts(count) / divisor[b.pair_context], weight[b.pair_context] * word[b.pair_word])
        p[b.known] = pair[b.at]
        known = b.count[b.tokens] > 0
        total = lambda x: np.add.reduceat(x, b.first)  # noqa: E731  every document has a token
        return pd.DataFrame(
            {
                "doc_id": pd.Series(b.ids.to_pylist(), dtype="Int64"),
                "held_out": b.held,
                "n_tokens": b.sizes,
                "n_known": total(known.astype(np.int64)),
                "train_tokens": unigrams.tokens,
                "base_score": total(unigrams.base(b.count[b.tokens])),
                "score": total(np.log10(p)),
            }
        )

    answers = words.withColumn("of", F.lit("word")).unionByName(pairs.withColumn("of", F.lit("pair"))).drop("d", "e", "f", "stats", "kind")
    rows = batches.select("batch", "docs", "sizes", "tokens", "vocab").groupBy("batch").cogroup(answers.groupBy("batch"))
    return rows.applyInPandas(evaluate, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _exchange(space: Workspace, batches: DataFrame, owners: int, hot: int, start_count: int, shares: int = 1, keep: str | None = None, model: str | None = None) -> DataFrame:
    spark = batches.sparkSession
    sent = lambda name, **columns: spark.read.parquet(f"{model}/{name}").select(F.col("owner").cast("int").alias("owner"), F.lit(MODEL).cast("long").alias("batch"), *[F.col(c).alias(n) for n, c in columns.items()]) if model else None
    stats = lambda t, n: [int(x or 0) for x in t.where("kind = 1").agg(*[F.sum(F.get("stats", F.lit(i))) for i in range(n)]).first()]
    words = through_owners(space, "words", words_asked(batches, owners), shares, Words, Words.own, sent("words", words="words", counts="counts"))
    tokens, types, *of = stats(words, K + 3)
    unigrams = Unigrams(tokens, types, [0, *of])
    words_given = words.where("kind = 0")
    kept = sent("pairs", contexts="contexts", hot="hot", per="successors_each", successors="successors", counts="word_counts", trained="counts")
    own = lambda pool, tables: pool.own(tables, unigrams, keep is not None)
    pairs = through_owners(space, "pairs", pairs_asked(batches, words_given, owners, hot, start_count), shares, Pairs, own, kept)
    shared: dict[int, tuple[np.ndarray, float]] = {}
    # contexts with at least ``hot`` of the tokens: at most HOT, each in at most count // hot + 1 rows' arrays
    for r in pairs.where("kind = 2").select("a", "b", "c").orderBy("owner").collect():
        for name, sums, held in zip(np.frombuffer(r["a"], "<u8").tolist(), unsqueeze(bytes(r["b"])).astype(np.int64).reshape(-1, K + 1), np.frombuffer(r["c"], np.float64).tolist(), strict=True):
            old = shared.get(name, (0, 0.0))
            shared[name] = (old[0] + sums, old[1] + held)
    if keep:
        words.where("kind = 1").select("owner", F.col("a").alias("words"), F.col("b").alias("counts")).write.partitionBy("owner").parquet(f"{keep}/words")
        names = {"a": "contexts", "b": "successors_each", "c": "successors", "d": "counts", "e": "word_counts", "f": "hot"}
        pairs.where("kind = 1").select("owner", *[F.col(c).alias(n) for c, n in names.items()]).write.partitionBy("owner").parquet(f"{keep}/pairs")
        # last, so that a model without it is known to be unfinished
        spark.range(1).select(F.lit(owners).alias("owners"), F.lit(hot).cast("long").alias("hot"), F.lit(start_count).cast("long").alias("start_count")).write.parquet(f"{keep}/about")
    bigrams = Bigrams(unigrams, [0, *stats(pairs, K + 1)], shared)
    return cut(scores(batches, words_given, pairs.where("kind = 0"), bigrams, owners, hot, start_count))


def katz_scores(docs: DataFrame, modulus: int = 7, owned: int = OWNED, text: str = "text", doc_id: str = "doc_id", keep_model: str | None = None) -> DataFrame:
    """Learns from the documents that are not held out and scores all; see :func:`scores`.

    ``keep_model``: a new folder for the tables of words and pairs, partitioned by owner, from which :func:`scores_from` scores further documents.
    """
    space = Workspace(docs.sparkSession)
    try:
        batches = space.bucketed(batches_of(docs, modulus, text, doc_id), "batches", "batch")
        n_tokens, n_learned, start_count = batches.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n_tokens", "n_learned", "learned_docs")]).first()
        return _exchange(space, batches, max(1, -(-n_tokens // owned)), max(owned // 8, n_learned // HOT), start_count, keep=keep_model)
    finally:
        space.drop()


def scores_from(docs: DataFrame, model: str, owned: int = OWNED, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Scores ``docs`` by a model that :func:`katz_scores` kept, learning nothing: every row is held out. Columns as of :func:`scores`."""
    spark = docs.sparkSession
    about, space = spark.read.parquet(f"{model}/about").first(), Workspace(spark)
    try:
        batches = space.bucketed(batches_of(docs, None, text, doc_id), "batches", "batch")
        n_tokens = batches.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
        return _exchange(space, batches, about["owners"], about["hot"], about["start_count"], max(1, -(-n_tokens // (owned * about["owners"]))), model=model)
    finally:
        space.drop()
