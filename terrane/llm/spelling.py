"""Spelling variants: words one edit apart, each pointed to its most frequent neighbour, and those pointers followed to a root.

Two words are near if one inserted, deleted or replaced letter makes one into the other. Of such a pair either the first half of the
shorter word stands unchanged at the front of the other, or its second half at the back. So each word is dealt twice, by its first
half and by its second, and meets all its neighbours in one shard or the other. There the words of a shard's task are a minimal acyclic
automaton that numbers them (the number of a word is the sum of what its edges skip): one read forward for words dealt by their front,
one of reversed words for those dealt by their back (Mihov and Schulz, "Fast Approximate Search in Large Dictionaries", 2004).
The shorter word of a pair looks the other up: its half is matched exactly, the rest is completed with one error. What is found both
ways is kept once.

Scale: words are counted on the map side before they are shuffled. A shard holds words of two lengths that share half their letters; if more than
``most`` do, they are dealt again by half of what is left open, until only one letter is open, which the alphabet bounds. A task builds its
automata of some ``chunk`` words at a time. Nothing is broadcast. Pointers are followed by doubling, a join a round.

Defined cases: a null text has no words; a null doc_id is written ''; each row counts, repeated or not; neighbours that tie in number rank in
code-point order; a very long text is read whole, and a very long word is looked up in time in proportion to its length; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, cut, small_batches, text_of

#: What stands between runs of letters: all but those of ASCII and the block from U+00C0 to U+00FF.
BETWEEN = "[^A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def damaged(run: Column, doc_id: Column, every: int) -> Column:
    """The run, or without one of its letters where ``every`` divides the CRC-32 of its document and itself."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def corpus_words(docs: DataFrame, min_length: int = 6, min_count: int = 5, every: int | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """word, n of the words of a table of texts. ``every``: typing errors are made on purpose, in one run of so many."""
    runs = docs.select(F.col(doc_id).alias("id"), F.explode_outer(F.split(F.translate(text_of(text), UPPER, LOWER), BETWEEN)).alias("run"))
    long_enough = runs.where(F.char_length("run") >= min_length)
    words = long_enough.select((damaged(F.col("run"), F.col("id"), every) if every else F.col("run")).alias("word")).where(F.char_length("word") >= min_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


class Automaton:
    """The minimal acyclic automaton of sorted, distinct words; edges know how many words come before those they lead to."""

    def __init__(self, words: list[str]) -> None:
        self.final: list[bool] = []
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.words: list[int] = []
        self._known: dict[tuple, int] = {}
        path: list[tuple[bool, dict[str, int]]] = [(False, {})]
        before = ""
        for word in words:
            same = 0
            while same < len(before) and before[same] == word[same]:
                same += 1
            self._close(path, before, same)
            path += [(False, {}) for _ in range(len(word) - same)]
            path[-1] = (True, path[-1][1])
            before = word
        self._close(path, before, 0)
        self.root = self._state(path[0])

    def _close(self, path: list, word: str, depth: int) -> None:
        """Makes states of what no further word can change: the nodes of ``word`` below a depth."""
        while len(path) > depth + 1:
            state = self._state(path.pop())
            path[-1][1][word[len(path) - 1]] = state

    def _state(self, node: tuple[bool, dict[str, int]]) -> int:
        final, below = node
        key = (final, *below.items())
        if (state := self._known.get(key)) is None:
            edges, n = {}, int(final)
            for letter, to in below.items():
                edges[letter] = (to, n)
                n += self.words[to]
            state = self._known[key] = len(self.final)
            self.final.append(final)
            self.edges.append(edges)
            self.words.append(n)
        return state

    def near(self, word: str, start: int, end: int) -> set[int]:
        """Numbers of the words that one letter replaced or inserted between two places of ``word`` makes; what is before and after is matched exactly."""
        edges, state, number = self.edges, self.root, 0
        for letter in word[:start]:
            state, skipped = edges[state][letter]
            number += skipped
        found: set[int] = set()
        known: dict[tuple[int, int], int] = {}
        for i in range(start, end + 1):
            own = word[i] if i < end else None
            for letter, (to, skipped) in edges[state].items():
                if own is not None and letter != own and (rest := self._complete(to, word, i + 1, known)) >= 0:
                    found.add(number + skipped + rest)
                if (rest := self._complete(to, word, i, known)) >= 0:
                    found.add(number + skipped + rest)
            if own is not None:
                state, skipped = edges[state][own]
                number += skipped
        return found

    def _complete(self, state: int, word: str, i: int, known: dict[tuple[int, int], int]) -> int:
        """What the rest of a word from a place on adds to its number, -1 if a state does not lead on so. ``known``: answers for this word so far."""
        way, rest = [], -1
        while True:
            if (state, i) in known:
                rest = known[state, i]
                break
            if i == len(word):
                rest = 0 if self.final[state] else -1
                break
            edge = self.edges[state].get(word[i])
            if edge is None:
                break
            way.append((state, i, edge[1]))
            state, i = edge[0], i + 1
        for state, i, skipped in reversed(way):
            rest = rest + skipped if rest >= 0 else -1
            known[state, i] = rest
        return rest


PAIRS = "word string, near string, near_n long"
_PAIRS = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])


def _look_up(rows: list[dict], backward: bool) -> Iterator[tuple[str, str, int]]:
    turn = (lambda w: w[::-1]) if backward else (lambda w: w)
    numbers = {turn(r["word"]): r["n"] for r in rows}
    words = sorted(numbers)
    automaton = Automaton(words)
    for r in rows:
        if not r["asks"]:
            continue
        word, length = turn(r["word"]), len(r["word"])
        start, end = (r["back"], length - r["front"]) if backward else (r["front"], length - r["back"])
        for i in automaton.near(word, start, end):
            near = words[i]
            yield r["word"], turn(near), numbers[near]
            if len(near) > length:  # the longer of two does not ask
                yield turn(near), r["word"], r["n"]


def _pairs_of(chunk: int):
    def pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(rows: list[dict]) -> Iterator[pa.RecordBatch]:
            found = [p for backward in (False, True) for p in _look_up([r for r in rows if (r["front"] == 0) == backward], backward)]
            for i in range(0, len(found), 10_000):
                part = found[i : i + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), _PAIRS)], schema=_PAIRS)

        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if len(held) >= chunk and row["shard"] != held[-1]["shard"]:
                    yield from answer(held)
                    held = []
                held.append(row)
        if held:
            yield from answer(held)

    return pairs_of


def _shard() -> Column:
    """Names what a shard's words have in common: two lengths, their first letters and their last."""
    return F.concat_ws(":", "size", "front", "back", F.expr("left(word, front)"), F.expr("right(word, back)"))


def shards(words: DataFrame, most: int = 4096) -> DataFrame:
    """word, n, asks, size, front, back, shard: each word in each shard where it can meet neighbours.

    ``size`` is the length of the shorter word of a pair: words of that length ask, words longer by one are asked only. ``front`` and ``back``
    are the numbers of letters that all words of the shard have in common.
    """
    length = F.char_length("word")
    sized = words.select("word", "n", F.explode(F.array(F.lit(True), F.lit(False))).alias("asks")).withColumn("size", F.when(F.col("asks"), length).otherwise(length - 1))
    half = F.floor(F.col("size") / 2).cast("int")
    ends = F.explode(F.array(F.struct(half.alias("front"), F.lit(0).alias("back")), F.struct(F.lit(0).alias("front"), (F.col("size") - half).alias("back")))).alias("fixed")
    rows = sized.where("size > 0").select("word", "n", "asks", "size", ends).select("word", "n", "asks", "size", "fixed.*")
    return split_shards(rows.withColumn("shard", _shard()), most)


def split_shards(rows: DataFrame, most: int) -> DataFrame:
    """Shards of more than ``most`` words dealt again by more letters, the first half or the last of those left open."""
    rows, done = cut(rows), None
    while True:
        hot = cut(rows.where("size - front - back > 1").groupBy("shard").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > most).select("shard"))
        if hot.isEmpty():
            return rows if done is None else done.unionByName(rows)
        rest = rows.join(hot, "shard", "left_anti")
        done = cut(rest if done is None else done.unionByName(rest))
        more = F.floor((F.col("size") - F.col("front") - F.col("back")) / 2).cast("int")
        less = (F.col("size") - F.col("front") - F.col("back") - more).cast("int")
        finer = F.explode(F.array(F.struct((F.col("front") + more).alias("front"), F.col("back")), F.struct(F.col("front"), (F.col("back") + less).alias("back")))).alias("fixed")
        rows = rows.join(hot, "shard", "left_semi").select("word", "n", "asks", "size", finer).select("word", "n", "asks", "size", "fixed.*")
        rows = cut(rows.withColumn("shard", _shard()))


def near_pairs(words: DataFrame, most: int = 4096, chunk: int = 50_000) -> DataFrame:
    """word, near, near_n: every ordered pair of words (word, n) that are one edit apart."""
    small_batches(words.sparkSession)
    dealt = shards(words, most).repartition("shard").sortWithinPartitions("shard")
    found = dealt.select("shard", "word", "n", "asks", "front", "back").mapInArrow(_pairs_of(chunk), PAIRS)
    return found.groupBy("word", "near").agg(F.first("near_n").alias("near_n"))


def spelling_variants(words: DataFrame, ratio: int = 5, most: int = 4096, chunk: int = 50_000) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of a table (word, n) of distinct words.

    A word's form is its most frequent neighbour, if that occurs ``ratio`` times as often at least; its root is the last of the
    forms of its forms.
    """
    space = Workspace(words.sparkSession)
    try:
        words = space.write(words.select("word", "n"), "words")
        best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
        near = near_pairs(words, most, chunk).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
        known = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "best.form", (-F.col("best.less")).alias("form_n"))
        far = F.col("form_n") >= F.col("n") * ratio
        known = space.write(known.withColumns({"form": F.when(far, F.col("form")), "form_n": F.when(far, F.col("form_n"))}), "known")
        ends = roots(known.where("form is not null").select("word", F.col("form").alias("root")))
        out = known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
        return cut(out)
    finally:
        space.drop()


def roots(forms: DataFrame) -> DataFrame:
    """word, root: forms (word, root) followed to the last one. Each round doubles the steps that are done."""
    forms = cut(forms)
    while True:
        onward = forms.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut(forms.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        forms = step.select("word", "root")
        if step.where("moved").isEmpty():
            return forms
