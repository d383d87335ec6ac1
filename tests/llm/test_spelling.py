"""Spelling variants against a plain version, automata against lists of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from terrane.llm import spelling
from terrane.llm.spelling import Automaton, corpus_words, near_pairs, spelling_variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LETTERS = "abcdefghijklmnopqrstuvwxyzäéñ"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_words(rows, every=199, min_length=6, min_count=5):
    n = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(lowered(text)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= min_length and c >= min_count}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def edits(word, letters):
    return {word[:i] + c + word[i + d :] for i in range(len(word) + 1) for c in [*letters, ""] for d in (0, 1)} - {word}


def plain_variants(n, ratio=5):
    letters = sorted(set("".join(n)))
    near = {w: sorted((x for x in edits(w, letters) if x in n), key=lambda x: (-n[x], x)) for w in n}
    form = {w: next((x for x in near[w][:1] if n[x] >= ratio * n[w]), None) for w in n}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else 0) for w in n)


def got(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in df.collect())


def dictionary(rng, n):
    words = set()
    while len(words) < n:
        w = "".join(rng.choice(LETTERS[:4] + LETTERS[-2:]) for _ in range(rng.randrange(1, 9)))
        words |= {w, *rng.sample(sorted(edits(w, LETTERS[:5])), 3)}
    return {w: rng.choice([1, 2, 5, 30, 200, 1000]) for w in words if w}


def test_cases(docs, rows):
    plain = [(i, t) for i, t, *_ in rows]
    words = corpus_words(docs, every=199)
    assert {r["word"]: r["n"] for r in words.collect()} == plain_words(plain)
    some = corpus_words(docs, min_length=2, min_count=1, every=7)
    assert {r["word"]: r["n"] for r in some.collect()} == plain_words(plain, 7, 2, 1)
    assert got(spelling_variants(words)) == plain_variants(plain_words(plain))


def test_damage_makes_neighbours(spark):
    rows = [(i, "Wonderful wonderfulÉ ×÷×÷×÷ ab abcdef_abcdef") for i in range(300)] + [(None, "wonderful"), (7, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    n = plain_words(rows, every=3)
    assert got(spelling_variants(corpus_words(docs, every=3))) == plain_variants(n)
    assert any(len(w) == 8 for w in n)


@pytest.mark.parametrize("most, chunk", [(4096, 50_000), (3, 40), (10, 1)])
def test_dense_dictionary(spark, most, chunk):
    """Words of all lengths from 1, most with many neighbours; hot shards split to single letters, tasks of one shard at a time."""
    n = dictionary(random.Random(5), 900)
    words = spark.createDataFrame(sorted(n.items()), "word string, n long").repartition(3)
    assert got(spelling_variants(words, most=most, chunk=chunk)) == plain_variants(n)


def test_hot_shards_are_split(spark):
    """3,000 words that share their first five letters: no shard keeps more than can differ in one open letter."""
    rng = random.Random(2)
    n = {"const" + "".join(rng.choice(LETTERS) for _ in range(6)): 1 for _ in range(3000)}
    words = spark.createDataFrame(sorted(n.items()), "word string, n long")
    sizes = spelling.shards(words, most=50).groupBy("shard", "size", "front", "back").count().collect()
    assert all(r["count"] <= 50 or r["size"] - r["front"] - r["back"] == 1 for r in sizes) and max(r["count"] for r in sizes) < 100
    assert max(r["count"] for r in spelling.shards(words, most=10**6).groupBy("shard").count().collect()) >= 2900


def test_every_pair_once(spark):
    n = dictionary(random.Random(8), 400)
    pairs = [(r["word"], r["near"]) for r in near_pairs(spark.createDataFrame(sorted(n.items()), "word string, n long")).collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(a, b) for a in n for b in n if one_edit(a, b)}


def test_long_words(spark):
    """Words of 30,000 letters, of one letter, with one more, and with one changed."""
    n = {"x" * 30_000: 1, "x" * 30_001: 5, "x" * 20_000 + "y" + "x" * 10_000: 30, "xy" * 15_000: 2}
    words = spark.createDataFrame(sorted(n.items()), "word string, n long")
    rows = {r["word"]: r for r in spelling_variants(words).collect()}
    assert [rows[w]["n_near"] for w in n] == [2, 2, 2, 0]
    assert rows["x" * 30_000]["form_n"] == 30 and rows["x" * 30_000]["root"] == "x" * 20_000 + "y" + "x" * 10_000


def test_long_chains_of_forms(spark):
    """Forms of forms, nine steps to the root."""
    n = {"a" * i + "b" * (12 - i): 5**i for i in range(10)}
    words = spark.createDataFrame(sorted(n.items()), "word string, n long")
    assert got(spelling_variants(words)) == plain_variants(n)
    assert {r["root"] for r in spelling_variants(words).collect()} == {"a" * 9 + "bbb"}


def test_automaton():
    words = sorted(dictionary(random.Random(1), 500))
    a = Automaton(words)
    for i, w in enumerate(words):  # numbers are places in the list
        state, number = a.root, 0
        for c in w:
            state, skipped = a.edges[state][c]
            number += skipped
        assert number == i and a.final[state]
    assert a.words[a.root] == len(words)
    # minimal: no two states accept the same
    rests = {}

    def rest(s):
        if s not in rests:
            rests[s] = frozenset(({""} if a.final[s] else set()) | {c + r for c, (t, _) in a.edges[s].items() for r in rest(t)})
        return rests[s]

    rest(a.root)
    assert len(rests) == len(a.final) == len(set(rests.values()))
    assert Automaton([]).words == [0]


def test_empty(spark, empty):
    assert spelling_variants(corpus_words(empty)).count() == 0
