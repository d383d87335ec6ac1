"""Terms found by stored keys, against a look at every term of the dictionary."""

import itertools
import random

import pytest

from terrane.operators import search as Q


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_near_words_share_a_key(spark):
    """All words of up to five of two letters, with fronts of three, and random longer ones: none is missed."""
    rng = random.Random(3)
    words = ["".join(w) for n in range(1, 6) for w in itertools.product("ab", repeat=n)]
    words += ["".join(rng.choice("abc") for _ in range(rng.randrange(6, 12))) for _ in range(150)]
    frame = spark.createDataFrame([(w, 1, 1, 0) for w in dict.fromkeys(words)], "term string, df long, cf long, bucket int")
    keys = {}
    for r in Q.lookups(frame, 4).collect():
        assert r["key"] not in keys.setdefault(r["term"], set())
        keys[r["term"]].add(r["key"])
    for w in keys:
        assert {k for k in keys[w] if k[0] == "d"} == set(Q.word_keys(w, Q.DELETED))
        assert {k for k in keys[w] if k[0] == "g"} == set(Q.pattern_keys(w))
    for a, b in itertools.combinations(keys, 2):
        if (d := edits(a, b)) <= Q.DELETED:
            assert keys[a] & set(Q.word_keys(b, d)) and keys[b] & set(Q.word_keys(a, d)), (a, b)


def test_terms_by_keys(spark, tmp_path):
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("thingüx1") for _ in range(rng.randrange(1, 9))) for _ in range(400)} | {"thing", "th", "x" * 3000})
    docs = spark.createDataFrame([(i, " ".join(rng.sample(words, 8))) for i in range(80)] + [(99, None)], "id long, body string")
    index, plain = (Q.Index(spark, str(tmp_path / n), buckets=4) for n in ("keys", "plain"))
    for i in (index, plain):
        i.add(docs, "id", ["body"], "c")
    index.index_terms("c", "body")
    rows = lambda df: sorted(map(tuple, df.select(sorted(df.columns)).collect()))
    for pattern in ("th*", "*ing", "t*g", "*hin*", "?h?", "thing", "*", "", "*t*", "x*x", "ü?*", "nothing*here"):
        assert rows(index.terms_like("c", "body", pattern)) == rows(plain.terms_like("c", "body", pattern)), pattern
    for word, distance in itertools.product(("thing", "x", "", "hhinggg", "üüx1thin"), (0, 1, 2, 3)):
        assert rows(index.terms_near("c", "body", word, distance)) == rows(plain.terms_near("c", "body", word, distance)), (word, distance)
    assert rows(index.wildcard("c", "body", "*hin*")) == rows(plain.wildcard("c", "body", "*hin*")) and rows(index.fuzzy("c", "body", "thing", 1)) == rows(plain.fuzzy("c", "body", "thing", 1))
    for found in (index.terms_like("c", "body", "*hin*"), index.terms_near("c", "body", "thing", 2)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "/lookups/" in plan and "/dictionary/" not in plan and "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket#")
    # segments are searched too, by the dictionary; keys are of one part
    for i in (index, plain):
        i.update(spark.createDataFrame([(1, "thingy things"), (200, "thong")], "id long, body string"), "id", "body", "c")
    assert rows(index.terms_near("c", "body", "thing", 1)) == rows(plain.terms_near("c", "body", "thing", 1))
    with pytest.raises(ValueError, match="merge"):
        index.index_terms("c", "body")
    index.merge("c", "body")
    index.vacuum()
    assert not list((tmp_path / "keys/lookups").iterdir())
    index.index_terms("c", "body")
    assert rows(index.terms_like("c", "body", "*hing*")) == rows(plain.terms_like("c", "body", "*hing*"))
