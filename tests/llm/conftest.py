import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, kinds=200):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


def cases():
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, near copies, one hot group, odd scripts."""
    rng = random.Random(3)
    rows = [
        (None, None, None, None),
        (None, "a text without an id", "en", "b"),
        (1, "", "en", "a"),
        (2, " \t\n ", "en", None),
        (3, "one", None, "a"),
        (4, "one", "en", ""),
        (4, "one", "en", ""),
        (5, "Two  Words", "de", "z"),
        (6, "Two\tWords", "de", "z"),
        (7, "two words", "de", "z"),
        (8, "漢字仮名交じり文 ÅÄÖ é́ \U0001f600 don't a.b ... x, <|endoftext|>", "ja", "a"),
        (9, "x" * 70_000, "en", "a"),
        (10, "1234 5678 !!", "en", "a"),
        (11, "no\x00nul\x1fmarks here end", "en", "a"),
    ]
    long = words(rng, 30_000)
    rows += [(20, long, "en", "b"), (21, long[:-1] + "!", "en", "b"), (22, long, "fr", "b")]
    base = words(rng, 120).split()
    for i in range(40):  # near copies
        w = list(base)
        w[rng.randrange(120)] = f"new{i}"
        rows.append((100 + i, " ".join(w), "en", "hot"))
    hot = words(rng, 60)
    rows += [(200 + i, hot, "en", "hot") for i in range(80)]  # a third of all rows
    for i in range(60):
        rows.append((400 + 7 * i, words(rng, rng.randrange(1, 300)), rng.choice(["en", "de", "fr"]), rng.choice("abc")))
    rows += [(2**40, "far id", "en", "a"), (-5, "negative id", "en", "a")]
    return [(i, t, l, s, None if t is None else len(t)) for i, t, l, s in rows]


@pytest.fixture(scope="session")
def rows():
    return cases()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The cases, with columns whose names operators might use for themselves."""
    plain = spark.createDataFrame(rows, SCHEMA)
    clashing = ("h", "body", "sha", "fp", "rep", "size", "bucket", "b", "tail", "key", "keep_id", "kept", "shard", "slot", "score", "lang_pred", "tokens", "batch", "taken", "component", "id", "place", "replaced", "grams", "ids", "owner", "held", "k", "m", "n", "v", "x", "row", "keep", "first", "gone", "copies", "places", "times", "of_hash", "c0", "c1", "__row", "__first", "__hash", "__times", "__copies", "__of", "__text", "a.b", "x`y", "two words")
    from pyspark.sql import functions as F

    return plain.repartition(3).withColumns({c: F.lit(7) for c in clashing})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
