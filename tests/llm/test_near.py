"""The pipeline's near-duplicate stage against brute-force Jaccard similarity of five-word shingles."""

import random

import pytest

import corpus_pipeline as P
from terrane.llm import near

from .conftest import SCHEMA, words


def plain_shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain_near_rows(rows):
    """The rows that stay, for rows without repeated ids."""
    known = [r for r in rows if r["doc_id"] is not None]
    sets = [plain_shingles(r["text"]) for r in known]
    parent = list(range(len(known)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(known)):
        for j in range(i):
            small, large = sorted((len(sets[i]), len(sets[j])))
            if 5 * small >= 4 * large and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                x, y = top(i), top(j)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, r in enumerate(known):
        least[top(i)] = min(least.get(top(i), r["doc_id"]), r["doc_id"])
    return [r for r in rows if r["doc_id"] is None] + [r for i, r in enumerate(known) if r["doc_id"] == least[top(i)]]


def plain_near(rows):
    """(doc_id, text) of the rows that stay."""
    return sorted([(repr(r["doc_id"]), r["text"]) for r in plain_near_rows(rows)], key=repr)


def stayed(df):
    return sorted([(repr(r["doc_id"]), r["text"]) for r in df.collect()], key=repr)


def test_cases(spark, docs):
    distinct = docs.dropDuplicates(["doc_id", "text"])
    assert stayed(P.near(spark, distinct, "")) == plain_near(distinct.collect())


def test_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    wanted = plain_near(table.collect())
    assert len(wanted) < table.count()
    assert stayed(P.near(spark, table, "")) == wanted


@pytest.mark.parametrize("common", [0, 40])
def test_around_the_threshold(spark, common):
    """Copies with 1 to 9 of 150 words replaced, in chains and stars, on a shared passage."""
    rng, rows = random.Random(5), []
    shared = words(rng, common, 10**6)
    for g in range(30):
        last = words(rng, 150, 10**6).split()
        rows.append((100 * g, " ".join([*last, shared]), "en", "a", None))
        for i in range(1, 8):
            copy = list(last)
            for _ in range(rng.randrange(1, 10)):
                copy[rng.randrange(150)] = f"new{rng.random()}"
            rows.append((100 * g + i, " ".join([*copy, shared]), "en", "a", None))
            last = copy if g % 2 else last
    table = spark.createDataFrame(rows, SCHEMA)
    wanted = plain_near(table.collect())
    assert 30 < len(wanted) < 240
    assert stayed(P.near(spark, table, "")) == wanted


def test_pairs_of_long_texts(spark, monkeypatch):
    """Long texts that share a half, told by no sample: a pair comes up for that half, not for each of its shingles, nor each with each."""
    rng, rows, made = random.Random(8), [], []
    passage = words(rng, 800, 10**6)
    for i in range(40):
        rows.append((i, passage + " " + words(rng, 1000, 10**6), "en", "a", None))
    table = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(near, "COMMON", 0)
    true = near.candidates
    monkeypatch.setattr(near, "candidates", lambda rows, every: made.append(true(rows, every).count()) or true(rows, every))
    assert near.survivors(table).count() == 40
    # of all 780 pairs, whose 512 bits are full
    assert len(made) == 2 and made[1] < 80


@pytest.mark.parametrize("batch", [2, 3, 1000])
def test_shared_keeps_what_can_be_linked(spark, batch):
    """Every two sets that a key could link are there after the sieve, however lists lie in batches."""
    rng = random.Random(batch)
    rows = sorted({(k, rng.randrange(40), k % 3) for k in range(60) for _ in range(rng.randrange(1, 5))})
    rows = [(k, n, 5 + 3 * n, p) for k, n, p in rows]
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = [(r["key"], r["node"]) for r in near.shared(spark.createDataFrame(rows + rows[:9], "key long, node long, size long, pos int")).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    wanted = {(a[0], x) for a in rows for b in rows if a[0] == b[0] and a[1] != b[1] and 5 * min(a[2], b[2]) >= 4 * max(a[2], b[2]) and 9 * min(a[2] - a[3], b[2] - b[3]) >= 4 * (a[2] + b[2]) for x in (a[1], b[1])}
    assert wanted and wanted <= set(got) <= {r[:2] for r in rows}
    assert batch < 1000 or len(got) < len(rows)


def test_repeated_ids(spark):
    """A different text under the id of a near copy stays."""
    rng = random.Random(6)
    base = words(rng, 100, 10**6)
    other = words(rng, 100, 10**6)
    rows = [(1, base, "en", "a", None), (2, base + " end", "en", "a", None), (2, other, "en", "a", None), (None, base + " x", "en", "a", None)]
    assert stayed(near.survivors(spark.createDataFrame(rows, SCHEMA))) == sorted([("1", base), ("2", other), ("None", base + " x")])


def test_empty(spark, empty):
    assert near.survivors(empty).collect() == []


def test_wide_parity_loses_nothing():
    """Similar sets pass at whatever sizes, those well below the threshold don't."""
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 300, 513, 2000, 9000):
        base = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        for share, linked in ((0.0, True), (0.2, True), (0.5, None)):
            other = np.unique(np.concatenate([base[int(share * n) :], rng.integers(0, 2**63, 0 if linked else n // 2, dtype=np.uint64)]))
            both = len(np.intersect1d(base, other))
            similar = 9 * both >= 4 * (len(base) + len(other))
            passed = near.near_wide(near.wide_parity(base), near.wide_parity(other), len(base) + len(other))
            assert passed if similar else (n < 100 or not passed)
