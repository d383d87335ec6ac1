"""Documents of a stored index replaced, added and deleted, against an index of what is left."""

import random

import pytest

from terrane.functions.text import tokens
from terrane.operators import search as Q
from terrane.streaming.index_stream import index_stream


def text(rng):
    return " ".join(rng.choice("the of sea SEA, tree x1 über".split()) for _ in range(rng.randrange(12)))


def answers(index):
    got = index.search("c", "body", any=["the", "sea"], none=["tree"], k=None)
    like = index.wildcard("c", "body", "s*")
    figures = index.figures("c", "body")
    return (
        sorted(tuple(r) for r in got.collect()), sorted(tuple(r) for r in like.collect()), sorted(tuple(r) for r in index.phrase("c", "body", ["the", "sea"]).collect()),
        sorted((r["term"], r["df"], r["cf"]) for r in index.dictionary("c", "body").collect()), figures["n_docs"], figures["n_tokens"],
    )


def test_rounds_of_updates(spark, tmp_path, monkeypatch):
    """Five rounds, more than are kept apart: replaced, new, emptied and deleted documents, some again and again."""
    monkeypatch.setattr(Q, "TIER", 3)
    rng = random.Random(9)
    held = {i: text(rng) for i in range(60)}
    frame = lambda rows: spark.createDataFrame(sorted(rows.items()), "id long, body string")
    index = Q.Index(spark, str(tmp_path / "index"), buckets=4)
    index.add(frame(held), "id", ["body"], "c")
    first = {f: f.stat().st_mtime_ns for f in (tmp_path / "index" / "terms").rglob("*.parquet")}
    for round_ in range(Q.TIER + 2):
        if round_ % 3 == 2:
            gone = rng.sample(range(70), 6)
            index.delete(spark.createDataFrame([(i,) for i in gone], "id long"), "c", "body")
            held = {i: t for i, t in held.items() if i not in gone}
        else:
            new = {rng.randrange(75): text(rng) if rng.random() < 0.8 else "" for _ in range(5)}
            index.update(frame(new), "id", "body", "c")
            held |= new
        assert len(index.figures("c", "body")["segments"]) <= Q.TIER
        if round_ in (2, Q.TIER + 1):
            fresh = Q.Index(spark, str(tmp_path / f"fresh{round_}"), buckets=4)
            fresh.add(frame(held), "id", ["body"], "c")
            assert answers(index) == answers(fresh), round_
    # nothing that was stored before is rewritten
    assert {f: f.stat().st_mtime_ns for f in first} == first
    index.merge("c", "body")
    assert answers(index) == answers(fresh) and not index.figures("c", "body")["segments"]
    index.vacuum()
    assert answers(index) == answers(fresh) and len(list((tmp_path / "index" / "terms").iterdir())) == 1


def test_updates_of_nothing(spark, tmp_path):
    index = Q.Index(spark, str(tmp_path), buckets=2)
    none = spark.createDataFrame([], "id long, body string")
    index.add(none, "id", ["body"], "c")
    index.update(none, "id", "body", "c")
    index.delete(none.select("id"), "c", "body")
    index.update(spark.createDataFrame([(1, "the sea"), (1, "the"), (2, None)], "id long, body string"), "id", "body", "c")
    assert [r["doc_id"] for r in index.search("c", "body", any=["sea", "the"]).collect()] == [1] and index.figures("c", "body")["n_docs"] == 2
    with pytest.raises(KeyError):
        index.update(none, "id", "other", "c")


def test_term_stats(spark):
    rows = [(1, "The sea, the SEA"), (2, "sea"), (3, None), (4, " . "), (5, ""), (5, "über ÜBER 5x")]
    docs = spark.createDataFrame(rows, "id long, body string")
    key = lambda df: sorted((r["term"], r["df"], r["cf"], r["bucket"]) for r in df.collect())
    assert key(Q.term_stats(docs, "id", "body")) == key(Q.dictionary(Q.term_rows(docs, "id", "body")))
    assert [r[0] for r in docs.select(tokens("body")).collect()] == [["the", "sea", "the", "sea"], ["sea"], None, [], [], ["über", "über", "5x"]]


def test_streams_do_not_overwrite(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one")], "id long, body string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    index_stream(stream(), "id", "body", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    index_stream(stream(), "id", "body", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    with pytest.raises(ValueError, match="another checkpoint"):
        index_stream(stream(), "id", "body", str(tmp_path / "out"), str(tmp_path / "state2"))
