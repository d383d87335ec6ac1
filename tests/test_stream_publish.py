"""A stream's batches put into an index: nothing dealt without need, nothing shuffled left behind, the same rows share by share."""

import glob
import os
import time

import pytest

from terrane.operators import search as Q
from terrane.sources import tables as IO
from terrane.streaming import index_stream as S

SCHEMA = "id int, body string"
BATCHES = [
    [(1, "a b a"), (2, "c sea"), (3, None), (None, "lost sea"), (6, "sea the sea")],
    [(1, "z sea"), (4, "q " * 40), (2, "..."), (5, ""), (7, "the")],
    [(1, "the last sea"), (3, "now the"), (7, None)],
]
LAST = {i: t for batch in BATCHES for i, t in batch}


@pytest.fixture(scope="module")
def batches(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("stream")
    for rows in BATCHES:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(top / "src"))
        S.index_stream(spark.readStream.schema(SCHEMA).parquet(str(top / "src")), "id", "body", str(top / "out"), str(top / "state")).awaitTermination()
    return str(top / "out")


def _held(index):
    rows = sorted((r["term"], str(r["doc_id"]), r["tf"], r["dl"], list(r["positions"]), r["bucket"]) for r in index.rows("c", "body").collect())
    docs = sorted((str(r["doc_id"]), r["dl"]) for r in index._docs("c", "body").collect())
    known = sorted((r["term"], r["df"], r["cf"]) for r in index.dictionary("c", "body").collect())
    f = index.figures("c", "body")
    return rows, docs, known, (f["n_docs"], f["n_tokens"], f["avg_dl"], f["id_type"])


@pytest.mark.parametrize("at_once, sent, buckets, old", [(1 << 30, 200_000, 4, False), (0, 200_000, 16, False), (0, 0, 5, False), (0, 200_000, 8, True)])
def test_published_as_added(spark, tmp_path, monkeypatch, batches, at_once, sent, buckets, old):
    """At once or by shares, with documents that come again sent or dealt, for numbers of buckets that SHARES doesn't divide, and of batches that no share was stored with."""
    monkeypatch.setattr(S, "AT_ONCE", at_once, raising=False)
    monkeypatch.setattr(S, "SENT", sent, raising=False)
    if old:
        for n in range(len(BATCHES)):
            rows = spark.read.parquet(f"{batches}/batch={n}")
            (rows.drop("share") if n != 1 else rows).write.parquet(f"{tmp_path}/out/batch={n}")
        batches = f"{tmp_path}/out"
    published, added = (Q.Index(spark, str(tmp_path / x), buckets=buckets) for x in ("published", "added"))
    S.publish(spark, batches, published, "c", "body")
    added.add(spark.createDataFrame(list(LAST.items()), SCHEMA), "id", ["body"], "c")
    assert _held(published) == _held(added)


def test_rows_of_one_batch_are_not_dealt(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one sea"), (2, "two"), (3, None)], SCHEMA)
    docs.write.parquet(str(tmp_path / "in"))
    S.index_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), "id", "body", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    rows = S.current(spark, str(tmp_path / "out"))
    assert sorted((r["term"], r["doc_id"]) for r in rows.collect()) == [("one", 1), ("sea", 1), ("two", 2)]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert sorted(rows.columns) == sorted(["corpus", "field", "bucket", "term", "doc_id", "tf", "dl", "positions"])


def _shuffled(spark):
    """Files of shuffles on disk, with their bytes."""
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f: os.stat(f).st_size for d in dirs for f in glob.glob(f"{d}/*/shuffle_*.data") if os.path.exists(f)}


def test_shuffles_go(spark, sf, tmp_path, monkeypatch):
    """What a batch, and each share of what is published, has shuffled is not kept; the session's own settings stay."""
    monkeypatch.setattr(S, "AT_ONCE", 0, raising=False)
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = _shuffled(spark), spark.conf.get(name)
    left = lambda: sum(n for f, n in _shuffled(spark).items() if f not in before)
    S.index_stream(IO.stream(spark, sf, "documents"), "doc_id", "text", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    most, write = [], Q.Index._write

    def watched(self, rows, part):
        for _ in range(50):  # files go a moment after the query
            if left() < held // 4:
                break
            time.sleep(0.1)
        most.append(left())
        return write(self, rows, part)

    held = sum(os.path.getsize(f) for f in glob.glob(f"{tmp_path}/out/batch=*/*.parquet"))
    monkeypatch.setattr(Q.Index, "_write", watched)
    S.publish(spark, str(tmp_path / "out"), Q.Index(spark, str(tmp_path / "index"), buckets=16), "documents", "text")
    assert max(most) < held // 4 and len(most) == S.SHARES
    assert spark.conf.get(name) == setting
