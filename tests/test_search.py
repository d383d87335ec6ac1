import math
import random
import re

import pytest

from terrane.functions import text as X
from terrane.operators import search as Q

WORDS = ["the", "cat", "dog", "sat", "on", "mat", "größe", "x1"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(WORDS) + rng.choice(["", ",", "."]) for _ in range(rng.randrange(0, 30))), rng.choice(["a", "b"])) for i in range(60)]
    rows += [(100, None, "a"), (101, "", "b"), (102, "The CAT_sat", "a")]
    return rows, spark.createDataFrame(rows, "id int, body string, kind string").cache()


def plain(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def bm25(rows, terms):
    docs = {i: plain(t) for i, t, _ in rows}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    out = {}
    for i, w in docs.items():
        if set(w) & set(terms):
            out[i] = 0.0
            for t in terms:
                tf, df = w.count(t), sum(t in x for x in docs.values())
                if tf:
                    out[i] += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avg))
    return out


def phrase(words, p):
    return sum(words[i : i + len(p)] == p for i in range(len(words) - len(p) + 1))


def test_scan(corpus):
    rows, docs = corpus
    words = {i: plain(t) for i, t, _ in rows}
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    anyof, allof = ids(Q.scan_any(docs, "id", "body", ["cat", "x1"])), ids(Q.scan_all(docs, "id", "body", ["cat", "x1"]))
    assert anyof == sorted(i for i, w in words.items() if {"cat", "x1"} & set(w))
    assert set(allof) <= set(anyof) and allof == sorted(i for i, w in words.items() if {"cat", "x1"} <= set(w))
    assert ids(Q.scan_all(docs, "id", "body", ["the"], ["dog"])) == sorted(i for i, w in words.items() if "the" in w and "dog" not in w)
    got = {r["doc_id"]: r["hits"] for r in Q.scan_phrase(docs, "id", "body", ["the", "cat"]).collect()}
    assert got == {i: n for i, w in words.items() if (n := phrase(w, ["the", "cat"]))}
    near = {r["doc_id"]: r["pairs"] for r in Q.scan_near(docs, "id", "body", "cat", "mat", 3).collect()}
    want = {i: sum(abs(p - q) <= 3 for p, a in enumerate(w) for q, b in enumerate(w) if a == "cat" and b == "mat") for i, w in words.items()}
    assert near == {i: n for i, n in want.items() if n}
    scores = {r["doc_id"]: r["score"] for r in Q.scan_scores(docs, "id", "body", ["größe", "the"]).collect()}
    assert scores == pytest.approx(bm25(rows, ["größe", "the"]))
    assert {r["value"]: r["n"] for r in Q.facets(Q.scan_any(docs, "id", "body", ["cat"]), docs, "id", "kind").collect()} == {k: sum("cat" in words[i] for i, _, kk in rows if kk == k) for k in "ab"}
    best = Q.best_per(Q.scan_scores(docs, "id", "body", ["cat"], extra=["kind"]), "kind", 2).collect()
    assert sorted((r["kind"], r["rank"]) for r in best) == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]


def test_index(spark, corpus, tmp_path):
    rows, docs = corpus
    index = Q.Index(spark, str(tmp_path / "index"), buckets=4)
    index.add(docs, "id", ["body"], "c")
    index.add(docs.where("id < 5"), "id", ["body", "kind"], "other")
    words = {i: plain(t) for i, t, _ in rows}
    want = sorted(bm25(rows, ["cat", "größe"]).items(), key=lambda x: (-round(x[1], 4), x[0]))[:7]
    got = [(r["doc_id"], r["score"]) for r in index.search("c", "body", any=["cat", "größe"], k=7).collect()]
    assert [i for i, _ in got] == [i for i, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-4)
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    assert ids(index.search("c", "body", all=["cat", "mat"], none=["x1"], k=1000)) == sorted(i for i, w in words.items() if {"cat", "mat"} <= set(w) and "x1" not in w)
    where = spark.createDataFrame([(i,) for i in range(10)], "doc_id int")
    assert ids(index.search("c", "body", any=["cat"], k=1000, where=where)) == sorted(i for i, w in words.items() if "cat" in w and i < 10)
    for p in (["the", "cat"], ["cat", "cat"], ["mat", "the", "dog"]):
        assert {r["doc_id"]: r["hits"] for r in index.phrase("c", "body", p).collect()} == {i: n for i, w in words.items() if (n := phrase(w, p))}
    assert {r["term"] for r in index.terms_like("c", "body", "?at").collect()} == {"cat", "sat", "mat"} & set().union(*words.values())
    assert index.search("other", "kind", any=["a", "b"], k=100).count() == 5
    assert ids(index.search("c", "body", any=["cat"], k=None)) == sorted(i for i, w in words.items() if "cat" in w)
    assert ids(index.wildcard("c", "body", "?at")) == sorted(i for i, w in words.items() if {"cat", "sat", "mat"} & set(w))
    assert ids(index.fuzzy("c", "body", "dig", 1)) == sorted(i for i, w in words.items() if "dog" in w)
    want = {i: sum(abs(p - q) <= 3 for p, a in enumerate(w) for q, b in enumerate(w) if a == "cat" and b == "mat") for i, w in words.items()}
    assert {r["doc_id"]: r["pairs"] for r in index.near("c", "body", "cat", "mat", 3).collect()} == {i: n for i, n in want.items() if n}
    with pytest.raises(ValueError, match="already"):
        index.add(docs, "id", ["body"], "c")
    before = [tuple(r) for r in index.search("other", "body", any=["cat"], k=99).collect()]
    index.add(docs.where("id >= 5"), "id", ["body"], "c", replace=True)
    assert ids(index.search("c", "body", any=["cat"], k=None)) == sorted(i for i, w in words.items() if "cat" in w and i >= 5)
    assert index.figures("c", "body")["n_docs"] == sum(i >= 5 for i in words)
    index.vacuum()
    assert [tuple(r) for r in index.search("other", "body", any=["cat"], k=99).collect()] == before
    assert sum(1 for _ in (tmp_path / "index/terms").iterdir()) == 3
    index.add(docs.where("1 = 0"), "id", ["body"], "none")
    assert index.search("none", "body", any=["cat"]).count() == 0
    with pytest.raises(KeyError, match="not in the index"):
        index.search("nothing", "body", any=["cat"])
    index.add(spark.createDataFrame([(1, "图书馆的藏书与检索方法"), (2, "检查索引")], "id int, text string"), "id", ["text"], "cjk", tokenizer=X.bigrams)
    assert ids(index.search("cjk", "text", any=["检索"])) == [1] and ids(index.phrase("cjk", "text", ["藏书", "书与"])) == [1]
    plan = index.rows("c", "body", ["cat"])._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1]


def test_dictionary(spark):
    terms = spark.createDataFrame([("thing", 5), ("think", 7), ("thin", 7), ("th_ng", 1), ("größe", 2)], "term string, df int")
    assert {r["term"] for r in Q.like(terms, "th?ng").collect()} == {"thing", "th_ng"}
    assert {r["term"] for r in Q.like(terms, "th_ng").collect()} == {"th_ng"}
    assert {(r["term"], r["distance"]) for r in Q.fuzzy(terms, "thing", 1).collect()} == {("thing", 0), ("think", 1), ("thin", 1), ("th_ng", 1)}
    assert [r["term"] for r in Q.suggest(terms, "thi", 2).collect()] == ["thin", "think"]


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    from pyspark.sql import functions as F

    assert one(X.identifier_tokens(F.lit("o_orderKey2Name"))) == ["o", "order", "key2", "name"]
    assert one(X.bigrams(F.lit("元数 据"))) == ["元数", "数据"] and one(X.bigrams(F.lit("a"))) == ["a"] and one(X.bigrams(F.lit(""))) == []
    assert one(X.snippet(F.lit("one TWO three"), "two", 2, 6)) == "e TWO " and one(X.snippet(F.lit("x"), "two")) is None
    assert one(X.highlight(F.lit("cat catalog Cat"), "cat")) == "<cat> catalog <Cat>"


def test_stream(spark, tmp_path):
    from terrane.streaming.index_stream import current, index_stream, publish

    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    def add(*rows):
        spark.createDataFrame(rows, "id int, body string").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("id int, body string").parquet(src)
        index_stream(stream, "id", "body", out, state).awaitTermination()
        return {(r["doc_id"], r["term"], r["tf"]) for r in current(spark, out).collect()}

    assert add((1, "a b a"), (2, "c")) == {(1, "a", 2), (1, "b", 1), (2, "c", 1)}
    assert add((1, "z"), (3, "q")) == {(1, "z", 1), (2, "c", 1), (3, "q", 1)}
    assert add((2, "...")) == {(1, "z", 1), (3, "q", 1)}
    assert add((4, "a"), (4, "b b"), (5, "x"), (5, None)) == {(1, "z", 1), (3, "q", 1), (4, "b", 2), (5, "x", 1)}
    index = Q.Index(spark, str(tmp_path / "index"), buckets=4)
    publish(spark, out, index, "c", "body")
    assert index.figures("c", "body")["n_docs"] == 5 and [r["doc_id"] for r in index.search("c", "body", any=["q", "b"], k=None).orderBy("doc_id").collect()] == [3, 4]
    assert add((4, "q")) and publish(spark, out, index, "c", "body") is None
    assert [r["doc_id"] for r in index.search("c", "body", any=["q", "b"], k=None).orderBy("doc_id").collect()] == [3, 4]


def test_pairs_compute_their_text_once(spark):
    """Pairs of characters beyond ASCII and the basic plane; the text without white space stands once in the expression, outside of what is done for each pair."""
    from pyspark.sql import functions as F

    made = X.bigrams("t")
    rows = [("東京 都", ["東京", "京都"]), ("a", ["a"]), ("", []), (None, None), ("\U0001f600bé \tÄ", ["\U0001f600b", "bé", "éä"]), (" \n", [])]
    assert [r[0] for r in spark.createDataFrame([(t,) for t, _ in rows], "t string").select(made).collect()] == [want for _, want in rows]
    assert made._jc.toString().count("regexp_replace") == 1
    assert spark.range(1).select(F.repeat(F.lit("ab é"), 50_000).alias("t")).select(F.size(X.bigrams("t"))).first()[0] == 149_999


def test_pairs_of_documents_that_share_an_id(spark, tmp_path):
    from terrane.queries import f18_cjk_bigrams

    for name, ids in (("apart", (1, 2, 3)), ("shared", (1, 1, 3))):
        rows = [(i, t, "", "") for i, t in zip(ids, ("aab", "aa", None), strict=True)]
        spark.createDataFrame(rows, "doc_id int, text string, lang string, source string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
    got = {name: sorted(tuple(r) for r in f18_cjk_bigrams(spark, f"{tmp_path}/{name}").collect()) for name in ("apart", "shared")}
    assert got == {"apart": [("aa", 2, 2), ("ab", 1, 1)], "shared": [("aa", 2, 1), ("ab", 1, 1)]}


def test_term_rows_are_cut_behind_the_generator(spark):
    """Rows by term and document of odd texts; slices are not taken inside of a lambda, which interprets them."""
    docs = spark.createDataFrame([(1, "b a b"), (2, ""), (3, None), (None, "x"), (5, ".."), (1, "a")], "doc_id int, text string")
    rows = Q.term_rows(docs, "doc_id", "text", buckets=1)
    got = sorted(((r["doc_id"] or 0), r["term"], r["tf"], r["dl"], r["positions"]) for r in rows.collect())
    assert got == [(0, "x", 1, 1, [0]), (1, "a", 1, 1, [0]), (1, "a", 1, 3, [1]), (1, "b", 2, 3, [0, 2])]
    assert "posexplode(starts" in rows._jdf.queryExecution().optimizedPlan().toString()
