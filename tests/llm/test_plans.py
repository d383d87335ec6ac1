"""Plans that the operators are meant to have."""

import re

import pytest

from terrane.llm import mixing, pii, sharding, winnowing


@pytest.fixture(scope="module")
def table(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_native_operators_run_no_python(table):
    for df in (mixing.mix_sources(table), winnowing.edited_fingerprints(table), winnowing.fingerprints(table), pii.pseudonymise(table, "k"), mixing.mixed_documents(table)):
        assert not re.search("Python|Pandas|Arrow", plan(df))


def test_no_shuffle(table):
    from pyspark.sql import functions as F

    for df in (pii.pseudonymise(table, "k"), winnowing.fingerprints(table), table.select(sharding.rendezvous(F.col("doc_id"), [1.0] * 24))):
        assert "Exchange" not in plan(df)


def test_texts_are_shuffled_once(table):
    text = plan(winnowing.edited_fingerprints(table, per_bucket=20))
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_bounds_are_one_literal(spark):
    from pyspark.sql import functions as F

    bounds = [-(2**63), *range(0, 40_000, 2), 2**63 - 1]
    df = spark.range(-3, 50).select("id", winnowing.bucket_of(F.col("id"), bounds).alias("b"))
    assert all(r["b"] == sum(x < r["id"] for x in bounds[:100]) for r in df.collect())


def test_columns_are_pruned(table):
    assert re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", plan(pii.pseudonymise(table, "k")))


def test_ranges_come_from_a_bounded_sample(spark, monkeypatch):
    """Next documents with ranges from some 50 ids of 3,000, negative, repeated and null ones among them."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(winnowing, "SAMPLE", 50)
    ids = [None, -7, *range(0, 3000, 1), 2999, 10**15]
    docs = spark.createDataFrame([(i, f"t{n}") for n, i in enumerate(ids)], "doc_id long, text string").repartition(5)
    rows, _ = winnowing.with_next(docs, per_bucket=20, most_buckets=10)
    assert rows.where("tail").count() < 20
    got = {r["text"]: r["next_text"] for r in rows.where(~F.col("tail")).collect()}
    for n, i in enumerate(ids[:-3]):
        assert got[f"t{n}"] == f"t{n + 1}" or i == 2999
    assert got[f"t{len(ids) - 1}"] == "t0" and len(got) == len(ids)
