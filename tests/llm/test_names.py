"""Operators that keep rows give back all columns as they were, whatever they are called."""

import corpus_pipeline
from terrane.llm import exact_dedup, langid, mixing, near


def test_columns_pass_through(spark, docs):
    languages, prototypes = langid.learn(docs)
    kept = {
        "exact": exact_dedup.survivors(docs),
        "mixed": mixing.mixed_documents(docs),
        "near": near.survivors(docs),
        "identified": langid.keep_identified(docs, languages, prototypes),
    }
    given = ["doc_id", "text", "lang", "source", "n_chars"]
    for name, df in kept.items():
        assert df.columns == docs.columns, name
        rows = df.collect()
        assert rows and all(set(r[len(given) :]) == {7} for r in rows), name
        assert {tuple(r[: len(given)]) for r in rows} <= {tuple(r[: len(given)]) for r in docs.collect()}, name


def test_stages_in_a_row(spark, docs, sf):
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, sf)
        assert rows.columns == docs.columns, name
    assert all(set(r[5:]) == {7} for r in rows.collect())
