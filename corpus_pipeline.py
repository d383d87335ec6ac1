"""From raw documents to packed sequences: each stage reads what the one before it wrote.

1. ``language_id`` learns languages from the labelled documents that are not held out and drops documents whose
   language can't be determined: null texts, texts without letters, and texts unlike every language learned.
2. ``exact_dedup`` keeps one document of each group of equal texts.
3. ``simhash_dedup`` keeps one document, that of smallest doc_id, of each group of near copies: texts linked by a Jaccard
   similarity of 0.8 or more between their five-word shingles, all of them found and each link confirmed. The name is op8's, whose
   place the stage takes; its fingerprints are too short to find such pairs (see ``terrane/llm/near.py``).
4. ``mix_sources`` takes each remaining document as often as its source's share allows, up to three times.
5. ``curve_packing`` packs what was taken into sequences of 4096 tokens; it returns their pieces.

All but the last return the columns of ``documents``. No stage before the fourth repeats or changes a row.

Defined cases: a null or empty text goes in the first stage, which can't tell its language; a very long text is judged, linked and packed
whole; of rows that repeat, the second stage keeps one a text; a null doc_id never makes another document go; ties are settled as the operators
say; an empty table gives an empty result; further columns stay until the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm import exact_dedup, langid, mixing, near as near_dedup, packing
from terrane.llm.common import Workspace, cut, documents, learns


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    languages, prototypes = langid.learn(docs.where(learns(F.col("doc_id"), 4)))
    return langid.keep_identified(docs, languages, prototypes)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.survivors(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.survivors(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("simhash_dedup", near),
    ("mix_sources", mix),
    ("curve_packing", packed),
]

#: Language prototypes, Hamming search and tokenizing are beyond SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the last stage returns, over the whole of ``documents``."""
    docs, space = documents(spark, sf_dir), Workspace(spark)
    try:
        for name, stage in STAGES:
            out = stage(spark, docs, sf_dir)
            docs = space.write(out, name) if stage is not STAGES[-1][1] else cut(out)
        return docs
    finally:
        space.drop()
