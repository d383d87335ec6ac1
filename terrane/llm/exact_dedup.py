"""Exact deduplication by a 128-bit content hash, with byte comparison inside each group.

Texts are equal when they are identical after every run of white space became one space. Rows are
grouped by (hash, text), so that two texts that merely share a hash stay two groups: the hash
deals the rows out and the bytes decide. The grouping combines on the map side, where a hot
text shrinks to one row a task before anything is shuffled. Members then find their group by the hash and SHA-256
of their text together, so that no text is shuffled a second time.

Defined cases: a null text is an empty text; rows repeated under one doc_id with equal texts are
one document, of which each row is reported; a null doc_id stays only if its whole group has none;
a very long text is grouped whole, like any other; of rows that tie for the smallest doc_id all have the same text;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, enclosed, text_of


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, " ")


def content_hash(text: Column) -> Column:
    """128 bits, as 16 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", hash128: Callable[[Column], Column] = content_hash, digest: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per distinct normalised text: h, sha, body, keep_id, group_size."""
    digest = digest or (lambda t: F.sha2(t.cast("binary"), 256))
    rows = docs.select(F.col(doc_id).alias("id"), normalised(text_of(text)).alias("body"))
    groups = rows.groupBy(hash128(F.col("body")).alias("h"), "body").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return groups.select("h", digest(F.col("body")).alias("sha"), "body", "keep_id", "group_size")


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", hash128: Callable[[Column], Column] = content_hash, digest: Callable[[Column], Column] | None = None, compare: bool = False) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    ``compare`` joins members to their group by the text as well as by the digests; it is needed only
    with digests weak enough to collide together, and tests use it so.
    """
    sha = digest or (lambda t: F.sha2(t.cast("binary"), 256))
    groups = exact_groups(docs, text, doc_id, hash128, digest).select(F.col("h").alias("gh"), F.col("sha").alias("gsha"), *([F.col("body").alias("gbody")] if compare else []), "keep_id", "group_size")
    rows = docs.select(F.col(doc_id).alias("doc_id"), normalised(text_of(text)).alias("body"))
    rows = rows.select("doc_id", hash128(F.col("body")).alias("h"), sha(F.col("body")).alias("sha"), *(["body"] if compare else []))
    match = (F.col("h") == F.col("gh")) & (F.col("sha") == F.col("gsha"))
    if compare:
        match = match & (F.col("body") == F.col("gbody"))
    return rows.join(groups, match).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def survivors(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: one of each group, and one of rows repeated under its doc_id."""
    key = lambda sha, id_: F.concat(sha, F.lit(":"), F.coalesce(id_.cast("string"), F.lit("")))
    keep = exact_groups(docs, text, doc_id).select(key(F.col("sha"), F.col("keep_id")).alias("keep"))
    rows, column, laid_out = enclosed(docs)
    rows = rows.withColumn("key", key(F.sha2(normalised(text_of(column(text))).cast("binary"), 256), column(doc_id)))
    stay = rows.join(keep, rows["key"] == keep["keep"], "left_semi")
    first = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    return laid_out(stay.withColumn("first", first).where("first = 1"))
