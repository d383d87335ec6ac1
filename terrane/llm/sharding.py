"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Every shard bids for a key with ``-ln(u) / weight``, u a hash of (key, shard) in (0, 1); the lowest
bid wins. A further shard only wins keys, it never moves one between the others, and a shard wins in
proportion to its weight. Keys and shard numbers alone decide, so the placement needs no shuffle and no
state. Only slots, gapless numbers inside a shard, need one: they come from a
running count over buckets of a shard, named by key and text, so that no shard and no key that many different texts bear is ever one task.

Defined cases: a null text has no bytes, a very long one has all of its; a null key is the key '' ; equal keys share a shard, and
rows repeated have a slot each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running_total, text_of

#: Hex digits of the hash that make u: 48 bits, exact in a double.
DIGITS = 12


def unit_hash(text: Column) -> Column:
    """A number strictly between 0 and 1."""
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("double") + 0.5) / float(16**DIGITS)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard, from 0, that wins ``key``; ties go to the smaller number."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    bids = [F.struct((-F.ln(unit_hash(F.concat(text, F.lit(f":{i}")))) / float(w)).alias("bid"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]
    return (F.least(*bids) if len(bids) > 1 else bids[0])["shard"]


def grown(key: Column, shard: Column, weights: Sequence[float], more: float = 1.0) -> Column:
    """The shard of ``key`` once a further shard of weight ``more`` stands after the others."""
    return rendezvous(key, [*weights, more])


def place(docs: DataFrame, weights: Sequence[float] = (1.0,) * 24, more: float = 1.0, buckets: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per record: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    body = text_of(text)
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col(key), weights).alias("shard"),
        rendezvous(F.col(key), [*weights, more]).alias("grown_shard"),
        F.md5(F.concat_ws(":", F.lit("slot"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.crc32(body.cast("binary"))).cast("binary")).alias("slot_hash"),
        F.lit(1).alias("one"),
    ).withColumn("bucket", F.conv(F.substring("slot_hash", 1, 8), 16, 10).cast("long") % buckets)
    placed = running_total(rows, ["shard"], "bucket", [F.col("slot_hash"), F.col("doc_id"), F.col("text_crc32"), F.col("size")], "one", "slot", "shard_rows")
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, weights: Sequence[float] = (1.0,) * 24, key: str = "doc_id", format: str = "parquet") -> None:
    """Writes ``docs`` with all their columns into folders shard=0, shard=1 ...

    Rows are dealt by shard into files of about the session's advisory partition size: adaptive execution splits what is more than
    that, be it a large shard or a key that repeats, over several tasks.
    """
    if "shard" in (c.lower() for c in docs.columns):
        raise ValueError("the input already has a column named shard")
    rows = docs.withColumn("shard", rendezvous(F.col(key), weights))
    rows.hint("rebalance", "shard").write.mode("error").partitionBy("shard").format(format).save(path)
