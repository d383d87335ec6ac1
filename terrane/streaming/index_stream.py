"""Keeping term rows up to date from a stream of documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terrane.functions.text import tokens
from terrane.operators.barriers import cut, drop_shuffles, tidy
from terrane.operators.search import Index, bucket_of, term_rows

#: A batch's files are in the order of so many shares of the terms, so that a share is read by itself.
SHARES = 8
#: Bytes of batches that are published at once, not share by share.
AT_ONCE = 32 << 20
#: Documents that have come again, up to which they are sent to the rows of all batches.
SENT = 200_000


def index_stream(docs: DataFrame, id: str, text: str, path: str, checkpoint: str, corpus: str = "default", buckets: int = 256, order: Sequence[str] = (), tokenizer=tokens) -> StreamingQuery:
    """Writes the term rows of each micro-batch under ``path``, one folder a batch; a batch that is tried again replaces its own.

    A document that comes again replaces its earlier rows when read by :func:`current`; of several rows in one batch the one with the
    greatest ``order`` columns counts, and among equals the greatest text. Starts at once and ends when what is there now is
    indexed; call again with the same ``checkpoint`` for what has come since.
    """

    def write(batch: DataFrame, number: int) -> None:
        drop_shuffles(batch.sparkSession)  # the stream's own session
        last = F.max(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(text).alias("text")))
        latest = batch.groupBy(id).agg(last.alias("last")).select(id, F.col("last.text").alias(text))
        # a document without a token still replaces its rows: it leaves one without a term
        rows = term_rows(latest, id, text, corpus, None, buckets, tokenizer, empty=True)
        rows.withColumn("share", _share_of(F.col("term"))).sortWithinPartitions("share").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/batch={number}")

    spark = docs.sparkSession
    files = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    there = lambda p: files(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(files(p))
    if there(path) and not there(checkpoint):
        raise ValueError(f"{path} holds batches of another checkpoint, which a new one would overwrite from the first on")
    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _share_of(term: Column) -> Column:
    return bucket_of(term, SHARES)


def _documents(rows: DataFrame) -> DataFrame:
    """doc_id, batch, dl of each document's latest batch, and if there are earlier ones (again)."""
    # rows of a document and batch are in a few files, so that little of them is left to deal
    each = rows.groupBy("doc_id", "batch").agg(F.max("dl").cast("long").alias("dl"))
    last = each.groupBy("doc_id").agg(F.max(F.struct("batch", "dl")).alias("last"), (F.count(F.lit(1)) > 1).alias("again"))
    return last.select("doc_id", "last.batch", "last.dl", "again")


def _live(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Term rows of each document's latest batch; nothing is joined if no document has come again, and no row is dealt if few have."""
    again = documents.where("again").select(F.col("doc_id").alias("of"), F.col("batch").alias("last"))
    n = again.count()
    rows = rows.where("term is not null")
    if n:
        rows = rows.join(F.broadcast(again) if n <= SENT else again, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("batch") < F.col("last")), "left_anti")
    return rows.drop("batch")


def current(spark, path: str) -> DataFrame:
    """The term rows of each document's latest batch. Which documents have come again is looked up at once, the rows are read later."""
    rows = spark.read.parquet(path)
    return _live(rows, cut(_documents(rows))).drop("share")


def publish(spark, path: str, index: Index, corpus: str, field: str) -> None:
    """Puts what a stream has indexed under ``path`` into an index, in place of what the field of the corpus held there.

    Batches are merged once here, not by each search. Larger ones are dealt share by share of the terms, and what is shuffled for a
    share goes before the next: on disk are the batches, the index and one share at most.
    """
    rows = tidy(spark).read.parquet(path)
    documents = cut(_documents(rows))
    live = _live(rows, documents).withColumn("bucket", bucket_of(F.col("term"), index.buckets))
    index.store(_shares(live) if _bytes(spark, path) > AT_ONCE else live, corpus, field, documents.select("doc_id", "dl"))


def _shares(rows: DataFrame) -> list[DataFrame]:
    """Rows of each share; of a number of buckets that SHARES divides, each bucket is in one."""
    # the stored share only spares reading, as rows written without it have none
    read = lambda i: rows.where((F.col("share") == i) | F.col("share").isNull()) if "share" in rows.columns else rows
    return [read(i).where(_share_of(F.col("term")) == i) for i in range(SHARES)]


def _bytes(spark, path: str) -> int:
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    return files.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(files).getLength()
