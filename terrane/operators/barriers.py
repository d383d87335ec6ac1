"""Saying what is computed once, and cutting plans."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, inside one expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def computed(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """``keep`` and new columns that are computed once a row.

    Without it, a filter on a computed column is pushed below its computation with a copy of the expression, and a lambda that
    uses such a column can come to compute it for every element. Nothing is pushed through a generator's output.
    """
    made = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*keep, F.explode_outer(F.array(made)).alias("__made")).select(*keep, *[F.col(f"__made.{n}").alias(n) for n in columns])


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, ``spark.checkpoint.dir``.

    Only a local session may have none: it gets a temporary folder. On a cluster that would write to one machine's own disk, and
    is refused.
    """
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    context = spark.sparkContext
    now = context._jsc.sc().getCheckpointDir()
    if now.isEmpty():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="terrane-"))
        now = context._jsc.sc().getCheckpointDir()
    return now.get()


def drop_shuffles(session: SparkSession) -> None:
    """From now on what a query of the session has shuffled goes when the query ends, not when the driver happens to collect its garbage."""
    session.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def tidy(spark: SparkSession) -> SparkSession:
    """A session of its own with the settings of ``spark``, of whose queries no shuffle files stay behind."""
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    drop_shuffles(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, its lineage cut there.

    A lost executor then costs a read of shared files, not a new computation. The files go when nothing refers to them any more.
    """
    spark = df.sparkSession
    shared_folder(spark)
    # read by Spark when a checkpoint is made; only its own files of checkpoints out of use are concerned
    spark.sparkContext._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    return df.checkpoint(eager=True)
