"""Pieces shared by the training-data operators: input shaping, lineage cuts, distributed running totals.

Conventions that hold for every operator of this package:

* an operator reads only the columns it names, so further columns of the input, whatever they
  are called, can neither clash with its own nor reach its result;
* a null text counts as an empty text unless an operator says otherwise;
* a null ``doc_id`` is a value like any other and sorts first.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrane.operators.barriers import cut, let, shared_folder
from terrane.sources.tables import spread

__all__ = ["SPACE", "WORD", "Workspace", "cut", "documents", "enclosed", "held_out_of", "learns", "let", "running_total", "small_batches", "text_of", "word_count"]

#: White space as the contracts define it: the space and the five ASCII control characters.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


class Workspace:
    """Tables in the shared folder that live as long as one computation."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.name = spark, f"terrane_{uuid.uuid4().hex}"
        self.path = f"{shared_folder(spark)}/{self.name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def table(self, df: DataFrame, name: str, by: str) -> DataFrame:
        df.write.partitionBy(by).parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def bucketed(self, df: DataFrame, name: str, by: str) -> DataFrame:
        """Dealt by ``by`` once, as the session deals shuffles, so that joins by it don't deal it again."""
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.bucketBy(buckets, by).option("path", f"{self.path}/{name}").saveAsTable(f"{self.name}_{name}")
        return self.spark.table(f"{self.name}_{name}")

    def drop(self) -> None:
        for t in self.spark.catalog.listTables(pattern=f"{self.name}_*"):
            self.spark.sql(f"DROP TABLE IF EXISTS `{t.name}`")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives executors this package, once per application, whether or not they could import it from elsewhere."""
    import terrane

    context, root = spark.sparkContext, Path(terrane.__path__[0])
    if context.applicationId in _shipped or not root.is_dir():
        return
    path = Path(tempfile.mkdtemp(prefix="terrane-")) / f"terrane-{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> None:
    """Readies executors for Python: ships the package, and bounds what one Arrow batch holds, in rows and bytes, whatever the length of the texts."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def text_of(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def enclosed(docs: DataFrame) -> tuple[DataFrame, Callable[[str], Column], Callable[[DataFrame], DataFrame]]:
    """The rows of ``docs``, each in one column ``row``; what gives a column of them by its name; and what lays the rows out again.

    So an operator that keeps rows can add columns of any name, and the input's may have any: those of the operator, dots, backticks.
    """
    names = docs.columns
    places = docs.toDF(*[f"c{i}" for i in range(len(names))])
    return (
        places.select(F.struct(*places.columns).alias("row")),
        lambda name: F.col(f"row.c{names.index(name)}"),
        lambda rows: rows.select("row.*").toDF(*names),
    )


def word_count(text: Column) -> Column:
    """Number of maximal runs of other than white space, as a long, without building the words."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def learns(doc_id: Column, modulus: int, held_out: int = 2) -> Column:
    """True for documents that models may learn from; a null id is learned from."""
    return ~held_out_of(doc_id, modulus, held_out)


def held_out_of(doc_id: Column, modulus: int, held_out: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == held_out, F.lit(False))


def running_total(df: DataFrame, group: list[str], bucket: str, order: list[Column], value: str, out: str, total: str, about: DataFrame | None = None) -> DataFrame:
    """Adds ``out``, the sum of ``value`` over the rows before in the group, and ``total``, the group's sum.

    A group may hold a third of all rows, so no task ever sees a whole one: rows are dealt by
    (group, bucket), summed up inside the bucket, and shifted by the sum of the buckets before.
    ``bucket`` numbers the buckets of a group in the wanted order; ``order`` holds inside a bucket.
    ``group`` columns must not be null. Only per-bucket sums meet per group. ``about``: one row a group, with
    columns to add, which meets the sums, so that no join deals all rows of a group to one task.
    """
    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    shifts = sums.select(
        *[F.col(c).alias(f"__{c}") for c in (*group, bucket)],
        F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__shift"),
        F.sum("__sum").over(Window.partitionBy(*group)).alias(total),
    )
    if about is not None:
        shifts = shifts.join(about.withColumnsRenamed({c: f"__{c}" for c in group}), [f"__{c}" for c in group])
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("__in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    match = [F.col(c) == F.col(f"__{c}") for c in (*group, bucket)]
    joined = rows.join(shifts, match)
    return joined.withColumn(out, F.col("__in") + F.col("__shift")).drop("__in", "__shift", *[f"__{c}" for c in (*group, bucket)])
