"""Reading tables, and the schemas of files, in the formats that this Spark has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FORMATS = ("parquet", "orc", "json", "csv", "text")


def read(spark: SparkSession, path: str, format: str = "parquet", schema: T.StructType | str | None = None, **options) -> DataFrame:
    if format not in FORMATS:
        raise ValueError(f"format is one of {', '.join(FORMATS)}")
    reader = spark.read.options(**options)
    return (reader.schema(schema) if schema is not None else reader).format(format).load(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as the cluster has cores, for tables of a few files that can't be split.

    Tables of more partitions, as all large ones are, stay as they are, unshuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def infer(spark: SparkSession, path: str, format: str = "parquet", **options) -> T.StructType:
    """The schema of files. Parquet and ORC keep it in their footers; JSON and CSV have to be read for it."""
    if format == "csv":
        options = {"header": True, "inferSchema": True} | options
    return read(spark, path, format, **options).schema


def write(df: DataFrame, path: str, format: str = "parquet", mode: str = "error", partition_by: tuple[str, ...] = ()) -> None:
    if format not in FORMATS:
        raise ValueError(f"format is one of {', '.join(FORMATS)}")
    df.write.mode(mode).partitionBy(*partition_by).format(format).save(path)


def register_views(spark: SparkSession, sf_dir: str, names: list[str]) -> None:
    """Temporary views of Parquet tables in a folder."""
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder as a stream of its files, be the table a file or a folder of files."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(there).isDirectory():
        return spark.readStream.schema(schema).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
