"""A versioned registry of schemas and of the dependencies between datasets, kept as Parquet tables that are only appended to.

A version is stored with its flattened fields, in one row, so that questions to the fields of all schemas are scans. One writer at a
time is assumed. Reads are lazy tables; only a schema that a Python caller asks for is fetched.
"""

from __future__ import annotations

import hashlib
import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from terrane.plans.lineage import EDGES, column_edges

from . import schemas as S

FIELDS = "array<struct<ordinal:int,path:string,parent_path:string,name:string,type:string,nullable:boolean,comment:string>>"
VERSIONS = f"subject string, version int, schema_json string, fingerprint string, comment string, deleted boolean, registered_at timestamp, fields {FIELDS}"
STORED_EDGES = f"{EDGES}, stored_at timestamp"
DATASETS = "name string, location string, format string, subject string, version int, bound_at timestamp"


class Registry:
    """Schemas by subject and version, and the datasets that are bound to them."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if there else self.spark.createDataFrame([], schema)

    def _append(self, name: str, rows: list[tuple], schema: str) -> None:
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")

    # versions

    def register(self, subject: str, schema: T.StructType | DataFrame | str, comment: str | None = None, mode: str = "NONE") -> int:
        """The version of a schema under a subject: the latest if it is the same, else a new one.

        With a ``mode`` other than NONE, a schema that is not compatible with the latest version is refused.
        """
        new = S.as_schema(self.spark, schema)
        text = S.canonical(new)
        fingerprint = hashlib.sha256(text.encode()).hexdigest()
        every = self._table("versions", VERSIONS).where(F.col("subject") == subject)
        last = every.agg(F.max("version")).first()[0] or 0
        latest = self.versions(subject).orderBy(F.desc("version")).first()
        if latest and latest["fingerprint"] == fingerprint:
            return latest["version"]
        if latest and mode != "NONE":
            old = S.fields_frame(self.spark, [(subject, latest["version"], T.StructType.fromJson(json.loads(latest["schema_json"])))])
            bad = S.compatibility(S.diff(old, S.fields_frame(self.spark, [(subject, last + 1, new)])), mode).where("not ok").collect()
            if bad:
                raise ValueError(f"{subject}: not {mode} compatible: " + ", ".join(f"{r['path']} {r['change']}" for r in bad))
        self._append("versions", [(subject, last + 1, text, fingerprint, comment, False, datetime.now(UTC), S.flatten(new))], VERSIONS)
        return last + 1

    def deprecate(self, subject: str, version: int) -> None:
        """Hides a version by a tombstone row; its number is not given again."""
        self.schema(subject, version)
        self._append("versions", [(subject, version, None, None, None, True, datetime.now(UTC), None)], VERSIONS)

    def versions(self, subject: str | None = None) -> DataFrame:
        """Live versions: subject, version, schema_json, fingerprint, comment, registered_at."""
        return self._live(subject).drop("fields")

    def _live(self, subject: str | None = None) -> DataFrame:
        rows = self._table("versions", VERSIONS)
        if subject is not None:
            rows = rows.where(F.col("subject") == subject)
        gone = rows.where("deleted").select("subject", "version")
        return rows.where("not deleted").join(gone, ["subject", "version"], "left_anti").drop("deleted")

    def subjects(self) -> DataFrame:
        """subject, latest, n_versions."""
        return self.versions().groupBy("subject").agg(F.max("version").alias("latest"), F.count(F.lit(1)).alias("n_versions"))

    def latest(self) -> DataFrame:
        """The latest live version of each subject."""
        return self._latest().drop("fields")

    def _latest(self) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("subject").orderBy(F.desc("version")))
        return self._live().withColumn("rank", rank).where("rank = 1").drop("rank")

    def schema(self, subject: str, version: int | None = None) -> T.StructType:
        rows = self.versions(subject)
        row = (rows.orderBy(F.desc("version")) if version is None else rows.where(F.col("version") == version)).first()
        if row is None:
            raise KeyError(f"{subject} has no live version" + f" {version}" * (version is not None))
        return T.StructType.fromJson(json.loads(row["schema_json"]))

    # fields

    def fields(self, subject: str | None = None, version: int | None = None) -> DataFrame:
        """Rows per field of a version, of a subject's latest, or of every subject's latest."""
        rows = self._latest() if version is None else self._live().where(F.col("version") == version)
        if subject is not None:
            rows = rows.where(F.col("subject") == subject)
            if version is not None and rows.isEmpty():
                raise KeyError(f"{subject} has no live version {version}")
        return rows.select("subject", "version", F.inline("fields"))

    def find_fields(self, like: str | None = None, type: str | None = None, subject: str | None = None) -> DataFrame:
        return S.find_fields(self.fields(), like, type, subject)

    def diff(self, subject: str, v1: int, v2: int) -> DataFrame:
        return S.diff(self.fields(subject, v1), self.fields(subject, v2))

    def compatible(self, subject: str, v1: int, v2: int, mode: str) -> DataFrame:
        return S.compatibility(self.diff(subject, v1, v2), mode)

    def shared_fields(self) -> DataFrame:
        return S.shared_fields(self.fields())

    def type_summary(self) -> DataFrame:
        return S.type_summary(self.fields())

    # datasets

    def bind(self, name: str, location: str, format: str, subject: str, version: int | None = None) -> None:
        """Says that a physical table has a registered schema; of bindings of one name the last holds."""
        if version is None:
            live = self.latest().where(F.col("subject") == subject).select("version").first()
            if live is None:
                raise KeyError(f"{subject} has no live version")
            version = live["version"]
        self.schema(subject, version)
        self._append("datasets", [(name, location, format, subject, version, datetime.now(UTC))], DATASETS)

    def datasets(self) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("bound_at")))
        return self._table("datasets", DATASETS).withColumn("rank", rank).where("rank = 1").drop("rank")

    def validate(self, name: str) -> DataFrame:
        """Differences between the schema that a dataset is bound to (old) and that of its files (new)."""
        from terrane.sources.tables import infer

        d = self.datasets().where(F.col("name") == name).first()
        if d is None:
            raise KeyError(name)
        there = S.fields_frame(self.spark, [(d["subject"], d["version"], infer(self.spark, d["location"], d["format"]))])
        return S.diff(self.fields(d["subject"], d["version"]), there)

    # dependencies

    def declare_edge(self, src_dataset: str, src_field: str, dst_dataset: str, dst_field: str, job: str | None = None) -> None:
        """Says that a column depends on another, as a foreign key or a hand-written job makes it."""
        self.declare_edges([(src_dataset, src_field, dst_dataset, dst_field)], job)

    def declare_edges(self, edges: list[tuple[str, str, str, str]], job: str | None = None) -> None:
        self._append("edges", [(*e, "declared", job, datetime.now(UTC)) for e in edges], STORED_EDGES)

    def register_query(self, job: str, query: DataFrame, dst: str | None = None) -> None:
        """Stores the column edges of a query that makes ``dst`` (else: a dataset named as the job); they replace those stored for the job before.

        Columns are named by the registered subjects that the query reads, or by the tables' own names.
        """
        known = [r["subject"] for r in self.subjects().select("subject").toLocalIterator()]
        found = [tuple(r) for r in column_edges(query, dst or job, known, job=job).collect()]
        # a row without a source replaces the earlier ones of a query that has none now
        self._append("edges", [(*e, now) for now in [datetime.now(UTC)] for e in [*found, (None, None, dst or job, None, "value", job)]], STORED_EDGES)

    def edges(self) -> DataFrame:
        """All declared edges, and those of each query as registered last: what the functions of ``graph`` take as column edges."""
        rows = self._table("edges", STORED_EDGES)
        of_queries = rows.where("kind <> 'declared'")
        last = of_queries.groupBy("job").agg(F.max("stored_at").alias("stored_at"))
        kept = of_queries.join(last, ["job", "stored_at"], "left_semi").where("src_dataset is not null")
        return rows.where("kind = 'declared'").unionByName(kept).drop("stored_at").distinct()

    def table_edges(self) -> DataFrame:
        """src, dst: the same between datasets."""
        return self.edges().select(F.col("src_dataset").alias("src"), F.col("dst_dataset").alias("dst")).distinct()
