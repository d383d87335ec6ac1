"""Schemas as rows: flattening, differences between two schemas, and compatibility verdicts."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELD_COLUMNS = "subject string, version int, ordinal int, path string, parent_path string, name string, type string, nullable boolean, comment string"
MODES = ("NONE", "BACKWARD", "FORWARD", "FULL")

#: Widening steps that keep every value: whole numbers, fractions, and the whole numbers that a fraction's digits hold.
NUMERIC = ["tinyint", "smallint", "int", "bigint"]
EXACT = [("tinyint", "float"), ("smallint", "float"), ("tinyint", "double"), ("smallint", "double"), ("int", "double"), ("float", "double")]
#: Decimal digits that hold every value of an integral type.
DIGITS = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 20}


def as_schema(spark: SparkSession, schema: T.StructType | DataFrame | str) -> T.StructType:
    """A schema from itself, a table, or DDL text."""
    if isinstance(schema, DataFrame):
        return schema.schema
    if isinstance(schema, T.StructType):
        return schema
    return T.StructType.fromDDL(schema)


def canonical(schema: T.StructType) -> str:
    """JSON text that equal schemas share."""
    return json.dumps(schema.jsonValue(), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def flatten(schema: T.StructType) -> list[tuple]:
    """(ordinal, path, parent_path, name, type, nullable, comment) of every field, nested ones after their parent.

    Members of a struct are ``a.b``, the element of an array ``a.element``, key and value of a map ``a.key``, ``a.value``.
    """

    def below(kind: T.DataType, path: str) -> Iterator[tuple]:
        if isinstance(kind, T.StructType):
            for i, f in enumerate(kind.fields):
                yield from field(i, f"{path}.{f.name}" if path else f.name, path or None, f.name, f.dataType, f.nullable, (f.metadata or {}).get("comment"))
        elif isinstance(kind, T.ArrayType):
            yield from field(0, f"{path}.element", path, "element", kind.elementType, kind.containsNull, None)
        elif isinstance(kind, T.MapType):
            yield from field(0, f"{path}.key", path, "key", kind.keyType, False, None)
            yield from field(1, f"{path}.value", path, "value", kind.valueType, kind.valueContainsNull, None)

    def field(i: int, path: str, parent: str | None, name: str, kind: T.DataType, nullable: bool, comment: str | None) -> Iterator[tuple]:
        yield i, path, parent, name, kind.simpleString(), nullable, comment
        yield from below(kind, path)

    return list(below(schema, ""))


def fields_frame(spark: SparkSession, schemas: Iterable[tuple[str, int, T.StructType]]) -> DataFrame:
    """One row per field of each (subject, version, schema); see :data:`FIELD_COLUMNS`."""
    return spark.createDataFrame([(subject, version, *f) for subject, version, schema in schemas for f in flatten(schema)], FIELD_COLUMNS)


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change, old_type, new_type, old_nullable, new_nullable of two tables of fields: a row per difference.

    Changes: added, removed, retyped, nullability. A field that changes both type and nullability has a row for each. A
    renamed field is one removed and one added. Types of containers are compared by their kind alone; what is in
    them has rows of its own.
    """
    own = lambda t: F.when(F.col(t).startswith("struct<"), "struct").when(F.col(t).startswith("array<"), "array").when(F.col(t).startswith("map<"), "map").otherwise(F.col(t))
    a = old.select(F.col("path").alias("a_path"), F.col("type").alias("old_type"), F.col("nullable").alias("old_nullable"))
    b = new.select(F.col("path").alias("b_path"), F.col("type").alias("new_type"), F.col("nullable").alias("new_nullable"))
    both = a.join(b, F.col("a_path") == F.col("b_path"), "full_outer")
    changes = F.array_compact(
        F.array(
            F.when(F.col("a_path").isNull(), "added"),
            F.when(F.col("b_path").isNull(), "removed"),
            F.when(own("old_type") != own("new_type"), "retyped"),
            F.when(F.col("old_nullable") != F.col("new_nullable"), "nullability"),
        )
    )
    return both.select(F.coalesce("a_path", "b_path").alias("path"), F.explode(changes).alias("change"), "old_type", "new_type", "old_nullable", "new_nullable")


def readable_as(written: Column, read: Column) -> Column:
    """Whether every value of one type can be read as the other."""
    place = lambda c: F.array_position(F.array(*map(F.lit, NUMERIC)), c)
    digits = F.coalesce(*[F.when(written == t, F.lit(d)) for t, d in DIGITS.items()])
    precision = lambda c, i: F.regexp_extract(c, r"^decimal\((\d+),(-?\d+)\)$", i).try_cast("int")
    atomic = ~written.rlike(r"^(struct|array|map)<|^binary$|^void$")
    return F.coalesce(
        (written == read)
        | (written == "void")
        | (place(written) > 0) & (place(read) > place(written))
        | F.struct(written, read).isin(*[F.struct(F.lit(a), F.lit(b)) for a, b in EXACT])
        | (precision(read, 1) - precision(read, 2) >= digits)
        | (precision(written, 1) - precision(written, 2) <= precision(read, 1) - precision(read, 2)) & (precision(written, 2) <= precision(read, 2))
        | (written == "date") & read.isin("timestamp", "timestamp_ntz")
        | (read == "string") & atomic,
        F.lit(False),
    )


def compatibility(changes: DataFrame, mode: str) -> DataFrame:
    """The rows of :func:`diff` with mode and ok: whether the change is allowed.

    BACKWARD: readers of the new schema can read what was written with the old one. FORWARD: the other way round. FULL:
    both. NONE allows everything. A field may be missing from what is read only if it is nullable.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    change = F.col("change")
    backward = F.when(change == "added", F.col("new_nullable")).when(change == "removed", True).when(change == "retyped", readable_as(F.col("old_type"), F.col("new_type"))).otherwise(F.col("new_nullable"))
    forward = F.when(change == "added", True).when(change == "removed", F.col("old_nullable")).when(change == "retyped", readable_as(F.col("new_type"), F.col("old_type"))).otherwise(F.col("old_nullable"))
    ok = {"NONE": F.lit(True), "BACKWARD": backward, "FORWARD": forward, "FULL": backward & forward}[mode]
    return changes.select("*", F.lit(mode).alias("mode"), ok.alias("ok"))


def find_fields(fields: DataFrame, like: str | None = None, type: str | None = None, subject: str | None = None) -> DataFrame:
    """Fields whose name matches a regular expression, of a type, of a subject; what is None is any."""
    for condition in (F.col("name").rlike(like) if like else None, F.col("type") == type if type else None, F.col("subject") == subject if subject else None):
        if condition is not None:
            fields = fields.where(condition)
    return fields


def shared_fields(fields: DataFrame) -> DataFrame:
    """name, type, n_subjects, subjects of top-level columns that several subjects have."""
    top = fields.where("parent_path is null").groupBy("name", "type").agg(F.countDistinct("subject").alias("n_subjects"), F.array_join(F.array_sort(F.collect_set("subject")), ",").alias("subjects"))
    return top.where("n_subjects > 1")


def type_summary(fields: DataFrame) -> DataFrame:
    """subject, type, n of top-level columns, with totals by subject and of all (nulls)."""
    return fields.where("parent_path is null").rollup("subject", "type").agg(F.count(F.lit(1)).alias("n"))
