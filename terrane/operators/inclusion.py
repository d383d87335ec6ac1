"""Inclusion dependencies between the columns of tables, found in their values, and the foreign keys among them.

A column is included in another if each of its values occurs there; values are compared within kinds (whole numbers of any width, text,
days, moments, decimals), nulls don't count, and a column without values is included in nothing. Discovery takes three passes over the tables, of
ever fewer columns (after De Marchi, Lopes and Petit, "Unary and n-ary inclusion dependency discovery in relational databases", 2009):

1. a sketch of each column: its bounds, and a sample of its values by their hashes;
2. which columns hold the sampled values: what holds all samples of a column, and reaches as far as it, can include it;
3. the values of the columns left, grouped by value, with a bit for each column that holds it: a candidate that as many values as the column has
   agree on includes it.

Columns are never paired with each other: candidates come from the values that columns share. Every pass is a union of scans that read the columns
in question only; values longer than ``LONG`` bytes are compared by their SHA-256 in the third.

Scale: the first pass shuffles ``SAMPLES`` rows a task and column at most. Sampled values are a table of columns x ``SAMPLES`` rows, broadcast, so that the second
shuffles what of them each task has seen. The third shuffles each distinct value once a task, in whichever and how many columns it stands there, so no value
is a hot key; what leaves it is a row for each set of columns that have a value in common.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .barriers import cut

SAMPLES = 8
LONG = 64
#: Columns that one long has bits for.
BITS = 62
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FOUND = "src_dataset string, src_field string, dst_dataset string, dst_field string, values long, src_values long"
PREFIX = "^[a-z]{1,2}_"

Columns = list[tuple[str, str]]


def kind_of(type: T.DataType) -> str | None:
    """What a column's values can be compared with; None for what no key is made of: fractions, booleans, bytes, containers."""
    if isinstance(type, WHOLE):
        return "whole"
    if isinstance(type, T.DecimalType):
        return "whole" if type.scale == 0 else f"decimal {type.scale}"
    return {T.StringType: "text", T.DateType: "day", T.TimestampType: "moment", T.TimestampNTZType: "moment without zone"}.get(type.__class__)


def columns_of(tables: dict[str, DataFrame]) -> Columns:
    """(table, column) of all top-level columns that have a kind."""
    return [(t, f.name) for t, df in tables.items() for f in df.schema if kind_of(f.dataType)]


def _kinds(tables: dict[str, DataFrame], columns: Columns, named: bool) -> list[int]:
    """A number for each column: those of one number are compared, which are of one kind and, with ``named``, of one bare name."""
    keys = [(kind_of(tables[t].schema[c].dataType), bare(c) if named else "") for t, c in columns]
    numbers = {k: i for i, k in enumerate(sorted(set(keys)))}
    return [numbers[k] for k in keys]


def _values(tables: dict[str, DataFrame], columns: Columns, kinds: list[int], about: dict[int, list[Column]]) -> DataFrame:
    """kind, value and what is said about it, of some of the columns by their numbers, nulls left out."""
    parts = []
    for t, df in tables.items():
        place = {f.name: i for i, f in enumerate(df.schema)}
        own = [(i, c) for i, (table, c) in enumerate(columns) if table == t and i in about]
        if own:
            # one generator a table, and names by place, so that any column name will do
            cells = [F.struct(F.lit(kinds[i]).alias("kind"), F.col(f"c{place[c]}").cast("string").alias("value"), *about[i]) for i, c in own]
            parts.append(df.toDF(*[f"c{i}" for i in range(len(df.columns))]).select(F.inline(F.array(*cells))))
    return reduce(DataFrame.unionByName, parts).where("value is not null")


def sketches(tables: dict[str, DataFrame], columns: Columns, named: bool = False) -> DataFrame:
    """c, kind, least, greatest, samples of each column that has values, by its number in the list.

    Samples are the least hashes in each of ``SAMPLES`` parts of all hashes. Bounds are in the order of whole numbers, and of hashes for all else:
    any order that goes by the value alone will do.
    """
    whole = [kind_of(tables[t].schema[c].dataType) == "whole" for t, c in columns]
    about = {i: [F.lit(i).alias("c"), F.lit(whole[i]).alias("whole")] for i in range(len(columns))}
    rows = _values(tables, columns, _kinds(tables, columns, named), about).withColumn("h", F.xxhash64("value"))
    at = F.coalesce(F.when(F.col("whole"), F.col("value").try_cast("bigint")), F.col("h"))
    # a row a column, part of the hashes and task is shuffled
    parts = rows.groupBy("c", "kind", F.pmod("h", F.lit(SAMPLES)).alias("part")).agg(F.min("h").alias("h"), F.min(at).alias("least"), F.max(at).alias("greatest"))
    return parts.groupBy("c", "kind").agg(F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.collect_list("h").alias("samples"))


def candidates(tables: dict[str, DataFrame], columns: Columns, sketched: DataFrame, named: bool = False) -> DataFrame:
    """c, in_c: columns that hold all samples of another and reach as far both ways."""
    asked = sketched.select("c", "kind", F.size("samples").alias("wanted"), "least", "greatest", F.explode("samples").alias("h"))
    rows = _values(tables, columns, _kinds(tables, columns, named), {i: [F.lit(i).alias("in_c")] for i in range(len(columns))}).select("in_c", "kind", F.xxhash64("value").alias("h"))
    # as many rows as columns have samples: values pass by them where they are read
    held = rows.join(F.broadcast(asked.select("kind", "h").distinct()), ["kind", "h"], "left_semi").distinct()
    both = asked.join(held, ["kind", "h"]).where("c <> in_c")
    whole = both.groupBy("c", "in_c", "least", "greatest", "wanted").agg(F.count(F.lit(1)).alias("found")).where("found = wanted")
    reach = sketched.select(F.col("c").alias("in_c"), F.col("least").alias("from"), F.col("greatest").alias("to"))
    return whole.join(reach, "in_c").where("from <= least and greatest <= to").select("c", "in_c")


def confirmed(tables: dict[str, DataFrame], columns: Columns, possible: DataFrame, named: bool = False) -> DataFrame:
    """src_dataset, src_field, dst_dataset, dst_field, values, src_values: candidates of which every value agrees; dst is included in src.

    ``values`` and ``src_values`` are the distinct values of the two. Only columns that a candidate names are read; their numbers, as many as the
    tables have columns at most, come to the driver. A value's columns are bits, so that one combined aggregate finds them; of those, the few sets that
    occur are counted.
    """
    spark = possible.sparkSession
    left = sorted(r[0] for r in possible.select("c").union(possible.select("in_c")).distinct().collect())
    if not left:
        return spark.createDataFrame([], FOUND)
    bit = {c: (f"m{i // BITS}", 1 << i % BITS) for i, c in enumerate(left)}
    masks = sorted({m for m, _ in bit.values()})
    about = {c: [F.lit(b if m == own else 0).cast("long").alias(m) for m in masks] for c, (own, b) in bit.items()}
    long = F.when(F.octet_length("value") > LONG, F.concat(F.lit("sha256:"), F.sha2("value", 256))).otherwise(F.col("value"))
    rows = _values(tables, columns, _kinds(tables, columns, named), about).withColumn("value", long)
    by_value = rows.groupBy("kind", "value").agg(*[F.bit_or(m).alias(m) for m in masks])
    sets = by_value.groupBy(*masks).agg(F.count(F.lit(1)).alias("n"))
    members = F.array_compact(F.array(*[F.when(F.col(m).bitwiseAND(F.lit(b)) != 0, F.lit(c)) for c, (m, b) in bit.items()]))
    held = cut(sets.select(members.alias("columns"), "n")).select("columns", F.explode("columns").alias("c"), "n")
    sizes = held.groupBy("c").agg(F.sum("n").alias("n"))
    pairs = held.select("c", F.explode("columns").alias("in_c"), "n").where("c <> in_c").groupBy("c", "in_c").agg(F.sum("n").alias("agreed"))
    known = pairs.join(possible, ["c", "in_c"], "left_semi").join(sizes, "c").where("agreed = n")
    names = spark.createDataFrame([(i, *c) for i, c in enumerate(columns)], "i int, dataset string, field string")
    of = lambda side, c: names.select(F.col("i").alias(c), F.col("dataset").alias(f"{side}_dataset"), F.col("field").alias(f"{side}_field"))
    full = known.join(sizes.select(F.col("c").alias("in_c"), F.col("n").alias("src_values")), "in_c").join(of("src", "in_c"), "in_c").join(of("dst", "c"), "c")
    return cut(full.select("src_dataset", "src_field", "dst_dataset", "dst_field", F.col("n").alias("values"), "src_values"))


def inclusions(tables: dict[str, DataFrame], columns: Columns | None = None, named: bool = False) -> DataFrame:
    """src_dataset, src_field, dst_dataset, dst_field, values, src_values: each column (dst) with each that includes it (src).

    With ``named``, columns of one bare name only are compared.
    """
    columns = columns_of(tables) if columns is None else columns
    if not columns:
        spark: SparkSession = next(iter(tables.values())).sparkSession
        return spark.createDataFrame([], FOUND)
    sketched = cut(sketches(tables, columns, named))
    return confirmed(tables, columns, cut(candidates(tables, columns, sketched, named)), named)


def bare(name: str) -> str:
    """A column's name without a prefix of one or two letters, as tables give their columns."""
    return re.sub(PREFIX, "", name.lower())


def same_names(tables: dict[str, DataFrame], columns: Iterable[tuple[str, str]]) -> Columns:
    """Those of the columns that share kind and bare name with a column of another table."""
    of: dict[tuple, set[str]] = {}
    columns = list(columns)
    key = lambda t, c: (kind_of(tables[t].schema[c].dataType), bare(c))
    for t, c in columns:
        of.setdefault(key(t, c), set()).add(t)
    return [(t, c) for t, c in columns if len(of[key(t, c)]) > 1]


def foreign_keys(tables: dict[str, DataFrame], columns: Columns | None = None) -> DataFrame:
    """src_dataset, src_field, dst_dataset, dst_field: inclusions in a key of another table, between columns of the same bare name.

    A key is a column that has no value twice and no null. Names come first, then values: only columns that share
    a name are read.
    """
    named = same_names(tables, columns_of(tables) if columns is None else columns)
    found = inclusions(tables, named, named=True)
    if not named:
        return found.select("src_dataset", "src_field", "dst_dataset", "dst_field")
    of = lambda side: F.regexp_replace(F.lower(f"{side}_field"), PREFIX, "")
    alike = found.where((of("src") == of("dst")) & (F.col("src_dataset") != F.col("dst_dataset")))
    sizes = reduce(DataFrame.unionByName, [tables[t].select(F.lit(t).alias("src_dataset"), F.count(F.lit(1)).alias("rows")) for t in sorted({t for t, _ in named})])
    # as many distinct values as rows: none twice, none null
    keys = alike.join(sizes, "src_dataset").where(F.col("src_values") == F.col("rows"))
    return keys.select("src_dataset", "src_field", "dst_dataset", "dst_field")
