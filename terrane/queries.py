"""Registered queries of the catalog, impact and search operators, with the same question in SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from terrane.functions import text as X
from terrane.operators import graph as G
from terrane.operators import inclusion as K
from terrane.operators import schemas as S
from terrane.operators import search as Q
from terrane.operators.barriers import computed, cut, shared_folder
from terrane.plans import lineage as L
from terrane.sources import tables as IO

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Foreign keys as a person would declare them, column to column.
FOREIGN_KEYS = [
    ("region", "r_regionkey", "nation", "n_regionkey"),
    ("nation", "n_nationkey", "customer", "c_nationkey"),
    ("nation", "n_nationkey", "supplier", "s_nationkey"),
    ("customer", "c_custkey", "orders", "o_custkey"),
    ("orders", "o_orderkey", "lineitem", "l_orderkey"),
    ("part", "p_partkey", "lineitem", "l_partkey"),
    ("supplier", "s_suppkey", "lineitem", "l_suppkey"),
]


def _struct(*fields: tuple) -> T.StructType:
    """A schema of (name, type) and (name, type, False) for what is not nullable."""
    return T.StructType([T.StructField(*f) for f in fields])


INT, STRING = T.IntegerType(), T.StringType()
#: Two versions of a schema with every kind of change.
OLD = _struct(
    ("a", INT, False), ("b", STRING), ("c", _struct(("x", INT), ("y", STRING))), ("d", T.DecimalType(10, 2)), ("e", T.ArrayType(INT)),
    ("f", T.MapType(STRING, T.DateType())), ("g", INT), ("r", INT),
)
NEW = _struct(
    ("a", T.LongType(), False), ("b", STRING, False), ("c", _struct(("x", INT), ("y", STRING), ("z", T.DoubleType()))), ("d", T.DecimalType(12, 2)), ("e", T.ArrayType(T.LongType())),
    ("f", T.MapType(STRING, T.TimestampType())), ("g", T.ArrayType(INT)), ("q", INT), ("n", STRING, False),
)
TERMS = ["the", "die", "que", "les"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return IO.spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))


def _schemas(spark: SparkSession, sf_dir: str) -> dict[str, T.StructType]:
    return {t: IO.infer(spark, f"{sf_dir}/{t}.parquet") for t in TABLES}


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fields_frame(spark, [(t, 1, s) for t, s in _schemas(spark, sf_dir).items()])


# R: schema registration

_NAMES = ", ".join(f"'{t}'" for t in TABLES)
#: The driver tables' columns as DuckDB sees them, in Spark's type names, with the elements of lists as fields of their own.
_FIELDS_SQL = f"""
    cols AS (
        SELECT table_name AS subject, CAST(ordinal_position - min(ordinal_position) OVER (PARTITION BY table_name) AS INT) AS ordinal, column_name AS name,
               replace(CASE data_type WHEN 'INTEGER' THEN 'int' WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string'
                    WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>' ELSE lower(data_type) END, ' ', '') AS type
        FROM information_schema.columns WHERE table_name IN ({_NAMES})),
    fields AS (
        SELECT subject, ordinal, name AS path, CAST(NULL AS VARCHAR) AS parent_path, name, type FROM cols
        UNION ALL
        SELECT subject, 0, name || '.element', name, 'element', regexp_extract(type, 'array<(.*)>', 1) FROM cols WHERE type LIKE 'array<%')
"""


@query("r3_subjects", f"WITH {_FIELDS_SQL} SELECT subject, 1 AS latest, CAST(count(*) AS BIGINT) AS n_columns FROM cols GROUP BY subject")
def r3_subjects(spark, sf_dir):
    rows = [(t, 1, s.fieldNames()) for t, s in _schemas(spark, sf_dir).items()]
    return spark.createDataFrame(rows, "subject string, latest int, columns array<string>").select("subject", "latest", F.size("columns").cast("long").alias("n_columns"))


@query("r4_fields", f"WITH {_FIELDS_SQL} SELECT subject, 1 AS version, ordinal, path, parent_path, name, type, true AS nullable FROM fields")
def r4_fields(spark, sf_dir):
    return _fields(spark, sf_dir).drop("comment")


@query("r5_find_fields", f"WITH {_FIELDS_SQL} SELECT subject, path, type FROM fields WHERE regexp_matches(name, 'key$|_id$') AND type = 'bigint'")
def r5_find_fields(spark, sf_dir):
    return S.find_fields(_fields(spark, sf_dir), like="key$|_id$", type="bigint").select("subject", "path", "type")


def _values(schema: T.StructType) -> str:
    return f"(VALUES {', '.join(f"('{path}', '{kind}', {str(nullable).lower()})" for _, path, _, _, kind, nullable, _ in S.flatten(schema))})"


#: A summary of the lines, whose columns are not quite theirs.
SUMMARY = """
    SELECT CAST(l_orderkey AS INT) AS l_orderkey, l_partkey, CAST(max(l_linenumber) AS BIGINT) AS l_linenumber, CAST(sum(l_extendedprice) AS DECIMAL(20, 2)) AS l_extendedprice, count(*) AS n_lines
    FROM lineitem GROUP BY l_orderkey, l_partkey
"""
_SUMMARY_SQL = "(VALUES ('l_orderkey', 'int', true), ('l_partkey', 'bigint', true), ('l_linenumber', 'bigint', true), ('l_extendedprice', 'decimal(20,2)', true), ('n_lines', 'bigint', false))"
_DIFF_SQL = f"""
    {_FIELDS_SQL},
    olds AS (SELECT 'example' AS subject, * FROM {_values(OLD)} AS a(path, type, nullable) UNION ALL SELECT 'lineitem_summary', path, type, true FROM fields WHERE subject = 'lineitem'),
    news AS (SELECT 'example' AS subject, * FROM {_values(NEW)} AS a(path, type, nullable) UNION ALL SELECT 'lineitem_summary', * FROM {_SUMMARY_SQL} AS b(path, type, nullable)),
    pairs AS (
        SELECT coalesce(a.subject, b.subject) AS subject, coalesce(a.path, b.path) AS path, a.path AS a_path, b.path AS b_path, a.type AS old_type, b.type AS new_type, a.nullable AS old_nullable, b.nullable AS new_nullable
        FROM olds a FULL JOIN news b ON a.path = b.path AND a.subject = b.subject),
    changes AS (
        SELECT subject, path, 'added' AS change, old_type, new_type, old_nullable, new_nullable FROM pairs WHERE a_path IS NULL
        UNION ALL SELECT subject, path, 'removed', old_type, new_type, old_nullable, new_nullable FROM pairs WHERE b_path IS NULL
        UNION ALL SELECT subject, path, 'retyped', old_type, new_type, old_nullable, new_nullable FROM pairs
            WHERE CASE WHEN old_type LIKE '%<%' THEN split_part(old_type, '<', 1) ELSE old_type END <> CASE WHEN new_type LIKE '%<%' THEN split_part(new_type, '<', 1) ELSE new_type END
        UNION ALL SELECT subject, path, 'nullability', old_type, new_type, old_nullable, new_nullable FROM pairs WHERE old_nullable <> new_nullable)
"""


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An example with every kind of change, and the lines' own schema against that of their summary."""
    IO.register_views(spark, sf_dir, ["lineitem"])
    schemas = {"example": (OLD, NEW), "lineitem_summary": (IO.infer(spark, f"{sf_dir}/lineitem.parquet"), spark.sql(SUMMARY).schema)}
    a, b = (S.diff(*(S.fields_frame(spark, [(subject, v, schema)]) for v, schema in enumerate(both, 1))).withColumn("subject", F.lit(subject)) for subject, both in schemas.items())
    return a.union(b)


@query("r6_diff", f"WITH {_DIFF_SQL} SELECT * FROM changes")
def r6_diff(spark, sf_dir):
    return _diff(spark, sf_dir)


#: The retyped fields of the example whose new type holds every old value, and the reverse.
_OK_SQL = """
    CASE change WHEN 'added' THEN new_nullable WHEN 'removed' THEN true
        WHEN 'retyped' THEN (old_type, new_type) IN (('int', 'bigint'), ('decimal(10,2)', 'decimal(12,2)'), ('date', 'timestamp')) ELSE new_nullable END AS backward,
    CASE change WHEN 'added' THEN true WHEN 'removed' THEN old_nullable WHEN 'retyped' THEN (new_type, old_type) IN (('int', 'bigint')) ELSE old_nullable END AS forward
"""


@query(
    "r7_compatible",
    f"""WITH {_DIFF_SQL}, judged AS (SELECT *, {_OK_SQL} FROM changes)
        SELECT subject, path, change, 'BACKWARD' AS mode, backward AS ok FROM judged UNION ALL SELECT subject, path, change, 'FORWARD', forward FROM judged
        UNION ALL SELECT subject, path, change, 'FULL', backward AND forward FROM judged UNION ALL SELECT subject, path, change, 'NONE', true FROM judged""",
)
def r7_compatible(spark, sf_dir):
    changes = _diff(spark, sf_dir)
    a, b, c, d = (S.compatibility(changes, m).select("subject", "path", "change", "mode", "ok") for m in S.MODES)
    return a.union(b).union(c).union(d)


@query("r8_shared_fields", f"WITH {_FIELDS_SQL} SELECT name, type, count(DISTINCT subject) AS n_subjects, string_agg(DISTINCT subject, ',' ORDER BY subject) AS subjects FROM cols GROUP BY name, type HAVING count(DISTINCT subject) > 1")
def r8_shared_fields(spark, sf_dir):
    return S.shared_fields(_fields(spark, sf_dir))


@query("r9_infer", f"WITH {_FIELDS_SQL} SELECT name, type, true AS nullable FROM cols WHERE subject = 'lineitem'")
def r9_infer(spark, sf_dir):
    schema = IO.infer(spark, f"{sf_dir}/lineitem.parquet")
    return spark.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable) for f in schema], "name string, type string, nullable boolean")


@query("r10_validate", "SELECT * FROM (VALUES ('o_orderkey', 'retyped'), ('o_comment', 'removed'), ('o_orderpriority', 'added')) AS t(path, change)")
def r10_validate(spark, sf_dir):
    """The orders table against a registered schema that it does not keep to."""
    registered = "o_orderkey int, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_comment string"
    there = S.fields_frame(spark, [("orders", 1, IO.infer(spark, f"{sf_dir}/orders.parquet"))])
    return S.diff(S.fields_frame(spark, [("orders", 1, S.as_schema(spark, registered))]), there).select("path", "change")


@query("r12_type_summary", f"WITH {_FIELDS_SQL} SELECT subject, type, count(*) AS n FROM cols GROUP BY ROLLUP (subject, type)")
def r12_type_summary(spark, sf_dir):
    return S.type_summary(_fields(spark, sf_dir))


def _registry(spark: SparkSession, sf_dir: str):
    """A new registry in the shared folder, with the tables' schemas, then a second version of one and a deprecated third."""
    import uuid

    from terrane.operators.registry import Registry

    registry = Registry(spark, f"{shared_folder(spark)}/terrane_registry_{uuid.uuid4().hex}")
    schemas = _schemas(spark, sf_dir)
    for t in ("region", "nation", "orders"):
        registry.register(t, schemas[t], f"the table {t}")
    registry.register("orders", schemas["orders"])  # the same schema: no new version
    registry.register("orders", schemas["orders"].add("o_comment", "string"), mode="FULL")
    registry.register("orders", "o_orderkey bigint")
    registry.deprecate("orders", 3)
    return registry


@query("r1_register_r2_latest_r11_deprecate", "SELECT * FROM (VALUES ('nation', 1, 3), ('orders', 2, 7), ('region', 1, 2)) AS t(subject, version, n_columns)")
def r1_register(spark, sf_dir):
    registry = _registry(spark, sf_dir)
    rows = [(s, v, len(registry.schema(s))) for s, v in registry.latest().select("subject", "version").collect()]
    return spark.createDataFrame(rows, "subject string, version int, n_columns int")


@query("r4_fields_registered", f"WITH {_FIELDS_SQL} SELECT subject, 1 AS version, ordinal, path, parent_path, name, type, true AS nullable FROM fields WHERE subject IN ('region', 'nation') UNION ALL SELECT 'orders', 2, ordinal, path, parent_path, name, type, true FROM (SELECT * FROM fields WHERE subject = 'orders' UNION ALL SELECT 'orders', 6, 'o_comment', NULL, 'o_comment', 'string')")
def r4_fields_registered(spark, sf_dir):
    """Fields of the latest versions, as they were stored when registered."""
    return _registry(spark, sf_dir).fields().drop("comment")


# I: impact analysis

#: Columns of the tables that share kind and bare name with one of another table.
_ALIKE = [
    [("region", "r_regionkey"), ("nation", "n_regionkey")], [("nation", "n_nationkey"), ("customer", "c_nationkey"), ("supplier", "s_nationkey")],
    [("customer", "c_custkey"), ("orders", "o_custkey")], [("orders", "o_orderkey"), ("lineitem", "l_orderkey")], [("part", "p_partkey"), ("lineitem", "l_partkey")],
    [("supplier", "s_suppkey"), ("lineitem", "l_suppkey")], [("documents", "doc_id"), ("labels", "doc_id")], [("documents", "text"), ("benchmark", "text"), ("conversations", "text")],
    [("region", "r_name"), ("nation", "n_name"), ("customer", "c_name"), ("supplier", "s_name"), ("part", "p_name")],
]


def _distinct_sql(columns) -> str:
    return " UNION ALL ".join(f"SELECT DISTINCT '{t}' AS t, '{c}' AS c, '{kind}' AS kind, CAST({c} AS VARCHAR) AS v FROM {t} WHERE {c} IS NOT NULL" for t, c, kind in columns)


#: Foreign keys found by comparing all values of columns of one name, and the dependencies between tables that they make.
_KEYS_SQL = f"""
    vals AS ({_distinct_sql((t, c, i) for i, group in enumerate(_ALIKE) for t, c in group)}),
    sizes AS (SELECT t, c, count(*) AS n FROM vals GROUP BY t, c),
    counts AS ({" UNION ALL ".join(f"SELECT '{t}' AS t, count(*) AS n_rows FROM {t}" for t in sorted({t for group in _ALIKE for t, _ in group}))}),
    keys AS (SELECT a.t AS src_dataset, a.c AS src_field, b.t AS dst_dataset, b.c AS dst_field
        FROM (SELECT x.t AS t1, x.c AS c1, y.t AS t2, y.c AS c2, count(*) AS n FROM vals x JOIN vals y ON x.kind = y.kind AND x.v = y.v AND x.t <> y.t GROUP BY ALL) m
        JOIN sizes a ON a.t = t1 AND a.c = c1 JOIN sizes b ON b.t = t2 AND b.c = c2 JOIN counts ON counts.t = t1 WHERE m.n = b.n AND a.n = n_rows)"""
_EDGE_SQL = _KEYS_SQL + ", edges(src, dst) AS (SELECT DISTINCT src_dataset, dst_dataset FROM keys)"
#: The same with a way back.
_CYCLIC_SQL = _KEYS_SQL + ", edges(src, dst) AS (SELECT DISTINCT src_dataset, dst_dataset FROM keys UNION SELECT 'lineitem', 'region')"


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys among all the tables, found in their values."""
    return K.foreign_keys({t: IO.spread(spark.read.parquet(f"{sf_dir}/{t}.parquet")) for t in TABLES})


def _edges(spark: SparkSession, sf_dir: str, *more: tuple[str, str]) -> DataFrame:
    """Dependencies between tables by the foreign keys in their data, and further ones."""
    found = _keys(spark, sf_dir).select(F.col("src_dataset").alias("src"), F.col("dst_dataset").alias("dst"))
    return cut((found.union(G.edges_frame(spark, list(more))) if more else found).distinct())


@query("i7_foreign_keys", f"WITH {_KEYS_SQL} SELECT * FROM keys")
def i7_foreign_keys(spark, sf_dir):
    return _keys(spark, sf_dir)


#: Columns with a kind, all tables.
_KINDS = {
    "whole": "region.r_regionkey nation.n_nationkey nation.n_regionkey customer.c_custkey customer.c_nationkey supplier.s_suppkey supplier.s_nationkey part.p_partkey part.p_size orders.o_orderkey orders.o_custkey lineitem.l_orderkey lineitem.l_partkey lineitem.l_suppkey lineitem.l_linenumber events.event_id events.user_id documents.doc_id documents.n_chars embeddings.vec_id embeddings.label pages.page_id benchmark.item_id labels.doc_id labels.quality labels.toxic conversations.conv_id conversations.turn",
    "text": "region.r_name nation.n_name customer.c_name customer.c_mktsegment supplier.s_name part.p_name part.p_brand part.p_type orders.o_orderstatus orders.o_orderpriority lineitem.l_returnflag lineitem.l_linestatus events.event_type events.props documents.text documents.lang documents.source pages.url pages.html benchmark.text conversations.role conversations.text",
    "moment": "orders.o_orderdate lineitem.l_shipdate events.ts",
}


@query(
    "i7_inclusions",
    f"""WITH vals AS ({_distinct_sql((*name.split("."), kind) for kind, names in _KINDS.items() for name in names.split())}),
        sizes AS (SELECT t, c, count(*) AS n FROM vals GROUP BY t, c),
        both_hold AS (SELECT x.t AS t1, x.c AS c1, y.t AS t2, y.c AS c2, count(*) AS n FROM vals x JOIN vals y ON x.kind = y.kind AND x.v = y.v AND (x.t <> y.t OR x.c <> y.c) GROUP BY ALL)
        SELECT t1 AS src_dataset, c1 AS src_field, t2 AS dst_dataset, c2 AS dst_field, b.n AS "values", a.n AS src_values
        FROM both_hold m JOIN sizes a ON a.t = t1 AND a.c = c1 JOIN sizes b ON b.t = t2 AND b.c = c2 WHERE m.n = b.n""",
)
def i7_inclusions(spark, sf_dir):
    """Each column of the tables with each that holds all its values."""
    return K.inclusions({t: IO.spread(spark.read.parquet(f"{sf_dir}/{t}.parquet")) for t in TABLES})


def _closure_sql(start: str, edges: str = _EDGE_SQL, up: bool = False, depth: int = 20) -> str:
    a, b = ("dst", "src") if up else ("src", "dst")
    return f"""WITH RECURSIVE {edges}, walk(node, d) AS (
        SELECT {start}, 0 UNION ALL SELECT e.{b}, w.d + 1 FROM walk w JOIN edges e ON e.{a} = w.node WHERE w.d < {depth})
        SELECT node, CAST(min(d) AS INT) AS min_distance, CAST(max(d) AS INT) AS max_distance, count(*) AS paths FROM walk WHERE d > 0 GROUP BY node"""


@query("i3_downstream", _closure_sql("'region'"))
def i3_downstream(spark, sf_dir):
    return G.downstream(_edges(spark, sf_dir), "region")


@query("i3_downstream_cyclic", _closure_sql("'region'", _CYCLIC_SQL, depth=12))
def i3_downstream_cyclic(spark, sf_dir):
    return G.downstream(_edges(spark, sf_dir, ("lineitem", "region")), "region", 12)


#: Each order with its customer's next one, an urgent one with the one after that too; the first order and the last of the customer who has most.
_CHAIN_SQL = """
    o AS (SELECT 'o' || o_orderkey AS src, o_orderpriority AS priority, 'o' || lead(o_orderkey) OVER w AS next, 'o' || lead(o_orderkey, 2) OVER w AS far FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
    edges(src, dst) AS (SELECT src, next FROM o WHERE next IS NOT NULL UNION SELECT src, far FROM o WHERE far IS NOT NULL AND priority = '1-URGENT'),
    most AS (SELECT 'o' || min(o_orderkey) AS first, 'o' || max(o_orderkey) AS last FROM orders GROUP BY o_custkey ORDER BY count(*) DESC, o_custkey LIMIT 1)"""


def _chain(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str, str]:
    orders = IO.spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderpriority"))
    name = lambda c: F.concat(F.lit("o"), c.cast("string"))
    own = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    far = F.when(F.col("o_orderpriority") == "1-URGENT", F.lead("o_orderkey", 2).over(own))
    rows = orders.select(name(F.col("o_orderkey")).alias("src"), F.array_compact(F.array(F.lead("o_orderkey").over(own), far)).alias("next"))
    edges = rows.select("src", F.explode("next").alias("dst")).select("src", name(F.col("dst")).alias("dst"))
    of = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), name(F.min("o_orderkey")).alias("first"), name(F.max("o_orderkey")).alias("last"))
    most = of.orderBy(F.desc("n"), "o_custkey").first()
    return edges, most["first"], most["last"]


@query("i3_downstream_deep", _closure_sql("(SELECT first FROM most)", _CHAIN_SQL, depth=1000))
def i3_downstream_deep(spark, sf_dir):
    """All later orders of the customer who has most, in a graph of all orders."""
    edges, first, _ = _chain(spark, sf_dir)
    return G.downstream(edges, first)


@query("i4_upstream", _closure_sql("'lineitem'", up=True))
def i4_upstream(spark, sf_dir):
    return G.upstream(_edges(spark, sf_dir), "lineitem")


@query(
    "i6_impact",
    f"""WITH RECURSIVE {_EDGE_SQL}, {_DIFF_SQL}, walk(node, d) AS (SELECT 'customer', 0 UNION ALL SELECT e.dst, w.d + 1 FROM walk w JOIN edges e ON e.src = w.node),
        near AS (SELECT node, CAST(min(d) AS INT) AS distance FROM walk WHERE d > 0 GROUP BY node)
        SELECT path, change, node, distance FROM changes, near WHERE subject = 'lineitem_summary'""",
)
def i6_impact(spark, sf_dir):
    return G.impact(_diff(spark, sf_dir).where("subject = 'lineitem_summary'").drop("subject"), "customer", _edges(spark, sf_dir))


@query(
    "i6_field_impact_i7_declared",
    """WITH RECURSIVE e(src, dst) AS (VALUES ('region.r_regionkey', 'nation.n_regionkey'), ('nation.n_nationkey', 'customer.c_nationkey'), ('nation.n_nationkey', 'supplier.s_nationkey')),
        walk(seed, node, d) AS (SELECT src, dst, 1 FROM e UNION ALL SELECT seed, e.dst, d + 1 FROM walk JOIN e ON e.src = walk.node)
        SELECT 'n_nationkey' AS path, 'retyped' AS change, node, CAST(min(d) AS INT) AS distance FROM walk WHERE seed = 'nation.n_nationkey' GROUP BY node""",
)
def i6_field_impact(spark, sf_dir):
    """Declared foreign keys as edges, and a changed key column."""
    nation = IO.infer(spark, f"{sf_dir}/nation.parquet")
    new = T.StructType([T.StructField(f.name, T.LongType() if f.name == "n_nationkey" else f.dataType, f.nullable) for f in nation])
    changes = S.diff(S.fields_frame(spark, [("nation", 1, nation)]), S.fields_frame(spark, [("nation", 2, new)]))
    edges = spark.createDataFrame([(*e, "declared", None) for e in FOREIGN_KEYS], L.EDGES)
    return G.field_impact(changes, "nation", edges)


@query(
    "i7_declared",
    f"""WITH RECURSIVE e(src, dst) AS (VALUES {', '.join(f"('{a}.{b}', '{c}.{d}')" for a, b, c, d in FOREIGN_KEYS)}, ('orders.o_totalprice', 'spending.spent'), ('orders.o_custkey', 'spending.o_custkey')),
        walk(seed, node, d) AS (SELECT src, dst, 1 FROM e UNION ALL SELECT seed, e.dst, d + 1 FROM walk JOIN e ON e.src = walk.node)
        SELECT seed, node, CAST(min(d) AS INT) AS distance FROM walk WHERE seed IN ('customer.c_custkey', 'nation.n_nationkey', 'orders.o_totalprice') GROUP BY seed, node""",
)
def i7_declared(spark, sf_dir):
    """Foreign keys and a query, kept in a registry: what depends on three columns."""
    import uuid

    from terrane.operators.registry import Registry

    registry = Registry(spark, f"{shared_folder(spark)}/terrane_registry_{uuid.uuid4().hex}")
    registry.declare_edges(FOREIGN_KEYS)
    registry.register("orders", IO.infer(spark, f"{sf_dir}/orders.parquet"))
    spark.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceTempView("orders")
    registry.register_query("spending", spark.sql("SELECT o_custkey, o_orderdate AS spent FROM orders"))
    registry.register_query("spending", spark.sql("SELECT o_custkey, o_totalprice AS spent FROM orders"))
    edges = registry.edges().select(F.concat_ws(".", "src_dataset", "src_field").alias("src"), F.concat_ws(".", "dst_dataset", "dst_field").alias("dst"))
    seeds = spark.createDataFrame([("customer.c_custkey",), ("nation.n_nationkey",), ("orders.o_totalprice",)], "node string")
    return G.reach(edges, seeds)


@query(
    "i8_paths",
    f"""WITH RECURSIVE {_CYCLIC_SQL}, walk(node, path, d) AS (SELECT 'region', ['region'], 0
        UNION ALL SELECT e.dst, list_append(path, e.dst), d + 1 FROM walk JOIN edges e ON e.src = walk.node WHERE NOT list_contains(path, e.dst) AND walk.node <> 'lineitem')
        SELECT array_to_string(path, ' > ') AS path, CAST(d AS INT) AS length FROM walk WHERE node = 'lineitem'""",
)
def i8_paths(spark, sf_dir):
    return G.paths(_edges(spark, sf_dir, ("lineitem", "region")), "region", "lineitem")


@query(
    "i8_paths_deep",
    f"""WITH RECURSIVE {_CHAIN_SQL}, walk(node, path, d) AS (SELECT first, [first], 0 FROM most
        UNION ALL SELECT e.dst, list_append(path, e.dst), d + 1 FROM walk JOIN edges e ON e.src = walk.node WHERE NOT list_contains(path, e.dst))
        SELECT array_to_string(path, ' > ') AS path, CAST(d AS INT) AS length FROM walk WHERE node = (SELECT last FROM most)""",
)
def i8_paths_deep(spark, sf_dir):
    edges, first, last = _chain(spark, sf_dir)
    return G.paths(edges, first, last)


@query(
    "i9_roots_leaves_orphans",
    f"""WITH {_EDGE_SQL}, nodes(node) AS (VALUES {', '.join(f"('{t}')" for t in TABLES)})
        SELECT DISTINCT 'root' AS kind, src AS node FROM edges WHERE src NOT IN (SELECT dst FROM edges)
        UNION ALL SELECT DISTINCT 'leaf', dst FROM edges WHERE dst NOT IN (SELECT src FROM edges)
        UNION ALL SELECT 'orphan', node FROM nodes WHERE node NOT IN (SELECT src FROM edges UNION ALL SELECT dst FROM edges)""",
)
def i9_roots(spark, sf_dir):
    e = _edges(spark, sf_dir)
    every = spark.createDataFrame([(t,) for t in TABLES], "node string")
    kinds = [("root", G.roots(e)), ("leaf", G.leaves(e)), ("orphan", G.orphans(e, every))]
    a, b, c = (d.select(F.lit(k).alias("kind"), "node") for k, d in kinds)
    return a.union(b).union(c)


@query(
    "i10_cycles",
    f"""WITH RECURSIVE {_CYCLIC_SQL.removesuffix(")")} UNION SELECT 'part', 'part'), walk(seed, node, d) AS (SELECT src, dst, 1 FROM edges
        UNION ALL SELECT seed, e.dst, d + 1 FROM walk JOIN edges e ON e.src = walk.node WHERE walk.node <> seed AND d < 12)
        SELECT seed AS node, CAST(min(d) AS INT) AS length FROM walk WHERE node = seed GROUP BY seed""",
)
def i10_cycles(spark, sf_dir):
    return G.cycles(_edges(spark, sf_dir, ("lineitem", "region"), ("part", "part")))


@query(
    "i11_top_impact",
    f"""WITH RECURSIVE {_EDGE_SQL}, walk(seed, node) AS (SELECT src, dst FROM edges UNION SELECT seed, e.dst FROM walk JOIN edges e ON e.src = walk.node),
        n AS (SELECT seed AS node, count(DISTINCT node) AS n_affected FROM walk GROUP BY seed ORDER BY n_affected DESC, node LIMIT 5)
        SELECT node, n_affected, CAST(rank() OVER (ORDER BY n_affected DESC) AS INT) AS rank FROM n""",
)
def i11_top_impact(spark, sf_dir):
    return G.top_impact(_edges(spark, sf_dir), 5)


#: Parts and suppliers by the lines of large quantity: a supplier of a line that came back depends on its part, the part of a line accepted on its supplier.
_ROWS_SQL = """
    edges(src, dst) AS (SELECT DISTINCT CASE l_returnflag WHEN 'R' THEN 'p' || l_partkey ELSE 's' || l_suppkey END, CASE l_returnflag WHEN 'R' THEN 's' || l_suppkey ELSE 'p' || l_partkey END
        FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_quantity >= 46)"""


def _row_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = IO.spread(spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_returnflag in ('A', 'R') and l_quantity >= 46").select("l_partkey", "l_suppkey", "l_returnflag"))
    part, supplier, back = F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey"), F.col("l_returnflag") == "R"
    return cut(lines.select(F.when(back, part).otherwise(supplier).alias("src"), F.when(back, supplier).otherwise(part).alias("dst")).distinct())


@query(
    "i10_components",
    f"""WITH RECURSIVE {_ROWS_SQL}, nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges),
        walk(seed, node) AS (SELECT src, dst FROM edges WHERE src LIKE 's%' UNION SELECT seed, e.dst FROM walk JOIN edges e ON e.src = walk.node),
        -- every cycle has a supplier; a part is on it if one of its suppliers leads back
        members AS (SELECT a.seed, a.node FROM walk a JOIN walk b ON b.seed = a.node AND b.node = a.seed
            UNION SELECT a.seed, a.node FROM walk a JOIN edges e ON e.src = a.node AND e.dst = a.seed
            UNION SELECT a.seed, a.node FROM walk a JOIN edges e ON e.src = a.node JOIN walk w ON w.seed = e.dst AND w.node = a.seed),
        own AS (SELECT seed, min(node) AS component FROM members GROUP BY seed),
        part AS (SELECT n.node, coalesce(min(o.component), n.node) AS component FROM nodes n LEFT JOIN members m ON m.node = n.node LEFT JOIN own o ON o.seed = m.seed GROUP BY n.node)
        SELECT node, component, count(*) OVER (PARTITION BY component) AS size, count(*) OVER (PARTITION BY component) > 1 AS cyclic FROM part""",
)
def i10_components(spark, sf_dir):
    return G.strong_components(_row_edges(spark, sf_dir))


#: Nations with their customers, those with their orders.
_TREE_SQL = """
    edges(src, dst) AS (SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"""


@query(
    "i11_top_rows",
    f"""WITH RECURSIVE {_TREE_SQL}, walk(seed, node) AS (SELECT src, dst FROM edges UNION ALL SELECT e.src, walk.node FROM walk JOIN edges e ON e.dst = walk.seed),
        n AS (SELECT seed AS node, count(DISTINCT node) AS n_affected FROM walk GROUP BY seed ORDER BY n_affected DESC, node LIMIT 12)
        SELECT node, n_affected, CAST(rank() OVER (ORDER BY n_affected DESC) AS INT) AS rank FROM n""",
)
def i11_top_rows(spark, sf_dir):
    """The rows on which most rows depend, from regions down to orders."""
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    steps = [("nation", "r", "n_regionkey", "n", "n_nationkey"), ("customer", "n", "c_nationkey", "c", "c_custkey"), ("orders", "c", "o_custkey", "o", "o_orderkey")]
    a, b, c = (IO.spread(spark.read.parquet(f"{sf_dir}/{t}.parquet").select(name(x, of).alias("src"), name(y, key).alias("dst"))) for t, x, of, y, key in steps)
    return G.top_impact(a.union(b).union(c), 12)


@query(
    "i12_common",
    f"""WITH RECURSIVE {_EDGE_SQL}, walk(seed, node) AS (SELECT src, dst FROM edges UNION SELECT seed, e.dst FROM walk JOIN edges e ON e.src = walk.node),
        a AS (SELECT node FROM walk WHERE seed = 'nation'), b AS (SELECT node FROM walk WHERE seed = 'customer')
        SELECT 'both' AS how, node FROM (SELECT node FROM a INTERSECT SELECT node FROM b) UNION ALL SELECT 'either', node FROM (SELECT node FROM a UNION SELECT node FROM b)
        UNION ALL SELECT 'first', node FROM (SELECT node FROM a EXCEPT SELECT node FROM b)""",
)
def i12_common(spark, sf_dir):
    e = _edges(spark, sf_dir)
    a, b, c = (G.common(e, "nation", "customer", how).select(F.lit(how).alias("how"), "node") for how in ("both", "either", "first"))
    return a.union(b).union(c)


REVENUE = """
    WITH o AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F')
    SELECT c_mktsegment, sum(o_totalprice) AS revenue FROM o JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment
"""


def _edges_values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows)


@query("i1_table_edges", "SELECT * FROM (VALUES ('customer', 'revenue'), ('orders', 'revenue')) AS t(src, dst)")
def i1_table_edges(spark, sf_dir):
    IO.register_views(spark, sf_dir, ["orders", "customer"])
    return L.table_edges(spark.sql(REVENUE), "revenue", TABLES)


_REVENUE_VALUE = [("customer", "c_mktsegment", "revenue", "c_mktsegment", "value"), ("orders", "o_totalprice", "revenue", "revenue", "value")]
_REVENUE_INFLUENCE = [(t, c, "revenue", d, "influence") for t, c in (("orders", "o_orderstatus"), ("orders", "o_custkey"), ("customer", "c_custkey"), ("customer", "c_mktsegment")) for d in ("c_mktsegment", "revenue")]


@query("i2_column_edges_i13_influence", f"SELECT * FROM (VALUES {_edges_values(_REVENUE_VALUE + _REVENUE_INFLUENCE)}) AS t(src_dataset, src_field, dst_dataset, dst_field, kind)")
def i2_column_edges(spark, sf_dir):
    IO.register_views(spark, sf_dir, ["orders", "customer"])
    return L.column_edges(spark.sql(REVENUE), "revenue", TABLES).drop("job")


@query("i5_what_if", "SELECT * FROM (VALUES ('revenue', 'drop', 'BREAKS'), ('count', 'drop', 'UNAFFECTED'), ('revenue', 'decimal', 'CHANGES_TYPE'), ('count', 'decimal', 'UNAFFECTED')) AS t(query, change, verdict)")
def i5_what_if(spark, sf_dir):
    schemas = {t: IO.infer(spark, f"{sf_dir}/{t}.parquet") for t in ("orders", "customer")}
    texts = {"revenue": REVENUE, "count": "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority"}
    fields = schemas["orders"].fields
    changes = {
        "drop": T.StructType([f for f in fields if f.name != "o_totalprice"]),
        "decimal": T.StructType([T.StructField(f.name, T.DecimalType(12, 2) if f.name == "o_totalprice" else f.dataType) for f in fields]),
    }
    a, b = (L.what_if(spark, schemas, texts, "orders", new).select("query", F.lit(name).alias("change"), "verdict") for name, new in changes.items())
    return a.union(b)


@query(
    "i5_what_if_through_queries",
    """SELECT * FROM (VALUES ('segments', 'drop', 'BREAKS'), ('best', 'drop', 'BREAKS'), ('spent', 'drop', 'BREAKS'), ('n_customers', 'drop', 'BREAKS'), ('statuses', 'drop', 'UNAFFECTED'),
        ('segments', 'decimal', 'CHANGES_TYPE'), ('best', 'decimal', 'CHANGES_TYPE'), ('spent', 'decimal', 'CHANGES_TYPE'), ('n_customers', 'decimal', 'UNAFFECTED'), ('statuses', 'decimal', 'UNAFFECTED')) AS t(query, change, verdict)""",
)
def i5_what_if_through_queries(spark, sf_dir):
    """A column of orders dropped or retyped, and queries that read queries that read orders."""
    schemas = {t: IO.infer(spark, f"{sf_dir}/{t}.parquet") for t in ("orders", "customer")}
    texts = {
        "best": "SELECT max(revenue) AS most FROM segments",
        "segments": "SELECT c_mktsegment, sum(total) AS revenue FROM spent JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
        "spent": "SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey",
        "n_customers": "SELECT count(*) AS n FROM spent",
        "statuses": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus",
    }
    fields = schemas["orders"].fields
    changes = {
        "drop": T.StructType([f for f in fields if f.name != "o_totalprice"]),
        "decimal": T.StructType([T.StructField(f.name, T.DecimalType(12, 2) if f.name == "o_totalprice" else f.dataType) for f in fields]),
    }
    a, b = (L.what_if(spark, schemas, texts, "orders", new).select("query", F.lit(name).alias("change"), "verdict") for name, new in changes.items())
    return a.union(b)


# F: full-text search

_WORDS_SQL = r"w AS (SELECT doc_id, lang, source, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS words FROM documents)"
_TOKENS_SQL = _WORDS_SQL + ", tok AS (SELECT doc_id, lang, source, unnest(words) AS term, unnest(range(len(words))) AS pos FROM w)"


@query("f1_tokens", f"WITH {_WORDS_SQL} SELECT doc_id, len(words) AS n_tokens, len(list_distinct(words)) AS n_terms, array_to_string(words, ' ') AS line FROM w")
def f1_tokens(spark, sf_dir):
    w = _docs(spark, sf_dir).select("doc_id", X.tokens("text").alias("words"))
    return w.select("doc_id", F.size("words").cast("long").alias("n_tokens"), F.size(F.array_distinct("words")).cast("long").alias("n_terms"), F.array_join("words", " ").alias("line"))


@query("f2_postings", f"WITH {_TOKENS_SQL} SELECT 'documents' AS corpus, 'text' AS field, doc_id, term, CAST(pos AS INT) AS pos FROM tok")
def f2_postings(spark, sf_dir):
    return Q.postings(_docs(spark, sf_dir), "doc_id", "text", "documents")


@query("f2_term_rows", f"WITH {_TOKENS_SQL} SELECT term, doc_id, CAST(count(*) AS INT) AS tf, CAST(max(n) AS INT) AS dl, array_to_string(list(pos ORDER BY pos), ',') AS positions FROM tok JOIN (SELECT doc_id, len(words) AS n FROM w) USING (doc_id) GROUP BY term, doc_id")
def f2_term_rows(spark, sf_dir):
    rows = Q.term_rows(_docs(spark, sf_dir), "doc_id", "text", "documents")
    return rows.select("term", "doc_id", "tf", "dl", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"))


@query("f3_term_stats", f"WITH {_TOKENS_SQL} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM tok GROUP BY term")
def f3_term_stats(spark, sf_dir):
    return Q.term_stats(_docs(spark, sf_dir), "doc_id", "text").select("term", "df", "cf")


@query("f3_corpus_stats", f"WITH {_WORDS_SQL} SELECT count(*) AS n_docs, CAST(sum(len(words)) AS BIGINT) AS n_tokens, round(sum(len(words)) / count(*), 6) AS avg_dl FROM w")
def f3_corpus_stats(spark, sf_dir):
    return Q.corpus_stats(_docs(spark, sf_dir), "doc_id", "text").select("n_docs", "n_tokens", F.round("avg_dl", 6).alias("avg_dl"))


@query("f4_any", f"WITH {_WORDS_SQL} SELECT doc_id FROM w WHERE list_has_any(words, ['die', 'que'])")
def f4_any(spark, sf_dir):
    return Q.scan_any(_docs(spark, sf_dir), "doc_id", "text", ["die", "que"])


@query("f5_all", f"WITH {_WORDS_SQL} SELECT doc_id FROM w WHERE list_has_all(words, ['the', 'of', 'and'])")
def f5_all(spark, sf_dir):
    return Q.scan_all(_docs(spark, sf_dir), "doc_id", "text", ["the", "of", "and"])


@query("f6_none", f"WITH {_WORDS_SQL} SELECT doc_id FROM w WHERE list_has_all(words, ['the']) AND NOT list_has_any(words, ['with', 'for'])")
def f6_none(spark, sf_dir):
    return Q.scan_all(_docs(spark, sf_dir), "doc_id", "text", ["the"], none=["with", "for"])


def _scores_sql(score: str, words: str = _WORDS_SQL, terms: list[str] = TERMS) -> str:
    formula = {
        "bm25": "ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))",
        "tfidf": "(1 + ln(tf)) * ln(n / df)",
    }[score]
    return f"""{words}, tok AS (SELECT doc_id, lang, source, unnest(words) AS term FROM w), t AS (SELECT doc_id, any_value(lang) AS lang, any_value(source) AS source, term, count(*) AS tf FROM tok WHERE term IN ({', '.join(f"'{x}'" for x in terms)}) GROUP BY doc_id, term),
        df AS (SELECT term, count(*) AS df FROM t GROUP BY term), s AS (SELECT count(*) AS n, avg(len(words)) AS avg_dl FROM w),
        scored AS (SELECT t.doc_id, any_value(t.lang) AS lang, any_value(t.source) AS source, sum({formula}) AS score FROM t JOIN df USING (term) JOIN (SELECT doc_id, len(words) AS dl FROM w) USING (doc_id), s GROUP BY t.doc_id)"""


@query("f7_bm25", f"WITH {_scores_sql('bm25')} SELECT doc_id, round(score, 4) AS score FROM scored ORDER BY round(score, 4) DESC, doc_id LIMIT 20")
def f7_bm25(spark, sf_dir):
    return Q.top(Q.scan_scores(_docs(spark, sf_dir), "doc_id", "text", TERMS), 20)


@query("f7_bm25_all_hits", f"WITH {_scores_sql('bm25')} SELECT doc_id, round(score, 4) AS score FROM scored")
def f7_bm25_all_hits(spark, sf_dir):
    return Q.scan_scores(_docs(spark, sf_dir), "doc_id", "text", TERMS).select("doc_id", F.round("score", 4).alias("score"))


def _stored_index(spark: SparkSession, sf_dir: str) -> Q.Index:
    import uuid

    index = Q.Index(spark, f"{shared_folder(spark)}/terrane_index_{uuid.uuid4().hex}", buckets=16)
    index.add(_docs(spark, sf_dir), "doc_id", ["text"], "documents")
    return index


@query(
    "f7_bm25_indexed",
    f"""WITH {_scores_sql('bm25')} SELECT 'bm25' AS search, doc_id, round(score, 4) AS score FROM (SELECT * FROM scored ORDER BY round(score, 4) DESC, doc_id LIMIT 20)
        UNION ALL SELECT 'phrase', doc_id, CAST(len(list_filter(range(len(words) - 2), lambda i: words[i + 1] = 'of' AND words[i + 2] = 'the' AND words[i + 3] = 'that')) AS DOUBLE) FROM w
            WHERE len(list_filter(range(len(words) - 2), lambda i: words[i + 1] = 'of' AND words[i + 2] = 'the' AND words[i + 3] = 'that')) > 0
        UNION ALL SELECT 'all but', doc_id, 0.0 FROM w WHERE list_has_all(words, ['the', 'of']) AND NOT list_has_any(words, ['with', 'for'])""",
)
def f7_bm25_indexed(spark, sf_dir):
    """Searches of an index that is stored first."""
    index = _stored_index(spark, sf_dir)
    best = index.search("documents", "text", any=TERMS, k=20).select(F.lit("bm25").alias("search"), "doc_id", "score")
    phrase = index.phrase("documents", "text", ["of", "the", "that"]).select(F.lit("phrase"), "doc_id", F.col("hits").cast("double"))
    rest = index.search("documents", "text", all=["the", "of"], none=["with", "for"], k=None).select(F.lit("all but"), "doc_id", F.lit(0.0))
    return best.union(phrase).union(rest)


@query("f8_phrase", f"WITH {_WORDS_SQL}, h AS (SELECT doc_id, len(list_filter(range(len(words) - 2), lambda i: words[i + 1] = 'of' AND words[i + 2] = 'the' AND words[i + 3] = 'that')) AS hits FROM w) SELECT doc_id, hits FROM h WHERE hits > 0")
def f8_phrase(spark, sf_dir):
    return Q.scan_phrase(_docs(spark, sf_dir), "doc_id", "text", ["of", "the", "that"])


def _dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.term_stats(_docs(spark, sf_dir), "doc_id", "text")


@query("f9_wildcard", f"WITH {_TOKENS_SQL} SELECT term, count(DISTINCT doc_id) AS df FROM tok WHERE term LIKE 'th%ing' OR term LIKE 'th_n' GROUP BY term")
def f9_wildcard(spark, sf_dir):
    d = _dictionary(spark, sf_dir)
    return Q.like(d, "th*ing").union(Q.like(d, "th?n")).select("term", "df").distinct()


#: DuckDB measures bytes; a letter beyond ASCII is none of the word's, so any one byte may stand for it.
_FUZZY_SQL = r"levenshtein(regexp_replace(term, '[^\x00-\x7F]', '#', 'g'), 'thing')"


@query("f10_fuzzy", rf"WITH {_TOKENS_SQL} SELECT term, CAST({_FUZZY_SQL} AS INT) AS distance FROM (SELECT DISTINCT term FROM tok) WHERE {_FUZZY_SQL} <= 2")
def f10_fuzzy(spark, sf_dir):
    return Q.fuzzy(_dictionary(spark, sf_dir), "thing", 2).select("term", "distance")


@query(
    "f9_wildcard_docs_f10_fuzzy_docs_f15_near_indexed",
    rf"""WITH {_TOKENS_SQL}, t AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY doc_id, term)
        SELECT 'wildcard' AS search, doc_id, count(*) AS n, CAST(sum(tf) AS BIGINT) AS tf FROM t WHERE term LIKE 'th_n%' GROUP BY doc_id
        UNION ALL SELECT 'fuzzy', doc_id, count(*), CAST(sum(tf) AS BIGINT) FROM t WHERE {_FUZZY_SQL} <= 2 GROUP BY doc_id
        UNION ALL SELECT 'near', a.doc_id, count(*), 0 FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND a.term = 'with' AND b.term = 'from' AND abs(a.pos - b.pos) <= 5 GROUP BY a.doc_id""",
)
def f9_wildcard_docs(spark, sf_dir):
    """Documents by pattern, by edit distance and by nearness of two words, all from a stored index."""
    index = _stored_index(spark, sf_dir)
    like, near_word = (d.select(F.lit(kind).alias("search"), "doc_id", F.col("n_terms").alias("n"), "tf") for kind, d in (("wildcard", index.wildcard("documents", "text", "th?n*")), ("fuzzy", index.fuzzy("documents", "text", "thing", 2))))
    close = index.near("documents", "text", "with", "from", 5).select(F.lit("near"), "doc_id", "pairs", F.lit(0).cast("long"))
    return like.union(near_word).union(close)


@query(
    "f9_terms_by_grams_f10_terms_by_deletions",
    rf"""WITH {_TOKENS_SQL}, d AS (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM tok GROUP BY term)
        SELECT 'begins and ends' AS search, term, df, cf FROM d WHERE term LIKE 'th%ing' UNION ALL SELECT 'holds', term, df, cf FROM d WHERE term LIKE '%ing%'
        UNION ALL SELECT 'near', term, df, cf FROM d WHERE {_FUZZY_SQL} <= 2""",
)
def f9_terms_by_keys(spark, sf_dir):
    """Terms by pattern and by edit distance, of stored keys, without reading the dictionary."""
    index = _stored_index(spark, sf_dir)
    index.index_terms("documents", "text")
    found = {"begins and ends": index.terms_like("documents", "text", "th*ing"), "holds": index.terms_like("documents", "text", "*ing*"), "near": index.terms_near("documents", "text", "thing", 2)}
    return reduce(DataFrame.union, [d.select(F.lit(kind).alias("search"), "term", "df", "cf") for kind, d in found.items()])


@query("f11_filtered", f"WITH {_WORDS_SQL} SELECT doc_id FROM w WHERE list_has_all(words, ['die', 'und']) AND lang = 'de' AND source IN ('src1', 'src2', 'src3')")
def f11_filtered(spark, sf_dir):
    docs = _docs(spark, sf_dir).where((F.col("lang") == "de") & F.col("source").isin("src1", "src2", "src3"))
    return Q.scan_all(docs, "doc_id", "text", ["die", "und"])


@query("f12_facets", f"WITH {_WORDS_SQL} SELECT lang AS value, count(*) AS n FROM w WHERE list_has_any(words, ['die', 'que', 'the']) GROUP BY lang")
def f12_facets(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return Q.facets(Q.scan_any(docs, "doc_id", "text", ["die", "que", "the"]), docs, "doc_id", "lang")


@query("f13_best_per_lang", f"WITH {_scores_sql('bm25')}, r AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY round(score, 4) DESC, doc_id) AS rank, doc_id, round(score, 4) AS score FROM scored) SELECT lang, CAST(rank AS INT) AS rank, doc_id, score FROM r WHERE rank <= 3")
def f13_best_per_lang(spark, sf_dir):
    return Q.best_per(Q.scan_scores(_docs(spark, sf_dir), "doc_id", "text", TERMS, extra=["lang"]), "lang", 3)


@query("f14_tfidf", f"WITH {_scores_sql('tfidf')} SELECT doc_id, round(score, 4) AS score FROM scored ORDER BY round(score, 4) DESC, doc_id LIMIT 20")
def f14_tfidf(spark, sf_dir):
    return Q.top(Q.scan_scores(_docs(spark, sf_dir), "doc_id", "text", TERMS, "tfidf"), 20)


@query("f15_near", f"WITH {_TOKENS_SQL} SELECT a.doc_id, count(*) AS pairs FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND a.term = 'with' AND b.term = 'from' AND abs(a.pos - b.pos) <= 5 GROUP BY a.doc_id")
def f15_near(spark, sf_dir):
    return Q.scan_near(_docs(spark, sf_dir), "doc_id", "text", "with", "from", 5)


@query("f16_snippet", "SELECT doc_id, CASE WHEN instr(lower(text), 'stupid') > 0 THEN substr(text, greatest(instr(lower(text), 'stupid') - 20, 1), 60) END AS snippet FROM documents WHERE instr(lower(text), 'stupid') > 0")
def f16_snippet(spark, sf_dir):
    return computed(_docs(spark, sf_dir), ["doc_id"], snippet=X.snippet("text", "stupid")).where("snippet is not null")


@query("f17_suggest", f"WITH {_TOKENS_SQL} SELECT term, count(DISTINCT doc_id) AS df FROM tok WHERE starts_with(term, 'th') GROUP BY term ORDER BY df DESC, term LIMIT 10")
def f17_suggest(spark, sf_dir):
    return Q.suggest(_dictionary(spark, sf_dir), "th", 10)


@query(
    "f18_cjk_bigrams",
    r"""WITH s AS (SELECT doc_id, regexp_replace(lower(text), '\s+', '', 'g') AS s FROM documents),
        g AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(s), 2)), lambda i: substr(s, i, 2))) AS gram FROM s WHERE len(s) > 0)
        SELECT gram, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM g GROUP BY gram""",
)
def f18_cjk_bigrams(spark, sf_dir):
    """Pairs of characters of all documents, and how many documents have each."""
    docs = _docs(spark, sf_dir)
    if spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy("doc_id").count().where("count > 1").isEmpty():
        # a document is a row: its own pairs once more behind all of its pairs count it, and nothing is kept by document
        rows = docs.select(X.bigrams("text").alias("grams")).select(F.size("grams").alias("size"), F.posexplode_outer(F.concat("grams", F.array_distinct("grams"))).alias("at", "gram"))
        once = F.col("at") >= F.col("size")
        return rows.where("gram is not null").groupBy("gram").agg(F.count(F.when(~once, 1)).alias("n"), F.count(F.when(once, 1)).alias("n_docs"))
    grams = docs.select("doc_id", F.explode_outer(X.bigrams("text")).alias("gram")).where("gram is not null")
    return grams.groupBy("gram", "doc_id").agg(F.count(F.lit(1)).alias("n")).groupBy("gram").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_docs"))


@query(
    "f18_cjk_search",
    r"""WITH s AS (SELECT doc_id, regexp_replace(lower(text), '\s+', '', 'g') AS s FROM documents), g AS (SELECT doc_id, list_transform(range(1, len(s)), lambda i: substr(s, i, 2)) AS grams FROM s)
        SELECT doc_id, CAST(len(list_filter(range(1, len(grams)), lambda i: grams[i] = 'qu' AND grams[i + 1] = 'ui')) AS BIGINT) AS hits FROM g
        WHERE len(list_filter(range(1, len(grams)), lambda i: grams[i] = 'qu' AND grams[i + 1] = 'ui')) > 0""",
)
def f18_cjk_search(spark, sf_dir):
    """An index of pairs of characters, as scripts without spaces need it: a run of characters is a phrase of its pairs."""
    import uuid

    index = Q.Index(spark, f"{shared_folder(spark)}/terrane_index_{uuid.uuid4().hex}", buckets=16)
    index.add(_docs(spark, sf_dir), "doc_id", ["text"], "documents", tokenizer=X.bigrams)
    return index.phrase("documents", "text", ["qu", "ui"])


@query("f19_index_stream", f"WITH {_TOKENS_SQL} SELECT term, doc_id, CAST(count(*) AS INT) AS tf FROM tok GROUP BY term, doc_id")
def f19_index_stream(spark, sf_dir):
    """The documents as a stream, indexed until all are in."""
    import uuid

    from terrane.streaming.index_stream import current, index_stream

    path = f"{shared_folder(spark)}/terrane_stream_{uuid.uuid4().hex}"
    index_stream(IO.stream(spark, sf_dir, "documents"), "doc_id", "text", f"{path}/index", f"{path}/state").awaitTermination()
    return current(spark, f"{path}/index").select("term", "doc_id", "tf")


@query("f19_stream_search", f"WITH {_scores_sql('bm25')} SELECT doc_id, round(score, 4) AS score FROM scored ORDER BY round(score, 4) DESC, doc_id LIMIT 20")
def f19_stream_search(spark, sf_dir):
    """A search of an index that a stream has filled."""
    import uuid

    from terrane.streaming.index_stream import index_stream, publish

    path = f"{shared_folder(spark)}/terrane_stream_{uuid.uuid4().hex}"
    index_stream(IO.stream(spark, sf_dir, "documents"), "doc_id", "text", f"{path}/batches", f"{path}/state").awaitTermination()
    index = Q.Index(spark, f"{path}/index", buckets=16)
    publish(spark, f"{path}/batches", index, "documents", "text")
    return index.search("documents", "text", any=TERMS, k=20)


_UPDATED_SQL = r"""up AS (SELECT d.doc_id, lang, source, CASE WHEN l.toxic = 1 THEN 'the les ' || left(text, 200) ELSE text END AS text FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality IS NULL OR l.quality = 1 OR l.toxic = 1
        UNION ALL SELECT -1 - item_id, NULL, NULL, text FROM benchmark), w AS (SELECT doc_id, lang, source, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS words FROM up)"""


@query("f19_updates", f"WITH {_scores_sql('bm25', _UPDATED_SQL)} SELECT doc_id, round(score, 4) AS score FROM scored")
def f19_updates(spark, sf_dir):
    """A batch index after three rounds: documents of poor quality deleted, toxic ones put back cut short, benchmark items added."""
    index, docs = _stored_index(spark, sf_dir), _docs(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    index.delete(labels.where("quality = 0").select("doc_id"), "documents", "text")
    toxic = docs.join(labels.where("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    index.update(toxic.select("doc_id", F.concat(F.lit("the les "), F.substring("text", 1, 200)).alias("text")), "doc_id", "text", "documents")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    index.update(items.select((-1 - F.col("item_id")).alias("doc_id"), "text"), "doc_id", "text", "documents")
    return index.search("documents", "text", any=TERMS, k=None)


@query("f20_search_catalog", f"WITH {_FIELDS_SQL} SELECT subject, path FROM fields WHERE list_has_any(regexp_extract_all(lower(name), '[a-z0-9]+'), ['comment', 'text', 'name'])")
def f20_search_catalog(spark, sf_dir):
    """Fields whose names hold a word: the catalog searched like any text."""
    fields = _fields(spark, sf_dir)
    return fields.where(F.arrays_overlap(X.identifier_tokens("name"), F.array(*map(F.lit, ["comment", "text", "name"])))).select("subject", "path")


_FIELD_WORDS_SQL = f"{_FIELDS_SQL}, w AS (SELECT subject || '.' || path AS doc_id, NULL AS lang, NULL AS source, regexp_extract_all(lower(name), '[a-z0-9]+') AS words FROM fields)"


@query("f20_search_catalog_ranked", f"WITH {_scores_sql('bm25', _FIELD_WORDS_SQL, ['name', 'key', 'text'])} SELECT doc_id, round(score, 4) AS score FROM scored ORDER BY round(score, 4) DESC, doc_id LIMIT 10")
def f20_search_catalog_ranked(spark, sf_dir):
    return Q.search_catalog(_fields(spark, sf_dir), ["name", "key", "text"], 10)
