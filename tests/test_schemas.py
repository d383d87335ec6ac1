import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from terrane.operators import schemas as S
from terrane.operators.registry import Registry
from terrane.sources import tables as IO

ALL_TYPES = "a int not null, b struct<c:array<map<string,decimal(10,2)>>>, i interval day to second"


@pytest.fixture
def registry(spark, tmp_path):
    return Registry(spark, str(tmp_path / "registry"))


def test_register_and_read_back(registry):
    assert registry.register("t", "a int, b string") == 1
    assert registry.register("t", T.StructType.fromDDL("a int, b string")) == 1
    assert registry.register("t", "a bigint, b string", "wider") == 2
    assert registry.register("u", ALL_TYPES) == 1
    assert registry.schema("t", 1) == T.StructType.fromDDL("a int, b string")
    assert registry.schema("u") == T.StructType.fromDDL(ALL_TYPES)
    assert [tuple(r) for r in registry.subjects().orderBy("subject").collect()] == [("t", 2, 2), ("u", 1, 1)]
    assert registry.versions("t").where("comment = 'wider'").count() == 1
    with pytest.raises(KeyError):
        registry.schema("nothing")


def test_deprecate(registry):
    registry.register("t", "a int")
    registry.register("t", "a int, b int")
    registry.deprecate("t", 2)
    assert registry.schema("t") == T.StructType.fromDDL("a int")
    assert registry.register("t", "a int, c int") == 3
    with pytest.raises(KeyError):
        registry.deprecate("t", 2)


def test_refuses_what_is_incompatible(registry):
    registry.register("t", "a int")
    with pytest.raises(ValueError, match="a retyped"):
        registry.register("t", "a string, b int", mode="FORWARD")
    assert registry.register("t", "a bigint", mode="BACKWARD") == 2


def test_flatten():
    rows = [(r[1], r[2], r[4], r[5]) for r in S.flatten(T.StructType.fromDDL(ALL_TYPES))]
    assert rows == [
        ("a", None, "int", False),
        ("b", None, "struct<c:array<map<string,decimal(10,2)>>>", True),
        ("b.c", "b", "array<map<string,decimal(10,2)>>", True),
        ("b.c.element", "b.c", "map<string,decimal(10,2)>", True),
        ("b.c.element.key", "b.c.element", "string", False),
        ("b.c.element.value", "b.c.element", "decimal(10,2)", True),
        ("i", None, "interval day to second", True),
    ]


CASES = [
    ("a int", "a int, b string", {("b", "added")}, True, True),
    ("a int", "a int, b string not null", {("b", "added")}, False, True),
    ("a int, b string", "a int", {("b", "removed")}, True, True),
    ("a int, b string not null", "a int", {("b", "removed")}, True, False),
    ("a int", "a bigint", {("a", "retyped")}, True, False),
    ("a bigint", "a int", {("a", "retyped")}, False, True),
    ("a int", "a array<int>", {("a", "retyped"), ("a.element", "added")}, False, False),
    ("a int", "b int", {("a", "removed"), ("b", "added")}, True, True),
    ("s struct<x:int>", "s struct<x:int,y:string>", {("s.y", "added")}, True, True),
    ("a int", "a int not null", {("a", "nullability")}, False, True),
    ("a decimal(10,2)", "a decimal(12,4)", {("a", "retyped")}, True, False),
    ("a decimal(10,2)", "a decimal(10,4)", {("a", "retyped")}, False, False),
    ("a int", "a decimal(12,2)", {("a", "retyped")}, True, False),
    ("a int", "a decimal(11,2)", {("a", "retyped")}, False, False),
    ("a date", "a string", {("a", "retyped")}, True, False),
    (ALL_TYPES, ALL_TYPES, set(), True, True),
]


@pytest.mark.parametrize(("old", "new", "changes", "backward", "forward"), CASES)
def test_diff_and_compatibility(spark, old, new, changes, backward, forward):
    a, b = (S.fields_frame(spark, [("t", i, S.as_schema(spark, ddl))]) for i, ddl in ((1, old), (2, new)))
    d = S.diff(a, b)
    assert {(r["path"], r["change"]) for r in d.collect()} == changes
    turned = {"added": "removed", "removed": "added"}
    assert {(r["path"], turned.get(r["change"], r["change"])) for r in S.diff(b, a).collect()} == changes
    ok = {m: all(r["ok"] for r in S.compatibility(d, m).collect()) for m in S.MODES}
    assert ok == {"NONE": True, "BACKWARD": backward, "FORWARD": forward, "FULL": backward and forward}


atoms = st.sampled_from([T.IntegerType(), T.StringType(), T.DateType(), T.DecimalType(8, 3), T.DoubleType()])
kinds = st.recursive(atoms, lambda k: st.one_of(k.map(T.ArrayType), k.map(lambda x: T.MapType(T.StringType(), x)), st.lists(k, min_size=1, max_size=3).map(lambda ks: T.StructType([T.StructField(f"m{i}", x) for i, x in enumerate(ks)]))), max_leaves=5)


@given(st.lists(st.tuples(kinds, st.booleans()), min_size=1, max_size=4))
@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
def test_any_schema_equals_itself(spark, columns):
    schema = T.StructType([T.StructField(f"c{i}", k, n) for i, (k, n) in enumerate(columns)])
    assert T.StructType.fromJson(__import__("json").loads(S.canonical(schema))) == schema
    f = S.fields_frame(spark, [("t", 1, schema)])
    assert S.diff(f, f).count() == 0


def test_bind_and_validate(registry, spark, tmp_path):
    spark.range(3).selectExpr("id", "cast(id as string) name").write.parquet(str(tmp_path / "data"))
    registry.register("t", "id bigint, name string")
    registry.bind("data", str(tmp_path / "data"), "parquet", "t")
    assert registry.validate("data").count() == 0
    registry.register("t", "id int, name string")
    registry.bind("data", str(tmp_path / "data"), "parquet", "t")
    assert [(r["path"], r["change"]) for r in registry.validate("data").collect()] == [("id", "retyped")]
    assert registry.datasets().count() == 1


@pytest.mark.parametrize("format", ["parquet", "orc", "json", "csv"])
def test_infer(spark, tmp_path, format):
    path = str(tmp_path / format)
    frame = spark.createDataFrame([(1, "x")], "a bigint, b string")
    (frame.write.option("header", True).csv(path) if format == "csv" else IO.write(frame, path, format))
    assert [(f.name, f.dataType.simpleString()) for f in IO.infer(spark, path, format)] in ([("a", "bigint"), ("b", "string")], [("a", "int"), ("b", "string")])
    assert IO.read(spark, path, format, "a bigint, b string", header=True).collect()[0]["b"] == "x"
    with pytest.raises(ValueError):
        IO.read(spark, path, "exe")


def test_fields_of_all(registry):
    registry.register("t", "id bigint, name string")
    registry.register("u", "id bigint, s struct<name:string>")
    assert {(r["subject"], r["path"]) for r in registry.find_fields(like="name").collect()} == {("t", "name"), ("u", "s.name")}
    assert [tuple(r) for r in registry.shared_fields().collect()] == [("id", "bigint", 2, "t,u")]
    assert {tuple(r) for r in registry.type_summary().where("type is null").collect()} == {(None, None, 4), ("t", None, 2), ("u", None, 2)}
    assert {(r["path"], r["change"]) for r in registry.diff("t", 1, 1).collect()} == set()


def test_fields_are_stored(registry):
    registry.register("t", ALL_TYPES)
    registry.register("t", "a int")
    assert [r["path"] for r in registry.fields("t", 1).orderBy("path").collect()] == sorted(f[1] for f in S.flatten(T.StructType.fromDDL(ALL_TYPES)))
    assert [tuple(r)[:4] for r in registry.fields("t").collect()] == [("t", 2, 0, "a")] and registry.fields("nothing").count() == 0
    registry.deprecate("t", 2)
    assert registry.fields().count() == registry.fields("t", 1).count() > 1
    with pytest.raises(KeyError):
        registry.fields("t", 2)


def test_stored_edges(registry, spark):
    assert registry.edges().count() == 0
    registry.declare_edge("a", "x", "b", "y")
    registry.declare_edge("a", "x", "b", "y")
    registry.register("a_table", "x int, z int")
    spark.createDataFrame([], "x int, z int").createOrReplaceTempView("a_table")
    registry.register_query("job", spark.sql("SELECT x AS v FROM a_table WHERE z > 1"), "c")
    got = {tuple(r) for r in registry.edges().collect()}
    assert got == {("a", "x", "b", "y", "declared", None), ("a_table", "x", "c", "v", "value", "job"), ("a_table", "z", "c", "v", "influence", "job")}
    assert {tuple(r) for r in registry.table_edges().collect()} == {("a", "b"), ("a_table", "c")}
    registry.register_query("job", spark.sql("SELECT 1 AS v"), "c")
    assert {tuple(r) for r in registry.edges().collect()} == {("a", "x", "b", "y", "declared", None)}
