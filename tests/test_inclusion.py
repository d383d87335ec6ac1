"""Inclusions found in data against all pairs of columns."""

import datetime
import random

import pytest

from terrane.operators import inclusion as I


def plain(tables):
    values = {}
    for t, df in tables.items():
        rows = df.collect()
        for c in df.schema.names:
            kind = I.kind_of(df.schema[c].dataType)
            if kind:
                got = {(kind, str(r[c])) for r in rows if r[c] is not None}
                values[t, c] = got
    return sorted((*b, *a, len(values[a]), len(values[b])) for a in values for b in values if a != b and values[a] and values[a] <= values[b])


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(6)
    day = lambda i: datetime.date(2020, 1, 1) + datetime.timedelta(days=i)
    keys = [(i, f"name {i}", day(i % 40), float(i)) for i in range(300)]
    uses = [(rng.randrange(300) if i % 10 else None, f"name {rng.randrange(40)}", None, day(rng.randrange(40)), -i) for i in range(900)]
    odd = [("1", 2, "x" * 100 + str(i % 3)) for i in range(20)]
    return {
        "keys": spark.createDataFrame(keys, "k_id int, k_name string, k_day date, k_part double"),
        "uses": spark.createDataFrame(uses, "u_id bigint, u_name string, u_none int, u_day date, u_other smallint"),
        "odd": spark.createDataFrame(odd, "`a.b` string, `c``d` tinyint, long string"),
        "more": spark.createDataFrame([(f"{'x' * 100}{i}",) for i in range(3)], "long string"),
        "empty": spark.createDataFrame([], "k_id int"),
    }


def test_inclusions(tables):
    got = sorted(tuple(r) for r in I.inclusions(tables).collect())
    assert got == plain(tables)
    assert ("keys", "k_id", "uses", "u_id") in {r[:4] for r in got} and ("more", "long", "odd", "long") in {r[:4] for r in got}


def test_no_pair_is_lost_to_sketches(spark):
    """Random subsets of one another: whatever the samples hold, nothing true is pruned."""
    rng = random.Random(3)
    base = [rng.randrange(10**12) for _ in range(400)]
    tables = {f"t{n}": spark.createDataFrame([(v,) for v in rng.sample(base, n)], "v bigint") for n in (1, 2, 5, 20, 200, 399)} | {"all": spark.createDataFrame([(v,) for v in base * 2], "v bigint")}
    assert sorted(tuple(r) for r in I.inclusions(tables).collect()) == plain(tables)


def test_sketches_prune(tables):
    columns = I.columns_of(tables)
    possible = I.candidates(tables, columns, I.sketches(tables, columns)).count()
    assert len(plain(tables)) <= possible < len(columns) * (len(columns) - 1) / 4


def test_foreign_keys(tables):
    assert sorted(tuple(r) for r in I.foreign_keys(tables).collect()) == [("keys", "k_id", "uses", "u_id"), ("keys", "k_name", "uses", "u_name"), ("more", "long", "odd", "long")]


def test_keys_of_the_tables(spark, sf):
    from terrane.queries import FOREIGN_KEYS, TABLES

    tables = {t: spark.read.parquet(f"{sf}/{t}.parquet") for t in TABLES}
    assert {tuple(r) for r in I.foreign_keys(tables).collect()} == {*FOREIGN_KEYS, ("documents", "doc_id", "labels", "doc_id")}


def test_no_candidates(spark):
    assert I.inclusions({"t": spark.createDataFrame([(1.5,)], "x double")}).count() == 0
    assert I.inclusions({"t": spark.createDataFrame([(1, "a")], "x int, y string")}).count() == 0
    assert I.foreign_keys({"t": spark.createDataFrame([(1, "a")], "x int, y string")}).count() == 0


def test_columns_are_not_paired(tables):
    columns = I.columns_of(tables)
    plan = I.candidates(tables, columns, I.sketches(tables, columns))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_values_pass_by_samples_unshuffled(spark, tables):
    """Samples are sent to the values whatever Spark takes their size for, and values leave one aggregate as sets of columns."""
    columns = I.columns_of(tables)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = I.candidates(tables, columns, I.sketches(tables, columns))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert any("BroadcastHashJoin" in line and "LeftSemi" in line for line in plan.splitlines())


def test_columns_of_more_bits_than_a_long(spark):
    tables = {"many": spark.createDataFrame([tuple(range(i, i + 70)) for i in range(3)], ", ".join(f"c{i} int" for i in range(70)))}
    assert sorted(tuple(r) for r in I.inclusions(tables).collect()) == plain(tables)
    tables["one"] = spark.createDataFrame([(i,) for i in range(80)], "v int")
    assert sorted(tuple(r) for r in I.inclusions(tables).collect()) == plain(tables)
