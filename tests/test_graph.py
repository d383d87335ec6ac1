import itertools
import random

import pytest

from pyspark.sql import functions as F

from terrane.operators import graph as G

EDGES = [("region", "nation"), ("nation", "customer"), ("nation", "supplier"), ("customer", "orders"), ("orders", "lineitem"), ("part", "lineitem"), ("supplier", "lineitem")]


def test_downstream(spark):
    got = {tuple(r) for r in G.downstream(G.edges_frame(spark, EDGES), "region").collect()}
    assert got == {("nation", 1, 1, 1), ("customer", 2, 2, 1), ("supplier", 2, 2, 1), ("orders", 3, 3, 1), ("lineitem", 3, 4, 2)}
    assert G.downstream(G.edges_frame(spark, EDGES), "lineitem").collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain(spark, seed):
    rng = random.Random(seed)
    nodes = [f"n{i}" for i in range(9)]
    plain = sorted({(rng.choice(nodes), rng.choice(nodes)) for _ in range(13)})
    e = G.edges_frame(spark, plain)
    depth, walks = 6, {}
    for start in nodes:
        level, out = {start: 1}, {}
        for d in range(1, depth + 1):
            new = {}
            for a, b in plain:
                if a in level:
                    new[b] = new.get(b, 0) + level[a]
            for b, n in new.items():
                out.setdefault(b, []).append((d, n))
            level = new
        walks[start] = {b: (min(d for d, _ in x), max(d for d, _ in x), sum(n for _, n in x)) for b, x in out.items()}
    for start in nodes[:2]:
        assert {r["node"]: tuple(r)[1:] for r in G.downstream(e, start, depth).collect()} == walks[start]
        ups = {r["node"] for r in G.upstream(e, start, depth).collect()}
        assert ups == {n for n in nodes if start in walks[n]}
    near = {(r["seed"], r["node"]): r["distance"] for r in G.reach(e).collect()}
    assert near == {(s, n): d for s in nodes for n, d in _nearest(plain, s).items()}
    assert {r["node"]: r["length"] for r in G.cycles(e).collect()} == _cycles(plain, nodes)
    for start in nodes[:3]:
        assert {r["node"]: tuple(r)[1:] for r in G.downstream(e, start).collect()} == _figures(plain, start)
    assert {r["node"] for r in G.roots(e).collect()} == {a for a, _ in plain} - {b for _, b in plain}
    assert {r["node"] for r in G.leaves(e).collect()} == {b for _, b in plain} - {a for a, _ in plain}


def _nearest(edges, start):
    found, level, d = {}, {start}, 0
    while level:
        d += 1
        level = {b for a, b in edges if a in level} - found.keys()
        found |= dict.fromkeys(level, d)
    return found


def _figures(edges, start):
    """Nearest, furthest and number of ways by listing them all; the last two None on and behind cycles."""
    near = _nearest(edges, start)
    endless = {n for n in near if n in _nearest(edges, n)}
    endless |= {b for n in endless for b in _nearest(edges, n)}
    ways, level, d = {n: [] for n in near}, [start], 0
    while level:
        d += 1
        level = [b for x in level for a, b in edges if a == x and b not in endless]
        for b in level:
            ways[b].append(d)
    return {n: (near[n], None, None) if n in endless else (near[n], max(ways[n]), len(ways[n])) for n in near}


@pytest.mark.parametrize(("nodes", "edges"), [(12, 14), (40, 46)])
def test_unbounded_on_random_graphs(spark, nodes, edges):
    rng = random.Random(nodes)
    plain = sorted({(f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}") for _ in range(edges)} | {(f"n{i}", f"n{i + 1}") for i in range(nodes // 2)})
    e = G.edges_frame(spark, plain)
    for start in ("n0", f"n{nodes // 3}"):
        assert {r["node"]: tuple(r)[1:] for r in G.downstream(e, start).collect()} == _figures(plain, start)


def test_long_chain(spark):
    """200 edges in a row, with a second way round every tenth node, and a cycle far off."""
    chain = [(f"c{i}", f"c{i + 1}") for i in range(200)]
    e = G.edges_frame(spark, chain + [(f"c{i}", f"c{i + 2}") for i in range(0, 100, 10)] + [("c200", "r0"), ("r0", "r1"), ("r1", "r0")])
    got = {r["node"]: tuple(r)[1:] for r in G.downstream(e, "c0").collect()}
    assert len(got) == 202 and got["c200"] == (190, 200, 2**10) and got["r1"] == (192, None, None)
    assert {r["node"]: r["length"] for r in G.cycles(G.edges_frame(spark, [*chain[:59], ("c59", "c0")])).collect()} == {f"c{i}": 60 for i in range(60)}


def test_more_ways_than_a_long_holds(spark):
    e = G.edges_frame(spark, [x for i in range(64) for x in ((f"a{i}", f"b{i}"), (f"a{i}", f"c{i}"), (f"b{i}", f"a{i + 1}"), (f"c{i}", f"a{i + 1}"))])
    got = {r["node"]: r["paths"] for r in G.downstream(e, "a0").where("node like 'a%'").collect()}
    assert got["a62"] == 2**62 and got["a64"] is None


def _cycles(edges, nodes):
    out = {}
    for n in nodes:
        seen, level, d = set(), {n}, 0
        while level:
            d += 1
            level = {b for a, b in edges if a in level} - seen
            if n in level:
                out[n] = d
                break
            seen |= level
    return out


def test_paths(spark):
    e = G.edges_frame(spark, [*EDGES, ("lineitem", "region")])
    got = {(r["path"], r["length"]) for r in G.paths(e, "region", "lineitem").collect()}
    assert got == {("region > nation > supplier > lineitem", 3), ("region > nation > customer > orders > lineitem", 4)}
    assert G.paths(e, "lineitem", "part").collect() == []


def test_common_orphans_and_impact(spark):
    e = G.edges_frame(spark, EDGES)
    names = lambda df: {r["node"] for r in df.collect()}
    assert names(G.common(e, "nation", "customer")) == {"orders", "lineitem"}
    assert names(G.common(e, "nation", "customer", "first")) == {"customer", "supplier"}
    assert names(G.orphans(e, spark.createDataFrame([("x",), ("part",)], "node string"))) == {"x"}
    top = [tuple(r) for r in G.top_impact(e, 3).orderBy("rank", "node").collect()]
    assert top == [("region", 5, 1), ("nation", 4, 2), ("customer", 2, 3)]
    for a, b in itertools.combinations(["region", "part"], 2):
        assert names(G.common(e, a, b, "either")) == names(G.downstream(e, a)) | names(G.downstream(e, b))
    changes = spark.createDataFrame([("a", "removed"), ("b", "retyped")], "path string, change string")
    got = sorted(tuple(r) for r in G.impact(changes, "customer", e).collect())
    assert got == [("a", "removed", "lineitem", 2), ("a", "removed", "orders", 1), ("b", "retyped", "lineitem", 2), ("b", "retyped", "orders", 1)]


def test_levels_do_not_shuffle_the_edges(spark, monkeypatch):
    """A level of few rows is broadcast, though Spark takes a cut table for large, and the edges are computed once."""
    plans, true = [], G.cut
    monkeypatch.setattr(G, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or true(df))
    edges = G.edges_frame(spark, [(f"n{i}", f"n{i + 1}") for i in range(6)]).withColumn("made", F.rand(3)).where("made >= 0")
    for ask in (lambda: G.downstream(edges, "n0"), lambda: G.paths(edges, "n0", "n6"), lambda: G.reach(edges, G._seeds(edges, ["n0"]))):
        plans.clear()
        assert ask().count() in (1, 6)
        assert sum("rand(" in p for p in plans) == 1
        assert sum("BroadcastHashJoin" in p for p in plans) >= 6
