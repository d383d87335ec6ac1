"""Components, cycles and sketches of graphs against plain versions."""

import random

import pytest

from terrane.operators import cyclic as C
from terrane.operators import graph as G


def reached(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    def of(n):
        seen, todo = set(), [n]
        while todo:
            for b in out.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen
    return {n: of(n) for n in {x for e in edges for x in e}}


def plain_components(edges):
    far = reached(edges)
    return {n: (min(c), len(c), n in far[n]) for n in far for c in [{n} | {m for m in far[n] if n in far[m]}]}


def random_graph(rng, n, m):
    return sorted({(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)})


GRAPHS = {
    "sparse": random_graph(random.Random(1), 60, 60),
    "giant": random_graph(random.Random(2), 60, 150),
    "chain": [(f"n{i:02}", f"n{i + 1:02}") for i in range(25)],
    "ring": [(f"n{i:02}", f"n{(i + 1) % 12:02}") for i in range(12)],
    "rings in a row": [(f"{r}{i}", f"{r}{(i + 1) % 4}") for r in "abc" for i in range(4)] + [("a0", "b1"), ("b0", "c0"), ("c0", "z"), ("y", "a0"), ("s", "s")],
    "star": [("hub", f"n{i}") for i in range(300)] + [(f"n{i}", "hub") for i in range(0, 300, 3)],
}


@pytest.mark.parametrize("name", sorted(GRAPHS))
def test_components(spark, name):
    edges = GRAPHS[name]
    got = {r["node"]: (r["component"], r["size"], r["cyclic"]) for r in C.strong_components(G.edges_frame(spark, [*edges, edges[0]])).collect()}
    assert got == plain_components(edges)


def test_rounds(spark, monkeypatch):
    """A large component is found in as many rounds as its ways are long, both ways at once; long ways elsewhere aren't cut off node by node."""
    edges = random_graph(random.Random(4), 300, 800) + [(f"x{i:02}", f"x{i + 1:02}") for i in range(60)]
    e, true, cuts = G.edges_frame(spark, edges), C.cut, []
    monkeypatch.setattr(C, "cut", lambda df: cuts.append(1) or true(df))
    got = {r["node"]: (r["component"], r["size"], r["cyclic"]) for r in C.strong_components(e).collect()}
    assert got == plain_components(edges)
    assert len(cuts) <= 60, len(cuts)


def test_condensed_has_no_cycle(spark):
    e = G.edges_frame(spark, GRAPHS["sparse"])
    own = C.strong_components(e)
    dag = [tuple(r) for r in C.condensed(e, own).collect()]
    component = {n: c for n, (c, _, _) in plain_components(GRAPHS["sparse"]).items()}
    assert sorted(dag) == sorted({(component[a], component[b]) for a, b in GRAPHS["sparse"] if component[a] != component[b]})
    assert G.cycles(G.edges_frame(spark, dag)).count() == 0


@pytest.mark.parametrize("name", ["sparse", "rings in a row", "chain"])
def test_cycles(spark, name):
    edges, want = GRAPHS[name], {}
    for n in {x for e in edges for x in e}:
        level, seen, d = {n}, set(), 0
        while level:
            d += 1
            level = {b for a, b in edges if a in level} - seen
            seen |= level
            if n in level:
                want[n] = d
                break
    assert {r["node"]: r["length"] for r in G.cycles(G.edges_frame(spark, edges)).collect()} == want


def test_sketches_that_hold_all(spark):
    far = reached(GRAPHS["giant"])
    about = C.reached_about(G.edges_frame(spark, GRAPHS["giant"]), 128).collect()
    assert {r["node"]: (r["at_least"], r["at_most"], r["known"]) for r in about} == {n: (len(x), len(x), True) for n, x in far.items() if x}


def test_sketches_that_do_not(spark):
    """A tree of 3 x 12 x 20 leaves: bounds hold, and only nodes near the top stay in question."""
    edges = [(f"r{i}", f"r{i}.{j}") for i in range(3) for j in range(12 + i)]
    edges += [(m, f"{m}.{k}") for _, m in edges for k in range(20)]
    far = {n: len(x) for n, x in reached(edges).items()}
    e = G.edges_frame(spark, edges)
    about = C.reached_about(e, 64).collect()
    assert all(r["at_least"] <= far[r["node"]] <= r["at_most"] for r in about) and not all(r["known"] for r in about)
    assert {r["node"] for r in C.contenders(e, 2, 64).collect()} == {"r0", "r1", "r2"}
    assert C.sketches(e, 64).groupBy("node").count().agg({"count": "max"}).first()[0] == 64


@pytest.mark.parametrize("name, size", [("sparse", 128), ("giant", 8), ("rings in a row", 4), ("star", 32), ("chain", 40)])
def test_top_impact(spark, name, size):
    far = {n: len(x) for n, x in reached(GRAPHS[name]).items() if x}
    want = sorted(far.items(), key=lambda x: (-x[1], x[0]))[:6]
    got = [(r["node"], r["n_affected"], r["rank"]) for r in G.top_impact(G.edges_frame(spark, GRAPHS[name]), 6, size).orderBy("rank", "node").collect()]
    assert got == sorted(((n, c, 1 + sum(d > c for _, d in want)) for n, c in want), key=lambda x: (x[2], x[0]))


def test_rows_followed(spark, monkeypatch):
    """Of 757 nodes that reach others, the first few alone are followed: no row for each pair of nodes."""
    edges = [(f"r{i}", f"r{i}.{j}") for i in range(3) for j in range(12 + i)]
    edges += [(m, f"{m}.{k}") for _, m in edges for k in range(20)]
    seeds, true = [], G.reach
    monkeypatch.setattr(G, "reach", lambda e, nodes=None, max_depth=None: seeds.append(nodes.count()) or true(e, nodes, max_depth))
    got = [(r["node"], r["n_affected"]) for r in G.top_impact(G.edges_frame(spark, edges), 2, 64).orderBy("rank").collect()]
    assert got == [("r2", 14 * 21), ("r1", 13 * 21)] and seeds == [3]


def test_nothing(spark):
    none = G.edges_frame(spark, [])
    assert C.strong_components(none).count() == G.cycles(none).count() == G.top_impact(none, 3).count() == 0
