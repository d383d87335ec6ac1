"""Strongly connected components of a dependency graph, and how much each node reaches, without a row for each pair of nodes.

Components are found by trimming and colouring. Nodes without a way in or out can't be on a cycle and are cut off, wave by wave. Of the
rest every node takes two colours, the greatest number that reaches it and the greatest that it reaches, both in the same rounds. Where they are one, the
node is in that number's component; elsewhere nodes of one component have the same two, so edges between others are dropped, and what is left goes round
again (after Orzan, "On Distributed Verification and Verified Distribution", 2004; McLendon et al., "Finding strongly connected components in distributed
graphs", 2005, who take the two ways one after the other). Numbers go by degree, so that few rounds bring the greatest everywhere.

What nodes reach is sketched: each keeps the ``size`` least hashes of the nodes behind it, and sends what is new in them along the edges
until nothing is new. A sketch that isn't full is the whole set; a full one estimates its size (Beyer et al., "On Synopses for Distinct-Value
Estimation under Multiset Operations", 2007). Sketches pass through cycles as through anything else.

Scale: every round is joins and combined aggregates over edges and a row or ``size`` rows a node; only nodes that changed send anything, and a node of very
many edges is spread by adaptive execution. Rounds are as many as the longest way through the graph at most. Each is cut into the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .barriers import cut

#: A sketch's bounds are so many standard errors wide: what is outside of them is so by one chance in a billion.
ERRORS = 6.0
#: Rounds from node to node before ways are followed by doubling, which long chains and rings need.
PLAIN = 12
#: Waves of trimming at once; colours take apart what is left of long ways.
WAVES = 4


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def trimmed(edges: DataFrame, n: int | None = None) -> tuple[DataFrame, int]:
    """The edges between nodes that have a way in and a way out, among these edges themselves, after ``WAVES`` waves at most, and their number."""
    if n is None:
        edges = cut(edges)
        n = edges.count()
    for _ in range(WAVES):
        if not n:
            break
        ends = edges.select(F.explode(F.array(F.struct(F.col("dst").alias("node"), F.lit(1).alias("into"), F.lit(0).alias("out")), F.struct(F.col("src").alias("node"), F.lit(0).alias("into"), F.lit(1).alias("out")))).alias("end"))
        both = cut(ends.groupBy("end.node").agg(F.max("end.into").alias("into"), F.max("end.out").alias("out")).where("into + out = 2").select("node"))
        kept = cut(edges.join(both, F.col("src") == F.col("node"), "left_semi").join(both, F.col("dst") == F.col("node"), "left_semi"))
        left = kept.count()
        edges, n, done = kept, left, left == n
        if done:
            break
    return edges, n


def numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with numbers (node, id) that go by the lesser of ways in and out, and the edges between numbers."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))).alias("end"))
    degrees = ends.groupBy("end.node").agg(F.least(F.sum("end.out"), F.sum("end.into")).alias("ways"))
    # ranges of sorted rows, each numbered on its own: numbers ascend over all of them
    ids = cut(degrees.orderBy("ways", "node").select("node", F.monotonically_increasing_id().alias("id")))
    a, b = (ids.select(F.col("node").alias(end), F.col("id").alias(f"{end}_id")) for end in ("src", "dst"))
    return ids, cut(edges.join(a, "src").join(b, "dst").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst")))


def _leapt(edges: DataFrame, held: DataFrame) -> DataFrame:
    """node, value: the greatest value on one of the ways that lead to each node, followed twice as far each time."""
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.max("src").alias("via"))
    rows = cut(held.join(into, "node", "left").select("node", "value", F.coalesce("via", "node").alias("via")))
    for _ in range(max(1, rows.count()).bit_length()):
        far = rows.select(F.col("node").alias("via"), F.col("value").alias("more"), F.col("via").alias("next"))
        rows = cut(rows.join(far, "via").select("node", F.greatest("value", "more").alias("value"), F.col("next").alias("via")))
    return rows.select("node", "value")


def _greatest(edges: DataFrame, start: DataFrame) -> DataFrame:
    """node, value: the greatest value (node, value) of the nodes that reach each, its own included."""
    held, rounds = cut(start), 0
    changed = held
    while True:
        sent = changed.join(edges, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("to")).agg(F.max("value").alias("sent"))
        step = cut(held.join(sent, F.col("node") == F.col("to"), "left").select("node", F.greatest("value", F.coalesce("sent", "value")).alias("value"), (F.col("sent") > F.col("value")).alias("new")))
        held, changed, rounds = step.select("node", "value"), step.where("new").select("node", "value"), rounds + 1
        if changed.isEmpty():
            return held
        if rounds == PLAIN:
            held = changed = _leapt(edges, held)


def _coloured(edges: DataFrame) -> DataFrame:
    """node, down, up: the greatest number that reaches each, and the greatest that it reaches, its own included in both."""
    # every node twice, once for each way
    way = lambda column, back: F.struct(F.col(column).alias("id"), F.lit(back).alias("back"))
    arcs = edges.select(F.explode(F.array(F.struct(way("src", 0).alias("a"), way("dst", 0).alias("b")), F.struct(way("dst", 1).alias("a"), way("src", 1).alias("b")))).alias("arc"))
    code = lambda end: F.col(f"arc.{end}.id") * 2 + F.col(f"arc.{end}.back")
    arcs = cut(arcs.select(code("a").alias("src"), code("b").alias("dst")))
    held = _greatest(arcs, _nodes(arcs).withColumn("value", F.shiftright("node", 1)))
    back = F.col("node").bitwiseAND(F.lit(1)) == 1
    found = held.groupBy(F.shiftright("node", 1).alias("node"))
    return cut(found.agg(F.max(F.when(~back, F.col("value"))).alias("down"), F.max(F.when(back, F.col("value"))).alias("up")))


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component, size, cyclic: the set of nodes that a node reaches and is reached from, named by its least node.

    ``cyclic`` is false for a node that doesn't reach itself. An empty graph has no rows.
    """
    every = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    left, n = trimmed(every.where("src <> dst"))
    found = []
    if n:
        ids, left = numbered(left)
        while n:
            colours = _coloured(left)
            found.append(colours.where("down = up").select(F.col("node").alias("id"), F.col("down").alias("colour")))
            of = lambda end: colours.where("down <> up").select(F.col("node").alias(end), F.struct("down", "up").alias(f"{end}_in"))  # noqa: E731, B023
            left, n = trimmed(left.join(of("src"), "src").join(of("dst"), "dst").where("src_in = dst_in").select("src", "dst"))
    nodes = _nodes(every)
    loops = every.where("src = dst").select(F.col("src").alias("loop"))
    if found:
        parts = cut(reduce(DataFrame.unionByName, found).join(ids, "id").select("node", "colour"))
        named = parts.join(parts.groupBy("colour").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("size")), "colour").drop("colour")
        nodes = nodes.join(named, "node", "left")
    else:
        nodes = nodes.select("node", F.lit(None).cast(every.schema["src"].dataType).alias("component"), F.lit(None).cast("long").alias("size"))
    nodes = nodes.join(loops, F.col("node") == F.col("loop"), "left")
    size = F.coalesce("size", F.lit(1).cast("long"))
    return nodes.select("node", F.coalesce("component", "node").alias("component"), size.alias("size"), ((size > 1) | F.col("loop").isNotNull()).alias("cyclic"))


def condensed(edges: DataFrame, components: DataFrame) -> DataFrame:
    """src, dst between components, which has no cycle."""
    of = lambda end: components.select(F.col("node").alias(end), F.col("component").alias(f"{end}_in"))
    both = edges.select("src", "dst").join(of("src"), "src").join(of("dst"), "dst")
    return both.where("src_in <> dst_in").select(F.col("src_in").alias("src"), F.col("dst_in").alias("dst")).distinct()


def cycles(edges: DataFrame) -> DataFrame:
    """node, length: nodes that reach themselves, with the shortest way round.

    Ways are followed inside components, and a node's no further than once round.
    """
    every = cut(edges.select("src", "dst").distinct())
    on = cut(strong_components(every).where("cyclic").select("node", "component"))
    of = lambda end: on.select(F.col("node").alias(end), F.col("component").alias(f"{end}_in"))
    inside = cut(every.join(of("src"), "src").join(of("dst"), "dst").where("src_in = dst_in").select("src", "dst", F.col("src_in").alias("component")))
    # as many edges as nodes: one ring, whose length is their number
    edges_in, nodes_in = (df.groupBy("component").agg(F.count(F.lit(1)).alias(n)) for df, n in ((inside, "edges"), (on, "nodes")))
    rings = cut(edges_in.join(nodes_in, "component").where("edges = nodes").select("component", F.col("nodes").cast("int").alias("length")))
    inside = cut(inside.join(rings, "component", "left_anti").select("src", "dst"))
    closed = [on.join(rings, "component").select("node", "length")]
    front, seen, length = on.join(rings, "component", "left_anti").select(F.col("node").alias("seed"), "node"), [], 0
    while True:
        length += 1
        step = front.join(inside, front["node"] == inside["src"]).select("seed", F.col("dst").alias("node")).distinct()
        for part in seen:
            step = step.join(part, ["seed", "node"], "left_anti")
        step = cut(step)
        round_ = step.where("seed = node").select("node").withColumn("length", F.lit(length))
        front = cut(step.join(round_.select(F.col("node").alias("seed")), "seed", "left_anti"))
        closed, seen = [*closed, round_], [*seen, front]
        if len(seen) >= 16:
            seen = [cut(reduce(DataFrame.unionByName, seen))]
        if front.isEmpty():
            return cut(reduce(DataFrame.unionByName, closed))


def sketches(edges: DataFrame, size: int = 128) -> DataFrame:
    """node, h: the ``size`` least hashes of the nodes that each node reaches."""
    every = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    least = Window.partitionBy("node").orderBy("h")
    keep = lambda rows: rows.withColumn("rank", F.row_number().over(least)).where(F.col("rank") <= size).drop("rank")
    held = fresh = cut(keep(every.select(F.col("src").alias("node"), F.xxhash64("dst").alias("h")).distinct()))
    while True:
        sent = fresh.join(every, F.col("node") == F.col("dst")).select(F.col("src").alias("node"), "h").distinct()
        # rows that were held before stay apart from those that come in
        rows = held.withColumn("old", F.lit(1)).unionByName(sent.withColumn("old", F.lit(0))).groupBy("node", "h").agg(F.max("old").alias("old"))
        step = cut(keep(rows))
        held, fresh = step.select("node", "h"), step.where("old = 0").select("node", "h")
        if fresh.isEmpty():
            return held


def reached_about(edges: DataFrame, size: int = 128) -> DataFrame:
    """node, at_least, at_most, known: bounds of how many nodes each reaches; ``known`` if they are its number."""
    held = sketches(edges, size).groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("h").alias("greatest"))
    # the share of all hashes that the sketch's greatest one is at
    share = (F.col("greatest").cast("double") + 2.0**63) / 2.0**64
    about, error = (size - 1) / share, ERRORS / (size - 2) ** 0.5
    known = F.col("n") < size
    low = F.greatest(F.lit(float(size)), F.floor(about / (1 + error)).cast("double"))
    high = F.ceil(about / (1 - error)).cast("double") if error < 1 else F.lit(float("inf"))
    return held.select("node", F.when(known, F.col("n").cast("double")).otherwise(low).alias("at_least"), F.when(known, F.col("n").cast("double")).otherwise(high).alias("at_most"), known.alias("known"))


def contenders(edges: DataFrame, k: int, size: int = 128) -> DataFrame:
    """The rows of :func:`reached_about` that can be among the ``k`` nodes that reach most."""
    about = cut(reached_about(edges, size))
    last = about.orderBy(F.desc("at_least")).limit(k).agg(F.min("at_least")).first()[0]
    return about.where(F.col("at_most") >= F.lit(last)) if last is not None else about


def top_impact(edges: DataFrame, k: int, size: int = 128) -> DataFrame:
    """node, n_affected, rank: the ``k`` nodes that most nodes depend on; equal numbers share a rank.

    Only nodes whose bounds let them be among the first are followed, one of each cycle.
    """
    from .graph import reach

    every = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    best = cut(contenders(every, k, size))
    counts = best.where("known").select("node", F.col("at_least").cast("long").alias("n_affected"))
    open_ = cut(best.where("not known").select("node"))
    if not open_.isEmpty():
        among = every.join(open_, F.col("src") == F.col("node"), "left_semi").join(open_, F.col("dst") == F.col("node"), "left_semi")
        of = strong_components(among).select("node", "component")
        of = cut(open_.join(of, "node", "left").select("node", F.coalesce("component", "node").alias("component")))
        followed = reach(every, of.select(F.col("component").alias("node")).distinct()).groupBy(F.col("seed").alias("component")).agg(F.count(F.lit(1)).alias("n_affected"))
        counts = counts.unionByName(of.join(followed, "component").select("node", "n_affected"))
    first = counts.orderBy(F.desc("n_affected"), "node").limit(k)
    # at most k rows are ranked
    return first.select("node", "n_affected", F.rank().over(Window.orderBy(F.desc("n_affected"))).alias("rank"))
