"""Questions to a graph of dependencies, edges (src, dst): what is downstream, upstream, on the way, and shared.

A closure goes level by level. A level holds one row per node, with the number of ways that lead there, so it never
has more rows than there are nodes, where listing paths could have exponentially many. A closure remembers what it has seen and
ends by itself, however long its paths and cycles are; a depth is only kept to where the caller gives one. Each level is cut
into the shared folder when it is asked for: plans don't grow with depth.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .barriers import cut
from .cyclic import cycles, strong_components, top_impact

__all__ = ["common", "cycles", "downstream", "edges_frame", "field_impact", "impact", "leaves", "nodes_of", "orphans", "paths", "reach", "reverse", "roots", "strong_components", "top_impact", "upstream"]

#: Tables of levels that are read one by one before they are put into one.
PARTS = 16
#: Levels of so many rows are sent to the edges; for larger ones Spark shuffles both as it sees fit.
FEW = 20_000
#: Numbers of ways stop here, far above what a long holds, so that sums of them can't overflow.
MANY = Decimal(10**30)


def edges_frame(spark: SparkSession, edges: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(edges, "src string, dst string")


def _ways(x: str) -> Column:
    return F.least(F.sum(x), F.lit(MANY)).cast("decimal(38,0)")


def _as_long(ways: str) -> Column:
    """Null where there are more ways than a long holds."""
    return F.when(F.col(ways) < F.lit(Decimal(2**63)), F.col(ways).cast("long"))


def _together(parts: list[DataFrame]) -> list[DataFrame]:
    """The same rows in fewer tables, once there are many."""
    return [cut(reduce(DataFrame.unionByName, parts))] if len(parts) >= PARTS else parts


def _sent(level: DataFrame) -> DataFrame:
    """A level as it is joined with the edges: what is few is broadcast, so that a level doesn't shuffle all edges anew.

    Spark can't see it: of a cut table it knows the size that its plan had been thought to have."""
    return F.broadcast(level) if level.count() <= FEW else level


def _levels(edges: DataFrame, seeds: DataFrame, max_depth: int) -> list[DataFrame]:
    """Tables (seed, node, depth, paths) of all walks, a depth each, up to a depth or until nothing is reached."""
    e = cut(edges.select("src", "dst").distinct())
    level = seeds.select("seed", F.col("seed").alias("node"), F.lit(1).cast("decimal(38,0)").alias("paths"))
    levels = []
    for depth in range(1, max_depth + 1):
        step = _sent(level).join(e, F.col("node") == F.col("src")).groupBy("seed", "dst").agg(_ways("paths").alias("paths"))
        level = cut(step.select("seed", F.col("dst").alias("node"), "paths"))
        if level.isEmpty():
            break
        levels = _together([*levels, level.withColumn("depth", F.lit(depth))])
    return levels


def _seeds(edges: DataFrame, nodes: list[str]) -> DataFrame:
    return edges.sparkSession.createDataFrame([(n,) for n in nodes], "node string")


DOWNSTREAM = "node string, min_distance int, max_distance int, paths long"


def downstream(edges: DataFrame, node: str, max_depth: int | None = None) -> DataFrame:
    """node, min_distance, max_distance, paths of everything that depends on a node, at any distance.

    A node on or behind a cycle is reached in endlessly many ways: its max_distance and paths are null. So are paths beyond a
    long. With ``max_depth``, walks of up to so many edges count, round cycles as well, and a node further away has no row.
    """
    if max_depth is not None:
        levels = _levels(edges, _seeds(edges, [node]).withColumnRenamed("node", "seed"), max_depth)
        if not levels:
            return edges.sparkSession.createDataFrame([], DOWNSTREAM)
        rows = reduce(DataFrame.unionByName, levels).groupBy("node").agg(F.min("depth").alias("min_distance"), F.max("depth").alias("max_distance"), _ways("paths").alias("paths"))
        return rows.withColumn("paths", _as_long("paths"))
    start, e = _seeds(edges, [node]), cut(edges.select("src", "dst").distinct())
    found = cut(_reach(e, start).select("node", F.col("distance").alias("min_distance")))
    inside = found.select("node").union(start).distinct()
    inner = cut(e.join(_sent(inside), F.col("src") == F.col("node"), "left_semi"))
    need = cut(inner.groupBy(F.col("dst").alias("of")).agg(F.count(F.lit(1)).alias("need")))
    # a node's figures are known once those of all nodes before it are; on and behind cycles that never happens
    wave = start.select("node", F.lit(0).alias("far"), F.lit(1).cast("decimal(38,0)").alias("ways"))
    wave = wave.join(need, F.col("node") == F.col("of"), "left_anti")
    partial = wave.select("node", F.lit(0).cast("long").alias("had"), "far", "ways").where("1 = 0")
    known: list[DataFrame] = []
    while not wave.isEmpty():
        gain = wave.join(inner, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.lit(1).cast("long").alias("had"), (F.col("far") + 1).alias("far"), "ways")
        sums = partial.unionByName(gain).groupBy("node").agg(F.sum("had").alias("had"), F.max("far").alias("far"), _ways("ways").alias("ways"))
        sums = cut(sums.join(need, F.col("node") == F.col("of")).drop("of"))
        wave, partial = sums.where("had = need").select("node", "far", "ways"), sums.where("had < need").select("node", "had", "far", "ways")
        known = _together([*known, wave])
    if not known:
        return found.select("node", "min_distance", F.lit(None).cast("int").alias("max_distance"), F.lit(None).cast("long").alias("paths"))
    rows = reduce(DataFrame.unionByName, known).withColumnRenamed("node", "of")
    return found.join(rows, F.col("node") == F.col("of"), "left").select("node", "min_distance", F.col("far").alias("max_distance"), _as_long("ways").alias("paths"))


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def upstream(edges: DataFrame, node: str, max_depth: int | None = None) -> DataFrame:
    """What a node depends on, as :func:`downstream` says what depends on it."""
    return downstream(reverse(edges), node, max_depth)


def reach(edges: DataFrame, nodes: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """seed, node, distance: the nearest way from each seed (every node unless given) to each node it reaches.

    Goes on until nothing new is found, or to ``max_depth`` if one is given."""
    return _reach(cut(edges.select("src", "dst").distinct()), nodes, max_depth)


def _reach(e: DataFrame, nodes: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """:func:`reach` of edges that are distinct and cut."""
    level = cut((nodes if nodes is not None else nodes_of(e)).select(F.col("node").alias("seed"), "node").distinct())
    seen, depth = [], 0
    while max_depth is None or depth < max_depth:
        depth += 1
        level = _sent(level.select("seed", "node")).join(e, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        for part in seen:
            level = level.join(part.select("seed", "node"), ["seed", "node"], "left_anti")
        level = cut(level.withColumn("distance", F.lit(depth)))
        if level.isEmpty():
            break
        seen = _together([*seen, level])
    if not seen:
        return e.sparkSession.createDataFrame([], "seed string, node string, distance int")
    return reduce(DataFrame.unionByName, seen).select("seed", "node", "distance")


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def paths(edges: DataFrame, src: str, dst: str, max_length: int | None = None) -> DataFrame:
    """path, length: every path without a repeated node, kept to nodes from which ``dst`` is reached.

    There can be exponentially many; ``max_length`` asks for those of up to so many edges only.
    """
    e = cut(edges.select("src", "dst").distinct())
    useful = cut(_reach(reverse(e), _seeds(edges, [dst])).select("node").union(_seeds(edges, [dst])).distinct())
    kept = cut(e.join(_sent(useful), F.col("dst") == F.col("node"), "left_semi"))
    level = edges.sparkSession.createDataFrame([([src],)], "nodes array<string>")
    found: list[DataFrame] = []
    length = 0
    while max_length is None or length < max_length:
        length += 1
        step = _sent(level).join(kept, F.element_at("nodes", -1) == F.col("src")).where(~F.array_contains("nodes", F.col("dst")))
        step = cut(step.select(F.concat("nodes", F.array("dst")).alias("nodes"), F.lit(length).alias("length")))
        if step.isEmpty():
            break
        found = _together([*found, step.where(F.element_at("nodes", -1) == dst)])
        level = step.where(F.element_at("nodes", -1) != dst).select("nodes")
    if not found:
        return edges.sparkSession.createDataFrame([], "path string, length int")
    return reduce(DataFrame.unionByName, found).select(F.array_join("nodes", " > ").alias("path"), "length")


def roots(edges: DataFrame) -> DataFrame:
    """Nodes that depend on nothing."""
    return edges.select(F.col("src").alias("node")).distinct().join(edges.select(F.col("dst").alias("node")), "node", "left_anti")


def leaves(edges: DataFrame) -> DataFrame:
    """Nodes on which nothing depends."""
    return roots(reverse(edges))


def orphans(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes of a table (node) that no edge touches."""
    return nodes.select("node").distinct().join(nodes_of(edges), "node", "left_anti")


def common(edges: DataFrame, a: str, b: str, how: str = "both") -> DataFrame:
    """Nodes downstream of both, of either, or of only the first of two nodes."""
    of_a, of_b = (reach(edges, _seeds(edges, [x])).select("node") for x in (a, b))
    return {"both": of_a.intersect, "either": lambda x: of_a.union(x).distinct(), "first": of_a.exceptAll}[how](of_b)


def impact(changes: DataFrame, subject: str, edges: DataFrame, shares: int = 16) -> DataFrame:
    """path, change, node, distance: each change of a subject's schema with every dataset downstream of it.

    The answer has a row for each of both, by its definition. Changes, as many as a schema's fields at most, are repeated
    for ``shares`` shares of the datasets, so that no task has to make all of it.
    """
    reached = reach(edges, _seeds(edges, [subject])).select("node", "distance", F.pmod(F.xxhash64("node"), F.lit(shares)).alias("share"))
    each = changes.select("path", "change", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))).alias("share"))
    return each.join(reached, "share").select("path", "change", "node", "distance")


def field_impact(changes: DataFrame, subject: str, column_edges: DataFrame) -> DataFrame:
    """path, change, node, distance: each changed top-level column with the columns (dataset.column) that come from it."""
    edges = column_edges.select(F.concat_ws(".", "src_dataset", "src_field").alias("src"), F.concat_ws(".", "dst_dataset", "dst_field").alias("dst"))
    changed = changes.withColumn("seed", F.concat(F.lit(f"{subject}."), F.split("path", r"\.")[0]))
    found = reach(edges, changed.select(F.col("seed").alias("node")).distinct())
    return changed.join(found, "seed").select("path", "change", "node", "distance")
