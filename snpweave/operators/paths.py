"""Shortest paths of a network by rounds of joins: many sources at once as bits of longs, and shares of shortest paths.

Edges are (node1, node2), not directed; loops and repeated edges count for nothing. State is a table of the shared folder a
round, so a lost executor costs tasks. No adjacency stands on the driver or in one task; a node with very many neighbours is
split by AQE's skewed joins, and what it sends is added up before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snpweave import shared

STATE_ROWS = 200_000_000  # rows of state a batch of sources may have; more sources take more batches
WORD = 64


def _ends(edges: DataFrame) -> DataFrame:
    """node, other: both directions of every distinct edge without loops."""
    e = edges.where("node1 <> node2").select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")).distinct()
    both = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))
    return shared.materialize(e.select(F.explode(both).alias("e")).select("e.*"), "ends")


def _numbered_nodes(ends: DataFrame) -> tuple[DataFrame, int]:
    """node, i: nodes numbered from 0, and how many there are."""
    nodes = ends.select("node").distinct().withColumn("part", F.pmod(F.xxhash64("node"), F.lit(256)))
    nodes, seen = shared.materialize_and_see(shared.numbered(nodes, "part", ["node"], "i").select("node", "i"), "nodes", n=F.count(F.lit(1)))
    return nodes, seen["n"]


def _batches(n: int, step: int) -> Iterator[Column]:
    """Conditions on the number `i` that split n sources into ranges of `step`."""
    for first in range(0, n, step):
        yield (F.col("i") >= first) & (F.col("i") < first + step)


def _reach(ends: DataFrame, sources: DataFrame, limit: int | None) -> tuple[DataFrame, int]:
    """(node, w, reached, total) and the largest distance: for each node and word w of 64 sources, how many of them are at
    distance 1 or more (at most `limit`), and the sum of these distances.

    A bit stands for a source. A round sends what a node learnt last to its neighbours, where it is OR-ed; bits that were not
    there before are counted. Distances are symmetric, so counts by node are also counts by source.
    """
    bit = F.expr(f"shiftleft(1L, cast(i % {WORD} AS int))")
    word = F.floor(F.col("i") / WORD).cast("long")
    now = sources.select("node", word.alias("w"), bit.alias("seen"), bit.alias("fresh"), F.lit(0).cast("long").alias("reached"), F.lit(0).cast("long").alias("total"))
    now = shared.materialize(now, "reach")
    step = 0
    while limit is None or step < limit:
        gain = now.where("fresh <> 0").select("node", "w", "fresh").join(ends, "node").groupBy(F.col("other").alias("node"), "w").agg(F.bit_or("fresh").alias("gain"))
        both = now.drop("fresh").join(gain, ["node", "w"], "full")
        fresh = F.expr("coalesce(gain, 0L) & ~coalesce(seen, 0L)")
        both = both.withColumn("fresh", fresh).withColumn("n", F.bit_count("fresh").cast("long"))
        zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
        after = both.select("node", "w", F.expr("coalesce(seen, 0L) | fresh").alias("seen"), "fresh", (zero(F.col("reached")) + F.col("n")).alias("reached"), (zero(F.col("total")) + F.col("n") * (step + 1)).alias("total"))
        after, seen = shared.materialize_and_see(after, "reach", fresh=F.sum((F.col("fresh") != 0).cast("long")))
        if not seen["fresh"]:
            break
        now, step = after, step + 1
    return now.select("node", "w", "reached", "total"), step


def _words_a_batch(n: int) -> int:
    return WORD * max(1, STATE_ROWS // max(n, 1))


def diameter(edges: DataFrame) -> DataFrame:
    """diameter: the longest shortest path inside any component; 0 where all edges are loops, -1 without edges."""
    ends = _ends(edges)
    nodes, n = _numbered_nodes(ends)
    longest = 0 if n or not edges.isEmpty() else -1
    for batch in _batches(n, _words_a_batch(n)):
        longest = max(longest, _reach(ends, nodes.where(batch), None)[1])
    return edges.sparkSession.range(1).select(F.lit(longest).cast("long").alias("diameter"))


def closeness(edges: DataFrame, limit: int | None = None) -> DataFrame:
    """node, closeness: reached nodes over the sum of their distances, of all nodes reachable or within `limit` steps. Nodes
    with loops alone have no row."""
    ends = _ends(edges)
    nodes, n = _numbered_nodes(ends)
    parts = None
    for batch in _batches(n, _words_a_batch(n)):
        found = _reach(ends, nodes.where(batch), limit)[0].groupBy("node").agg(F.sum("reached").alias("reached"), F.sum("total").alias("total"))
        parts = found if parts is None else shared.materialize(parts.unionAll(found).groupBy("node").agg(F.sum("reached").alias("reached"), F.sum("total").alias("total")), "near")
    if parts is None:
        return nodes.select("node", F.lit(0.0).alias("closeness")).limit(0)
    return parts.where("total > 0").select("node", (F.col("reached") / F.col("total")).alias("closeness"))


# ---------------------------------------------------------------- betweenness


def _spread(rows: DataFrame, ends: DataFrame, value: str) -> DataFrame:
    """source, node, value: each row's value sent to all neighbours and added up there."""
    return rows.select("source", "node", value).join(ends, "node").groupBy("source", F.col("other").alias("node")).agg(F.sum(value).alias(value))


def _levels(ends: DataFrame, sources: DataFrame, limit: int | None) -> list[DataFrame]:
    """Tables (source, node, ways) of the nodes at distance 0, 1, ...: ways counts the shortest paths from the source."""
    level = shared.materialize(sources.select(F.col("node").alias("source"), "node", F.lit(1.0).alias("ways")), "level")
    out = [level]
    while limit is None or len(out) <= limit:
        near = _spread(level, ends, "ways")
        for known in out[-2:]:  # a neighbour of a level is in it, in the one before or in the one after
            near = near.join(known, ["source", "node"], "left_anti")
        level, seen = shared.materialize_and_see(near, "level", n=F.count(F.lit(1)))
        if not seen["n"]:
            break
        out.append(level)
    return out


def _shares(ends: DataFrame, sources: DataFrame, limit: int | None) -> DataFrame | None:
    """node, share: shares of the shortest paths that leave the batch's sources and go on behind the node. From the farthest
    level back, a node takes ways * sum((1 + share) / ways) over its neighbours one level farther."""
    levels = _levels(ends, sources, limit)
    behind, parts = levels[-1].select("source", "node", (1 / F.col("ways")).alias("part")), None
    for level in reversed(levels[1:-1]):
        got = level.join(_spread(behind, ends, "part"), ["source", "node"], "left")
        got = got.select("source", "node", "ways", (F.col("ways") * F.coalesce("part", F.lit(0.0))).alias("share"))
        got = shared.materialize(got, "shares")
        behind = got.select("source", "node", ((1 + F.col("share")) / F.col("ways")).alias("part"))
        some = got.groupBy("node").agg(F.sum("share").alias("share"))
        parts = some if parts is None else parts.unionAll(some)
    return parts


def betweenness(edges: DataFrame, limit: int | None = 3) -> DataFrame:
    """node, betweenness: shortest paths of at most `limit` steps through a node, each of the equally short ones of a pair of
    nodes counting as its share. Nodes with loops alone have 0.

    Two phases of joins for a batch of sources, sized so that sources times nodes stays within STATE_ROWS: counts of paths
    forward by level, shares of them backward. Work is edges times sources, as for any exact answer.
    """
    ends = _ends(edges)
    nodes, n = _numbered_nodes(ends)
    total = None
    for batch in _batches(n, max(1, STATE_ROWS // max(n, 1))):
        found = _shares(ends, nodes.where(batch), limit)
        if found is not None:
            total = found if total is None else total.unionAll(found)
            total = shared.materialize(total.groupBy("node").agg(F.sum("share").alias("share")), "between")
    every = edges.select(F.explode(F.array("node1", "node2")).alias("node")).distinct()
    if total is None:
        return every.select("node", F.lit(0.0).alias("betweenness"))
    return every.join(total, "node", "left").select("node", (F.coalesce("share", F.lit(0.0)) / 2).alias("betweenness"))
