"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, save

#: The least neighbours of up to so many edges (16 bytes for each node) are broadcast; those of more are joined.
BROADCAST_EDGES = 50_000


def _with_least_neighbour(pairs: DataFrame, few: bool) -> DataFrame:
    """pairs(u, v) with m, the least of u and all its v; few: they may be broadcast, which saves the join's shuffle.

    The join has a second key, a function of the first: so neither side's partitioning is taken over
    from the aggregate, both are exchanged for the join, and Spark can split the partition of a hub
    at run time. The aggregate itself combines on the map side.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if few:
        return pairs.join(F.broadcast(least), "u")
    salt = F.pmod(F.xxhash64("u"), F.lit(65_521))
    return pairs.withColumn("k", salt).join(least.withColumn("k", salt), ["u", "k"]).drop("k")


def _one_round(edges: DataFrame, few: bool = False) -> DataFrame:
    """edges(u, v) with u > v, once through large star and small star."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _with_least_neighbour(both, few).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
    small = _with_least_neighbour(large if few else large.distinct(), few)
    linked = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
    return linked.where("u > v").distinct()


def connected_components(links: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """(node, component) of every node with a link to another; component is the least node reachable.

    Loops, repeated and reversed links and links with a null end change nothing; no links give no rows.
    Every round is written to the shared folder, so a lost executor costs one round at most. Nothing but
    two numbers a round comes to the driver. Rounds grow with the logarithm of the longest chain.
    """
    with Scratch() as mine:
        edges = _settled(links, src, dst, max_rounds)
        mine.keep(edges)
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _settled(links: DataFrame, src: str, dst: str, max_rounds: int) -> DataFrame:
    """Stars (u, v): every node but a component's least, with the least."""
    a, b = F.col(src).cast("long"), F.col(dst).cast("long")
    edges = save(links.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    seen = None
    for _ in range(max_rounds):
        state = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if tuple(state) == seen or not state[0]:
            return edges
        seen = tuple(state)
        edges = save(_one_round(edges, state[0] <= BROADCAST_EDGES), "links")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
