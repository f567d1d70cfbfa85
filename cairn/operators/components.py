"""Connected components of an edge table, by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.session import discard, materialize

#: Nodes up to which they are broadcast; beyond, those of more than HUB neighbours are (there are few), and the rest is shuffled.
BROADCAST_ROWS, HUB = 200_000, 100_000


def _met(near: DataFrame, least: DataFrame, small: bool, tables: list[DataFrame]) -> DataFrame:
    """near with m, the least node that u sees; no task gets all neighbours of a hub. small: least may be broadcast.

    What it writes, it adds to tables. Files of ids are so short that Spark would send the rows of millions of nodes to the
    driver, round by round: beyond the counted sizes joins are told to sort.
    """
    if small:
        return near.join(F.broadcast(least.select("u", "m")), "u")
    least = materialize(least, "least")
    tables.append(least)
    hubs = least.where(F.col("degree") > HUB).select("u", F.col("m").alias("of_hub"))
    if hubs.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:  # more than 2e10 edges
        return near.join(least.select("u", "m").hint("merge"), "u")
    marked = near.join(F.broadcast(hubs), "u", "left")
    others = marked.where("of_hub is null").join(least.where(F.col("degree") <= HUB).select("u", "m").hint("merge"), "u").select("u", "v", "m")
    return marked.where("of_hub is not null").select("u", "v", F.col("of_hub").alias("m")).union(others)


def _star(edges: DataFrame, large: bool, small: bool, tables: list[DataFrame]) -> DataFrame:
    """Every node points its neighbours (those above it, or those below) at the least node it sees."""
    if large:
        near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree")).select("u", F.least("u", "m").alias("m"), "degree")
    joined = _met(near, least, small, tables)
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (its least node) for every node of an edge with two different ends.

    Edges are kept in the shared scratch folder from round to round; the rounds end when a round changes nothing, after
    about log(n) of them.
    """
    edges = materialize(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    print_of = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    seen = print_of(edges)
    while True:
        small = 2 * seen[0] <= BROADCAST_ROWS  # nodes that edges have; a round makes no more edges than that
        tables = [edges]
        edges = materialize(_star(_star(edges, True, small, tables), False, small, tables), "edges")
        for t in tables:
            discard(t)
        now = print_of(edges)
        if now == seen:
            break
        seen = now
    members = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.union(members.select(F.col("component").alias("node"), "component").distinct())
