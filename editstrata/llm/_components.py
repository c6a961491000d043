"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import written


#: Edges up to this number: the least neighbours are broadcast (about 100 bytes each) and few tasks write a round.
BROADCAST_EDGES = 300_000
#: Edges that a task writes in such a round.
_TASK_EDGES = 20_000


def _star(edges: DataFrame, large: bool, few: bool) -> DataFrame:
    """Large star: link each node's larger neighbours to the least of its neighbourhood; small star: the lesser ones."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = both.join(F.broadcast(least) if few else least, "u")
    if large:
        return linked.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `edges` (u, v); component is the least node reachable.

    Each round is two aggregations; a node's neighbourhood is never gathered.
    Stars shrink the distance to the least node geometrically, so rounds grow
    with the logarithm of the longest chain. An empty edge table gives an empty result.
    """
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter(F.col("u") != F.col("v")).distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (row["n"], row["h"]) == mark or not row["n"]:
            break
        mark = (row["n"], row["h"])
        few = row["n"] <= BROADCAST_EDGES
        stars = _star(_star(now, True, few), False, few)
        now = written(stars.coalesce(row["n"] // _TASK_EDGES + 1) if few else stars, "stars")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    inner = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return inner.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
