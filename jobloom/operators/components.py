"""Connected components of a graph given as edges, without any group on one task or the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.session import staged


def _star(e: DataFrame, large: bool) -> DataFrame:
    """One star operation on edges (u, v), u > v: neighbours are linked to the smallest neighbour instead. The smallest
    neighbour comes from a partial min and is joined back, so a hot node's edges may lie in many tasks."""
    if large:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        x = both.where("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        m = e.groupBy("u").agg(F.min("v").alias("m"))
        x = e.join(m, "u")
        x = x.select(F.col("v").alias("u"), F.col("m").alias("v")).union(m.select("u", F.col("m").alias("v")))
    return x.where("u <> v").distinct()


def connected_components(edges: DataFrame, src: str, dst: str, rounds: int = 40) -> DataFrame:
    """(node, component): every node of an edge with the smallest node it is connected to.

    Edges may repeat, point either way or be loops (a loop makes its node known); edges with a null end are left out.
    Large-star and small-star rounds alternate until nothing changes; each round is written to the shared folder, which
    ends the lineage.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).dropna()
    e = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = staged(e, "edges")
    loops, links = e.where("u = v").select("u"), e.where("u <> v")
    print_of = None
    for _ in range(rounds):
        links = staged(_star(_star(links, True), False), "stars")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(now) == print_of:
            break
        print_of = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    own = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component"))
    lone = loops.select(F.col("u").alias("node"), F.col("u").alias("component"))
    return own.union(roots).union(lone).groupBy("node").agg(F.min("component").alias("component"))
