"""Connected components of a link table, by joins and partial aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm._store import materialize


def connected_components(links: DataFrame, rounds: int = 64) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b); component is the smallest id reachable.

    Alternates two star steps until nothing changes: every larger neighbour of
    a node, then every smaller one and the node itself, is linked to the node's
    smallest neighbour. Components shrink to stars in a number of rounds
    logarithmic in their diameter. A node's smallest neighbour comes from a
    partial aggregate and is joined back, so a hub's neighbours never gather in
    one task: the aggregate sends one row per task, and adaptive execution may
    split the join's hot side, for which the aggregate is a written table.
    Every round is written to the shared folder.
    Null ends and self-links are ignored.
    """
    edges = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    edges = materialize(edges.distinct(), "links")
    state = _state(edges)
    for _ in range(rounds):
        edges = materialize(_small_star(materialize(_large_star(edges).distinct(), "large-stars")).distinct(), "stars")
        now = _state(edges)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)


def _state(edges: DataFrame) -> tuple:
    """Tells two edge sets apart: their number and 128 bits over them."""
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64(F.lit(1), "u", "v"))).collect()[0]
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Edges (u > v): each node links its larger neighbours to the least of itself and its neighbours."""
    both = edges.select(F.col("u").alias("n"), F.col("v").alias("w")).union(edges.select(F.col("v").alias("n"), F.col("u").alias("w")))
    least = materialize(both.groupBy("n").agg(F.min("w").alias("m")).select("n", F.least("n", "m").alias("m")), "least")
    up = both.where("w > n").join(least, "n")
    return up.select(F.col("w").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges (u > v): each node links its smaller neighbours, and itself, to the least of them."""
    least = materialize(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    down = edges.join(least, "u")
    moved = down.select(F.col("v").alias("x"), F.col("m").alias("v"))
    own = least.select(F.col("u").alias("x"), F.col("m").alias("v"))
    return moved.union(own).where("x <> v").select(F.greatest("x", "v").alias("u"), F.least("x", "v").alias("v"))
