"""Connected components of a graph held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components by alternating large-star and small-star rounds.

    ``edges`` has two non-null long columns ``a`` and ``b``; direction, loops and
    repeated edges do not matter.  Returns ``(node, component)`` for every node that
    has an edge to another node; ``component`` is the smallest node reachable.  No edges
    give no rows.  Each round is a few joins and groupings, so no component, whatever its
    size, is gathered in one task: a node's least neighbour is a partial aggregate, and the
    join that hands it back may be split by adaptive execution when one node has very many
    neighbours.  Rounds grow with the logarithm of the longest path.
    """
    least, most = F.least("a", "b"), F.greatest("a", "b")
    now = materialize(edges.where(F.col("a") != F.col("b")).select(most.alias("u"), least.alias("v")).distinct(), "edges")
    mark = _mark(now)
    for _ in range(max_rounds):
        before = mark
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("x"), "u", "m")
        small = small.select(F.explode(F.array(F.struct("x", "m"), F.struct(F.col("u").alias("x"), "m"))).alias("e"))
        small = small.select(F.col("e.x").alias("u"), F.col("e.m").alias("v")).where("u != v").distinct()
        after = materialize(small, "edges")
        discard(now)
        now, mark = after, _mark(after)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("u", "v")).alias("x"),
        F.sum(F.xxhash64("v", "u").cast("decimal(20,0)")).alias("s"),
    ).first()
    return (row["n"], row["x"], row["s"])
