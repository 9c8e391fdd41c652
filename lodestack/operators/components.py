"""Connected components of an edge list by alternating star contraction (large star, small star).

Each round costs a constant number of shuffles of the remaining edges, and the number of rounds
grows with the logarithm of the longest path. Minima are aggregated on the map side, and joins are
plain sort-merge joins of written tables, so the adaptive planner can split a hot centre.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.scratch import discard, materialise


def _is_star_forest(e: DataFrame) -> bool:
    """Every child has one parent and no parent is a child."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty()


def connected_components(edges: DataFrame, a: str = "src", b: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Map each node that has an edge to the smallest node it reaches: columns ``node, component``.

    Null ends and self loops are ignored; repeated edges count once; an empty edge list gives no
    rows. Nodes must be of one orderable type. Each round deletes the tables of the round before;
    the result reads one written table, which ``discard`` deletes.
    """
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = e.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = materialise(e, "edges")
    for _ in range(max_rounds):
        if _is_star_forest(e):
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        big = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        big = materialise(big.distinct(), "big")
        discard(e, low)
        low = materialise(big.groupBy("u").agg(F.min("v").alias("m")), "low")
        moved = big.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(big, low)
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    roots = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    out._scratch_path = e._scratch_path
    return out
