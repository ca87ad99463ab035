"""Connected components by alternating star contraction.

Large-star / small-star rounds (Kiveris et al., "Connected Components in
MapReduce and Beyond", 2014): each round hooks neighbours onto the smallest label
seen, so long chains contract in a logarithmic number of rounds. A hub is
never gathered: each round is an aggregate (combined map-side), whose result is written, and a join of two
plain tables, which the adaptive planner can split where a node has very many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.storage import drop_table, table


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One half-round over written edges ``(u, v)`` with ``u > v``; its result is written too."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        mins = table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        linked = both.join(mins, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        mins = table(edges.groupBy("u").agg(F.min("v").alias("m")))
        linked = edges.join(mins, "u")
        linked = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            mins.select("u", F.col("m").alias("v"))
        )
    out = table(linked.where("u > v").distinct())
    drop_table(mins)
    return out


def connected_components(
    edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60
) -> DataFrame:
    """Label each node that has an edge with its component's smallest node.

    ``edges``: columns ``a`` and ``b`` of one orderable type; direction, repeats,
    self loops and rows with a null end do not matter. Returns ``(node,
    component)``, one row for each node that has an edge to another node; an
    empty input gives an empty result.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a != b")
    now = table(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    for _ in range(max_rounds):
        half = _star(now, large=True)
        after = _star(half, large=False)
        drop_table(half)
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_table(now)
        now = after
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
