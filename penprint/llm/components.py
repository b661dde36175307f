"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is two equi-joins and minima over the edges; edges turn into stars around each component's least
node in O(log^2 n) rounds. Every round is a table in the shared folder: lineage stays short and nothing but two
numbers per round reaches the driver. The joined minima are tables too, so that Spark can split a hub's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penprint.llm.common import dropped, written


def _summary(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def _starred(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: neighbours above u go to u's least neighbour; small star: those below u, and u, do."""
    e = edges.filter("u <> v")
    if large:
        near = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = written(near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m")), "least")
    joined = near.join(least, F.col("u") == F.col("c"))
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
    out = written(out.filter("u <> v").distinct(), "star")
    dropped(least)
    return out


def roots(edges: DataFrame) -> DataFrame:
    """u, v of any component: u, and v its component's least node, for every u that isn't itself the least.

    edges: bigint columns u and v, either way round, repeats allowed. No edges give no rows.
    """
    now, before = written(edges.filter("u <> v").distinct(), "edges"), None
    while (seen := _summary(now)) != before:
        before = seen
        big = _starred(now, True)
        small = _starred(big, False)
        dropped(now)
        dropped(big)
        now = small
    return now
