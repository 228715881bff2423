"""Connected components of an edge table, by distributed union-find.

Large-star and small-star steps alternate until every vertex hangs on the least vertex of its component. Each step is a
min-aggregate (combined before the shuffle, so a hub is one row per task) and a join that adaptive execution can split; the
lineage is cut after each round in the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import checkpoint


def _large(edges: DataFrame) -> DataFrame:
    """Each vertex hands its larger neighbours the least of its neighbourhood."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    out = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.filter("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each vertex hangs itself and its smaller neighbours on the least of them; edges are held larger first."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def _sign(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31)))).first()
    return tuple(r)


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs -> (v, root) for every vertex on an edge that is not its component's least vertex.

    Loops and nulls are ignored; a vertex without a row is its own root.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges = checkpoint(edges)
    sign = _sign(edges)
    while sign[0]:
        edges = checkpoint(_small(_large(edges)))
        if (now := _sign(edges)) == sign:
            break
        sign = now
    return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
