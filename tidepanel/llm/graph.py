"""Connected components by alternating large and small stars, on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.sources.scratch import save


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Minima combine in each task before the exchange. They are written, so that the join may split a hot node.
    least = save(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links every smaller neighbour of a node, and the node, to the smallest."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = save(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node that has an edge; root is the smallest node of the component. Edges: a, b of one ordered type.

    Each round is two joins; the number of rounds grows with the logarithm of the longest path. An empty input gives an empty result.
    """
    stars = save(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    before = _fingerprint(stars)
    while before[0]:
        stars = save(_small_star(_large_star(stars)), "edges")
        now = _fingerprint(stars)
        if now == before:
            break
        before = now
    roots = stars.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(stars.select(F.col("a").alias("node"), F.col("b").alias("root")))
