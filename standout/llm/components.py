"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from standout.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the edges ``(a, b)``, both of type long; root is the least node reachable.

    Every round hangs the larger neighbours of a node to its least neighbour, then the smaller ones; it ends when no
    edge changes. Minima are combined before the shuffle and joined, so a hub is never gathered in one task. Loops and
    repeated edges are dropped. An empty table gives an empty table.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs, mark = _kept(pairs)
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        star = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = star.groupBy("a").agg(F.min("b").alias("m"))
        star = (
            star.join(least, "a")
            .where("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b")))
            .distinct()
        )
        pairs, now = _kept(star)
        if now == mark:
            break
        mark = now
    roots = pairs.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _kept(pairs: DataFrame) -> tuple[DataFrame, tuple]:
    pairs = cut_lineage(pairs)
    mark = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return pairs, tuple(mark)
