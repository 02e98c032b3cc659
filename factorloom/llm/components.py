"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import n_made, settled, written


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _least(edges: DataFrame) -> DataFrame:
    """Least member of each node's closed neighbourhood; partial minima are taken before the shuffle."""
    return edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))


def _round(edges: DataFrame) -> DataFrame:
    pairs = _both(edges)
    large = pairs.join(_least(pairs), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    large = large.distinct()
    # Every edge of ``large`` points from the greater to the lesser node.
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    to_least = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return to_least.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of ``edges(a, b)``.

    Each round cuts its lineage in the shared folder and drops the table of the round before; rounds end
    when the edges stay the same.
    """
    since = n_made()
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    sign = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
    seen = sign(now)
    while seen[0]:
        now = settled(_round(now), "edges", since)
        if (fresh := sign(now)) == seen:
            break
        seen = fresh
    # At the end every edge joins a node to its root.
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
