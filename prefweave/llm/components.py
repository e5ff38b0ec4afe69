"""Connected components of links by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefweave.llm.storage import written

MAX_ROUNDS = 60


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Point the larger (`large`), or the smaller, neighbours of every node to the least node around it."""
    both = links.union(links.select(F.col("b"), F.col("a")))
    if not large:
        both = links  # (a, b) with b < a: the smaller neighbours
    least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
    # Written, so that the join reads two plain tables: the engine can then split a node with very many neighbours.
    least = written(least.withColumn("least", F.least("node", "least")))
    joined = both.join(least, F.col("a") == F.col("node"))
    if large:
        moved = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).union(
            least.select(F.col("node").alias("a"), F.col("least").alias("b"))
        )
    return moved.filter(F.col("a") != F.col("b"))


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of `links` (columns a and b, of one orderable type): the least node it is connected to.

    Links shrink towards stars around the least nodes; when a round of both steps changes nothing, they are such stars. Only
    counts and checksums come to the driver, minima combine on the map side, and every round is written down.
    """
    current = written(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    )
    mark = _mark(current)
    for _ in range(MAX_ROUNDS):
        if not mark[0]:
            break
        current = written(_star(written(_star(current, True)), False).distinct())
        before, mark = mark, _mark(current)
        if mark == before:
            break
    else:
        raise RuntimeError(f"links did not settle in {MAX_ROUNDS} rounds")
    centers = current.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("label")).union(centers)
