"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written_and_seen


def _edges(edges: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """The edges written, with their number and a checksum."""
    out, seen = written_and_seen(edges, "component-edges", n=F.count("*"), h=F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    return out, (seen.get("n") or 0, int(seen.get("h") or 0))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the edges (a, b): the smallest node that can be reached from it.

    Each round joins nodes with their least neighbour and is written to the shared folder; the driver sees a count
    and a checksum. Loops and repeated edges have no effect; an edge with a null end is left out. An empty table gives
    no rows.
    """
    kept = edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    now, state = _edges(kept.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while state[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, last = now, state
        now, state = _edges(small.union(low.select("a", F.col("m").alias("b"))).distinct())
        discard(before)
        if state == last:
            break
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("label", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(roots)
