"""Deterministic orders and draws: md5 of a seed and the row's keys instead of random numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def seeded_key(seed: int | str, *keys: str | Column) -> Column:
    """md5 of the seed and the keys joined by bars. Null keys are left out of the text."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *keys))


def pick_index(n: Column, seed: int | str, *keys: str | Column) -> Column:
    """A number from 0 to n - 1 drawn by the row's keys; null where n is 0."""
    draw = F.conv(F.substring(seeded_key(seed, *keys), 1, 8), 16, 10).cast("long")
    return F.when(n > 0, F.pmod(draw, n.cast("long")))


def seeded_shuffle(df: DataFrame, seed: int | str, *keys: str) -> DataFrame:
    """The rows in an order drawn by their keys."""
    return df.orderBy(seeded_key(seed, *keys), *keys)


def first_n(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """The first n rows in the given order."""
    return df.orderBy(*order).limit(n)


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The k first rows of each group, with their rank from 1."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)


def ranked_index(df: DataFrame, order: list[str], index: str = "idx", by: list[str] | None = None) -> DataFrame:
    """Adds each row's place, from 0, in the order; by: the place inside each group of leading order columns.

    No window spans the data: rows are range-partitioned and sorted, numbered inside partitions, and shifted by the
    counts of earlier partitions (one number a partition).
    """
    spark, by = df.sparkSession, by or []
    mono = F.monotonically_increasing_id()
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.shiftright(mono, 33)).withColumn("_local", mono.bitwiseAND(F.lit((1 << 33) - 1)))
    placed = written(placed, "ranked")
    counts = sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect())
    total, starts = 0, []
    for part, n in counts:
        starts.append((part, total))
        total += n
    out = placed.join(F.broadcast(spark.createDataFrame(starts, "_part long, _start long")), "_part").withColumn(index, F.col("_start") + F.col("_local")).drop("_part", "_start", "_local")
    if by:
        first = out.groupBy(*by).agg(F.min(index).alias("_first"))
        out = out.join(first, by).withColumn(index, F.col(index) - F.col("_first")).drop("_first")
    return out
