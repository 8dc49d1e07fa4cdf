"""Quotas, epochs and orders of a curriculum over pools of samples by their number of tags (k)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.messages import valid_dialogues
from ..functions.ordering import pick_index, ranked_index, seeded_key

#: Shares of k = 2 to 7 in three epochs, and the samples of an epoch.
WEIGHTS = {
    1: {2: 0.6, 3: 0.2, 4: 0.1, 5: 0.05, 6: 0.03, 7: 0.02},
    2: {2: 0.35, 3: 0.25, 4: 0.15, 5: 0.1, 6: 0.08, 7: 0.07},
    3: {2: 0.2, 3: 0.2, 4: 0.2, 5: 0.15, 6: 0.13, 7: 0.12},
}
TARGET = 6000


def pool_sizes(pools: DataFrame) -> DataFrame:
    """(k, n) of each pool, and their total with k null."""
    return pools.rollup("k").agg(F.count("*").alias("n"))


def epoch_quotas(pools: DataFrame, weights: dict[int, dict[int, float]] | None = None, target: int = TARGET) -> DataFrame:
    """(epoch, k, quota, pool): rounded shares of the target, the difference added to the first k; pool 0 if k has no samples."""
    rows = []
    for epoch, shares in sorted((WEIGHTS if weights is None else weights).items()):
        quota = {k: round(w * target) for k, w in sorted(shares.items())}
        quota[min(quota)] += target - sum(quota.values())
        rows += [(epoch, k, q) for k, q in quota.items()]
    sizes = pools.groupBy("k").agg(F.count("*").alias("pool"))
    return pools.sparkSession.createDataFrame(rows, "epoch int, k int, quota long").join(sizes, "k", "left").select("epoch", "k", "quota", F.coalesce("pool", F.lit(0)).alias("pool"))


def slots(quotas: DataFrame, seed: int = 2024) -> DataFrame:
    """(epoch, k, slot, idx): which place of the shuffled pool fills each slot.

    Up to the pool's size a quota takes samples one after another from where the last such epoch stopped, around the
    end; a larger quota draws with replacement and leaves that place. An empty pool fills nothing.
    """
    plain = F.col("quota") <= F.col("pool")
    taken = F.sum(F.when(plain, F.col("quota")).otherwise(0)).over(Window.partitionBy("k").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1))
    rows = quotas.filter((F.col("quota") > 0) & (F.col("pool") > 0)).withColumn("start", F.pmod(F.coalesce(taken, F.lit(0)), F.col("pool")))
    rows = rows.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("quota") - 1)))
    drawn = pick_index(F.col("pool"), seed, F.col("epoch").cast("string"), F.col("k").cast("string"), F.col("slot").cast("string"))
    idx = F.when(F.col("quota") <= F.col("pool"), F.pmod(F.col("start") + F.col("slot"), F.col("pool"))).otherwise(drawn)
    return rows.select("epoch", "k", "slot", idx.alias("idx"))


def shuffled_pools(pools: DataFrame, seed: int = 2024) -> DataFrame:
    """Adds idx, each sample's place in its pool's order by md5; six pools don't become six tasks."""
    keyed = pools.withColumn("_key", seeded_key(seed, F.col("k").cast("string"), F.col("id").cast("string")))
    return ranked_index(keyed, ["k", "_key", "id"], "idx", by=["k"]).drop("_key")


def sample_epochs(pools: DataFrame, quotas: DataFrame, seed: int = 2024) -> DataFrame:
    """(epoch, k, slot, id and the pool's other columns) of every filled slot. Pools: (k, id, ...)."""
    return slots(quotas, seed).join(shuffled_pools(pools, seed), ["k", "idx"]).drop("idx")


def shortfall(quotas: DataFrame) -> DataFrame:
    """(epoch, k, quota) that an empty pool leaves unfilled."""
    return quotas.filter((F.col("pool") == 0) & (F.col("quota") > 0)).select("epoch", "k", "quota")


def order_epochs(sampled: DataFrame, seed: int = 2024) -> DataFrame:
    """Adds position, from 0, in an order by md5 inside each epoch; epochs follow one another."""
    key = seeded_key(seed, F.col("epoch").cast("string"), F.col("k").cast("string"), F.col("slot").cast("string"), F.col("id").cast("string"))
    return ranked_index(sampled.withColumn("_key", key), ["epoch", "_key", "k", "slot"], "position", by=["epoch"]).drop("_key")


def write_epochs(ordered: DataFrame, path: str) -> None:
    """One folder an epoch, lines in order."""
    ordered.repartitionByRange("epoch", "position").sortWithinPartitions("epoch", "position").write.mode("overwrite").partitionBy("epoch").json(path)


def load_and_filter_pools(samples: DataFrame) -> DataFrame:
    """Valid dialogues (v, k, ...) of all pools; other scripts may stay."""
    return valid_dialogues(samples)


def clean_pool(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid samples without CJK, counts (raw, valid))."""
    kept = valid_dialogues(samples, no_cjk=True)
    counts = samples.agg(F.count("*").alias("raw")).join(F.broadcast(kept.agg(F.count("*").alias("valid"))))
    return kept, counts
