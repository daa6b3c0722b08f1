"""Choosing rows: best of a key, leaders with followers, samples, bounded queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathe.functions.ids import sample_key


def best_of(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key in an order that ends with an id."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def one_per_group(df: DataFrame, group: str, order: list[Column], most: int, item: str, per_group: str | None = None) -> DataFrame:
    """(group, leader, position, followers): the first item of each group, the groups in their leaders' order.

    At most ``most`` groups, a top-k as a feed shows it. Followers are counted,
    not collected, so a group of any size stays one row.
    """
    w = Window.partitionBy(group).orderBy(*order)
    ranked = df.withColumn("__n", F.row_number().over(w)).withColumn("followers", F.count(F.lit(1)).over(Window.partitionBy(group)) - 1)
    # Only leaders go on, and Spark takes the first ``most`` of each partition before it merges them.
    leaders = ranked.where("__n = 1").orderBy(*order).limit(most)
    position = F.row_number().over(Window.orderBy(*order))  # ``most`` rows
    return leaders.withColumn("position", position).select(F.col(group), F.col(item).alias("leader"), "position", "followers")


def seeded_sample(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """The same ``n`` rows for the same seed, whatever the order or partitioning."""
    return df.withColumn("__k", sample_key(seed, key)).orderBy("__k", key).limit(n).drop("__k")


def work_queue(df: DataFrame, priority: Column, last: str, key: str, n: int) -> DataFrame:
    """The next ``n`` to do: by priority, never tried first, longest ago, id."""
    return df.withColumn("__p", priority).orderBy("__p", F.col(last).asc_nulls_first(), key).limit(n).drop("__p")


def by_prefix(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """(matches, only): number of distinct values that start so, and the value if it is the only one."""
    hit = df.where(F.col(column).startswith(prefix)).select(column).distinct()
    return hit.agg(F.count(F.lit(1)).alias("matches"), F.min(column).alias("first")).select("matches", F.when(F.col("matches") == 1, F.col("first")).alias("only"))


def percentile_nearest_rank(df: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """The element at rank ceil(p n) of each key, by counts of values: no key is sorted whole in one task."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    run = counts.withColumn("__r", F.sum("__c").over(w)).withColumn("__t", F.sum("__c").over(Window.partitionBy(*keys)))
    at = lambda p: F.min(F.when(F.col("__r") >= F.ceil(F.col("__t") * p), F.col(value)))
    return run.groupBy(*keys).agg(*[at(p).alias(f"p{round(p * 100)}") for p in shares])
