"""Exact order statistics per group, without gathering a group in one task.

`percentile` keeps every distinct value of a group in one task's memory. Here
the values are counted first (a combinable aggregate on group and value) and
sorted by group and value into ranges of about equal size, so that a group has
as many ranges as it needs. Sizes of ranges tell which one holds a wanted rank,
and only that one is counted through.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tagspark.session import written

Rank = Callable[[Column], Column]


def lower_middle(n: Column) -> Column:
    return F.floor((n + 1) / 2)


def upper_middle(n: Column) -> Column:
    return F.floor(n / 2) + 1


def nearest_rank(percent: float) -> Rank:
    """WN-3: rank 1 + round-half-even(percent/100 * (n - 1)), at most n."""
    share = percent / 100
    return lambda n: F.least(F.bround(F.lit(share) * (n - 1), 0).cast("bigint") + 1, n)


def counted(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows per (group, value); NULL values are left out."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_count"))


def values_at_ranks(counts: DataFrame, keys: Sequence[str], value: str, ranks: Mapping[str, Rank]) -> DataFrame:
    """One row per group: its size `_n` and the value at every named rank.

    `counts` is what `counted` returns: unique on (group, value), with `_count`.
    The sorted ranges are written once, as two branches must see the same.
    """
    keys = list(keys)
    placed = written(counts.repartitionByRange(*keys, value).withColumn("_range", F.spark_partition_id()), "ranges")
    targets = F.array(*[
        F.struct(F.lit(name).alias("name"), rank(F.col("_n")).cast("bigint").alias("rank"))
        for name, rank in ranks.items()])

    def between(low: Column, high: Column) -> Column:
        return F.filter("_targets", lambda t: (t["rank"] > low) & (t["rank"] <= high))

    # At most one row per range of a group in these windows.
    group = Window.partitionBy(*keys)
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(*keys, "_range").agg(F.sum("_count").alias("_size"))
    held = (sizes.withColumn("_n", F.sum("_size").over(group))
            .withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
            .withColumn("_targets", targets)
            .withColumn("_targets", between(F.col("_before"), F.col("_before") + F.col("_size")))
            .filter(F.size("_targets") > 0).drop("_size"))
    held = held.withColumnsRenamed({k: f"_held_{k}" for k in (*keys, "_range")})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_held_{k}")) for k in (*keys, "_range")])
    wanted = placed.join(held, same).select(*keys, "_range", value, "_count", "_n", "_before", "_targets")
    upto = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    found = (
        wanted.withColumn("_upto", F.col("_before") + F.sum("_count").over(upto))
        .withColumn("_hits", between(F.col("_upto") - F.col("_count"), F.col("_upto")))
        .filter(F.size("_hits") > 0)
        .withColumn("_names", F.transform("_hits", lambda t: t["name"])))
    return found.groupBy(*keys).agg(
        F.max("_n").alias("_n"),
        *[F.max(F.when(F.array_contains("_names", name), F.col(value))).alias(name) for name in ranks])


def medians(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """The interpolated median of `value` per group, from the two middle values."""
    return medians_of_counts(counted(df, keys, value), keys, value, name)


def medians_of_counts(counts: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    middle = values_at_ranks(counts, keys, value, {"_low": lower_middle, "_high": upper_middle})
    return middle.select(*keys, ((F.col("_low") + F.col("_high")) / 2).alias(name))
