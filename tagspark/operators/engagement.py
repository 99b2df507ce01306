"""Which tags earn attention: the metric per tag against the overall mean."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagspark import fixed
from tagspark.functions.tags import ratio
from tagspark.functions.text import tolerant_number
from tagspark.operators.order_stats import medians_of_counts
from tagspark.operators.tagging import place
from tagspark.session import written


def measured(df: DataFrame, metric: str = "views") -> DataFrame:
    """FLT-2: rows whose metric is a number, as `value`."""
    return df.withColumn("value", tolerant_number(F.col(metric))).filter(F.col("value").isNotNull())


def tag_engagement(df: DataFrame, metric: str = "views", min_support: int = fixed.MIN_SUPPORT,
                   tags: str = "tags", order: str = "ord") -> DataFrame:
    """AG-10, FLT-3, SL-5: images, mean, median and lift per tag, best lift first.

    The overall mean covers every measured row, tagged or not; a tag named
    twice in a row counts twice. Ranking uses the lift to two decimals, ties
    by first appearance; the columns themselves are not rounded.
    """
    # One shuffle on (tag, value) feeds the counts, the means and the medians.
    # Untagged rows stay in it without a tag, and every row is counted once in
    # `_rows`, so that the overall mean comes from the same shuffle.
    rows = measured(df, metric).select(order, "value", F.posexplode_outer(tags).alias("_pos", "tag"))
    every = written(
        rows.groupBy("tag", "value")
        .agg(F.count(F.lit(1)).alias("_count"), F.min(place(rows, order, "_pos")).alias("_first"),
             F.count_if(F.coalesce("_pos", F.lit(0)) == 0).alias("_rows")), "engagement")
    counts = every.filter(F.col("tag").isNotNull())
    overall = every.agg((F.sum(F.col("value") * F.col("_rows")) / F.sum("_rows")).alias("overall")).scalar()
    per_tag = (
        counts.groupBy("tag")
        .agg(F.sum("_count").alias("images"),
             (F.sum(F.col("value") * F.col("_count")) / F.sum("_count")).alias("mean"),
             F.min("_first").alias("first_seen"))
        .filter(F.col("images") >= min_support))
    middle = medians_of_counts(counts.select("tag", "value", "_count"), ["tag"], "value", "median")
    return (
        per_tag.join(middle, "tag")
        .withColumn("lift", ratio(F.col("mean"), overall))
        .orderBy(F.desc(F.bround("lift", 2)), "first_seen")
        .select("tag", "images", "mean", "median", "lift"))


def coverage(df: DataFrame, metric: str = "views") -> DataFrame:
    """AG-11: overall mean and how many rows have the metric."""
    value = tolerant_number(F.col(metric))
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(value).alias("rows_with_metric"),
        F.avg(value).alias("overall_mean"))


def match_coverage(before: DataFrame, after: DataFrame) -> DataFrame:
    """AG-23: rows that went in and rows that found a partner."""
    found = after.agg(F.count(F.lit(1)).alias("n")).scalar()
    return before.agg(F.count(F.lit(1)).alias("rows")).withColumn("matched", found)
