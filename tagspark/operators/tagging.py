"""Vocabulary checks and tag counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagspark.functions import tags as T
from tagspark.functions.text import normalise


def validated(df: DataFrame, vocabulary: Sequence[str], raw: str = "raw") -> DataFrame:
    """PRJ-1: add `kept` and `dropped`."""
    return df.withColumns({
        "kept": T.kept_tags(F.col(raw), vocabulary),
        "dropped": T.dropped_tags(F.col(raw), vocabulary),
    })


def in_vocabulary(df: DataFrame, vocabulary: DataFrame, tag: str = "tag", keep: bool = True) -> DataFrame:
    """JN-11: rows whose normalised tag is (or is not) a term of a vocabulary table."""
    terms = vocabulary.select(F.col("tag").alias("_term")).distinct()
    rows = df.withColumn("_norm", normalise(F.col(tag)))
    how = "left_semi" if keep else "left_anti"
    return rows.join(terms, F.col("_norm") == F.col("_term"), how).drop("_norm")


# A place packs an ordinal and a position below 2**31.
_POSITIONS = 1 << 31


def place(df: DataFrame, order: str, position: str) -> Column:
    """Where a row's tag stands, in order of `order` and then position.

    One number where `order` is a whole number, so that the first place is
    found by hash aggregation; a struct, which Spark sorts for, otherwise.
    """
    if dict(df.dtypes)[order] in ("tinyint", "smallint", "int", "bigint"):
        return F.col(order).cast("decimal(20,0)") * F.lit(_POSITIONS) + F.col(position)
    return F.struct(F.col(order), F.col(position))


def place_parts(first: Column) -> tuple[Column, Column]:
    """Ordinal and position of a packed place."""
    ordinal = F.floor(first / F.lit(_POSITIONS)).cast("bigint")
    return ordinal, (first - ordinal.cast("decimal(20,0)") * F.lit(_POSITIONS)).cast("int")


def tag_counts(df: DataFrame, tags: str = "tags", order: str = "ord") -> DataFrame:
    """AG-1: how often each tag occurs, with where it occurred first."""
    rows = df.select(order, F.posexplode(tags).alias("_pos", "tag"))
    return rows.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.min(place(rows, order, "_pos")).alias("first_seen"))


def ranked(counts: DataFrame) -> DataFrame:
    """Commonest first, ties by first appearance."""
    return counts.orderBy(F.desc("n"), F.asc("first_seen"))


def top_tags(df: DataFrame, k: int, tags: str = "tags", order: str = "ord") -> DataFrame:
    """AG-2: the k commonest tags."""
    return ranked(tag_counts(df, tags, order)).limit(k)


def median_label_size(df: DataFrame, tags: str = "tags") -> DataFrame:
    """AG-3: the upper middle of the label sizes, 0 when there are no rows.

    Works on the histogram of sizes. A size of s takes s tags, so d different
    sizes need at least d(d-1)/2 tags and the histogram stays small.
    """
    sizes = df.groupBy(F.size(tags).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    histogram = sizes.agg(
        F.array_sort(F.collect_list(F.struct("s", "n"))).alias("steps"), F.sum("n").alias("total"))
    found = F.aggregate(
        "steps",
        F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("int").alias("median")),
        lambda a, b: F.struct(
            (a["seen"] + b["n"]).alias("seen"),
            F.coalesce(a["median"], F.when(
                a["seen"] + b["n"] > F.floor(F.col("total") / 2), b["s"])).alias("median")))
    return histogram.select(F.coalesce(found["median"], F.lit(0)).alias("median_size"))


def drift(df: DataFrame, raw: str = "raw", dropped: str = "dropped") -> DataFrame:
    """AG-21: how much of what was answered lies outside the vocabulary."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.size(dropped) > 0).alias("rows_with_drops"),
        F.coalesce(F.sum(F.size(dropped)), F.lit(0)).alias("dropped_tags"),
        F.coalesce(F.sum(F.size(raw)), F.lit(0)).alias("raw_tags"),
        F.coalesce(F.sum(F.size(dropped)) / F.nullif(F.sum(F.size(raw)), F.lit(0)), F.lit(0.0)).alias("dropped_share"))


def dropped_counts(df: DataFrame, dropped: str = "dropped", order: str = "ord") -> DataFrame:
    """AG-21: which tags outside the vocabulary are answered most."""
    return ranked(tag_counts(df, dropped, order))
