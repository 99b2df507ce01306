"""Does the scorer give the same answer twice?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagspark import fixed
from tagspark.functions.tags import jaccard
from tagspark.functions.text import basename
from tagspark.operators.keyed import HOT_ROWS, last_per_key, lookup


def compare_passes(first: DataFrame, second: DataFrame, row_id: str = "ord",
                   hot_rows: int = HOT_ROWS) -> DataFrame:
    """JN-3, SET-3: both answers per path and their agreement.

    A path the second pass answers twice counts with its last answer; a path
    it lacks is left out.
    """
    other = (last_per_key(second.select("path", "tags", row_id), ["path"], F.col(row_id))
             .select("path", F.col("tags").alias("second")))
    return (lookup(first.select("path", row_id, F.col("tags").alias("first")), other, ["path"],
                   F.col(row_id), hot_rows)
            .filter(F.col("second").isNotNull())
            .select(row_id, "path", basename(F.col("path")).alias("image"), "first", "second",
                    jaccard(F.col("first"), F.col("second")).alias("agreement")))


def summary(compared: DataFrame, threshold: float = fixed.UNSTABLE_BELOW) -> DataFrame:
    """AG-19: rows, mean agreement (0 when empty) and how many are unstable."""
    return compared.agg(
        F.count(F.lit(1)).alias("images"),
        F.coalesce(F.avg("agreement"), F.lit(0.0)).alias("mean_agreement"),
        F.count_if(F.col("agreement") < threshold).alias("unstable"))


def unstable(compared: DataFrame, threshold: float = fixed.UNSTABLE_BELOW, order: str = "ord",
             worst: int | None = None) -> DataFrame:
    """FLT-4, SL-6: unstable rows, worst first; only the `worst` when given."""
    rows = compared.filter(F.col("agreement") < threshold).orderBy("agreement", order)
    return rows if worst is None else rows.limit(worst)
