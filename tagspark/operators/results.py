"""The results history: latest row per image of a run, and the list of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagspark.functions.text import basename
from tagspark.operators.keyed import last_per_key


def latest_results(rows: DataFrame, order: str = "write_ord") -> DataFrame:
    """WN-2: the last written row of each (run, image)."""
    return last_per_key(rows, ["run_id", "image_path"], F.struct("created", order))


def runs_summary(history: DataFrame) -> DataFrame:
    """AG-13, SL-7: images and last write of each run, newest first; reads three columns of all writes."""
    return (history.groupBy("run_id")
            .agg(F.count_distinct("image_path").alias("images"), F.max("created").alias("created"))
            .orderBy(F.desc("created"), "run_id"))


def newest_run(history: DataFrame) -> DataFrame:
    """AG-13: one row, the id of the newest run."""
    newest = history.groupBy("run_id").agg(F.max("created").alias("created"))
    return newest.orderBy(F.desc("created"), "run_id").limit(1).select("run_id")


def run_rows(history: DataFrame, run_id: str | None = None, limit: int | None = None) -> DataFrame:
    """SRC-8, SL-7: the latest rows of one run, the newest by default, by image name.

    `history` holds all writes; the run is picked before its rows are reduced.
    """
    wanted = F.lit(run_id) if run_id else newest_run(history).scalar()
    rows = (latest_results(history.filter(F.col("run_id") == wanted))
            .withColumn("image_name", basename(F.col("image_path")))
            .orderBy("image_name", "image_path"))
    return rows.limit(limit) if limit else rows
