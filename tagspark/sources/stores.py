"""The request memory and the results history, as append-only Parquet.

A put appends; a read takes the latest row of each key. Nothing is rewritten in
place, so a lost executor or a failed job cannot leave half a table behind.

    <history>/run_id=<run>/part-*.parquet       puts of few runs
    <history>/_shared/rows/part-*.parquet       puts of many runs, in the order of their runs
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagspark.operators.keyed import last_per_key
from tagspark.operators.results import latest_results

DETAILS = "struct<category: string, product: string, description: string, specs: string>"
MEMORY = (f"key string, tags array<string>, rationale map<string, string>, details {DETAILS}, "
          "model string, created timestamp")
RESULT_ROWS = (
    "run_id string, image_path string, tags array<string>, highlights array<string>, "
    "rationale map<string, string>, category string, product string, description string, "
    "specs string, model string, attempts int, cached boolean, created timestamp, write_ord bigint")

# Runs of one put that get a folder each; with more of them its runs share files.
RUN_FOLDERS = 100
# Hidden from readers of the folders above it.
SHARED = "_shared/rows"


def _names(schema: str) -> list[str]:
    return [f.split(" ")[0] for f in schema.replace(f"details {DETAILS}", "details d").replace(
        "map<string, string>", "map").split(", ")]


def remember(rows: DataFrame, path: str) -> None:
    """SNK-3: insert or replace answers by key."""
    rows.select(*_names(MEMORY)).write.mode("append").parquet(path)


def read_memory(spark: SparkSession, path: str) -> DataFrame:
    """SRC-9: the latest answer of each key."""
    return last_per_key(spark.read.schema(MEMORY).parquet(path), ["key"], F.col("created"))


def compact_memory(spark: SparkSession, path: str, to: str) -> None:
    """Write the latest answers alone to a new folder."""
    read_memory(spark, path).write.parquet(to)


def remembered_payload(payload: Column) -> Column:
    """SRC-9: an answer stored as JSON text, either a bare tag list or an object."""
    tags_only = F.from_json(payload, "array<string>")
    whole = F.from_json(payload, f"struct<tags: array<string>, rationale: map<string, string>, details: {DETAILS}>")
    listed = F.ltrim(payload).startswith("[")
    none = F.array().cast("array<string>")
    return F.struct(
        F.coalesce(F.when(listed, tags_only).otherwise(whole["tags"]), none).alias("tags"),
        F.coalesce(F.when(~listed, whole["rationale"]),
                   F.create_map().cast("map<string, string>")).alias("rationale"),
        F.when(~listed, whole["details"]).alias("details"))


def append_results(rows: DataFrame, path: str) -> None:
    """SNK-6: result rows with the columns they have, added to the history.

    A put of up to `RUN_FOLDERS` runs gets one folder per run. With more of
    them the files and folders would grow with the runs, so they share files,
    in which a run lies together: few files hold it, and the least and largest
    run of each row group tell a reader which. `rows` is read once more for its runs.
    """
    if rows.select("run_id").distinct().limit(RUN_FOLDERS + 1).count() <= RUN_FOLDERS:
        rows.hint("rebalance", "run_id").write.mode("append").partitionBy("run_id").parquet(path)
    else:
        (rows.repartitionByRange("run_id", "image_path", "created").sortWithinPartitions("run_id")
         .write.mode("append").parquet(f"{path}/{SHARED}"))


def put_results(rows: DataFrame, path: str) -> None:
    """SNK-2: insert or replace result rows on (run, image)."""
    append_results(rows.select(*_names(RESULT_ROWS)), path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """SRC-8, SNK-6: the latest row of each (run, image) of every run.

    Rows written before a column existed read it as NULL. A filter on `run_id`
    reaches the scans: it prunes the other runs' folders, and the row groups of
    shared files that hold only other runs.
    """
    rows = spark.read.schema(RESULT_ROWS).parquet(path).select(*_names(RESULT_ROWS))
    shared = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{SHARED}")
    if shared.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(shared):
        rows = rows.unionByName(spark.read.schema(RESULT_ROWS).parquet(f"{path}/{SHARED}"))
    return latest_results(rows)
