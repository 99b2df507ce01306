"""Saved results, run records and logs."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagspark import fixed

RESULTS = "path string, category string, model string, tags array<string>, highlights array<string>"
LOG = "ts string, level string, logger string, event string, image string, ms double, error_type string"


def read_results(spark: SparkSession, path: str, as_array: bool = False) -> DataFrame:
    """SRC-5: results saved as JSON lines, or with `as_array` as one JSON array per file.

    `ord` is the ordinal the rows were saved with; rows without one get a
    number that tells them apart.
    """
    return (spark.read.schema(f"{RESULTS}, ord bigint").json(path, multiLine=as_array)
            .withColumn("ord", F.coalesce("ord", F.monotonically_increasing_id())))


def write_results(results: DataFrame, path: str) -> None:
    """SNK-1: CSV when the path ends so, JSON lines otherwise, with `ord` where the rows have one."""
    if path.endswith(".csv"):
        joined = {c: F.array_join(c, "; ") for c in ("highlights", "tags")}
        (results.select("path", "category", "model", "highlights", "tags").withColumns(joined)
         .write.csv(path, header=True, escape='"'))
    else:
        ordinal = ["ord"] if "ord" in results.columns else []
        results.select("path", "category", "model", "tags", "highlights", *ordinal).write.json(path)


def recorded_settings(arguments: Mapping[str, object]) -> dict[str, object]:
    """The arguments that change what a run produces and were given; 0 counts as not given, as False does."""
    kept = {name: arguments[name] for name in fixed.RECORDED_SETTINGS if arguments.get(name) not in (None, False)}
    if kept.get("from_sheet"):
        kept = {k: v for k, v in kept.items() if k not in fixed.SETTINGS_UNUSED_FROM_SHEET}
    return kept


def write_run_record(payload: DataFrame, command: str, arguments: Mapping[str, object], folder: str,
                     started: dt.datetime | None = None) -> str | None:
    """SNK-4: one JSON record of a run; its path, or None when it cannot be written.

    `payload` has one row. A run that did its work must not fail here.
    """
    started = started or dt.datetime.now()
    path = f"{folder.rstrip('/')}/{started:%Y%m%d-%H%M%S}_{command}.json"
    settings = [F.lit(value).alias(name) for name, value in recorded_settings(arguments).items()]
    try:
        payload.select(
            F.lit(command).alias("command"), F.lit(f"{started:%Y-%m-%dT%H:%M:%S}").alias("started_at"),
            *([F.struct(*settings).alias("settings")] if settings else []), "*",
        ).write.json(path)
    except (PySparkException, Py4JJavaError):
        return None
    return path


def newest_record(spark: SparkSession, folder: str, command: str | None = None) -> DataFrame | None:
    """SRC-6: the run record whose name sorts last, or None when there is none."""
    ending = f"_{command}.json" if command else ".json"
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
              .select(F.regexp_extract("path", r"\A(.*?/[^/]*\.json)(?:/part-[^/]*)?\z", 1).alias("record")))
    newest = listed.filter(F.col("record").endswith(ending)).agg(F.max("record").alias("record")).first()
    return spark.read.json(newest["record"], multiLine=True) if newest["record"] else None


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """AG-22: log events, one JSON object per line."""
    return spark.read.schema(LOG).json(path)


def write_review(table: DataFrame, path: str) -> None:
    """SNK-5: the review table as CSV with a header."""
    table.write.csv(path, header=True, escape='"')


def write_evaluation(path: str, *, metrics: DataFrame, per_tag: DataFrame, baselines: DataFrame, verdict: DataFrame,
                     workflow: DataFrame, records: DataFrame) -> None:
    """SNK-7: one JSON folder per part of the report.

    The records grow with the data, so they are written by every task rather
    than put together in one document.
    """
    for name, part in {"metrics": metrics, "per_tag": per_tag, "baselines": baselines,
                       "verdict": verdict, "workflow": workflow, "records": records}.items():
        part.write.json(f"{path.rstrip('/')}/{name}")
