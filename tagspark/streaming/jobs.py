"""Counters, latency and results of files that keep arriving, with Structured Streaming.

Each job reads new files, keeps its state in Spark's checkpoint and writes what a batch has changed
into a folder named by the batch's id, over whatever lies there. A batch that is run again after a
failure therefore leaves what it left before, and the last batch that names a key has its value.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tagspark.operators.keyed import last_per_key
from tagspark.operators.order_stats import nearest_rank, values_at_ranks
from tagspark.operators.results import latest_results
from tagspark.operators.runs import workflow_counters
from tagspark.sources.stores import RESULT_ROWS


def arriving(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """Rows of the Parquet files in a folder, new ones as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def put_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """Rows of one batch, in place of what an earlier try of it has left."""
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")


def batches(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all batches, with their `batch`."""
    return spark.read.parquet(path).withColumn("batch", F.col("batch").cast("bigint"))


def run_available(changed: DataFrame, path: str, checkpoint: str, mode: str = "update",
                  put: Callable[[DataFrame, str, int], None] = put_batch) -> StreamingQuery:
    """Work through all files there are, batch by batch, and stop; a later call goes on where this one ended."""
    query = (changed.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
             .foreachBatch(lambda rows, batch_id: put(rows, path, batch_id)).start())
    query.awaitTermination()
    return query


def counters(actions: DataFrame, *by: str, time: str = "ts", width: str = "1 day", late: str = "1 day") -> DataFrame:
    """AG-14, AG-16: the counters of each window of event time, as stream or table.

    Rows that come when events more than `late` newer have been seen by an
    earlier batch are late: those of windows that have ended by then are left out.
    """
    timed = actions.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return workflow_counters(timed, F.window(time, width).alias("window"), *by)


def counter_totals(written: DataFrame, *by: str) -> DataFrame:
    """The counters of whole runs from the batches that `counters` has left."""
    keys = ["window", *by]
    last = last_per_key(written, keys, F.col("batch"))
    names = [c for c in last.columns if c not in (*keys, "batch")]
    return last.groupBy(*by).agg(*[F.sum(c).alias(c) for c in names])


def value_counts(actions: DataFrame, keys: Sequence[str], value: str = "ms") -> DataFrame:
    """How often each value of a group has come so far: a state that adds up, from which ranks are exact."""
    return actions.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_count"))


def latency_totals(written: DataFrame, keys: Sequence[str] = ("action",), value: str = "ms") -> DataFrame:
    """AG-17, WN-3: calls and nearest-rank p50 and p95 from the batches that `value_counts` has left."""
    last = last_per_key(written, [*keys, value], F.col("batch")).drop("batch")
    return (values_at_ranks(last, keys, value, {"p50": nearest_rank(50), "p95": nearest_rank(95)})
            .select(*keys, F.col("_n").alias("calls"), "p50", "p95"))


def results_history(spark: SparkSession, path: str) -> DataFrame:
    """SNK-2, SRC-8: the latest row of each (run, image) of all batches of results; of equal times and orders the later batch counts."""
    names = [f.split(" ")[0] for f in RESULT_ROWS.replace("map<string, string>", "map").split(", ")]
    order = F.struct("write_ord", "batch").alias("_order")
    return latest_results(batches(spark, path).select("*", order), "_order").select(*names)
