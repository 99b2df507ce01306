"""The events as files that arrive one after another, and what streaming jobs make of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagspark.catalog import adapters as A
from tagspark.catalog.adapters import sql
from tagspark.catalog.registry import query
from tagspark.catalog.run_queries import COUNTERS, LATENCY, _history_rows
from tagspark.session import fresh_path
from tagspark.streaming import jobs

FILES = 4


def _arriving(spark, rows, order):
    """`rows` in a few files by `order`, read as a stream of one file per batch."""
    path = fresh_path(spark, "arriving")
    rows.repartitionByRange(FILES, order).write.parquet(path)
    return jobs.arriving(spark, path, rows.schema, files_per_batch=1)


def _run(spark, changed):
    path = fresh_path(spark, "batches")
    jobs.run_available(changed, path, fresh_path(spark, "stream-state"))
    return path


@query(sql(f"SELECT run_id, {COUNTERS} FROM actions GROUP BY run_id", "actions"))
def streamed_counters(spark, sf_dir):
    """Counters by day of events that come in no order, added up; no event is late, as years may lie between them."""
    events = _arriving(spark, A.actions(spark, sf_dir), "task_id")
    path = _run(spark, jobs.counters(events, "run_id", late="3650 days"))
    return jobs.counter_totals(jobs.batches(spark, path), "run_id")


@query(sql(LATENCY.format(by="action"), "actions"))
def streamed_latency(spark, sf_dir):
    """Exact ranks from value counts kept as the state of a stream."""
    path = _run(spark, jobs.value_counts(_arriving(spark, A.actions(spark, sf_dir), "task_id"), ["action"]))
    return jobs.latency_totals(jobs.batches(spark, path))


@query(sql("SELECT run_id, image_path, CAST(value AS VARCHAR) AS specs, write_ord FROM latest", "history"))
def streamed_results(spark, sf_dir):
    """Results put batch by batch, every batch twice, as after a failure."""
    rows = _history_rows(spark, sf_dir)
    path = fresh_path(spark, "batches")

    def twice(batch, to, batch_id):
        jobs.put_batch(batch, to, batch_id)
        jobs.put_batch(batch, to, batch_id)

    jobs.run_available(_arriving(spark, rows, "write_ord"), path, fresh_path(spark, "stream-state"), "append", twice)
    return jobs.results_history(spark, path).select("run_id", "image_path", "specs", "write_ord")
