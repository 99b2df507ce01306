"""Streaming jobs: totals, late rows, batches that run again, and going on after an end."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tagspark.operators import runs
from tagspark.streaming import jobs

SCHEMA = ("run_id string, action string, ms double, n_tags int, failed boolean, cached boolean, retries int, model_calls int, "
          "input_tokens bigint, output_tokens bigint, ts timestamp")


@pytest.fixture
def arrive(spark, folder):
    """Adds one file of (run, action, ms, day, hour) rows."""
    def add(*rows):
        spark.createDataFrame([(r, a, ms, 1, False, False, 0, 1, 10, 1, dt.datetime(2026, 1, d, h)) for r, a, ms, d, h in rows],
                              SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")

    return add


@pytest.fixture
def stream(spark, folder):
    def run(make, late="1 day"):
        events = jobs.arriving(spark, f"{folder}/in", SCHEMA, files_per_batch=1)
        query = jobs.run_available(make(events, late), f"{folder}/out", f"{folder}/state")
        return query, jobs.batches(spark, f"{folder}/out")

    return run


def by_window(events, late):
    return jobs.counters(events, "run_id", late=late)


def totals(df):
    return sorted(tuple(r) for r in df.select("run_id", "tasks", "model_calls", "input_tokens").collect())


def test_totals_and_going_on(spark, folder, arrive, stream):
    arrive(("a", "look", 5.0, 1, 1), ("b", "look", 7.0, 1, 2))
    arrive(("a", "look", 5.0, 2, 1), ("a", "check", 9.0, 1, 23))
    stream(by_window)
    arrive(("a", "look", 6.0, 2, 2))
    _, left = stream(by_window)
    events = spark.read.schema(SCHEMA).parquet(f"{folder}/in")
    assert totals(jobs.counter_totals(left, "run_id")) == totals(runs.workflow_counters(events, "run_id")) == [
        ("a", 4, 4, 40), ("b", 1, 1, 10)]
    # A run without new files changes nothing.
    assert totals(jobs.counter_totals(stream(by_window)[1], "run_id")) == [("a", 4, 4, 40), ("b", 1, 1, 10)]


def test_late_rows_of_ended_windows_are_left_out(arrive, stream):
    for rows in ([("a", "look", 1.0, 1, 1)], [("a", "look", 1.0, 10, 1)], [("a", "look", 1.0, 1, 5), ("a", "look", 1.0, 9, 5)]):
        arrive(*rows)
        query, left = stream(by_window)
    # The first of January ended with the tenth; the ninth is within a day of it.
    assert totals(jobs.counter_totals(left, "run_id")) == [("a", 3, 3, 30)]
    assert sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"]) == 1


def test_ranks_from_counts(spark, folder, arrive, stream):
    counts = lambda events, late: jobs.value_counts(events, ["action"])
    arrive(*[("a", "look", float(i % 7), 1, 1) for i in range(50)], ("a", "check", None, 1, 1))
    stream(counts)
    arrive(*[("a", "look", float(i), 2, 1) for i in range(30)], ("a", "check", 2.0, 1, 1))
    _, left = stream(counts)
    whole = runs.latency_per_action(spark.read.schema(SCHEMA).parquet(f"{folder}/in"))
    rows = lambda df: sorted(tuple(r) for r in df.select("action", "calls", "p50", "p95").collect())
    assert rows(jobs.latency_totals(left)) == rows(whole)


def test_a_batch_put_again_leaves_what_it_left_before(spark, folder):
    rows = spark.createDataFrame([("r", "x", 1), ("r", "y", 1)], "run_id string, image_path string, write_ord bigint")
    for n in (0, 1, 1):
        jobs.put_batch(rows.filter(F.col("image_path") == "x") if n == 0 else rows, f"{folder}/out", n)
    assert sorted((r.batch, r.image_path) for r in jobs.batches(spark, f"{folder}/out").collect()) == [(0, "x"), (1, "x"), (1, "y")]
