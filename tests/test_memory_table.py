"""The versioned memory: versions, conflicts, and what a probe reads."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tagspark.operators.memory import split_requests
from tagspark.sources.memory_table import MemoryTable, VersionTaken

SCHEMA = "key string, tags array<string>, created timestamp"


def day(n):
    return dt.datetime(2026, 1, n)


@pytest.fixture
def table(spark, folder):
    return MemoryTable(spark, f"{folder}/memory", SCHEMA, buckets=16)


def put(spark, table, *rows):
    return table.put(spark.createDataFrame([(k, [t], day(d)) for k, t, d in rows], SCHEMA))


def held(df):
    return sorted((r.key, r.tags[0]) for r in df.collect())


def test_a_version_holds_the_last_answer_of_each_key(spark, table):
    assert table.read().collect() == [] and table.versions() == []
    assert put(spark, table, ("a", "old", 1), ("b", "x", 1), ("a", "new", 2), (None, "z", 1)) == 1
    assert put(spark, table, ("a", "late", 1), ("b", "y", 3), ("c", "x", 1)) == 2
    assert held(table.read()) == [("a", "new"), ("b", "y"), ("c", "x")]
    assert held(table.read(1)) == [("a", "new"), ("b", "x")]
    assert table.put(spark.createDataFrame([], SCHEMA)) == 2


def test_only_touched_buckets_are_written(spark, table):
    put(spark, table, *[(f"k{i}", "x", 1) for i in range(200)])
    put(spark, table, ("k3", "y", 2))
    old, new = table.version(1), table.version(2)
    assert len(old.folders) == 16
    assert sum(old.folders[b] != new.folders[b] for b in old.folders) == 1
    assert len(table.read().collect()) == 200


def test_the_later_of_two_writers_merges_again(spark, table):
    put(spark, table, ("a", "one", 1))
    plain = table.version
    stale = [plain()]
    put(spark, table, ("b", "two", 1))
    # The other writer still holds the version before.
    table.version = lambda number=None: stale.pop() if stale and number is None else plain(number)
    assert put(spark, table, ("c", "three", 1)) == 3
    assert held(table.read()) == [("a", "one"), ("b", "two"), ("c", "three")]
    first = plain(1)
    table.version = lambda number=None: first
    with pytest.raises(VersionTaken):
        put(spark, table, ("d", "four", 1))
    table.version = plain
    assert held(table.read()) == [("a", "one"), ("b", "two"), ("c", "three")]


def test_an_unfinished_put_changes_nothing(spark, table, monkeypatch):
    put(spark, table, ("a", "one", 1))
    monkeypatch.setattr(MemoryTable, "_commit", lambda self, new: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        put(spark, table, ("a", "two", 2))
    assert held(table.read()) == [("a", "one")]


def test_files_read_fall_with_the_batch(spark, table):
    put(spark, table, *[(f"k{i}", f"t{i}", 1) for i in range(500)])
    ask = lambda n: spark.createDataFrame([(f"k{i}",) for i in range(n)] + [(None,), ("none",)], "key string")
    files = {n: len(table.matching(ask(n)).inputFiles()) for n in (0, 1, 4, 300)}
    assert files[0] <= 1 and files[1] <= 2 and files[4] <= 5 < files[300] == 16
    for n in (1, 4, 300):
        assert held(table.matching(ask(n))) == sorted((f"k{i}", f"t{i}") for i in range(n))
    assert table.matching(ask(0)).collect() == []


def test_a_few_keys_skip_row_groups(spark, table):
    one = MemoryTable(spark, table.path + "-one", SCHEMA, buckets=1)
    put(spark, one, *[(f"{i:05d}", "x", 1) for i in range(0, 4000, 2)])
    # Between the least and the greatest key, so that only the Bloom filter can tell.
    found = one.matching(spark.createDataFrame([("00001",)], "key string"))
    assert found.collect() == []
    scan = found._jdf.queryExecution().executedPlan()
    while scan.children().size():
        scan = scan.children().head()
    assert scan.metrics().apply("numOutputRows").value() == 0


def test_old_versions_can_go(spark, table):
    for d in (1, 2, 3):
        put(spark, table, ("a", f"v{d}", d), ("b", "x", 1))
    table.forget(keep=1)
    assert table.versions() == [3] and held(table.read()) == [("a", "v3"), ("b", "x")]


def test_requests_are_split_by_a_probe(spark, table):
    put(spark, table, ("a", "x", 1), ("z", "y", 1))
    requests = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "ord int, key string")
    got = split_requests(requests, table)
    assert sorted(tuple(r) for r in got.select("ord", "source").collect()) == [(1, "memory"), (2, "scorer"), (3, "batch")]
    assert got.filter(F.col("cached")).count() == 2
