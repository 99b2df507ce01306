"""Reusing earlier answers to identical requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagspark.functions.tags import ratio
from tagspark.operators.keyed import HOT_ROWS, lookup
from tagspark.sources.memory_table import MemoryTable


def split_requests(requests: DataFrame, memory: DataFrame | MemoryTable, order: str = "ord",
                   hot_rows: int = HOT_ROWS) -> DataFrame:
    """JN-2, WN-5: where each request's answer comes from.

    `source` is `memory` for a key already remembered, `batch` for a repeat of
    an earlier request of this batch, `scorer` for the first of its key. Keys
    are made distinct before they meet the memory, so a request copied over a
    third of the batch costs one probe. A memory table is read only where
    the keys can be. `requests` is read more than once: pass
    it written out when its keys are costly to compute.
    """
    if isinstance(memory, MemoryTable):
        memory = memory.matching(requests)
    heads = requests.groupBy("key").agg(F.min(order).alias("_head"), F.count(F.lit(1)).alias("_n"))
    known = memory.select("key").distinct().withColumn("_known", F.lit(True))
    answers = heads.drop("_n").join(known, "key", "left")
    return (lookup(requests, answers, ["key"], F.col(order), hot_rows, heat=heads.select("key", "_n"))
            .withColumn("source", F.when(F.col("_known"), "memory")
                        .when(F.col(order) == F.col("_head"), "scorer").otherwise("batch"))
            .withColumn("cached", F.col("source") != "scorer")
            .select(*requests.columns, "source", "cached"))


def memory_summary(split: DataFrame, memory: DataFrame) -> DataFrame:
    """AG-18: hits, misses, share reused and entries after the batch."""
    new = F.count_if(F.col("source") == "scorer")
    entries = memory.agg(F.count_distinct("key").alias("n")).scalar()
    return (split.agg(F.count_if("cached").alias("hits"), new.alias("misses"))
            .withColumn("reused_percent", 100 * ratio(F.col("hits"), F.col("hits") + F.col("misses")))
            .withColumn("entries", entries + F.col("misses")))
