"""Telling rows that may be wanted from rows that are not, without a shuffle, by a filter of fixed size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A slot filter has 2**SLOT_BITS bits in words of 64, so at most 2**(SLOT_BITS - 6) rows of 16 bytes, whatever the input.
SLOT_BITS = 26


def slot_filter(keys: DataFrame, hashed: Column) -> DataFrame:
    """A filter of fixed size for the 64-bit hashes of `keys`: the words that have a bit set, as word and mask."""
    slots = keys.select(F.shiftrightunsigned(hashed, 64 - SLOT_BITS).alias("_slot"))
    return slots.groupBy(F.shiftrightunsigned("_slot", 6).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(_slot & 63 AS int)))").alias("mask"))


def maybe_in(df: DataFrame, hashed: Column, words: DataFrame, name: str = "maybe") -> DataFrame:
    """`df` with a column `name` that is false only where the hash is none of the filter's.

    The filter's size is bounded, so it is broadcast. What it lets through by
    chance is for an exact step behind it to tell.
    """
    words = words.select(F.col("word").alias("_word"), F.col("mask").alias("_mask"))
    return (df.withColumn("_slot", F.shiftrightunsigned(hashed, 64 - SLOT_BITS))
            .withColumn("_word", F.shiftrightunsigned("_slot", 6)).join(F.broadcast(words), "_word", "left")
            .withColumn(name, F.expr("_mask IS NOT NULL AND (shiftrightunsigned(_mask, cast(_slot & 63 AS int)) & 1) = 1"))
            .drop("_slot", "_word", "_mask"))
