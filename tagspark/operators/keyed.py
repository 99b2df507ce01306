"""One row per key, and look-ups that stay balanced when a key is hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Look-ups leave skew to adaptive execution, which splits the large side of a
# left join. With a number here (or given to `lookup`) keys with more rows are
# split into parts of about that many rows, at the cost of counting them first.
HOT_ROWS: int | None = None
# Rows without a key match nothing; they are spread over this many parts.
KEYLESS_PARTS = 1 << 20


def _one_per_key(df: DataFrame, keys: Sequence[str], order: Column, pick) -> DataFrame:
    """Keep one whole row per key by an aggregate, so that each map task sends
    one row per key and a hot key never meets in one task."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def last_per_key(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """WN-1: the row with the greatest `order` of each key."""
    return _one_per_key(df, keys, order, F.max_by)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """WN-1: the row with the least `order` of each key."""
    return _one_per_key(df, keys, order, F.min_by)


def key_sizes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per key, as `_n`."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))


def lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], row_id: Column,
           hot_rows: int | None = HOT_ROWS, heat: DataFrame | None = None) -> DataFrame:
    """Left join to a side that is unique on `keys`, safe for hot keys.

    Without `hot_rows` this is a plain left join, whose skew adaptive execution
    splits. With it, rows of a key that `left` repeats more than `hot_rows` times are spread by
    the hash of `row_id` (a column that differs between rows, so that the
    spread is the same when a task is run again) over as many parts as they
    fill; only for those keys the row of `right` is repeated once per part.
    Rows with a NULL key match nothing and are spread as well. All other keys
    join as usual, and Spark is free to broadcast a `right` it measures as
    small.

    `heat` gives the rows per key (see key_sizes) when that is known more
    cheaply than by computing `left` twice; it decides balance alone, never
    the result.
    """
    if hot_rows is None:
        return left.join(right, list(keys), "left")
    sizes = key_sizes(left, keys) if heat is None else heat
    hot = (sizes.filter(F.col("_n") > hot_rows)
           .select(*keys, F.ceil(F.col("_n") / max(hot_rows, 1)).alias("_salts")))
    no_key = F.lit(False)
    for key in keys:
        no_key = no_key | F.col(key).isNull()
    spread = (
        left.withColumn("_hash", F.xxhash64(row_id))
        .join(hot, list(keys), "left")
        .withColumn("_salt", F.pmod("_hash", F.when(no_key, KEYLESS_PARTS).otherwise(F.coalesce("_salts", F.lit(1)))))
        .drop("_hash", "_salts"))
    repeated = (
        right.join(hot, list(keys), "left")
        .withColumn("_salt", F.explode(F.sequence(
            F.lit(0).cast("bigint"), F.coalesce("_salts", F.lit(1).cast("bigint")) - 1)))
        .drop("_salts"))
    return spread.join(repeated, [*keys, "_salt"], "left").drop("_salt")
