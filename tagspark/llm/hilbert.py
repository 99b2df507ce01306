"""Shards along a Hilbert curve, so that a filter on any of several metadata columns touches few files.

Each dimension is quantised to a few bits, the cells are numbered along the
curve, the rows are sorted by that number and the order is cut into runs of
equal counts. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagspark.session import written

BITS = 6


def _bind(value: Column, use) -> Column:
    """`use(value)` with `value` computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _fold(items: Sequence, start: Column, step) -> Column:
    return F.aggregate(F.array(*items), start, step)


def hilbert_index(dims: Sequence[Column], bits: int = BITS) -> Column:
    """Place of a cell on the Hilbert curve through a grid of 2**bits cells along each dimension.

    Gray-code construction: undo the rotations from the highest bit down, Gray
    encode, and interleave the bits.
    """
    n = len(dims)
    if n * bits > 62:
        raise ValueError("the index must fit 62 bits")
    levels = [1 << b for b in range(bits - 1, -1, -1)]
    turns = [F.struct(F.lit(q).cast("bigint").alias("q"), F.lit(i).alias("i")) for q in levels[:-1] for i in range(n)]

    def turn(x: Column, s: Column) -> Column:
        q, i = s["q"], s["i"]
        here, p = F.get(x, i), q - 1
        swapped = F.get(x, 0).bitwiseXOR(here).bitwiseAND(p)
        return F.when(here.bitwiseAND(q) != 0, F.transform(x, lambda v, j: F.when(j == 0, v.bitwiseXOR(p)).otherwise(v))) \
            .otherwise(F.transform(x, lambda v, j: F.when((j == 0) | (j == i), v.bitwiseXOR(swapped)).otherwise(v)))

    def gray(x: Column) -> Column:
        return F.transform(x, lambda v, j: F.aggregate(
            F.slice(x, 1, j + 1), F.lit(0).cast("bigint"), lambda a, b: a.bitwiseXOR(b)))

    def flip(x: Column) -> Column:
        last = F.get(x, n - 1)
        t = _fold([F.lit(q).cast("bigint") for q in levels[:-1]], F.lit(0).cast("bigint"),
                  lambda a, q: F.when(last.bitwiseAND(q) != 0, a.bitwiseXOR(q - 1)).otherwise(a)) if bits > 1 \
            else F.lit(0).cast("bigint")
        return _bind(t, lambda u: F.transform(x, lambda v: v.bitwiseXOR(u)))

    def interleave(x: Column) -> Column:
        picks = [F.struct(F.lit(q).cast("bigint").alias("q"), F.lit(i).alias("i")) for q in levels for i in range(n)]
        return _fold(picks, F.lit(0).cast("bigint"),
                     lambda a, s: a * 2 + F.when(F.get(x, s["i"]).bitwiseAND(s["q"]) != 0, 1).otherwise(0))

    cell = F.array(*[d.cast("bigint") for d in dims])
    turned = _fold(turns, cell, turn) if turns else cell
    return _bind(turned, lambda a: _bind(gray(a), lambda b: _bind(flip(b), interleave)))


def category(value: Column, bits: int = BITS) -> Column:
    """A category's cell: equal values share one, nulls lie in cell 0."""
    return F.when(value.isNull(), 0).otherwise(F.pmod(F.xxhash64(value), F.lit(1 << bits)))


def magnitude(value: Column, bits: int = BITS, per_doubling: int = 2) -> Column:
    """A size's cell on a logarithmic scale; nulls and numbers below one lie in cell 0."""
    level = F.floor(F.log2(F.greatest(value, F.lit(1))) * per_doubling)
    return F.least(F.coalesce(level, F.lit(0)), F.lit((1 << bits) - 1)).cast("bigint")


def curve_shards(rows: DataFrame, dims: Sequence[Column], ties: Sequence[Column], shards: int, bits: int = BITS) -> DataFrame:
    """`rows` with curve, shard and slot: shards differ by one row at most, slots count from 0 without gaps.

    Rows are ordered by the curve and then by `ties`; a range sort with ties
    that tell rows apart cannot be upset by one frequent cell. Rows equal in all
    of these may come in either order. The order is written once: places are
    read from the sorted partitions, so no task sees more than its own range.
    """
    keys = [hilbert_index(dims, bits).alias("_curve"), *[t.alias(f"_tie{i}") for i, t in enumerate(ties)]]
    names = ["_curve", *[f"_tie{i}" for i in range(len(ties))]]
    ordered = written(
        rows.select(F.struct("*").alias("_all"), *keys).repartitionByRange(*names).sortWithinPartitions(*names)
        .select("_all", "_curve", F.monotonically_increasing_id().alias("_at")), "curve")
    # The high bits of this number name the partition, the low ones count its rows.
    ordered = ordered.select("_all", "_curve", F.shiftright("_at", 33).alias("_part"),
                             F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))
    # One row per partition, however many rows there are.
    counts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
                           F.sum("_n").over(everything).alias("_total"))
    placed = ordered.join(F.broadcast(starts), "_part").withColumn("_rank", F.col("_start") + F.col("_at"))
    shard = F.expr(f"_rank * {shards} div _total")
    return (placed.withColumn("_shard", shard)
            .withColumn("_slot", F.expr(f"_rank - (_shard * _total + {shards - 1}) div {shards}"))
            .select("_all.*", F.col("_curve").alias("curve"), F.col("_shard").cast("int").alias("shard"),
                    F.col("_slot").alias("slot")))


def shard_documents(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text",
                    labels: Sequence[str] = ("lang", "source"), bits: int = BITS) -> DataFrame:
    """Where each document goes: doc_id, size, text_crc32, the labels, curve, shard, slot.

    Dimensions are the label columns and the size (UTF-8 bytes plus 8). A null
    text has size 8 and the checksum of the empty text. Copies of a text with
    the same labels lie next to each other. Repeated rows each get a slot; an empty table
    gives no rows. Columns not named here are not read.
    """
    body = F.coalesce(docs[text].cast("string"), F.lit("")).cast("binary")
    rows = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), (F.octet_length(body) + 8).cast("bigint").alias("size"),
                       F.crc32(body).alias("text_crc32"), *[docs[c].cast("string").alias(f"label{i}") for i, c in enumerate(labels)])
    dims = [*[category(F.col(f"label{i}"), bits) for i in range(len(labels))], magnitude(F.col("size"), bits)]
    return curve_shards(rows, dims, [F.col("text_crc32"), F.col("doc_id")], shards, bits)


def manifest(assigned: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per shard: rows, bytes, and the least and largest value of each of `columns`."""
    bounds = [f(c).alias(f"{name}_{c}") for c in columns for name, f in (("least", F.min), ("most", F.max))]
    return assigned.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), *bounds)


def prune(listed: DataFrame, **ranges: tuple) -> DataFrame:
    """Shards of a manifest that may hold rows with every named column between the two given values."""
    for column, (least, most) in ranges.items():
        listed = listed.filter((F.col(f"most_{column}") >= F.lit(least)) & (F.col(f"least_{column}") <= F.lit(most)))
    return listed


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, doc_id: str = "doc_id") -> None:
    """One folder per shard under `path`, rows in slot order; ids must be unique."""
    places = assigned.select(F.col("doc_id").alias("_id"), F.col("shard"), F.col("slot"))
    (docs.drop("shard", "slot").join(places, docs[doc_id].cast("bigint") == F.col("_id")).drop("_id")
     .repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
