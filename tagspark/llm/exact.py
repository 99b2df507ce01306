"""Exact dedup by an exchange of Golomb-coded fingerprints.

1. Every task hashes the texts of a block of rows, keeps each fingerprint of the
   block once with a mark for "met before in this block", sorts them, and sends
   each owner its range as Golomb-coded differences (a third of all rows being one
   text is thus one fingerprint per block).
2. Owners merge the blocks' lists and answer each with a bitmap of duplicates.
3. The blocks' lists and bitmaps give the suspect fingerprints. A filter of fixed
   size made from them keeps the texts that cannot be duplicates out of the shuffle;
   what passes is grouped by its bytes, so neither the hash nor the filter decides.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagspark.llm.common import arrow_pass, batch, maybe_in, row_key, shards_for, slot_filter
from tagspark.session import written

BLOCK_ROWS = 100_000
OWNER_ROWS = 500_000


def golomb_encode(values: np.ndarray, bits: int) -> bytes:
    """Sorted unsigned numbers as Golomb codes with divisor 2**bits of their differences: unary quotients, then fixed-width remainders."""
    gaps = np.diff(values, prepend=np.uint64(0))
    quotients = (gaps >> np.uint64(bits)).astype(np.int64)
    ends = np.cumsum(quotients + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, np.uint8)
    unary[ends] = 1
    shifts = np.arange(bits - 1, -1, -1, dtype=np.uint64)
    rest = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
    return np.packbits(unary).tobytes() + np.packbits(rest.ravel()).tobytes()


def golomb_decode(code: bytes, n: int, bits: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(code, np.uint8)
    rest_bytes = (n * bits + 7) // 8
    split = len(raw) - rest_bytes
    ends = np.flatnonzero(np.unpackbits(raw[:split]))[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    rest = np.unpackbits(raw[split:])[: n * bits].reshape(n, bits)
    remainders = np.zeros(n, np.uint64)
    for b in range(bits):
        remainders = (remainders << np.uint64(1)) | rest[:, b].astype(np.uint64)
    return np.cumsum((quotients.astype(np.uint64) << np.uint64(bits)) + remainders, dtype=np.uint64)


def divisor_bits(universe_bits: int, n: int) -> int:
    """log2 of the divisor that suits `n` numbers spread over the universe."""
    return max(0, universe_bits - int(np.ceil(np.log2(max(n, 1)))) - 1)


def fingerprints(docs: DataFrame, text: str, owners: int, rows_per_block: int = BLOCK_ROWS) -> DataFrame:
    """One row per block and owner: block, owner, n, bits, code (Golomb), twice (bitmap: met twice within the block)."""
    low = np.uint64(64 - owners.bit_length() + 1)

    def flush(parts, block):
        values, counts = np.unique(np.concatenate(parts).view(np.uint64), return_counts=True)
        edges = np.searchsorted(values >> low, np.arange(owners + 1, dtype=np.uint64))
        out = []
        for o in range(owners):
            part = values[edges[o]:edges[o + 1]] & ((np.uint64(1) << low) - np.uint64(1))
            if len(part):
                bits = divisor_bits(int(low), len(part))
                out.append((block, o, len(part), bits, golomb_encode(part, bits),
                            np.packbits(counts[edges[o]:edges[o + 1]] > 1).tobytes()))
        block, owner, n, bits, code, twice = zip(*out)
        return batch(block=pa.array(block, pa.int64()), owner=pa.array(owner, pa.int32()), n=pa.array(n, pa.int32()),
                     bits=pa.array(bits, pa.int32()), code=pa.array(code, pa.binary()), twice=pa.array(twice, pa.binary()))

    def step(batches):
        # Partition and number name a block, so that (block, owner) is met once; the caller writes the lists, which fixes the names.
        block = TaskContext.get().partitionId() << 32
        parts, size = [], 0
        for rows in batches:
            if len(rows):
                parts.append(rows.column(0).to_numpy())
                size += len(rows)
            if size >= rows_per_block:
                yield flush(parts, block)
                parts, size, block = [], 0, block + 1
        if size:
            yield flush(parts, block)

    return arrow_pass(docs.select(F.xxhash64(text).alias("hash")), step,
                      "block bigint, owner int, n int, bits int, code binary, twice binary")


def answers(sent: DataFrame) -> DataFrame:
    """For each (block, owner) the bitmap of its fingerprints that occur in more than one row of the input."""

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        lists = [golomb_decode(c, n, b) for c, n, b in zip(rows.code, rows.n, rows.bits)]
        twice = [np.unpackbits(np.frombuffer(t, np.uint8))[:n] for t, n in zip(rows.twice, rows.n)]
        values, counts = np.unique(np.concatenate(lists), return_counts=True)
        copies = counts > 1
        # A block's own repeats make the fingerprint a duplicate for every block.
        for v, t in zip(lists, twice):
            copies[np.searchsorted(values, v[t == 1])] = True
        return pd.DataFrame({"block": rows.block, "owner": rows.owner, "copies": [
            np.packbits(copies[np.searchsorted(values, v)]).tobytes() for v in lists]})

    return sent.groupBy("owner").applyInPandas(merge, "block bigint, owner int, copies binary")


def suspect_hashes(sent: DataFrame, answered: DataFrame, owners: int) -> DataFrame:
    """The fingerprints that the answers mark: hash."""
    low = np.uint64(64 - owners.bit_length() + 1)

    def step(batches):
        for rows in batches:
            for owner, n, bits, code, copies in zip(*(rows.column(i).to_pylist() for i in range(5))):
                flags = np.unpackbits(np.frombuffer(copies, np.uint8))[:n] == 1
                values = golomb_decode(code, n, bits)[flags] + (np.uint64(owner) << low)
                yield batch(hash=pa.array(values.view(np.int64)))

    suspects = sent.join(answered, ["block", "owner"]).select("owner", "n", "bits", "code", "copies")
    return arrow_pass(suspects, step, "hash bigint")


def _suspects(keyed: DataFrame) -> DataFrame:
    """`keyed` with a column `maybe`: false only where no other row can have the same text."""
    owners = shards_for(keyed.count(), OWNER_ROWS, 16)
    sent = written(fingerprints(keyed, "text", owners), "fingerprints")
    words = slot_filter(suspect_hashes(sent, answers(sent), owners), F.col("hash"))
    return maybe_in(keyed, F.xxhash64("text"), words)


def _pick(unique: bool, keep_largest: bool):
    """The aggregate that names the row of a group that stays."""
    last = F.lit(-(2 ** 63) if keep_largest else 2 ** 63 - 1).cast("bigint")
    pick = F.max if keep_largest else F.min
    if unique:
        return pick("_row")
    return pick(F.struct(F.coalesce("doc_id", last).alias("at"), F.col("_row"), F.col("doc_id")))


def _keyed(docs: DataFrame, doc_id: str, text: str, *more) -> tuple[DataFrame, bool]:
    return row_key(docs.select(docs[doc_id].cast("bigint").alias("doc_id"),
                               F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"), *more), "doc_id", "_row")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_largest: bool = True) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as the empty text. Of a
    group the row with the largest (or smallest) id stays, a null id after all
    others. Rows that repeat an id are documents of their own: one of them
    stays. Other columns are not read. An empty table gives no rows.
    """
    keyed, unique = _keyed(docs, doc_id, text)
    groups = (_suspects(keyed).filter("maybe").groupBy("text")
              .agg(_pick(unique, keep_largest).alias("_keep"), F.count(F.lit(1)).alias("group_size"))
              .filter("group_size > 1")
              .select(F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "group_size",
                      (F.col("_keep") if unique else F.col("_keep._row")).alias("_keep_row"),
                      (F.col("_keep") if unique else F.col("_keep.doc_id")).alias("keep_id")))
    rows = keyed.select("doc_id", "_row", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    alone = F.col("group_size").isNull()
    return rows.join(groups, "text_sha256", "left").select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        (alone | (F.col("_row") == F.col("_keep_row"))).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_largest: bool = True) -> DataFrame:
    """The rows of `docs` that stay, with all their columns; see `exact_groups`. Only suspects are shuffled."""
    keyed, unique = _keyed(docs, doc_id, text, F.struct("*").alias("_all"))
    flagged = _suspects(keyed)
    keep = flagged.filter("maybe").groupBy("text").agg(_pick(unique, keep_largest).alias("_keep"))
    keep = keep.select((F.col("_keep") if unique else F.col("_keep._row")).alias("_row"))
    stay = flagged.filter("maybe").join(keep, "_row", "left_semi")
    return flagged.filter("NOT maybe").select("_all").unionByName(stay.select("_all")).select("_all.*")
