"""What the operators of this package share: row keys, Arrow passes, byte-level words, hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagspark.operators.slots import maybe_in, slot_filter  # noqa: F401
from tagspark.session import written

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
# Entries a worker's word table holds before it starts afresh; results do not depend on it.
CACHE_ENTRIES = 150_000


def row_key(docs: DataFrame, id_col: str, key: str) -> tuple[DataFrame, bool]:
    """`docs` with a column `key` that is unique per row, and whether that is the id.

    The id itself where it is unique and never null (the usual case, one look
    at that narrow column). Otherwise the rows are written once with a number of
    their own, so that repeated rows and null ids stay apart and keep their
    numbers when a task runs again.
    """
    rows, ids = docs.agg(F.count(F.lit(1)), F.count_distinct(docs[id_col])).first()
    if rows == ids:
        return docs.withColumn(key, docs[id_col].cast("bigint")), True
    return written(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), False


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id written as text leaves `remainder`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def give_back() -> None:
    """Hand freed memory back to the system; a reused worker would otherwise hold its largest task's until it ends."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def arrow_pass(df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    def whole(batches):
        try:
            yield from step(batches)
        finally:
            give_back()

    return df.mapInArrow(whole, schema)


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def encode(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z lower-cased."""
    return encode(text).translate(LOWER).split()


class WordHashes(dict):
    """64-bit hashes of words; each distinct word is hashed once while it stays in the table."""

    def __init__(self, seed: int = 0):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word, seed=self.seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_ENTRIES:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers so that every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shards_for(rows: int, per_shard: int, least: int) -> int:
    """A power of two of shards, so many that one holds about `per_shard` of `rows`."""
    n = least
    while n * per_shard < rows:
        n *= 2
    return n


def without(keyed: DataFrame, gone: DataFrame, key: str = "_row") -> DataFrame:
    """`keyed` without the rows whose `key` is in `gone`; only rows that may be gone are shuffled."""
    flagged = maybe_in(keyed, F.xxhash64(key), slot_filter(gone, F.xxhash64(key)))
    stay = flagged.filter("maybe").join(gone.select(key), key, "left_anti")
    return flagged.filter("NOT maybe").drop("maybe").unionByName(stay.drop("maybe"))


def add_columns(df: DataFrame, column: str, start: Callable[[], Callable[[list], list[pa.Array]]], added: dict[str, str]) -> DataFrame:
    """`df` with the columns `added` (name: SQL type), worked out from the values of `column`.

    `start` is called once per task and gives a function from a list of values
    to one Arrow array per added column. Columns of these names are replaced, others pass through.
    """
    kept = df.drop(*added)
    at, names = kept.columns.index(column), [*kept.columns, *added]

    def step(batches):
        work = start()
        for rows in batches:
            yield pa.RecordBatch.from_arrays([*rows.columns, *work(rows.column(at).to_pylist())], names)

    schema = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema]
    return arrow_pass(kept, step, ", ".join([*schema, *[f"`{n}` {t}" for n, t in added.items()]]))
