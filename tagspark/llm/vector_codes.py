"""Vectors as short codes: one codebook per part of the components, and the nearest entry of each.

Components become integers, so that every distance, sum and mean is exact and the result depends
neither on the order of rows nor on the number of tasks. The nearest entry is found by
equal-average search: with entries sorted by the sum of their components, one looks outward from
the part's own sum; the squared gap of the sums over the number of components never exceeds the
squared distance, so the search of a part ends when it does exceed the best one strictly (an equal
one could still tie). Codebooks are fitted over all vectors in rounds: tasks send a sum and a count
per entry and component, which Spark adds up; the driver holds the codebooks alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagspark.llm.common import arrow_pass, batch
from tagspark.session import written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
# Sums and squares of a part stay below 2**63 when its components are below this over their number.
LARGEST = 1 << 30


def bounds(dimension: int, parts: int = PARTS) -> list[int]:
    """Where the parts begin and end; equal where `parts` divides the dimension, else as equal as can be."""
    return [i * dimension // parts for i in range(parts + 1)]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index in `book` of the entry nearest to each row of `x` (ties: the lower), and the squared distance."""
    n, d = x.shape
    who, best = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
    if not d:
        return who, np.zeros(n, np.int64)
    sums = book.sum(1)
    order = np.argsort(sums, kind="stable")
    sums, entries = sums[order], book[order]
    own, far = x.sum(1), np.iinfo(np.int64).max
    right = np.searchsorted(sums, own)
    left = right - 1
    active = np.arange(n)
    while len(active):
        a, l, r = own[active], left[active], right[active]
        below = np.where(l >= 0, a - sums[np.maximum(l, 0)], far)
        above = np.where(r < len(sums), sums[np.minimum(r, len(sums) - 1)] - a, far)
        gap = np.minimum(below, above)
        open_ = gap < far
        # Rounded up: an integer is exceeded strictly by the quotient exactly when it is by this.
        least = np.where(open_, -(-(gap * open_) ** 2 // d), far)
        go = open_ & (least <= best[active])
        active, l, r, down = active[go], l[go], r[go], (below <= above)[go]
        at = np.where(down, l, r)
        gaps = x[active] - entries[at]
        found, index = np.einsum("ij,ij->i", gaps, gaps), order[at]
        better = (found < best[active]) | ((found == best[active]) & (index < who[active]))
        best[active[better]], who[active[better]] = found[better], index[better]
        left[active], right[active] = l - down, r + ~down
    return who, best


def whole_numbers(vectors: DataFrame, vector: str = "vector", parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """`vectors` with the vector as array<int> of floor(scale * x), without the rows that have none.

    Rows go whose vector is null or empty, holds a null or a number that is not
    finite, or one of more than LARGEST times `parts` over the dimension after
    scaling, beyond which squared distances do not fit 64 bits.
    """
    rest = [c for c in vectors.columns if c != vector]
    narrow = vectors.select(F.col(vector).cast("array<double>"), *rest)

    def step(batches):
        for rows in batches:
            lists = rows.column(0)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            with np.errstate(over="ignore"):
                x = np.floor(lists.flatten().to_numpy(zero_copy_only=False) * scale)
            most = LARGEST // np.maximum(1, -(-sizes // parts))
            bad = np.concatenate([[0], np.cumsum(~(np.abs(x) <= np.repeat(most, sizes)))])
            ends = np.cumsum(sizes)
            ok = (sizes > 0) & (bad[ends] == bad[ends - sizes])
            kept = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes[ok])]), pa.int32()),
                                            pa.array(x[np.repeat(ok, sizes)].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([kept, *rows.select(rest).filter(pa.array(ok)).columns], [vector, *rest])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    return arrow_pass(narrow, step, ", ".join(f"`{c}` {'array<int>' if c == vector else kinds[c]}" for c in [vector, *rest]))


def _matrix(rows: pa.RecordBatch, at: int) -> np.ndarray:
    flat = rows.column(at).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(rows), -1).astype(np.int64) if len(rows) else np.zeros((0, 0), np.int64)


def _sums(ready: DataFrame, books: list[np.ndarray], edges: list[int]) -> DataFrame:
    """part, entry, position, total, n: what the vectors assigned to an entry add up to."""

    def step(batches):
        totals = [np.zeros(b.shape, np.int64) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for rows in batches:
            x = _matrix(rows, 0)
            for p, book in enumerate(books if len(x) else []):
                part = x[:, edges[p]:edges[p + 1]]
                who, _ = nearest(part, book)
                np.add.at(totals[p], who, part)
                counts[p] += np.bincount(who, minlength=len(book))
        for p, (total, n) in enumerate(zip(totals, counts)):
            used = np.flatnonzero(n)
            width = total.shape[1]
            yield batch(part=pa.array(np.full(len(used) * width, p, np.int32)), entry=pa.array(np.repeat(used, width).astype(np.int32)),
                        position=pa.array(np.tile(np.arange(width, dtype=np.int32), len(used))),
                        total=pa.array(total[used].ravel()), n=pa.array(np.repeat(n[used], width)))

    part = arrow_pass(ready.select("vector"), step, "part int, entry int, position int, total bigint, n bigint")
    return part.groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def fit(ready: DataFrame, dimension: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks of `ready` (vec_id, vector of whole numbers, all of one dimension), one array (entry, position) per part.

    They start as the parts of the rows with the smallest ids (null ids last,
    ties by the vector) and are moved to the floor of their members' mean.
    """
    edges = bounds(dimension, parts)
    # At most `entries` vectors.
    first = ready.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()
    start = np.array([r.vector for r in first], np.int64).reshape(len(first), dimension)
    books = [start[:, edges[p]:edges[p + 1]].copy() for p in range(parts)]
    for _ in range(rounds if first else 0):
        # As many rows as the codebooks have numbers.
        moved = _sums(ready, books, edges).toArrow()
        p, e, i, total, n = (moved.column(c).to_numpy() for c in ("part", "entry", "position", "total", "n"))
        for q, book in enumerate(books):
            own = p == q
            book[e[own], i[own]] = total[own] // n[own]
    return books


def assign(ready: DataFrame, books: list[np.ndarray], edges: list[int]) -> DataFrame:
    """`ready` with `code` (two hex digits per part and entry below 256, else four) and `error` in place of the vector."""
    rest = [c for c in ready.columns if c != "vector"]
    digits = 2 if max(map(len, books), default=0) <= 256 else 4

    def step(batches):
        for rows in batches:
            x = _matrix(rows, 0)
            code, error = [""] * len(x), np.zeros(len(x), np.int64)
            for p, book in enumerate(books if len(x) else []):
                who, far = nearest(x[:, edges[p]:edges[p + 1]], book)
                names = [f"{e:0{digits}x}" for e in range(len(book))]
                code = [c + names[w] for c, w in zip(code, who.tolist())]
                error += far
            yield pa.RecordBatch.from_arrays(
                [*rows.columns[1:], pa.array(code, pa.string()), pa.array(error)], [*rest, "code", "error"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema if f.name != "vector")
    return arrow_pass(ready.select("vector", *rest), step, f"{kinds}, code string, error bigint")


def digest(books: list[np.ndarray]) -> str:
    """Checksum of all components by part, entry and position, as decimal numbers."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def decoded(code: str, books: list[np.ndarray]) -> np.ndarray:
    """The vector of whole numbers that a code stands for."""
    digits = len(code) // len(books)
    return np.concatenate([b[int(code[i * digits:(i + 1) * digits], 16)] for i, b in enumerate(books)])


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "vector", label: str | Column = "label", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """The codebooks, and one row per usable vector: vec_id, label, code, error.

    `whole_numbers` says which rows are dropped. The dimension is that of the
    usable vector with the smallest id; vectors of another one are dropped as
    well. Repeated ids are vectors of their own. With fewer vectors than
    entries the codebooks have as many entries as there are vectors. Other
    columns are not read; an empty table gives no rows.
    """
    rows = vectors.select(vectors[vec_id].cast("bigint").alias("vec_id"), vectors[vector].alias("vector"),
                          (vectors[label] if isinstance(label, str) else label).alias("label"))
    ready = written(whole_numbers(rows, "vector", parts, scale), "vectors")
    first = ready.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select(F.size("vector").alias("n")).first()
    dimension = first.n if first else 0
    same = ready.filter(F.size("vector") == dimension)
    books = fit(same, dimension, parts, entries, rounds)
    return assign(same, books, bounds(dimension, parts)), books


def with_label_errors(coded: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """`coded` (see `compress`) as vec_id, code, error, label_error (the error of all rows of the label, null being one) and codebooks_sha256."""
    coded = written(coded, "codes")
    sums = written(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "_label")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label")), "left").select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
