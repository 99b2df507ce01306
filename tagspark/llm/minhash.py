"""Near-duplicate documents by HyperMinHash.

1. The hash of each five-word shingle picks one of 128 buckets; of a bucket's
   smallest hash a register keeps the count of leading zeros (6 bits) and the ten
   bits behind the leading one. These registers serve the estimate.
2. Documents of the same word sequence become one class. Classes that share one
   of 50 bands are candidates. A band has as many registers, up to eight, as keep the
   chance that a linked pair shares no band below `MISS`. No register serves two bands. Each is
   of a place of its own: the first hash to reach it, in as many rounds of hashes as fill all
   places, compressed to the round, the leading zeros and ten bits. Short texts thus have as
   many registers as long ones, and each agrees with the chance J or, by chance, a little more.
3. Candidates whose Jaccard estimate, corrected for registers that agree by
   chance, lies six standard errors below the threshold are dropped; the rest is
   verified on the full sets of shingles.
4. A band's members are not emitted as pairs: first all are held against one
   pivot of that band, and links are contracted to components. As the pivots
   differ from band to band, a member of a large group of near copies meets many
   of them and joins its component. What is left in a band then only matters
   where it lies in different components, and there an exact bound decides which
   pairs can reach the threshold at all: shingles that no other open member has
   cannot be shared, and of the rest two members share no more than the smaller count
   in each of 64 cells of the hashes. Copies with many changes of their own thus
   make no pairs in vain.

At the threshold 0.85 bands have eight values: a pair right at the threshold shares
none with a probability of about 1e-7, a pair of similarity 0.5 is a candidate with one of 18 percent.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagspark.llm.common import (
    WordHashes, arrow_pass, batch, mix, row_key, without, words_of,
)
from tagspark.llm.components import components, handed, in_files, joined, renamed
from tagspark.session import written

SHINGLE = 5
BUCKET_BITS = 7
MANTISSA = 10
BANDS, MOST_ROWS = 50, 8
MISS = 1e-5
MARGIN = 6.0
_NONE = np.uint64(2**64 - 1)
# Cells of the bound on what two rows can share.
CELLS = 64
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def shingle_hashes(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; fewer words are one shingle."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(n, SHINGLE)
    total = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        total = total + hashes[k:n - width + 1 + k] * _FACTORS[k]
    return np.unique(mix(total))


def registers(hashes: np.ndarray) -> np.ndarray:
    """Leading zeros plus one, above the mantissa bits, of each bucket's smallest hash; 0 where a bucket is empty."""
    out = np.zeros(1 << BUCKET_BITS, np.uint16)
    bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    # 53 bits of what follows the bucket's bits, so that a double holds them.
    rest = (hashes[first] << np.uint64(BUCKET_BITS)) >> np.uint64(11)
    fraction, length = np.frexp(rest.astype(np.float64))
    mantissa = np.where(rest > 0, (fraction - 0.5) * 2 * (1 << MANTISSA), 0).astype(np.int64)
    out[bucket[first]] = ((53 - length + 1) << MANTISSA) | mantissa
    return out


def band_rows(percent: int) -> int:
    """Values of a band for a threshold."""
    return max(r for r in range(1, MOST_ROWS + 1) if r == 1 or (1 - (percent / 100) ** r) ** BANDS <= MISS)


@lru_cache(maxsize=8)
def _seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _FACTORS[0])


def places(hashes: np.ndarray, size: int) -> np.ndarray:
    """For each of `size` places the first round and the smallest hash of it that falls there.

    Every round hashes all shingles anew and deals them out; rounds go on until
    no place is empty, so a value does not depend on how many rounds are done at a time.
    Whatever the sizes of two sets, a place agrees with the chance of their Jaccard similarity.
    """
    out = np.full(size, _NONE)
    at, least = 0, int(size * (np.log(size) + 2))
    while at == 0 or (out == _NONE).any():
        rounds = np.arange(at, at + max(1, least // len(hashes)), dtype=np.uint64)
        seeds = _seeds(1 << int(rounds[-1] + np.uint64(1)).bit_length())[rounds.astype(np.int64)]
        drawn = mix(hashes[None, :] ^ seeds[:, None])
        place = ((drawn >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)
        # The round above 44 bits of the hash.
        value = (drawn & np.uint64((1 << 44) - 1)) | (rounds[:, None] << np.uint64(44))
        np.minimum.at(out, place.ravel().astype(np.int64), value.ravel())
        at, least = at + len(rounds), size
    return out


def compressed(values: np.ndarray) -> np.ndarray:
    """Registers of what `places` gives: the round, six bits of leading zeros, and the bits behind the leading one."""
    fraction, length = np.frexp((values & np.uint64((1 << 44) - 1)).astype(np.float64))
    mantissa = np.where(fraction > 0, (fraction - 0.5) * 2 * (1 << MANTISSA), 0).astype(np.uint64)
    zeros = (44 - length).astype(np.uint64)
    return (values >> np.uint64(44) << np.uint64(6 + MANTISSA)) | (zeros << np.uint64(MANTISSA)) | mantissa


def bands(hashes: np.ndarray, percent: int) -> np.ndarray:
    """One key per band, of compressed registers that no other band has; none for no shingles."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    rows = compressed(places(hashes, BANDS * band_rows(percent))).reshape(BANDS, -1)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(rows.shape[1]):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k] + np.uint64(1))
    return key.view(np.int64)


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that a register of sets of n and m other elements agrees though the smallest hashes differ."""
    a, b = n / (1 << BUCKET_BITS), m / (1 << BUCKET_BITS)
    zeros = np.arange(0, 53)[:, None]
    low, high = 2.0 ** -(zeros + 1), 2.0 ** -zeros
    inside = np.exp(-(a + b) * low) - np.exp(-(a + b) * high)
    return (a * b / (a + b) * inside * low * 2.0 ** -MANTISSA).sum(0)


def estimate(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimate of rows of registers, corrected for chance, and the number of registers it rests on."""
    used = ((x > 0) | (y > 0)).sum(1)
    agree = ((x == y) & (x > 0)).sum(1) / np.maximum(used, 1)
    by_chance = np.minimum(chance(n.astype(float), m.astype(float)), 0.5)
    return np.clip((agree - by_chance) / (1 - by_chance), 0, 1), used


def sketch(keyed: DataFrame, percent: int) -> DataFrame:
    """_row, n_shingles, seq (SHA-256 of the words), regs, bands of every row of `keyed` (_row, text)."""
    def step(batches):
        table = WordHashes()
        for rows in batches:
            ns, seqs, regs, keys = [], [], [], []
            for text in rows.column(1).to_pylist():
                words = words_of(text)
                hashes = shingle_hashes(table.of(words))
                ns.append(len(hashes))
                seqs.append(hashlib.sha256(b" ".join(words)).digest())
                regs.append(registers(hashes).tobytes())
                keys.append(bands(hashes, percent))
            yield batch(_row=rows.column(0), n_shingles=pa.array(ns, pa.int64()), seq=pa.array(seqs, pa.binary()),
                        regs=pa.array(regs, pa.binary()), bands=pa.array(keys, pa.list_(pa.int64())))

    return arrow_pass(keyed.select("_row", "text"), step,
                      "_row bigint, n_shingles bigint, seq binary, regs binary, bands array<bigint>")


def both_sides(pairs: DataFrame, rows: DataFrame, values: list[str]) -> DataFrame:
    """Pairs (a, b) with `values` of both rows, as value_a and value_b.

    Pairs that are few enough are handed to every task, so that rows of no pair
    stay where they are and the two halves meet on the pair itself, which no hot row can skew.
    """
    pairs = handed(pairs)
    side = lambda c: pairs.join(rows.select(F.col("_row").alias(c), *[F.col(v).alias(f"{v}_{c}") for v in values]), c)
    return side("a").join(side("b"), ["a", "b"])


def promising(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose set sizes and estimate leave room for the threshold."""
    both = both_sides(pairs, sketches, ["n_shingles", "regs"])
    both = both.filter(100 * F.least("n_shingles_a", "n_shingles_b") >= percent * F.greatest("n_shingles_a", "n_shingles_b")).select(
        "a", "b", "n_shingles_a", "n_shingles_b", "regs_a", "regs_b")
    wanted = percent / 100

    def step(batches):
        for rows in batches:
            if not len(rows):
                continue
            x, y = (np.frombuffer(b"".join(rows.column(i).to_pylist()), np.uint16).reshape(len(rows), -1) for i in (4, 5))
            jaccard, used = estimate(x, y, rows.column(2).to_numpy(), rows.column(3).to_numpy())
            error = np.sqrt(wanted * (1 - wanted) / np.maximum(used, 1))
            ok = pa.array(jaccard + MARGIN * error >= wanted)
            yield batch(a=rows.column(0).filter(ok), b=rows.column(1).filter(ok))

    return arrow_pass(both, step, "a bigint, b bigint")


class ShingleSets:
    """Sets of whole shingles by row; the least recently used go when they hold more than `most` shingles."""

    def __init__(self, most: int = 100_000):
        self.sets: OrderedDict = OrderedDict()
        self.size, self.most = 0, most

    def of(self, row: int, text: str) -> set[bytes]:
        if row in self.sets:
            self.sets.move_to_end(row)
            return self.sets[row]
        words = words_of(text)
        width = min(len(words), SHINGLE)
        found = {b" ".join(words[i:i + width]) for i in range(len(words) - width + 1)} if words else set()
        self.sets[row] = found
        self.size += len(found)
        while self.size > self.most and len(self.sets) > 2:
            self.size -= len(self.sets.popitem(last=False)[1])
        return found


def verified(pairs: DataFrame, keyed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union of their full shingle sets."""
    both = both_sides(pairs, keyed, ["text"]).select("a", "b", "text_a", "text_b")

    def step(batches):
        sets = ShingleSets()
        for rows in batches:
            ok = []
            for a, b, x, y in zip(*(rows.column(i).to_pylist() for i in range(4))):
                x, y = sets.of(a, x), sets.of(b, y)
                common = len(x & y)
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch(a=rows.column(0).filter(pa.array(ok, pa.bool_())), b=rows.column(1).filter(pa.array(ok, pa.bool_())))

    return written(arrow_pass(both, step, "a bigint, b bigint"), "verified")


def shareable(ids: DataFrame, keyed: DataFrame) -> DataFrame:
    """_row, n, shares of the rows that `ids` lists: how many shingles they have, and in each of `CELLS` cells of the
    shingles' hashes how many that another of these rows has too.

    Two rows share at most the smaller of their counts in each cell, so the sum
    over the cells bounds their intersection.
    """
    texts = keyed.select("_row", "text").join(handed(ids), "_row")

    def step(batches):
        table = WordHashes()
        for rows in batches:
            found = [shingle_hashes(table.of(words_of(t))).view(np.int64) for t in rows.column(1).to_pylist()]
            yield batch(_row=rows.column(0), shingles=pa.array(found, pa.list_(pa.int64())))

    sets = written(arrow_pass(texts, step, "_row bigint, shingles array<bigint>"), "open-shingles")
    cell = F.pmod("shingle", F.lit(CELLS)).cast("int")
    alone = (sets.select("_row", F.explode("shingles").alias("shingle")).groupBy("shingle")
             .agg(F.count(F.lit(1)).alias("rows"), F.min("_row").alias("_row")).filter("rows = 1")
             .groupBy("_row").agg(F.collect_list(cell).alias("alone")))
    cells = F.transform("shingles", lambda s: F.pmod(s, F.lit(CELLS)).cast("int"))
    counted = F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda c: F.size(F.filter("cells", lambda x: x == c)) - F.size(
        F.filter("alone", lambda x: x == c)))
    none = F.array().cast("array<int>")
    return (sets.withColumn("cells", cells).join(alone, "_row", "left").withColumn("alone", F.coalesce("alone", none))
            .select("_row", F.size("shingles").cast("bigint").alias("n"), counted.alias("shares")))


def _classes(docs_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sketches of one row per word sequence (the smallest), and seq with that row."""
    first = docs_rows.filter("n_shingles > 0").groupBy("seq").agg(F.min("_row").alias("rep"))
    heads = in_files(docs_rows.join(first.select(F.col("rep").alias("_row")), "_row", "left_semi"), "class-heads", docs_rows.count())
    return heads, heads.select("seq", F.col("_row").alias("rep"))


def _roots(heads: DataFrame, keyed: DataFrame, percent: int) -> DataFrame:
    """node, root of every class that is linked to another."""
    every = heads.select("_row", F.explode("bands").alias("band"))
    shared = every.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("band")
    members = in_files(every.join(shared, "band").withColumn("draw", F.xxhash64("_row", "band")), "band-members", BANDS * heads.count())
    size = members.count()

    def linked(pairs):
        # Of the second search more pairs than members may be left; their number then only makes the files larger.
        found = in_files(pairs.distinct(), "candidates", size)
        return verified(in_files(promising(found, heads, percent), "pairs", found.count()), keyed, percent)

    # Every member against one of its band, drawn anew for each band.
    at = F.struct("draw", "_row")
    ends = members.groupBy("band").agg(F.min(at).alias("first"))
    drawn = in_files(members.join(ends, "band").select("band", "_row", F.col("first._row").alias("pivot")), "drawn", size)
    rest = drawn.filter("_row <> pivot")
    roots = components(linked(rest.select(F.least("_row", "pivot").alias("a"), F.greatest("_row", "pivot").alias("b"))))

    def still_open(rows):
        """Members of the bands whose untested members lie in different components; all others are settled."""
        named = (rows.join(handed(roots).select(F.col("node").alias("_row"), "root"), "_row", "left")
                 .withColumn("root", F.coalesce("root", "_row")))
        open_bands = (named.groupBy("band").agg(F.min("root").alias("least"), F.max("root").alias("most"))
                      .filter("least < most").select("band"))
        return in_files(named.join(open_bands, "band"), "open-bands", size)

    # What a member can share with any other open member bounds what it can reach at all.
    named = still_open(rest.select("band", "_row")).drop("root")
    facts = shareable(in_files(named.select("_row").distinct(), "open-rows", size), keyed)
    most = F.aggregate("shares", F.lit(0), lambda n, x: n + x)
    facts = written(facts.filter(100 * most >= percent * F.col("n")), "can-reach")
    named = still_open(named.join(facts.select("_row"), "_row", "left_semi"))
    one, two = (named.join(facts, "_row").select("band", F.col("_row").alias(c), F.col("root").alias(f"root_{c}"), F.col("n").alias(f"n_{c}"),
                                                 F.col("shares").alias(f"shares_{c}")) for c in "ab")
    shared = F.aggregate(F.zip_with("shares_a", "shares_b", lambda x, y: F.least(x, y)), F.lit(0), lambda n, x: n + x)
    reaches = 100 * shared >= percent * (F.col("n_a") + F.col("n_b") - shared)
    pairs = one.join(two, "band").filter("a < b AND root_a <> root_b").filter(reaches).select("a", "b")
    return joined(roots, components(renamed(linked(pairs), roots)))


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept.

    Words are what stands between ASCII white space, A-Z lower-cased. Documents
    are linked where 100 * intersection >= percent * union of their distinct
    five-word shingles; fewer words are one shingle; without words a document is linked with nothing.
    component_id is the smallest id in reach. Rows that repeat an id are
    documents of their own, of which one is kept; a null id counts last. Other columns are not read; an empty table gives no rows.
    """
    keyed, unique = row_key(docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("text")),
                            "doc_id", "_row")
    groups = _near_rows(keyed, percent)
    if unique:
        return groups.select(F.col("_row").alias("doc_id"), "n_shingles", F.col("root").alias("component_id"),
                             (F.col("_row") == F.col("root")).alias("kept"))
    # Row numbers stand for the ids; name each component by its smallest id.
    groups = written(groups.join(keyed.select("_row", "doc_id"), "_row"), "near-rows")
    names = groups.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    groups = groups.join(names, "root")
    keep = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("_row").alias("keep"))
    return groups.join(keep, "root").select("doc_id", "n_shingles", "component_id", (F.col("_row") == F.col("keep")).alias("kept"))


def _near_rows(keyed: DataFrame, percent: int) -> DataFrame:
    rows = written(sketch(keyed, percent), "sketches")
    heads, classes = _classes(rows)
    roots = _roots(heads, keyed, percent)
    named = classes.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select(
        "seq", F.coalesce("root", "rep").alias("root"))
    return rows.select("_row", "n_shingles", "seq").join(named, "seq", "left").select(
        "_row", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("root")).otherwise(F.col("_row")).alias("root"))


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """The rows of `docs` that stay, one per component, with all their columns; see `near_groups`."""
    keyed, _ = row_key(docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("text"),
                                   F.struct("*").alias("_all")), "doc_id", "_row")
    gone = written(_near_rows(keyed.drop("_all"), percent).filter("_row <> root").select("_row"), "near-copies")
    return without(keyed.select("_row", "_all"), gone).select("_all.*")
