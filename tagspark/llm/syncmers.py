"""Fingerprints of documents by closed syncmers. DataFrame functions only.

A k-mer (K bytes of the UTF-8 text) is an anchor when the least of the hashes of its inner
substrings of S bytes stands at its first or last place. That depends on the k-mer alone, so an
edit changes only the anchors that touch it, and the anchors of two joined texts are those of
either, shifted, and those of the few bytes around the joint (`joined`). At least one of K - S
successive k-mers is an anchor; on average 2 of K - S + 1 are.

Anchors are one bigint each, place << 32 | 1 << 31 | 31 bits of the k-mer's hash, in order of place. For
matching, an anchor counts with its distance from the one before (`elements`): equal elements
stand for equal runs of text at the same place relative to each other, wherever in the texts they are.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagspark.functions.text import let
from tagspark.llm.common import row_key
from tagspark.session import written

# Distances of anchors (K - S at most) fit a hex digit.
K, S = 20, 6
NONE = "array<bigint>"
# Rows of a run of neighbouring documents, and the most runs there are (their ends go to every task).
RUN_ROWS = 32
RUNS = 50_000


def _hash(part: Column) -> Column:
    """31 bits with a leading one, so that its hex digits are always eight."""
    return F.xxhash64(part).bitwiseAND(F.lit(0x7FFFFFFF)) + F.lit(0x80000000)


def picks(data: Column, k: int = K, s: int = S) -> Column:
    """Anchors of binary `data`; none where it is shorter than `k`."""
    w = k - s + 1
    # Where runs of three start that cover all inner places. The other edge need not be
    # looked at: if its hash is less than all of them, it is the least itself.
    runs = [*range(1, w - 4, 3), w - 4]

    def edge(h: Column, least: Column, i: Column) -> Column:
        below = lambda x: reduce(and_, [x <= F.get(least, i + j) for j in runs])
        return below(F.get(h, i)) | below(F.get(h, i + (w - 1)))

    def places(h: Column, n: Column) -> Column:
        least = F.transform(h, lambda x, i: F.least(x, F.get(h, i + 1), F.get(h, i + 2)))
        return let(least, lambda m: F.filter(F.sequence(F.lit(0), n - k), lambda i: edge(h, m, i)))

    def chosen(b: Column) -> Column:
        # Variables of lambdas are passed by reference; a binary column would be copied at every use.
        hashes = F.transform(F.sequence(F.lit(1), F.length(b) - (s - 1)), lambda i: F.xxhash64(F.substring(b, i, s)))
        at = let(hashes, lambda h: places(h, F.length(b)))
        return F.transform(at, lambda i: F.shiftleft(i.cast("bigint"), 32) + _hash(F.substring(b, i + 1, k)))

    return let(data, lambda b: F.when(F.length(b) >= k, chosen(b)).otherwise(F.array().cast(NONE)))


def _whole(data: Column) -> Column:
    """The one anchor of a text shorter than a k-mer; none of an empty one."""
    return F.when(F.length(data) > 0, F.array(_hash(data))).otherwise(F.array().cast(NONE))


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """Anchors of a text; one shorter than `k` bytes is an anchor itself, an empty one has none."""
    data = text.cast("binary")
    return F.when(F.length(data) >= k, picks(data, k, s)).otherwise(_whole(data))


def joined(first: Column, first_anchors: Column, second: Column, second_anchors: Column, k: int = K, s: int = S) -> Column:
    """Anchors of `first` || `second`, beginnings of two texts whose anchors are given; only bytes around the joint are hashed."""
    a, b = F.octet_length(first), F.octet_length(second)
    data = F.concat(first, second).cast("binary")
    low, high = F.greatest(F.lit(0), a - (k - 1)), F.least(a + b, a + (k - 1))
    around = F.transform(picks(F.substring(data, low + 1, high - low), k, s), lambda x: x + F.shiftleft(low.cast("bigint"), 32))
    before = F.filter(first_anchors, lambda x: F.shiftright(x, 32) <= a - k)
    after = F.transform(F.filter(second_anchors, lambda x: F.shiftright(x, 32) <= b - k),
                        lambda x: x + F.shiftleft(a.cast("bigint"), 32))
    return F.when(a + b >= k, F.concat(before, around, after)).otherwise(_whole(data))


def elements(found: Column) -> Column:
    """Each anchor as hash << 4 | distance from the anchor before (from the start of the text for the first)."""
    place = lambda x: F.shiftright(x, 32)
    return let(found, lambda f: F.transform(f, lambda x, i: F.shiftleft(x.bitwiseAND(F.lit(0xFFFFFFFF)), 4) + F.least(
        F.lit(15), place(x) - F.when(i > 0, place(F.get(f, i - 1))).otherwise(0))))


def fingerprint(elements: Column) -> Column:
    """Nine hex digits per element: eight of the hash, one of the distance."""
    return F.array_join(F.transform(elements, F.hex), "")


def distinct(elements: Column) -> Column:
    return F.size(F.array_distinct(elements))


def likeness(a: Column, b: Column, n_a: Column, n_b: Column) -> Column:
    """Shared elements over all elements of either, each once; 1 for two fingerprints without elements. `n_*` as by `distinct`."""
    def of(m: Column) -> Column:
        union = n_a + n_b - m
        return F.when(union > 0, m / union).otherwise(1.0)

    return let(F.size(F.array_intersect(a, b)), of)


def shared_places(a: Column, b: Column) -> Column:
    """Where two texts' anchors match: array of (a, b) byte places, each shared hash once, in order of a."""
    entry = lambda side: lambda x: F.struct(
        x.bitwiseAND(F.lit(0xFFFFFFFF)).alias("hash"), F.lit(side).alias("side"), F.shiftright(x, 32).alias("at"))
    both = F.sort_array(F.concat(F.transform(a, entry(0)), F.transform(b, entry(1))))
    pairs = let(both, lambda s: F.transform(s, lambda x, i: let(F.get(s, i + 1), lambda y: F.when(
        (x["side"] == 0) & (y["side"] == 1) & (x["hash"] == y["hash"]), F.struct(x["at"].alias("a"), y["at"].alias("b"))))))
    return F.sort_array(F.filter(pairs, lambda p: p.isNotNull()))


def _ordered(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text (null: empty) and `at`, a unique number that falls along the order of documents."""
    rows = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    keyed, unique = row_key(rows, "doc_id", "_row")
    if unique:
        return keyed.select("doc_id", "text", F.col("_row").alias("at"))
    numbered = written(keyed.select("_row", "doc_id").orderBy(F.col("doc_id").desc_nulls_last(), "_row")
                       .select("_row", (-F.monotonically_increasing_id()).alias("at")), "numbered")
    return keyed.join(numbered, "_row").select("doc_id", "text", "at")


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run_rows: int = RUN_ROWS) -> DataFrame:
    """doc_id, text, anchors, elements, n_elements, and the same (`next_`) of the document with the next smaller id; the smallest is followed by the largest.

    Ids are cut into runs at ids drawn by their hash; texts are shuffled once,
    by run. The first document of a run goes to the run before it as well, so
    that every neighbour is found where it is needed.
    """
    rows = _ordered(docs, doc_id, text)
    every = max(run_rows, -(-docs.count() // RUNS))
    cut = F.pmod(F.xxhash64("at"), F.lit(every)) == 0
    ends = rows.agg(F.array_sort(F.collect_list(F.when(cut, F.col("at")))).alias("ends")).scalar()
    top = rows.agg(F.max("at").alias("top")).scalar()
    # The number of ends below an id, by halving.
    steps = F.array(*[F.lit(1 << b) for b in range(RUNS.bit_length(), -1, -1)])
    run = let(F.col("ends"), lambda e: let(F.col("at"), lambda at: F.aggregate(
        steps, F.lit(0), lambda low, step: F.when(F.get(e, low + step - 1) < at, low + step).otherwise(low))))
    to = lambda run, rank: F.struct(run.alias("run"), F.lit(rank).alias("rank"))
    # The optimizer puts the subquery in place of the column, so no row carries the ends.
    dealt = rows.withColumn("ends", ends).withColumn("run", run).select("doc_id", "text", "at", F.inline(F.array_compact(F.array(
        to(F.col("run"), 0), F.when(cut, to(F.col("run") + 1, 1)), F.when(F.col("at") == top, to(F.lit(0), 2))))))
    # Worked out behind the exchange, once for a document and its neighbour.
    marked = dealt.repartition("run").withColumn("anchors", anchors(F.col("text"))).withColumn("elements", elements(F.col("anchors")))
    marked = marked.withColumn("n_elements", distinct(F.col("elements")))
    # A document copied from the next run is the last but one at most: only the first of all documents may follow it.
    order = Window.partitionBy("run").orderBy(F.col("rank") == 2, F.col("at").desc())
    own = ["text", "anchors", "elements", "n_elements"]
    return (marked.withColumns({f"next_{c}": F.lead(c).over(order) for c in own}).filter("rank = 0")
            .select("doc_id", *own, *[f"next_{c}" for c in own]))


def compare_neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run_rows: int = RUN_ROWS) -> DataFrame:
    """One row per row of `docs`: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last half of the characters (rounded down) replaced
    by the first as many of the next document in falling order of id, or all of
    it where it is shorter; the last document is followed by the first, a
    single one by itself. Null counts as empty; an empty text has an empty
    fingerprint, and two of those are alike (1). Rows that share an id follow
    each other in the order of numbers that the run gives them; null ids come
    last. Other columns are not read. An empty table gives no rows.
    """
    rows = with_next(docs, doc_id, text, run_rows).withColumn("n_chars", F.length("text").cast("bigint"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    parts = rows.withColumns({"first": F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half),
                              "second": F.substring("next_text", F.lit(1), half)})
    edited = joined(F.col("first"), F.col("anchors"), F.col("second"), F.col("next_anchors"))
    marked = parts.select(
        "doc_id", "n_chars", F.sha2(F.concat("first", "second").cast("binary"), 256).alias("edited_sha256"),
        "elements", "n_elements", "next_elements", "next_n_elements", elements(edited).alias("edited")).withColumn(
        "n_edited", distinct(F.col("edited")))
    near = lambda other, n: likeness(F.col("elements"), F.col(other), F.col("n_elements"), F.col(n))
    return marked.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("elements")).alias("fingerprint"),
        fingerprint(F.col("edited")).alias("edited_fingerprint"),
        near("edited", "n_edited").alias("near_edited"), near("next_elements", "next_n_elements").alias("near_next"))
