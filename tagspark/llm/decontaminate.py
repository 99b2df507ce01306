"""Benchmark passages in documents, by SimHash of item-sized windows. DataFrame functions only.

1. Five-word shingles of all texts are looked up among the benchmark's, and a text's
   hits are gathered by item. A window of an item's size reaches the similarity only with a
   certain number of hits, so all windows with as many of them are built, wherever in the
   item the shared shingles stand, and no others.
2. Every distinct window gets a 64-bit SimHash of its shingles. Five blocks of the
   fingerprint are looked up among the items' blocks with up to three bits
   changed: of 19 differing bits, one block has three or fewer, so all items
   of the window's size within radius 19 are found.
3. What is within the radius is verified by the weighted Jaccard similarity of
   the shingles themselves, a shingle weighing as often as it occurs.

Two texts of similarity 0.8 differ in 10 bits on average with a deviation of 3, so
about one in 3,000 lies beyond the radius; verbatim passages differ in none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagspark.functions.text import let
from tagspark.llm.common import maybe_in, row_key, slot_filter, without
from tagspark.session import written

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 19
# Offsets and widths of the blocks of a fingerprint.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
# Shingles of the benchmark (24 bytes each) that are broadcast; more of them are joined by a shuffle.
BROADCAST_SHINGLES = 1_000_000

DELIMITERS = "".join(c for c in map(chr, range(0x80)) if not ("0" <= c <= "9" or "a" <= c <= "z"))


def words(text: Column) -> Column:
    """Lower-cased words: runs of ASCII letters and digits and of all other characters; none for a null text."""
    split = F.split(F.btrim(F.lower(text), F.lit(DELIMITERS)), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
    return F.coalesce(F.array_remove(split, ""), F.array().cast("array<string>"))


def _hashes(name: str) -> Column:
    """Hashes of the five-word shingles of the array column `name`, by position."""
    parts = ", ".join(f"{name}[i + {k}]" for k in range(SHINGLE))
    return F.expr(f"CASE WHEN size({name}) >= {SHINGLE} THEN transform(sequence(0, size({name}) - {SHINGLE}), i -> xxhash64({parts})) "
                  "ELSE array() END").cast("array<bigint>")


def _shingles(name: str) -> Column:
    return F.expr(f"CASE WHEN size({name}) >= {SHINGLE} THEN transform(sequence(0, size({name}) - {SHINGLE}), "
                  f"i -> array_join(slice({name}, i + 1, {SHINGLE}), ' ')) ELSE array() END").cast("array<string>")


def simhash(name: str) -> Column:
    """64-bit SimHash of the hashes in the array column `name`: a bit is set where most of them have it."""
    # The outer lambda holds the hashes, which would else be worked out anew for every bit.
    return F.expr(f"""transform(array({name}), hashes -> aggregate(sequence(0, 63), 0L, (fp, b) ->
        fp | CASE WHEN 2 * aggregate(hashes, 0, (n, h) -> n + cast(shiftrightunsigned(h, b) & 1 AS int)) > size(hashes)
             THEN shiftleft(1L, b) ELSE 0L END))[0]""")


def _blocks(fingerprint: Column) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(fingerprint, at).bitwiseAND(F.lit((1 << width) - 1)).alias("value"))
                     for k, (at, width) in enumerate(BLOCKS)])


def _changed(block: int, value: Column):
    return lambda mask: F.struct(F.lit(block).alias("block"), value.bitwiseXOR(mask).alias("value"))


def _near_blocks(fingerprint: Column, changed: int) -> Column:
    """All blocks that differ from the fingerprint's in up to `changed` bits."""
    out = []
    for k, (at, width) in enumerate(BLOCKS):
        value = F.shiftrightunsigned(fingerprint, at).bitwiseAND(F.lit((1 << width) - 1))
        masks = F.expr(f"filter(sequence(0L, {(1 << width) - 1}L), m -> bit_count(m) <= {changed})")
        out.append(F.transform(masks, _changed(k, value)))
    return F.concat(*out)


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Of two arrays: sum of the smaller over sum of the larger counts of each shingle."""
    # Where all of one side are different, no smaller count is above one; only else shingles are counted.
    # A variable of a lambda is worked out once, however often it is used.
    def of(sides: Column) -> Column:
        x, y = sides["a"], sides["b"]
        shared = F.array_intersect(x, y)
        count = lambda s: F.least(F.size(F.filter(x, lambda z: z == s)), F.size(F.filter(y, lambda z: z == s)))
        plain = (F.size(F.array_distinct(x)) == F.size(x)) | (F.size(F.array_distinct(y)) == F.size(y))
        m = F.when(plain, F.size(shared)).otherwise(F.aggregate(shared, F.lit(0), lambda n, s: n + count(s)))
        return let(m, lambda m: m / (F.size(x) + F.size(y) - m))

    return let(F.struct(a.alias("a"), b.alias("b")), of)


def items_of(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item (a number of its own), item_id, words, size of the items that have a shingle, once each."""
    found = (benchmark.select(benchmark[item_id].cast("bigint").alias("item_id"), words(benchmark[text].cast("string")).alias("item_words"))
            .filter(F.size("item_words") >= SHINGLE).distinct().withColumn("size", F.size("item_words")))
    # Written once, so that the numbers stay as they are when a task runs again.
    return written(found.withColumn("item", F.monotonically_increasing_id()), "numbered-items")


def _windows(keyed: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """Every item-sized window with so many shingles of an item that their similarity can be reached: _row, start, length, size."""
    known = written(items.select("item", "size", F.explode(F.array_distinct(_hashes("item_words"))).alias("hash")), "benchmark-shingles")
    if known.count() <= BROADCAST_SHINGLES:
        known = F.broadcast(known)
    # Count and hashes are worked out before the rows are multiplied, so that no row carries its text's words; the outer
    # form, as for the inner one Spark adds a filter that works out the hashes a second time.
    spots = (keyed.select("_row", words(F.col("text")).alias("words"))
             .select("_row", F.size("words").alias("n"), _hashes("words").alias("hashes"))
             .select("_row", "n", F.posexplode_outer("hashes").alias("at", "hash")))
    length = F.least("n", "size")
    # Of m shared among a and b shingles the similarity is m / (a + b - m) at most.
    least = F.ceil(F.lit(similarity / (1 + similarity)) * (length + F.col("size") - 2 * (SHINGLE - 1)) - 1e-9).cast("int")
    hits = (spots.join(known, "hash").groupBy("_row", "item", "n", "size").agg(F.array_sort(F.collect_list("at")).alias("at"))
            .withColumns({"length": length, "least": F.greatest(least, F.lit(1))}).filter(F.size("at") >= F.col("least")))
    # Windows that hold the hits i to i + least - 1 start where the last of them allows at the earliest, and at the first at the latest.
    starts = F.expr(f"""array_distinct(flatten(transform(sequence(0, size(at) - least), i -> transform(
        array(named_struct('low', greatest(0, at[i + least - 1] - length + {SHINGLE}), 'high', least(at[i], n - length))),
        r -> if(r.low <= r.high, sequence(r.low, r.high), array()))[0])))""")
    return hits.select("_row", F.explode(starts).alias("start"), "length", "size").distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
          similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """Pairs of a document and an item it holds: doc_id, item_id, similarity, start, n_words, hamming, n_windows.

    One row per pair: the most similar of all windows of the item's size (the first of equals), how far its
    fingerprint is from the item's, and how many windows of the document match.
    Items of fewer than five words have no shingle and match nothing, as do null
    and empty texts. An item with a null id is an item of its own. A document shorter than an item is one window as a whole.
    Repeated rows, and rows with a null id, are documents of their own. Empty tables give no rows; other columns are not read.
    """
    keyed, _ = row_key(docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("text")), "doc_id", "_row")
    return _leaks(keyed, benchmark, similarity, radius).drop("_row")


def _leaks(keyed: DataFrame, benchmark: DataFrame, similarity: float, radius: int) -> DataFrame:
    items = written(items_of(benchmark).withColumn("hashes", _hashes("item_words"))
                    .withColumn("item_print", simhash("hashes")).drop("hashes"), "benchmark-items")
    windows = written(_windows(keyed, items, similarity), "windows")
    hit = windows.select("_row").distinct()
    bodies = (maybe_in(keyed, F.xxhash64("_row"), slot_filter(hit, F.xxhash64("_row"))).filter("maybe")
              .select("_row", "doc_id", words(F.col("text")).alias("words")))
    places = written(bodies.join(windows, "_row").select(
        "_row", "doc_id", "start", "length", "size",
        F.array_join(F.slice("words", F.col("start") + 1, F.col("length")), " ").alias("content")), "window-texts")
    # Copies of a passage are looked up and verified once.
    prints = written(places.groupBy("content", "size").agg(F.lit(1).alias("one")).drop("one")
                     .withColumn("window_words", F.split("content", " ")).withColumn("hashes", _hashes("window_words"))
                     .select("content", "size", simhash("hashes").alias("window_print")), "prints")
    asked = prints.select("content", "size", "window_print", F.inline(_blocks(F.col("window_print"))))
    known = items.select("item", "size", "item_print",
                         F.inline(_near_blocks(F.col("item_print"), radius // len(BLOCKS))))
    close = (asked.join(known, ["size", "block", "value"])
             .withColumn("hamming", F.bit_count(F.col("window_print").bitwiseXOR(F.col("item_print"))))
             .filter(F.col("hamming") <= radius)
             .select("content", "item", "hamming").distinct())
    # Few rows, each of which takes far longer to work out than to read: spread as they are, not by their bytes.
    spread = int(close.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    verified = (close.repartition(spread, "content", "item").join(items, "item").withColumn("window_words", F.split("content", " "))
                .withColumn("similarity", weighted_jaccard(_shingles("window_words"), _shingles("item_words")))
                .filter(F.col("similarity") >= similarity)
                .select("content", "size", "item", "item_id", "hamming", "similarity"))
    own = F.when(F.col("item_id").isNull(), F.col("item")).alias("own")
    best = F.max(F.struct("similarity", (-F.col("start")).alias("start"), "length", (-F.col("hamming")).alias("hamming")))
    return (places.join(verified, ["content", "size"]).groupBy("_row", "doc_id", "item_id", own)
            .agg(best.alias("best"), F.count(F.lit(1)).alias("n_windows"))
            .select("_row", "doc_id", "item_id", "best.similarity", (-F.col("best.start")).alias("start"),
                    F.col("best.length").alias("n_words"), (-F.col("best.hamming")).alias("hamming"), "n_windows"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The rows of `docs` that hold no item, with all their columns; see `leaks`."""
    keyed, _ = row_key(docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("text"),
                                   F.struct("*").alias("_all")), "doc_id", "_row")
    gone = written(_leaks(keyed.drop("_all"), benchmark, similarity, radius).select("_row").distinct(), "leaks")
    return without(keyed.select("_row", "_all"), gone).select("_all.*")
