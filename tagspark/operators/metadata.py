"""Joining results to a metadata sheet, and labels read off the sheet itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagspark.functions.paths import describe, tags_from_name
from tagspark.functions.text import basename, blank, filled, strict_number, strip
from tagspark.operators.keyed import HOT_ROWS, first_per_key, key_sizes, last_per_key, lookup
from tagspark.operators.order_stats import medians
from tagspark.session import written


def _folded(text: Column) -> Column:
    return F.lower(strip(blank(text)))


def join_two_tier(results: DataFrame, metadata: DataFrame, row_id: str = "ord",
                  hot_rows: int = HOT_ROWS) -> DataFrame:
    """JN-1: match on (category, model, file), else on file name alone.

    In the first tier the last sheet row of a key wins, in the second the
    first. Results without a match are dropped; a sheet column replaces the
    result column of the same name. `metadata` carries `ord`, its row order.
    """
    extra = [c for c in metadata.columns if c not in ("file", "ord")]
    sheet = metadata.select(
        _folded(F.col("category")).alias("_category"), _folded(F.col("product")).alias("_product"),
        F.col("file").alias("_name"), strip(F.col("file")).alias("_file"), "ord",
        F.struct(*extra).alias("_meta"))
    by_key = last_per_key(
        sheet.select("_category", "_product", "_file", "ord", F.col("_meta").alias("_by_key")),
        ["_category", "_product", "_file"], F.col("ord")).drop("ord")
    by_name = first_per_key(
        sheet.select("_name", "ord", F.col("_meta").alias("_by_name")), ["_name"], F.col("ord")).drop("ord")
    keyed = results.withColumns({
        "_category": _folded(F.col("category")), "_product": _folded(F.col("model")),
        "_name": basename(F.col("path")), "_file": strip(basename(F.col("path"))),
    })
    tier_one = lookup(keyed, by_key, ["_category", "_product", "_file"], F.col(row_id), hot_rows)
    tier_two = lookup(tier_one, by_name, ["_name"], F.col(row_id), hot_rows, heat=key_sizes(keyed, ["_name"]))
    meta = F.coalesce("_by_key", "_by_name")
    own = [c for c in results.columns if c not in extra]
    return (tier_two.filter(meta.isNotNull())
            .select(*own, *[meta[c].alias(c) for c in extra]))


def rows_from_sheet(metadata: DataFrame) -> DataFrame:
    """PRJ-8: sheet rows whose file name is a tag list, with `tags` and `path`."""
    return (metadata.withColumn("tags", tags_from_name(F.col("file")))
            .filter(F.size("tags") > 0)
            .withColumn("path", F.col("file")))


def by_file(metadata: DataFrame) -> DataFrame:
    """One row per file, the last of the sheet, with `first_ord` its first place."""
    return (metadata.groupBy("file")
            .agg(F.max_by(F.struct(*[c for c in metadata.columns if c != "file"]), "ord").alias("_row"),
                 F.min("ord").alias("first_ord"))
            .select("file", *[F.col("_row")[c].alias(c) for c in metadata.columns if c != "file"], "first_ord"))


def product_medians(metadata: DataFrame, dedupe_by_file: bool = True) -> DataFrame:
    """AG-12: median price and views per product, category of its first row.

    By default over the sheet with one row per file. `product_key` is the
    trimmed, upper-case product.
    """
    sheet = by_file(metadata) if dedupe_by_file else metadata.withColumn("first_ord", F.col("ord"))
    rows = written(sheet.select(
        F.upper(strip(blank(F.col("product")))).alias("product_key"), "category", "first_ord",
        strict_number(F.col("price")).alias("price"), strict_number(F.col("views")).alias("views"))
        .filter(F.col("product_key") != ""), "products")
    heads = rows.groupBy("product_key").agg(
        F.min_by("category", "first_ord").alias("category"), F.count(F.lit(1)).alias("images"))
    # Both figures in one pass: one value per row and figure.
    values = rows.select("product_key", F.explode(F.array(*[
        F.struct(F.lit(c).alias("figure"), F.col(c).alias("value")) for c in ("price", "views")])).alias("v")
    ).select("product_key", "v.figure", "v.value")
    middles = (medians(values, ["product_key", "figure"], "value", "middle")
               .groupBy("product_key")
               .agg(*[F.max(F.when(F.col("figure") == c, F.col("middle"))).alias(c) for c in ("price", "views")]))
    return (heads.join(middles, "product_key", "left")
            .select("product_key", "category", "price", "views", "images"))


def contexts_from_metadata(items: DataFrame, metadata: DataFrame, row_id: str = "ord",
                           hot_rows: int = HOT_ROWS) -> DataFrame:
    """JN-8: `context` of each item from the sheet row of its file; last row wins."""
    known = last_per_key(
        metadata.select("file", "ord", "category", "product"), ["file"], F.col("ord")
    ).select("file", F.col("category").alias("_category"), F.col("product").alias("_product"))
    keyed = items.withColumn("file", basename(F.col("path")))
    return (lookup(keyed, known, ["file"], F.col(row_id), hot_rows)
            .withColumn("context", describe(filled(F.col("_category")), filled(F.col("_product"))))
            .select(*items.columns, "context"))
