"""The table a reviewer reads, and its headline counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagspark import fixed
from tagspark.functions.tags import confidence
from tagspark.functions.text import basename, blank, display_number, filled, strip
from tagspark.operators.keyed import HOT_ROWS, key_sizes, last_per_key, lookup
from tagspark.operators.metadata import product_medians


def with_metadata(rows: DataFrame, metadata: DataFrame, row_id: str = "image_path",
                  hot_rows: int = HOT_ROWS) -> DataFrame:
    """JN-7: add what the sheet knows, by file, else by the product's medians.

    `from_product` marks rows that found their numbers through the product.
    """
    files = (last_per_key(metadata.select("file", "ord", "product", "category", "price", "views"),
                          ["file"], F.col("ord"))
             .select(F.col("file").alias("image_name"), F.lit(True).alias("_by_file"),
                     *[F.col(c).alias(f"_f_{c}") for c in ("product", "category", "price", "views")]))
    products = (product_medians(metadata)
                .select("product_key", F.lit(True).alias("_by_product"),
                        *[F.col(c).cast("string").alias(f"_p_{c}") for c in ("category", "price", "views")]))
    product_key = F.upper(strip(filled(F.col("product"))))
    found = (lookup(rows.withColumn("image_name", basename(F.col("image_path"))), files, ["image_name"],
                    F.col(row_id), hot_rows)
             .withColumn("product", F.coalesce(filled(F.col("product")), F.col("_f_product"), F.lit("")))
             # The product decides only where the file is unknown.
             .withColumn("product_key", F.when(F.col("_by_file").isNull(), product_key)))
    found = lookup(found, products, ["product_key"], F.col(row_id), hot_rows,
                   heat=key_sizes(rows.select(product_key.alias("product_key")), ["product_key"]))

    def extra(name: str):
        return F.when(F.col("_by_file"), F.col(f"_f_{name}")).otherwise(F.col(f"_p_{name}"))

    return (found
            .withColumn("category", F.coalesce(filled(F.col("category")), extra("category"), F.lit("")))
            .withColumn("price", extra("price"))
            .withColumn("views", extra("views"))
            .withColumn("from_product", F.coalesce("_by_product", F.lit(False)))
            .drop("_by_file", "_by_product", "product_key", "_f_product", "_f_category", "_f_price",
                  "_f_views", "_p_category", "_p_price", "_p_views"))


def review_table(known: DataFrame) -> DataFrame:
    """PRJ-6, S-17, S-18: the eleven columns shown, all of them text."""
    sure = confidence(F.col("tags"), F.col("rationale"), F.col("attempts"))
    return known.select(
        F.col("image_name").alias("Image name"),
        blank(F.col("product")).alias("Product"),
        blank(F.col("category")).alias("Category"),
        blank(F.col("description")).alias("Description"),
        blank(F.col("specs")).alias("Specs"),
        F.array_join("highlights", ", ").alias("Highlights"),
        F.array_join("tags", ", ").alias("Marketing tags"),
        sure["verdict"].alias("How sure? (confidence)"),
        sure["why"].alias("Why (signals)"),
        display_number(F.col("price")).alias("Price"),
        display_number(F.col("views")).alias("Views"))


def blank_columns(table: DataFrame, optional: Sequence[str] = tuple(fixed.OPTIONAL_COLUMNS)) -> DataFrame:
    """PRJ-7: one row per optional column, and whether any row fills it."""
    used = table.agg(*[F.coalesce(F.bool_or(F.col(f"`{c}`") != ""), F.lit(False)).alias(c) for c in optional])
    return used.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("filled")) for c in optional])).alias("c")
    ).select("c.column", "c.filled")


def without_blank_columns(table: DataFrame, optional: Sequence[str] = tuple(fixed.OPTIONAL_COLUMNS)) -> DataFrame:
    """PRJ-7: the table less the optional columns that no row fills.

    A schema cannot depend on unread data, so the flags (one per optional
    column) are read here.
    """
    unused = [r["column"] for r in blank_columns(table, optional).filter(~F.col("filled")).collect()]
    return table.drop(*unused)


def headline(known: DataFrame) -> DataFrame:
    """AG-20: counts shown above the table."""
    sure = confidence(F.col("tags"), F.col("rationale"), F.col("attempts"))
    return known.agg(
        F.count(F.lit(1)).alias("images"),
        F.count_if(sure["verdict"] == fixed.VERDICTS["more"]).alias("needs_a_look"),
        F.count_if("cached").alias("cached"),
        F.count_if(F.coalesce(F.col("attempts"), F.lit(0)) > 1).alias("asked_twice"),
        F.count_if("from_product").alias("from_product"))


def untagged(rows: DataFrame) -> DataFrame:
    """FLT-6: rows that came back without a tag."""
    return rows.filter(F.size("tags") == 0)


def explained(rows: DataFrame) -> DataFrame:
    """FLT-6: rows with at least one reason."""
    return rows.filter(F.size(F.map_keys("rationale")) > 0)
