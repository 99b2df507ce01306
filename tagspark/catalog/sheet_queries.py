"""Joining to the sheet, and the review table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagspark.catalog import adapters as A
from tagspark.catalog.adapters import sql
from tagspark.catalog.registry import query
from tagspark.functions.text import display_number, tolerant_number
from tagspark.functions.tags import highlights, kept_tags
from tagspark.operators import engagement, metadata as sheet, review
from tagspark.operators.keyed import first_per_key, last_per_key
from tagspark.session import fresh_path
from tagspark.sources.records import write_review
from tagspark.plans.reports import insights, insights_from_sheet

JOINED = """
, results AS (SELECT ord, path, category, CASE WHEN ord % 3 = 0 THEN 'other' ELSE upper(product) END AS model, truth
  FROM tagged),
by_key AS (SELECT * FROM metadata QUALIFY row_number() OVER (
  PARTITION BY lower(category), lower(product), file ORDER BY ord DESC) = 1),
by_name AS (SELECT * FROM metadata QUALIFY row_number() OVER (PARTITION BY file ORDER BY ord) = 1),
joined AS (
  SELECT r.ord, r.path, r.truth, coalesce(k.category, n.category) AS category, coalesce(k.product, n.product) AS product,
    coalesce(k.price, n.price) AS price, CASE WHEN k.ord IS NULL THEN n.views ELSE k.views END AS views
  FROM results r
  LEFT JOIN by_key k ON lower(k.category) = lower(r.category) AND lower(k.product) = lower(r.model)
    AND k.file = string_split(r.path, '/')[-1]
  LEFT JOIN by_name n ON n.file = string_split(r.path, '/')[-1]
  WHERE k.ord IS NOT NULL OR n.ord IS NOT NULL)"""


def _results(spark, sf_dir):
    return A.items(spark, sf_dir).select(
        "ord", "path", "category", F.when(F.col("ord") % 3 == 0, "other").otherwise(F.upper("product")).alias("model"),
        F.col("truth").alias("tags"))


@query(sql(JOINED + "SELECT ord, path, category, product, price, views FROM joined", "tagged", "metadata"))
def join_two_tier(spark, sf_dir):
    joined = sheet.join_two_tier(_results(spark, sf_dir), A.metadata(spark, sf_dir))
    return joined.select("ord", "path", "category", "product", "price", "views")


@query(sql(JOINED + "SELECT (SELECT count(*) FROM results) AS rows, (SELECT count(*) FROM joined) AS matched",
           "tagged", "metadata"))
def match_coverage(spark, sf_dir):
    results = _results(spark, sf_dir)
    return engagement.match_coverage(results, sheet.join_two_tier(results, A.metadata(spark, sf_dir)))


@query(sql(JOINED + """
, flat AS (SELECT unnest(truth) AS tag, TRY_CAST(views AS DOUBLE) AS v FROM joined
  WHERE TRY_CAST(views AS DOUBLE) IS NOT NULL)
SELECT tag, count(*) AS images, sum(v) / count(*) AS mean, median(v) AS median,
  (sum(v) / count(*)) / (SELECT avg(TRY_CAST(views AS DOUBLE)) FROM joined) AS lift
FROM flat GROUP BY tag HAVING count(*) >= 2""", "tagged", "metadata"))
def insights_job(spark, sf_dir):
    return insights(_results(spark, sf_dir), A.metadata(spark, sf_dir))


NAMED = """
, named AS (SELECT * REPLACE (CASE WHEN ord % 4 = 0 THEN file
    ELSE '[''' || upper(string_split(file[:-5], ' ')[1]) || ''', "' || string_split(file[:-5], ' ')[2] || '"' ||
      CASE WHEN ord % 4 = 1 THEN ',' ELSE '' END || ']' ||
      CASE WHEN ord % 4 = 3 THEN ' x ].jpg' ELSE '.jpg' END END AS file) FROM metadata)"""


def _named_sheet(spark, sf_dir):
    """The sheet with tag lists for file names: plain, closed by a comma, and broken ones."""
    words = F.split(F.regexp_extract("file", r"(.*)\.jpg", 1), " ")
    listed = F.concat(F.lit("['"), F.upper(F.get(words, F.lit(0))), F.lit("', \""), F.get(words, F.lit(1)), F.lit('"'),
                      F.when(F.col("ord") % 4 == 1, ",").otherwise(""), F.lit("]"),
                      F.when(F.col("ord") % 4 == 3, " x ].jpg").otherwise(".jpg"))
    return A.metadata(spark, sf_dir).withColumn(
        "file", F.when(F.col("ord") % 4 == 0, F.col("file")).otherwise(listed))


@query(sql(NAMED + """
SELECT ord, file AS path, lower(regexp_extract(file, '\\[''(\\w+)''', 1)) || '|' ||
  regexp_extract(file, '"(\\w+)"', 1) AS tags FROM named WHERE ord % 4 IN (1, 2)""", "metadata"))
def labels_from_names(spark, sf_dir):
    rows = sheet.rows_from_sheet(_named_sheet(spark, sf_dir))
    return rows.select("ord", "path", F.array_join("tags", "|").alias("tags"))


@query(sql(NAMED + """
, rows AS (SELECT lower(regexp_extract(file, '\\[''(\\w+)''', 1)) AS a, regexp_extract(file, '"(\\w+)"', 1) AS b,
  TRY_CAST(views AS DOUBLE) AS v FROM named WHERE ord % 4 IN (1, 2) AND TRY_CAST(views AS DOUBLE) IS NOT NULL),
flat AS (SELECT unnest([a, b]) AS tag, v FROM rows)
SELECT tag, count(*) AS images, sum(v) / count(*) AS mean, median(v) AS median,
  (sum(v) / count(*)) / (SELECT avg(v) FROM rows) AS lift
FROM flat GROUP BY tag HAVING count(*) >= 2""", "metadata"))
def insights_from_names(spark, sf_dir):
    return insights_from_sheet(_named_sheet(spark, sf_dir))


@query(sql("""
SELECT file, min(ord) AS first_ord, max(ord) AS last_ord, arg_min(product, ord) AS first_product,
  arg_max(product, ord) AS last_product FROM metadata GROUP BY file""", "metadata"))
def first_and_last_wins(spark, sf_dir):
    rows = A.metadata(spark, sf_dir).select("file", "ord", "product")
    first = first_per_key(rows, ["file"], F.col("ord")).toDF("file", "first_ord", "first_product")
    last = last_per_key(rows, ["file"], F.col("ord")).toDF("file", "last_ord", "last_product")
    return first.join(last, "file")


PRODUCTS = """
, files AS (SELECT file, min(ord) AS first_ord, arg_max(product, ord) AS product, arg_max(category, ord) AS category,
    arg_max(TRY_CAST(price AS DOUBLE), ord) AS price_last, max(ord) AS last_ord FROM metadata GROUP BY file),
filed AS (SELECT f.file, f.first_ord, m.product, m.category, TRY_CAST(m.price AS DOUBLE) AS price,
    TRY_CAST(m.views AS DOUBLE) AS views FROM files f JOIN metadata m ON m.ord = f.last_ord),
products AS (SELECT upper(trim(product)) AS product_key, arg_min(category, first_ord) AS category,
  median(price) AS price, median(views) AS views, count(*) AS images FROM filed GROUP BY 1)"""


@query(sql(PRODUCTS + "SELECT * FROM products", "metadata"))
def product_medians(spark, sf_dir):
    return sheet.product_medians(A.metadata(spark, sf_dir))


@query(sql("""
SELECT upper(trim(product)) AS product_key, arg_min(category, ord) AS category, median(TRY_CAST(price AS DOUBLE)) AS price,
  median(TRY_CAST(views AS DOUBLE)) AS views, count(*) AS images FROM metadata GROUP BY 1""", "metadata"))
def product_medians_all_rows(spark, sf_dir):
    return sheet.product_medians(A.metadata(spark, sf_dir), dedupe_by_file=False)


@query(sql("""
, last AS (SELECT file, arg_max(category, ord) AS c, arg_max(product, ord) AS p FROM metadata GROUP BY file)
SELECT t.ord, 'Category: ' || c || ', Model: ' || p AS context FROM tagged t JOIN last ON last.file = t.file""",
           "tagged", "metadata"))
def context_from_metadata(spark, sf_dir):
    items = A.items(spark, sf_dir).select("ord", "path")
    return sheet.contexts_from_metadata(items, A.metadata(spark, sf_dir)).select("ord", "context")


def _run_rows(spark, sf_dir):
    """F-TAG as one run of the results history; some files are not on the sheet."""
    rows = A.items(spark, sf_dir)
    kept = kept_tags(F.col("raw"), A.VOCABULARY)
    tags = F.when(F.col("ord") % 17 == 0, F.array().cast("array<string>")).otherwise(kept)
    seen = F.when((F.col("ord") % 2 == 0) & (F.size("tags") > 0),
                  F.create_map(F.get("tags", F.lit(0)), F.lit("seen")))
    shot = F.concat(F.lit("shots/"), F.col("ord").cast("string"), F.lit(".jpg"))
    return (rows.withColumn("tags", tags).select(
        "ord", F.when(F.col("ord") % 4 == 0, shot).otherwise(F.col("path")).alias("image_path"), "tags",
        highlights(F.col("tags"), A.FAMILY).alias("highlights"),
        F.coalesce(seen, F.create_map().cast("map<string,string>")).alias("rationale"),
        F.when(F.col("ord") % 6 == 0, "").otherwise(F.col("product")).alias("product"), F.lit("").alias("category"),
        F.lit("").alias("description"), F.lit(None).cast("string").alias("specs"),
        F.when(F.col("ord") % 5 == 0, 2).otherwise(1).alias("attempts"), (F.col("ord") % 3 == 0).alias("cached")))


RUN = PRODUCTS + """
, run AS (
  SELECT ord, CASE WHEN ord % 4 = 0 THEN CAST(ord AS VARCHAR) || '.jpg' ELSE file END AS image_name,
    CASE WHEN ord % 17 = 0 THEN [] ELSE kept END AS tags, CASE WHEN ord % 6 = 0 THEN '' ELSE product END AS product,
    CASE WHEN ord % 5 = 0 THEN 2 ELSE 1 END AS attempts, ord % 3 = 0 AS cached, ord % 2 = 0 AS has_reason FROM checked),
last_row AS (SELECT * FROM metadata QUALIFY row_number() OVER (PARTITION BY file ORDER BY ord DESC) = 1),
known AS (
  SELECT r.*, m.ord IS NOT NULL AS by_file, m.ord IS NULL AND p.product_key IS NOT NULL AS from_product,
    CASE WHEN r.product <> '' THEN r.product ELSE coalesce(m.product, '') END AS shown_product,
    CASE WHEN m.ord IS NOT NULL THEN m.category ELSE coalesce(p.category, '') END AS category,
    CASE WHEN m.ord IS NOT NULL THEN TRY_CAST(m.price AS DOUBLE) ELSE p.price END AS price,
    CASE WHEN m.ord IS NOT NULL THEN TRY_CAST(m.views AS DOUBLE) ELSE p.views END AS views,
    list_filter([CASE WHEN attempts > 1 THEN 're-prompted' END,
      CASE WHEN has_reason AND len(tags) > 1 THEN 'some tags unexplained' END,
      CASE WHEN len(tags) = 1 THEN 'only one tag' END], lambda x: x IS NOT NULL) AS warned
  FROM run r LEFT JOIN last_row m ON m.file = r.image_name
  LEFT JOIN products p ON m.ord IS NULL AND p.product_key = upper(trim(r.product))),
judgement AS (
  SELECT *, CASE WHEN len(tags) = 0 THEN 'Needs a look' WHEN len(warned) = 0 THEN 'High'
      WHEN len(warned) = 1 THEN 'Medium' ELSE 'Needs a look' END AS verdict,
    CASE WHEN len(tags) = 0 THEN 'nothing was tagged' WHEN len(warned) = 0 THEN 'clean first answer, every tag explained'
      ELSE array_to_string(warned, ', ') END AS why FROM known),
shown AS (
  SELECT image_name AS "Image name", shown_product AS "Product", category AS "Category", '' AS "Description",
    '' AS "Specs", array_to_string(list_filter(tags, lambda x: list_contains(
      ['widget', 'gear', 'plate', 'bolt', 'ring', 'rod'], x)), ', ') AS "Highlights",
    array_to_string(tags, ', ') AS "Marketing tags", verdict AS "How sure? (confidence)", why AS "Why (signals)",
    CASE WHEN price IS NULL THEN '' ELSE format('{:,}', CAST(round_even(price, 0) AS BIGINT)) END AS "Price",
    CASE WHEN views IS NULL THEN '' ELSE format('{:,}', CAST(round_even(views, 0) AS BIGINT)) END AS "Views"
  FROM judgement)"""
RUN_ON = ("tagged", "checked", "metadata")


def _known(spark, sf_dir):
    return review.with_metadata(_run_rows(spark, sf_dir), A.metadata(spark, sf_dir), row_id="ord")


@query(sql(RUN + 'SELECT * FROM shown', *RUN_ON))
def review_table(spark, sf_dir):
    return review.review_table(_known(spark, sf_dir))


@query(sql(RUN + 'SELECT * EXCLUDE ("Description", "Specs") FROM shown', *RUN_ON))
def review_table_filled(spark, sf_dir):
    return review.without_blank_columns(review.review_table(_known(spark, sf_dir)))


@query(sql(RUN + """
SELECT unnest(['Product', 'Category', 'Description', 'Specs', 'Price', 'Views']) AS "column",
  unnest([bool_or("Product" <> ''), bool_or("Category" <> ''), bool_or("Description" <> ''), bool_or("Specs" <> ''),
    bool_or("Price" <> ''), bool_or("Views" <> '')]) AS filled FROM shown""", *RUN_ON))
def blank_columns(spark, sf_dir):
    return review.blank_columns(review.review_table(_known(spark, sf_dir)))


@query(sql(RUN + """
SELECT count(*) AS images, count(*) FILTER (verdict = 'Needs a look') AS needs_a_look,
  count(*) FILTER (cached) AS cached, count(*) FILTER (attempts > 1) AS asked_twice,
  count(*) FILTER (from_product) AS from_product FROM judgement""", *RUN_ON))
def review_headline(spark, sf_dir):
    return review.headline(_known(spark, sf_dir))


@query(sql("SELECT ord FROM tagged WHERE ord % 17 = 0", "tagged"))
def untagged_rows(spark, sf_dir):
    return review.untagged(_run_rows(spark, sf_dir)).select("ord")


@query(sql("SELECT ord FROM checked WHERE ord % 2 = 0 AND ord % 17 <> 0 AND len(kept) > 0", "tagged", "checked"))
def explained_rows(spark, sf_dir):
    return review.explained(_run_rows(spark, sf_dir)).select("ord")


@query("""
SELECT l_orderkey, l_linenumber, l_extendedprice AS number,
  format('{:,}', CAST(round_even(l_extendedprice, 0) AS BIGINT)) AS shown
FROM lineitem""")
def display_numbers(spark, sf_dir):
    rows = A.table(spark, sf_dir, "lineitem")
    written = F.format_number("l_extendedprice", 2)
    return rows.select("l_orderkey", "l_linenumber", tolerant_number(written).alias("number"),
                       display_number(F.col("l_extendedprice")).alias("shown"))


@query(sql(RUN + 'SELECT "Image name", "Marketing tags", "Why (signals)", "Price" FROM shown', *RUN_ON))
def review_export(spark, sf_dir):
    """The review table written as CSV and read back."""
    path = fresh_path(spark, "review")
    write_review(review.review_table(_known(spark, sf_dir)), path)
    shown = ["Image name", "Marketing tags", "Why (signals)", "Price"]
    return spark.read.csv(path, header=True, escape='"').select(
        *[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in shown])
