"""Images in folders: suppliers written as one file each, listed, opened, sampled and tagged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagspark.catalog import adapters as A
from tagspark.catalog.adapters import sql
from tagspark.catalog.registry import query
from tagspark.catalog.replay import FollowingScorer
from tagspark.operators import engagement
from tagspark.plans.tagging_job import tag_items
from tagspark.session import fresh_path
from tagspark.sources import images
from tagspark.sources.memory_table import MemoryTable

WORDS = "[" + ", ".join(f"'{w}'" for w in A.VOCABULARY) + "]"
FILES = f"""
WITH named AS (
  SELECT s_suppkey AS k, {WORDS}[s_suppkey % {len(A.VOCABULARY)} + 1] AS one, {WORDS}[s_nationkey % {len(A.VOCABULARY)} + 1] AS two, s_nationkey
  FROM supplier),
files AS (
  SELECT k, 'nation-' || s_nationkey || '/' || k || CASE WHEN k % 3 = 0 THEN '' ELSE ' [''' || one || ''', ''' || two || ''']' END || '.jpg' AS name,
    one || ' ' || two || chr(10) AS content, CASE WHEN k % 3 = 0 THEN [] ELSE [one, two] END AS truth, one FROM named)"""


def _folder(spark: SparkSession, sf_dir: str) -> str:
    """Every supplier as an image file, two thirds of them named by a tag list."""
    words = F.array(*[F.lit(w) for w in A.VOCABULARY])
    named = A.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("k"), F.get(words, (F.col("s_suppkey") % len(A.VOCABULARY)).cast("int")).alias("one"),
        F.get(words, (F.col("s_nationkey") % len(A.VOCABULARY)).cast("int")).alias("two"), "s_nationkey")
    listed = F.when(F.col("k") % 3 == 0, "").otherwise(F.concat(F.lit(" ['"), "one", F.lit("', '"), "two", F.lit("']")))
    name = F.concat(F.lit("nation-"), F.col("s_nationkey").cast("string"), F.lit("/"), F.col("k").cast("string"), listed, F.lit(".jpg"))
    root = fresh_path(spark, "images")
    images.write_files(named.select(name.alias("name"), F.concat("one", F.lit(" "), "two", F.lit("\n")).cast("binary").alias("content")), root)
    return root


def _name(path: str = "path"):
    return F.regexp_extract(path, r"(nation-[0-9]+/[^/]*)\z", 1)


@query(FILES + "SELECT name FROM files ORDER BY name LIMIT 25")
def image_listing(spark, sf_dir):
    """The first 25 images of a folder tree in the order of their paths."""
    return images.list_images(spark, _folder(spark, sf_dir), limit=25).select(_name().alias("name"))


@query(FILES + "SELECT name, CAST(length(content) AS BIGINT) AS length, 'image/jpeg' AS media_type, base64(encode(content)) AS content_b64 FROM files")
def image_payloads(spark, sf_dir):
    """Length of every image by a listing that opens nothing, its media type and its bytes as base64."""
    folder = images.ImageFolder(spark, _folder(spark, sf_dir))
    read = images.encoded_images(spark, folder.root)
    return folder.listing().select("path", "length").join(read, "path").select(_name().alias("name"), "length", "media_type", "content_b64")


@query(FILES + "SELECT name, array_to_string(truth, '|') AS truth FROM files WHERE len(truth) > 0 ORDER BY name LIMIT 20")
def labelled_sample(spark, sf_dir):
    """The first 20 images whose name is a tag list, with these tags."""
    return images.labelled_images(spark, _folder(spark, sf_dir), sample=20).select(_name().alias("name"), F.array_join("truth", "|").alias("truth"))


@query(FILES + "SELECT name, one AS tags, true AS cached, 0 AS attempts FROM files")
def tagging_unchanged(spark, sf_dir):
    """A second run over an unchanged folder: fingerprints come from the manifest, answers from the memory."""
    folder = images.ImageFolder(spark, _folder(spark, sf_dir), MemoryTable(spark, fresh_path(spark, "manifest"), images.MANIFEST))
    memory = MemoryTable(spark, fresh_path(spark, "memory"))
    options = {"model_id": "alpha-mini-1", "vocabulary": A.VOCABULARY, "highlight_family": A.FAMILY, "passes": 1, "memory": memory}
    memory.put(tag_items(folder, FollowingScorer, **options).memory_rows)
    again = tag_items(folder, FollowingScorer, **options)
    return again.rows.select(_name().alias("name"), F.array_join("tags", "|").alias("tags"), "cached", "attempts")


@query(sql("""
, norm AS (SELECT t.ord, unnest(truth) AS tag, unnest(range(len(truth))) AS pos, TRY_CAST(views AS DOUBLE) AS v
  FROM tagged t JOIN metadata m USING (ord) WHERE TRY_CAST(views AS DOUBLE) IS NOT NULL),
lifts AS (SELECT tag, (sum(v) / count(*)) / (SELECT avg(TRY_CAST(views AS DOUBLE)) FROM metadata) AS lift, min((ord, pos)) AS first_seen
  FROM norm GROUP BY tag HAVING count(*) >= 2)
SELECT tag, row_number() OVER (ORDER BY round_even(lift, 2) DESC, first_seen) AS rank FROM lifts""", "tagged", "metadata"))
def engagement_ranking(spark, sf_dir):
    """Tags in the order of their lift; there are as many rows as tags."""
    rows = A.items(spark, sf_dir).select("ord", F.col("truth").alias("tags")).join(
        A.metadata(spark, sf_dir).select("ord", "views"), "ord")
    ranked: DataFrame = engagement.tag_engagement(rows).withColumn("_at", F.monotonically_increasing_id())
    return ranked.select("tag", F.row_number().over(Window.orderBy("_at")).cast("bigint").alias("rank"))
