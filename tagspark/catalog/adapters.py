"""The given tables in the shape the operators expect.

Every adapter has a Spark form and, under the same name in `SQL`, a common
table expression for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagspark.functions.images import base64_text, request_key

# fixed values: the vocabulary of the catalogue; `gizmo` and `anvil` stay out
TAXONOMY = {
    "colour": ["red", "blue"],
    "size": ["small", "large"],
    "temperature": ["hot", "cold"],
    "age": ["old", "new"],
    "object": ["widget", "gear", "plate", "bolt", "ring", "rod"],
}
VOCABULARY = [t for general, specifics in TAXONOMY.items() for t in (general, *specifics)]
FAMILY = TAXONOMY["object"]
CATEGORIES = ["economy", "promo", "large", "medium", "standard", "small"]
LICENCE_RULES = {
    "licence": ["license", "licensed", "copyright"],
    "permissive": ["mit license", "apache"],
    "copyleft": ["gnu general", "gpl"],
}
PRICES = [("alpha", 5.0, 25.0), ("alpha-mini", 1.0, 5.0)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _path() -> Column:
    return F.concat(F.lit("catalog/"), "p_type", F.lit("/"), "p_brand", F.lit("/"), "p_name", F.lit(".jpg"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-TAG without predictions: labelled items with raw answers."""
    words = F.split("p_name", " ")
    base = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ord"), _path().alias("path"), F.concat("p_name", F.lit(".jpg")).alias("file"),
        F.col("p_type").alias("category"), F.col("p_brand").alias("product"), words.alias("truth"))
    first, second = F.get("truth", F.lit(0)), F.get("truth", F.lit(1))
    raw = F.array(F.upper(first), F.concat(F.lit("  "), second, F.lit(" ")), first, F.col("category"))
    return base.withColumn("raw", raw)


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-TAG: items with the truth of the next one as their prediction."""
    part = table(spark, sf_dir, "part")
    total = part.agg(F.count(F.lit(1)).alias("n")).scalar()
    shifted = part.select(
        F.pmod(F.col("p_partkey") - 1 + total, total).alias("ord"), F.split("p_name", " ").alias("pred"))
    return items(spark, sf_dir).join(shifted, "ord")


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-META: the sheet, numbers as text, some missing."""
    sold = (table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey"))
            .agg(F.sum("l_quantity").cast("bigint").alias("sold")))
    return (table(spark, sf_dir, "part").join(sold, "p_partkey", "left").select(
        F.col("p_partkey").alias("ord"), F.concat("p_name", F.lit(".jpg")).alias("file"),
        F.col("p_type").alias("category"), F.col("p_brand").alias("product"),
        F.col("p_retailprice").cast("string").alias("price"),
        F.when(F.col("p_partkey") % 10 == 0, "n/a").when(F.col("p_partkey") % 10 != 1, F.col("sold").cast("string"))
        .alias("views")))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-LAB: documents with labels as truth and a length rule as prediction."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")

    def named(**when: Column) -> Column:
        return F.array_compact(F.array(*[F.when(c, name) for name, c in when.items()])).cast("array<string>")

    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        F.col("doc_id").alias("ord"), F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("path"),
        named(quality=F.col("quality") == 1, toxic=F.col("toxic") == 1).alias("truth"),
        named(quality=F.col("n_chars") > 1000, toxic=F.col("doc_id") % 9 == 0).alias("predicted"))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-ACT: one task with one timed action per event."""
    k = F.get_json_object("props", "$.k").cast("int")
    failed = F.col("event_type") == "error"
    status = F.element_at(F.array(*[F.lit(s) for s in (200, 429, 503, 400, 408)]), (F.col("k") % 5 + 1).cast("int"))
    return (table(spark, sf_dir, "events").withColumn("k", k).select(
        F.col("event_id").alias("task_id"), F.concat(F.lit("run-"), F.col("user_id") % 10).alias("run_id"),
        F.col("event_type").alias("action"), F.col("value").alias("ms"), failed.alias("failed"),
        F.when(failed, 0).otherwise(F.col("k") % 4).alias("n_tags"), (F.col("k") % 5 == 0).alias("cached"),
        (F.col("k") % 3).alias("retries"), (F.col("k") % 5 != 0).cast("int").alias("model_calls"),
        (100 * F.col("k")).cast("bigint").alias("input_tokens"), (10 * F.col("k")).cast("bigint").alias("output_tokens"),
        F.element_at(F.array(F.lit("alpha-mini-20250101"), F.lit("alpha-20250101"), F.lit("local-x")),
                     (F.col("user_id") % 3 + 1).cast("int")).alias("model_id"),
        status.alias("status"),
        F.when(failed, F.concat(F.lit("Kind"), (F.col("k") % 3).cast("string"), F.lit(": detail "),
                                F.col("k").cast("string"))).alias("error"),
        F.col("ts")))


def prices(spark: SparkSession) -> DataFrame:
    """F-PRICE."""
    return spark.createDataFrame(PRICES, "prefix string, usd_in double, usd_out double")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-REQ: one scoring request per document, with its fingerprint."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("ord"),
        request_key(base64_text(F.col("text").cast("binary")), F.lit("m1"), F.col("lang")).alias("key"))


def memory(spark: SparkSession, sf_dir: str, requests: DataFrame) -> DataFrame:
    """F-REQ: keys already answered, those of the labelled documents."""
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ord"))
    return requests.join(known, "ord", "left_semi").select("key").distinct()


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-RES: writes to the results history, many per (run, image)."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("image_path"),
        F.col("ts").alias("created"), F.col("event_id").alias("write_ord"), "value")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-EVI: one found text per document, its source as the entity."""
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("entity"), F.lit("").alias("title"), F.col("text").alias("snippet"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-COR: what was found about each brand, keyed by its lower-case name."""
    heads = table(spark, sf_dir, "part").groupBy("p_brand").agg(
        F.min("p_partkey").alias("ord"), F.min_by("p_type", "p_partkey").alias("p_type"))
    snippet = (F.when(F.col("ord") % 3 == 0, F.concat(F.lit("Winner among "), "p_type", F.lit(" models.")))
               .when(F.col("ord") % 3 == 1, "A step towards better tools, measured twice.")
               .otherwise("Sold in many shops."))
    return heads.select(F.lower("p_brand").alias("key"), "ord", F.array(
        F.struct(F.col("p_brand").alias("title"), snippet.alias("snippet"), F.lit("").alias("url"))).alias("results"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-ANS: raw answers built from parts, and assistant turns without an array."""
    first, second = F.get(F.split("p_name", " "), F.lit(0)), F.get(F.split("p_name", " "), F.lit(1))
    array = F.concat(F.lit('["'), first, F.lit('", "'), second, F.lit('"'),
                     F.when(F.col("p_partkey") % 7 == 0, "").otherwise("]"))
    fenced = F.when(F.col("p_partkey") % 2 == 1, F.concat(F.lit("```json\n"), array, F.lit("\n```"))).otherwise(array)
    long = F.col("p_partkey") % 5 == 0
    built = table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("item_id"),
        F.concat(F.lit("- "), first, F.lit(" - because "), first, F.when(long, F.repeat(F.lit(" and so on"), 30)).otherwise(""),
                 F.lit("\n"), second, F.lit(": seen\nCategory: "), F.col("p_type"), F.lit("\n**Model:** "), F.col("p_brand"),
                 F.lit("\nSpecs: "), F.when(long, F.repeat(F.lit("very "), 90)).otherwise(""), F.when(long, "long").otherwise("none"),
                 F.lit("\n"), fenced).alias("text"))
    turns = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("item_id"),
        "text")
    return built.unionByName(turns)


def _sql_list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


SQL = {
    "tagged": """
base AS (
  SELECT p_partkey AS ord, 'catalog/' || p_type || '/' || p_brand || '/' || p_name || '.jpg' AS path,
         p_name || '.jpg' AS file, p_type AS category, p_brand AS product, string_split(p_name, ' ') AS truth
  FROM part),
tagged AS (
  SELECT b.*, [upper(b.truth[1]), '  ' || b.truth[2] || ' ', b.truth[1], b.category] AS raw, p.truth AS pred
  FROM base b JOIN base p ON p.ord = (b.ord + 1) % (SELECT count(*) FROM base))""",
    "checked": f"""
checked AS (
  SELECT *,
    list_filter(norm, lambda x, i: list_contains({_sql_list(VOCABULARY)}, x) AND list_position(norm, x) = i) AS kept,
    list_filter(raw, lambda x: NOT list_contains({_sql_list(VOCABULARY)},
      lower(trim(regexp_replace(x, '\\s+', ' ', 'g'))))) AS dropped
  FROM (SELECT *, list_transform(raw, lambda x: lower(trim(regexp_replace(x, '\\s+', ' ', 'g')))) AS norm FROM tagged))""",
    "metadata": """
metadata AS (
  SELECT p_partkey AS ord, p_name || '.jpg' AS file, p_type AS category, p_brand AS product,
         CAST(p_retailprice AS VARCHAR) AS price,
         CASE WHEN p_partkey % 10 = 0 THEN 'n/a' WHEN p_partkey % 10 <> 1 THEN CAST(sold AS VARCHAR) END AS views
  FROM part LEFT JOIN (SELECT l_partkey, CAST(sum(l_quantity) AS BIGINT) AS sold FROM lineitem GROUP BY l_partkey)
    ON l_partkey = p_partkey)""",
    "judged": """
judged AS (
  SELECT doc_id AS ord, lpad(CAST(doc_id AS VARCHAR), 8, '0') AS path,
    list_filter([CASE WHEN quality = 1 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'toxic' END],
                lambda x: x IS NOT NULL) AS truth,
    list_filter([CASE WHEN n_chars > 1000 THEN 'quality' END, CASE WHEN doc_id % 9 = 0 THEN 'toxic' END],
                lambda x: x IS NOT NULL) AS predicted
  FROM labels JOIN documents USING (doc_id))""",
    "actions": """
actions AS (
  SELECT event_id AS task_id, 'run-' || CAST(user_id % 10 AS VARCHAR) AS run_id, event_type AS action, value AS ms,
    event_type = 'error' AS failed, CASE WHEN event_type = 'error' THEN 0 ELSE k % 4 END AS n_tags,
    k % 5 = 0 AS cached, k % 3 AS retries, CASE WHEN k % 5 <> 0 THEN 1 ELSE 0 END AS model_calls,
    CAST(100 * k AS BIGINT) AS input_tokens, CAST(10 * k AS BIGINT) AS output_tokens,
    ['alpha-mini-20250101', 'alpha-20250101', 'local-x'][user_id % 3 + 1] AS model_id,
    [200, 429, 503, 400, 408][k % 5 + 1] AS status,
    CASE WHEN event_type = 'error' THEN 'Kind' || CAST(k % 3 AS VARCHAR) || ': detail ' || CAST(k AS VARCHAR) END AS error,
    ts
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))""",
    "requests": """
requests AS (
  SELECT doc_id AS ord,
    sha256(encode(base64(encode(text))) || '\\x00'::BLOB || encode('m1') || '\\x00'::BLOB || encode(lang)) AS key
  FROM documents),
memory AS (SELECT DISTINCT key FROM requests WHERE ord IN (SELECT doc_id FROM labels))""",
    "history": """
history AS (
  SELECT CAST(user_id AS VARCHAR) AS run_id, event_type AS image_path, ts AS created, event_id AS write_ord, value
  FROM events),
latest AS (
  SELECT * FROM history
  QUALIFY row_number() OVER (PARTITION BY run_id, image_path ORDER BY created DESC, write_ord DESC) = 1)""",
    "corpus": """
corpus AS (
  SELECT lower(p_brand) AS key, ord, p_brand || ' ' || CASE ord % 3
      WHEN 0 THEN 'Winner among ' || p_type || ' models.'
      WHEN 1 THEN 'A step towards better tools, measured twice.'
      ELSE 'Sold in many shops.' END AS found
  FROM (SELECT p_brand, min(p_partkey) AS ord, arg_min(p_type, p_partkey) AS p_type FROM part GROUP BY p_brand))""",
    "answers": """
answers AS (
  SELECT 'p' || CAST(p_partkey AS VARCHAR) AS item_id,
    '- ' || w[1] || ' - because ' || w[1] || CASE WHEN p_partkey % 5 = 0 THEN repeat(' and so on', 30) ELSE '' END || chr(10)
    || w[2] || ': seen' || chr(10) || 'Category: ' || p_type || chr(10)
    || '**Model:** ' || p_brand || chr(10)
    || CASE WHEN p_partkey % 5 = 0 THEN 'Specs: ' || repeat('very ', 90) || 'long' ELSE 'Specs: none' END || chr(10)
    || CASE WHEN p_partkey % 2 = 1 THEN '```json' || chr(10) ELSE '' END
    || '["' || w[1] || '", "' || w[2] || '"' || CASE WHEN p_partkey % 7 = 0 THEN '' ELSE ']' END
    || CASE WHEN p_partkey % 2 = 1 THEN chr(10) || '```' ELSE '' END AS text
  FROM (SELECT *, string_split(p_name, ' ') AS w FROM part)
  UNION ALL
  SELECT 'c' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR), text
  FROM conversations WHERE role = 'assistant')""",
}


def sql(body: str, *names: str) -> str:
    """A query on top of the named adapters."""
    return "WITH " + ",".join(SQL[n] for n in names) + body
