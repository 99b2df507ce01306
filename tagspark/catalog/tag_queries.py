"""Vocabulary, counts, quality, baselines and consistency."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tagspark.catalog import adapters as A
from tagspark.catalog.adapters import sql
from tagspark.catalog.registry import query
from tagspark.functions import tags as T
from tagspark.functions.text import normalise
from tagspark.operators import consistency, engagement, examples, quality, tagging
from tagspark.session import fresh_path
from tagspark.sources.vocabulary import read_vocabulary

SCORED = """
outcomes AS (
  SELECT unnest(list_distinct(list_concat(truth, {pred}))) AS tag, truth, {pred} AS pred FROM {table}),
per_tag AS (
  SELECT tag, count(*) FILTER (list_contains(truth, tag) AND list_contains(pred, tag)) AS tp,
    count(*) FILTER (NOT list_contains(truth, tag)) AS fp, count(*) FILTER (NOT list_contains(pred, tag)) AS fn
  FROM outcomes GROUP BY tag),
scored AS (
  SELECT tag, tp + fn AS support, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision,
    CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall
  FROM per_tag),
tag_scores AS (
  SELECT *, CASE WHEN precision + recall = 0 THEN 0.0
    ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM scored)"""
MICRO = """
SELECT count(*) AS n, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn,
  sum(tp) / (sum(tp) + sum(fp)) AS precision, sum(tp) / (sum(tp) + sum(fn)) AS recall,
  2 * (sum(tp) / (sum(tp) + sum(fp))) * (sum(tp) / (sum(tp) + sum(fn)))
    / (sum(tp) / (sum(tp) + sum(fp)) + sum(tp) / (sum(tp) + sum(fn))) AS micro_f1
FROM (SELECT len(list_intersect(truth, {pred})) AS tp,
  len(list_filter(list_distinct({pred}), lambda x: NOT list_contains(truth, x))) AS fp,
  len(list_filter(list_distinct(truth), lambda x: NOT list_contains({pred}, x))) AS fn FROM {table})"""


def _eval(spark, sf_dir):
    return A.tagged(spark, sf_dir).select("ord", "path", "truth", F.col("pred").alias("predicted"))


@query(sql("""
, norm AS (SELECT t.ord, unnest(truth) AS tag, TRY_CAST(views AS DOUBLE) AS v
  FROM tagged t JOIN metadata m USING (ord) WHERE TRY_CAST(views AS DOUBLE) IS NOT NULL)
SELECT tag, count(*) AS images, sum(v) / count(*) AS mean, median(v) AS median,
  (sum(v) / count(*)) / (SELECT avg(TRY_CAST(views AS DOUBLE)) FROM metadata) AS lift
FROM norm GROUP BY tag HAVING count(*) >= 2""", "tagged", "metadata"))
def tag_engagement(spark, sf_dir):
    rows = A.items(spark, sf_dir).select("ord", F.col("truth").alias("tags")).join(
        A.metadata(spark, sf_dir).select("ord", "views"), "ord")
    return engagement.tag_engagement(rows)


@query(sql("""
SELECT count(*) AS rows, count(TRY_CAST(views AS DOUBLE)) AS rows_with_metric,
  avg(TRY_CAST(views AS DOUBLE)) AS overall_mean FROM metadata""", "metadata"))
def overall_metric_coverage(spark, sf_dir):
    return engagement.coverage(A.metadata(spark, sf_dir))


@query(sql("""
SELECT ord, array_to_string(kept, '|') AS kept, array_to_string(dropped, '|') AS dropped,
  len(kept) = 0 OR len(dropped) > len(kept) AS weak FROM checked""", "tagged", "checked"))
def validate_tags(spark, sf_dir):
    rows = tagging.validated(A.items(spark, sf_dir), A.VOCABULARY)
    return rows.select("ord", F.array_join("kept", "|").alias("kept"), F.array_join("dropped", "|").alias("dropped"),
                       T.looks_weak(F.col("kept"), F.col("dropped")).alias("weak"))


@query(sql("""
SELECT ord, array_to_string(list_filter(raw, lambda x: list_contains(
  ['widget', 'gear', 'plate', 'bolt', 'ring', 'rod'], lower(trim(x)))), '|') AS highlights FROM tagged""", "tagged"))
def highlights(spark, sf_dir):
    return A.items(spark, sf_dir).select(
        "ord", F.array_join(T.highlights(F.col("raw"), A.FAMILY), "|").alias("highlights"))


@query(sql("""
, tag AS (SELECT ord, unnest(raw) AS tag FROM tagged)
SELECT ord, tag, list_contains(['colour', 'red', 'blue', 'size', 'small', 'large', 'temperature', 'hot', 'cold', 'age',
  'old', 'new', 'object', 'widget', 'gear', 'plate', 'bolt', 'ring', 'rod'], lower(trim(tag))) AS known
FROM tag""", "tagged"))
def vocabulary_membership(spark, sf_dir):
    terms = spark.createDataFrame([(t,) for t in A.VOCABULARY], "tag string")
    rows = A.items(spark, sf_dir).select("ord", F.explode("raw").alias("tag"))
    return (tagging.in_vocabulary(rows, terms).withColumn("known", F.lit(True))
            .unionByName(tagging.in_vocabulary(rows, terms, keep=False).withColumn("known", F.lit(False))))


@query(sql("""
SELECT count(*) AS rows, count(*) FILTER (len(dropped) > 0) AS rows_with_drops,
  CAST(sum(len(dropped)) AS BIGINT) AS dropped_tags, CAST(sum(len(raw)) AS BIGINT) AS raw_tags,
  sum(len(dropped)) / sum(len(raw)) AS dropped_share FROM checked""", "tagged", "checked"))
def oov_rate(spark, sf_dir):
    return tagging.drift(tagging.validated(A.items(spark, sf_dir), A.VOCABULARY))


@query(sql("SELECT tag, count(*) AS n FROM (SELECT unnest(dropped) AS tag FROM checked) GROUP BY tag",
           "tagged", "checked"))
def oov_tags(spark, sf_dir):
    return tagging.dropped_counts(tagging.validated(A.items(spark, sf_dir), A.VOCABULARY)).select("tag", "n")


COUNTED = """
, flat AS (SELECT ord, unnest(range(len(truth))) AS pos, unnest(truth) AS tag FROM tagged),
counts AS (SELECT tag, count(*) AS n, min(ord * 1000 + pos) AS first_place FROM flat GROUP BY tag)"""


@query(sql(COUNTED + " SELECT tag, n, first_place FROM counts", "tagged"))
def tag_counts(spark, sf_dir):
    counts = tagging.ranked(tagging.tag_counts(A.items(spark, sf_dir), "truth"))
    ordinal, position = tagging.place_parts(F.col("first_seen"))
    return counts.select("tag", "n", (ordinal * 1000 + position).alias("first_place"))


@query(sql(COUNTED + " SELECT tag, n FROM counts ORDER BY n DESC, first_place LIMIT 5", "tagged"))
def top_k_tags(spark, sf_dir):
    return tagging.top_tags(A.items(spark, sf_dir), 5, "truth").select("tag", "n")


@query(sql("""
SELECT CAST(list_sort(list(len(truth)))[count(*) // 2 + 1] AS INTEGER) AS median_size FROM judged""", "judged"))
def median_label_size(spark, sf_dir):
    return tagging.median_label_size(A.judged(spark, sf_dir), "truth")


@query(sql(MICRO.format(pred="pred", table="tagged"), "tagged"))
def micro_f1(spark, sf_dir):
    return quality.micro_scores(_eval(spark, sf_dir))


@query(sql(MICRO.format(pred="predicted", table="judged"), "judged"))
def micro_f1_labels(spark, sf_dir):
    return quality.micro_scores(A.judged(spark, sf_dir))


@query(sql("," + SCORED.format(pred="pred", table="tagged") +
           "SELECT tag, support, precision, recall, f1 FROM tag_scores", "tagged"))
def per_tag_f1(spark, sf_dir):
    return quality.per_tag_scores(_eval(spark, sf_dir))


@query(sql("," + SCORED.format(pred="predicted", table="judged") +
           "SELECT tag, support, precision, recall, f1 FROM tag_scores", "judged"))
def per_tag_f1_labels(spark, sf_dir):
    return quality.per_tag_scores(A.judged(spark, sf_dir))


@query(sql("," + SCORED.format(pred="pred", table="tagged") +
           "SELECT count(*) AS tags, avg(f1) AS macro_f1 FROM tag_scores", "tagged"))
def macro_f1(spark, sf_dir):
    return quality.macro_f1(_eval(spark, sf_dir))


@query(sql("SELECT ord, list_sort(list_distinct(truth)) = list_sort(list_distinct(pred)) AS exact FROM tagged",
           "tagged"))
def exact_match(spark, sf_dir):
    return quality.exact_matches(_eval(spark, sf_dir)).select("ord", "exact")


@query(sql("""
, named AS (SELECT ord, truth, pred, unnest(list_distinct(truth || pred)) AS tag FROM tagged)
SELECT ord, tag, list_contains(truth, tag) AS in_truth, list_contains(pred, tag) AS in_predicted FROM named""", "tagged"))
def tag_matches(spark, sf_dir):
    rows = A.tagged(spark, sf_dir)
    return quality.matches(rows.select("ord", F.col("truth").alias("tags")),
                           rows.select("ord", F.col("pred").alias("tags")), item="ord")


BASELINES = """
, flat AS (SELECT ord, unnest(range(len(truth))) AS pos, unnest(truth) AS tag FROM judged),
counts AS (SELECT tag, count(*) AS n, min(ord * 1000 + pos) AS place FROM flat GROUP BY tag),
ordered AS (SELECT tag, row_number() OVER (ORDER BY n DESC, place) AS r FROM counts),
size AS (SELECT list_sort(list(len(truth)))[count(*) // 2 + 1] AS k FROM judged),
sets AS (
  SELECT 'agent' AS name, truth, predicted AS pred FROM judged
  UNION ALL SELECT (SELECT 'constant (' || string_agg(tag, ', ' ORDER BY r) || ')' FROM ordered WHERE r <= 1), truth,
    (SELECT list(tag ORDER BY r) FROM ordered WHERE r <= 1) FROM judged
  UNION ALL SELECT (SELECT 'prior top-' || count(*) || ' (' || string_agg(tag, ', ' ORDER BY r) || ')'
      FROM ordered, size WHERE r <= k), truth,
    (SELECT list(tag ORDER BY r) FROM ordered, size WHERE r <= k) FROM judged),
marks AS (SELECT name, unnest(list_distinct(list_concat(truth, pred))) AS tag, truth, pred FROM sets),
sums AS (
  SELECT name, tag, count(*) FILTER (list_contains(truth, tag) AND list_contains(pred, tag)) AS tp,
    count(*) FILTER (NOT list_contains(truth, tag)) AS fp, count(*) FILTER (NOT list_contains(pred, tag)) AS fn
  FROM marks GROUP BY name, tag),
f AS (SELECT name, tp, fp, fn, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS p,
  CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS r FROM sums),
pooled AS (
  SELECT name, avg(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END) AS macro_f1,
    sum(tp) / (sum(tp) + sum(fp)) AS mp, sum(tp) / (sum(tp) + sum(fn)) AS mr FROM f GROUP BY name),
scores AS (SELECT name, 2 * mp * mr / (mp + mr) AS micro_f1, macro_f1 FROM pooled)"""


@query(sql(BASELINES + "SELECT name, micro_f1, macro_f1 FROM scores", "judged"))
def baseline_comparison(spark, sf_dir):
    return quality.compare_baselines(A.judged(spark, sf_dir))


@query(sql(BASELINES + """
, v AS (SELECT max(micro_f1) FILTER (name = 'agent') AS micro_f1, max(macro_f1) FILTER (name = 'agent') AS macro_f1,
  coalesce(max(micro_f1) FILTER (name <> 'agent'), 0.0) AS best_baseline FROM scores)
SELECT *, micro_f1 > best_baseline AS beats_baseline, micro_f1 >= 0.75 AS micro_target_met,
  macro_f1 >= 0.4 AS macro_target_met FROM v""", "judged"))
def baseline_verdict(spark, sf_dir):
    return quality.verdict(quality.compare_baselines(A.judged(spark, sf_dir)))


@query(sql("""
SELECT string_split(error, ':')[1] AS kind, count(*) AS n FROM actions WHERE error IS NOT NULL GROUP BY 1""",
           "actions"))
def failure_kinds(spark, sf_dir):
    return quality.failure_kinds(A.actions(spark, sf_dir), order="task_id")


@query(sql("""
SELECT string_split(error, ':')[1] AS kind, row_number() OVER (ORDER BY count(*) DESC, min(task_id)) AS rank
FROM actions WHERE error IS NOT NULL GROUP BY 1""", "actions"))
def failure_ranking(spark, sf_dir):
    """Kinds of errors in their order; there are as many rows as kinds."""
    kinds = quality.failure_kinds(A.actions(spark, sf_dir), order="task_id").withColumn("_at", F.monotonically_increasing_id())
    return kinds.select("kind", F.row_number().over(Window.orderBy("_at")).cast("bigint").alias("rank"))


@query("""
WITH w AS (SELECT p_type AS general, p_brand AS tag FROM part),
own AS (SELECT DISTINCT general, general AS tag FROM w UNION SELECT DISTINCT general, tag FROM w)
SELECT general, tag FROM own
UNION ALL SELECT NULL, c FROM (SELECT DISTINCT c_mktsegment AS c FROM customer) WHERE c NOT IN (SELECT tag FROM own)""")
def vocabulary_file(spark, sf_dir):
    """A taxonomy of types and brands with market segments as extras, written as a vocabulary file and read back."""
    path = fresh_path(spark, "vocabulary")
    groups = A.table(spark, sf_dir, "part").groupBy("p_type").agg(F.collect_set("p_brand").alias("specifics"))
    book = groups.agg(F.map_from_entries(F.collect_list(F.struct("p_type", "specifics"))).alias("taxonomy"))
    extra = A.table(spark, sf_dir, "customer").agg(F.collect_set("c_mktsegment").alias("observed_extra"))
    book.withColumn("observed_extra", extra.scalar()).write.json(path)
    return read_vocabulary(spark, path)


@query(sql("""
SELECT count(error) AS failed, count(*) AS rows, arg_min(error, task_id) FILTER (error IS NOT NULL) AS first_error
FROM actions""", "actions"))
def failure_summary(spark, sf_dir):
    return quality.failure_summary(A.actions(spark, sf_dir), order="task_id")


COMPARED = """
, second AS (SELECT path, pred AS second FROM tagged
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY ord DESC) = 1),
compared AS (
  SELECT t.ord, string_split(path, '/')[-1] AS image, truth AS first, second,
    CASE WHEN len(truth) + len(second) = 0 THEN 1.0 ELSE
      len(list_intersect(truth, second)) / len(list_distinct(list_concat(truth, second))) END AS agreement
  FROM tagged t JOIN second USING (path))"""


def _compared(spark, sf_dir):
    rows = A.tagged(spark, sf_dir)
    return consistency.compare_passes(
        rows.select("ord", "path", F.col("truth").alias("tags")),
        rows.select("ord", "path", F.col("pred").alias("tags")))


@query(sql(COMPARED + """
SELECT ord, image, array_to_string(first, '|') AS first, array_to_string(second, '|') AS second, agreement
FROM compared""", "tagged"))
def consistency_rows(spark, sf_dir):
    return _compared(spark, sf_dir).select(
        "ord", "image", F.array_join("first", "|").alias("first"), F.array_join("second", "|").alias("second"), "agreement")


@query(sql(COMPARED + """
SELECT count(*) AS images, avg(agreement) AS mean_agreement, count(*) FILTER (agreement < 0.7) AS unstable
FROM compared""", "tagged"))
def consistency_summary(spark, sf_dir):
    return consistency.summary(_compared(spark, sf_dir))


@query(sql(COMPARED + "SELECT ord, image, agreement FROM compared WHERE agreement < 0.7", "tagged"))
def unstable_rows(spark, sf_dir):
    return consistency.unstable(_compared(spark, sf_dir)).select("ord", "image", "agreement")


@query(sql(COMPARED + """
SELECT ord, image, agreement FROM compared WHERE agreement < 0.7 ORDER BY agreement, ord LIMIT 5""", "tagged"))
def unstable_top5(spark, sf_dir):
    return consistency.unstable(_compared(spark, sf_dir), worst=5).select("ord", "image", "agreement")


@query(sql("""
SELECT ord, len(list_intersect(truth, pred)) AS shared,
  len(list_filter(list_distinct(pred), lambda x: NOT list_contains(truth, x))) AS spurious,
  len(list_filter(list_distinct(truth), lambda x: NOT list_contains(pred, x))) AS missed,
  len(list_distinct(list_concat(truth, pred))) AS either FROM tagged""", "tagged"))
def set_algebra(spark, sf_dir):
    truth, pred = F.col("truth"), F.col("pred")
    size = lambda c: F.size(c).cast("bigint")
    return A.tagged(spark, sf_dir).select(
        "ord", size(F.array_intersect(truth, pred)).alias("shared"), size(F.array_except(pred, truth)).alias("spurious"),
        size(F.array_except(truth, pred)).alias("missed"), size(F.array_union(truth, pred)).alias("either"))


@query(sql("SELECT ord, array_to_string(list_transform(raw, lambda x: lower(trim(x))), '|') AS tags FROM tagged",
           "tagged"))
def normalised_tags(spark, sf_dir):
    return A.items(spark, sf_dir).select(
        "ord", F.array_join(F.transform("raw", normalise), "|").alias("tags"))


@query(sql("""
, lab AS (SELECT * FROM judged WHERE len(truth) > 0),
ranked AS (SELECT *, row_number() OVER (ORDER BY path) AS r FROM lab),
pool AS (SELECT * FROM ranked WHERE r <= 4),
pairs AS (SELECT l.path, p.path || '=' || array_to_string(p.truth, '+') AS ex,
    row_number() OVER (PARTITION BY l.path ORDER BY p.path) AS k
  FROM judged l JOIN pool p ON p.path <> l.path)
SELECT path, string_agg(ex, ' ' ORDER BY k) AS examples FROM pairs WHERE k <= 3 GROUP BY path""", "judged"))
def leave_one_out_examples(spark, sf_dir):
    rows = A.judged(spark, sf_dir)
    shown = examples.leave_one_out(rows, rows.filter(F.size("truth") > 0), 3)
    text = F.transform("examples", lambda e: F.concat(e["path"], F.lit("="), F.array_join(e["tags"], "+")))
    return shown.select("path", F.array_join(text, " ").alias("examples"))


@query(sql("""
SELECT path, array_to_string(truth, '+') AS tags FROM judged WHERE len(truth) > 0 ORDER BY path LIMIT 8""", "judged"))
def first_examples(spark, sf_dir):
    return examples.draw(A.judged(spark, sf_dir).filter(F.size("truth") > 0), 8).select(
        "path", F.array_join("truth", "+").alias("tags"))


@query(sql("""
SELECT path, array_to_string(truth, '+') AS tags FROM judged WHERE len(truth) > 0
ORDER BY sha256(encode('17') || '\\x00'::BLOB || encode(path)), path LIMIT 8""", "judged"))
def seeded_draw(spark, sf_dir):
    return examples.draw(A.judged(spark, sf_dir).filter(F.size("truth") > 0), 8, seed=17).select(
        "path", F.array_join("truth", "+").alias("tags"))
