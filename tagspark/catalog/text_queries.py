"""Raw answers, evidence, paths, prompts and the tagging job."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagspark.catalog import adapters as A
from tagspark.catalog.adapters import sql
from tagspark.catalog.registry import query
from tagspark.catalog.replay import BREAK, FollowingScorer, RefusingScorer, ReplayScorer
from tagspark.functions import answers, paths
from tagspark.functions.tags import feedback
from tagspark.operators import evidence, keywords, runs
from tagspark.operators.consistency import summary
from tagspark.operators.examples import draw_pool
from tagspark.operators.tagging import validated
from tagspark.plans.answer_job import parse_answers as parse_all
from tagspark.plans.evidence_job import proposals
from tagspark.plans.prompts import Wording, prompt
from tagspark.plans.reports import evaluate, stability
from tagspark.plans.tagging_job import tag_items, to_results, to_tasks
from tagspark.session import fresh_path, written
from tagspark.sources.memory_table import MemoryTable


def _pairs(entries):
    return F.array_join(F.array_sort(F.transform(
        F.map_entries(entries), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|")


# The shapes of a reason line and a detail line, written for RE2.
REASON = r"'^\s*(?:[-*•]\s*)?(?:\d+[.)]\s*)?([A-Za-z][A-Za-z &'']{1,30}?)\s*[-–:]\s+(\S.*)$'"
DETAIL = r"'^\s*\**\s*(category|model|description|specs)\s*\**\s*:\s*(\S.*)$'"
TAGS_SQL = r"""
, spans AS (SELECT item_id, regexp_extract(regexp_replace(text, '```(json)?', '', 'g'), '\[.*?\]', 0, 's') AS span
  FROM answers),
read AS (SELECT item_id, CASE WHEN span <> '' AND json_valid(span) THEN from_json(span, '["VARCHAR"]') ELSE [] END AS tags
  FROM spans)"""
LINES = """
, split AS (SELECT item_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i
  FROM answers)"""
REASONS_SQL = LINES + rf"""
, hits AS (SELECT item_id, i, lower(trim(regexp_replace(regexp_extract(line, {REASON}, 1), '\s+', ' ', 'g'))) AS tag,
    rtrim(trim(regexp_extract(line, {REASON}, 2)), '.') AS why
  FROM split WHERE NOT starts_with(ltrim(line), '[')),
own AS (SELECT item_id, i, tag, why FROM hits WHERE tag <> '' AND tag NOT IN ('category', 'model', 'description', 'specs')),
nested AS (SELECT item_id, i + 0.5 AS i, lower(trim(regexp_extract(why, {REASON}, 1))) AS tag,
    rtrim(trim(regexp_extract(why, {REASON}, 2)), '.') AS why FROM own),
every AS (SELECT * FROM own UNION ALL SELECT * FROM nested WHERE tag IN ('colour', 'red', 'blue', 'size', 'small', 'large',
  'temperature', 'hot', 'cold', 'age', 'old', 'new', 'object', 'widget', 'gear', 'plate', 'bolt', 'ring', 'rod')),
firsts AS (SELECT item_id, tag, arg_min(why, i) AS why FROM every GROUP BY item_id, tag)"""


@query(sql(TAGS_SQL + "SELECT item_id, len(tags) AS n, array_to_string(tags, '|') AS tags FROM read", "answers"))
def parse_answers(spark, sf_dir):
    read = parse_all(A.answers(spark, sf_dir), A.VOCABULARY, fields=["tags"])
    return read.select("item_id", F.size("prediction.tags").cast("bigint").alias("n"),
                       F.array_join("prediction.tags", "|").alias("tags"))


@query(sql(REASONS_SQL + r"""
SELECT a.item_id, coalesce(string_agg(tag || '=' || why, '|' ORDER BY tag || '=' || why), '') AS reasons
FROM answers a LEFT JOIN firsts f ON f.item_id = a.item_id GROUP BY a.item_id""", "answers"))
def parse_reasons(spark, sf_dir):
    return A.answers(spark, sf_dir).select(
        "item_id", _pairs(answers.reasons(F.col("text"), A.VOCABULARY)).alias("reasons"))


@query(sql(LINES + rf"""
, hits AS (SELECT item_id, i, lower(regexp_extract(line, {DETAIL}, 1, 'i')) AS label,
    trim(trim(trim(regexp_extract(line, {DETAIL}, 2, 'i')), '*')) AS value FROM split),
facts AS (SELECT item_id, label, arg_min(value, i) AS value FROM hits WHERE label <> ''
  AND rtrim(lower(value), '.') NOT IN ('unknown', 'none', 'n/a', 'na', 'not shown', 'not visible', '-')
  GROUP BY item_id, label)
SELECT a.item_id, max(value) FILTER (label = 'category') AS category, max(value) FILTER (label = 'model') AS model,
  max(value) FILTER (label = 'description') AS description, max(value) FILTER (label = 'specs') AS specs
FROM answers a LEFT JOIN facts f ON f.item_id = a.item_id GROUP BY a.item_id""", "answers"))
def parse_details(spark, sf_dir):
    return (A.answers(spark, sf_dir).select("item_id", answers.details(F.col("text")).alias("d"))
            .select("item_id", "d.category", "d.model", "d.description", "d.specs"))


def _rule(tag: str) -> str:
    words = "|".join(A.LICENCE_RULES[tag])
    return f"bool_or(regexp_matches(lower(text), '(^|[^a-z0-9_])({words})'))"


@query(f"""
WITH earned AS (SELECT source AS entity, {_rule('licence')} AS a, {_rule('permissive')} AS b, {_rule('copyleft')} AS c
  FROM documents GROUP BY source)
SELECT entity, array_to_string(list_filter([CASE WHEN a THEN 'licence' END, CASE WHEN b THEN 'permissive' END,
  CASE WHEN c THEN 'copyleft' END], lambda x: x IS NOT NULL), '|') AS tags FROM earned""")
def evidence_tags(spark, sf_dir):
    return evidence.tags_by_entity(A.evidence(spark, sf_dir), rules=A.LICENCE_RULES).select(
        "entity", F.array_join("tags", "|").alias("tags"))


WORDS = "SELECT unnest(string_split(p_name, ' ')) AS word, p_partkey FROM part UNION ALL SELECT lower(p_type), p_partkey FROM part"


@query(f"""
WITH words AS (SELECT word AS key, min(p_partkey) AS ord FROM ({WORDS}) GROUP BY word)
SELECT c.doc_id, arg_min(key, (ord, key)) AS key FROM documents c LEFT JOIN words ON contains(lower(c.text), key) GROUP BY c.doc_id""")
def first_keywords(spark, sf_dir):
    """The first of all words of part names and types, in the order of parts, that a document holds."""
    part = A.table(spark, sf_dir, "part")
    words = (part.select(F.explode(F.split("p_name", " ")).alias("key"), F.col("p_partkey").alias("ord"))
             .unionByName(part.select(F.lower("p_type").alias("key"), F.col("p_partkey").alias("ord")))
             .groupBy("key").agg(F.min("ord").alias("ord")))
    docs = A.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("query"))
    return keywords.first_keyword(docs, words, keep=["doc_id"])


@query(f"""
WITH earned AS (SELECT source AS entity, {_rule('licence')} AS a, {_rule('permissive')} AS b, {_rule('copyleft')} AS c
  FROM documents GROUP BY source)
SELECT entity, array_to_string(list_filter([CASE WHEN a THEN 'licence' END, CASE WHEN b THEN 'permissive' END,
  CASE WHEN c THEN 'copyleft' END], lambda x: x IS NOT NULL), '|') AS tags FROM earned""")
def evidence_keywords(spark, sf_dir):
    """The tags of `evidence_tags`, by one pass for the keywords of all rules."""
    return evidence.tags_by_keywords(A.evidence(spark, sf_dir), rules=A.LICENCE_RULES).select(
        "entity", F.array_join("tags", "|").alias("tags"))


FOUND = """
, contexts AS (SELECT DISTINCT 'Category: ' || category || ', Model: ' || product AS context, category, product FROM tagged),
asked AS (SELECT context, lower(category || '   ' || product) AS q FROM contexts),
found AS (SELECT context, arg_min(found, ord) AS found FROM asked JOIN corpus ON contains(q, key) GROUP BY context)"""


@query(sql(FOUND + """
SELECT c.context, f.found FROM contexts c LEFT JOIN found f USING (context)""", "tagged", "corpus"))
def evidence_lookup(spark, sf_dir):
    asked = _contexts(spark, sf_dir).withColumn("query", paths.lookup_query(F.col("context")))
    found = evidence.find_evidence(asked.select("query").distinct(), A.corpus(spark, sf_dir))
    first = F.get("results", F.lit(0))
    return asked.join(found, "query").select("context", F.concat(first["title"], F.lit(" "), first["snippet"]).alias("found"))


@query(sql(FOUND + """
SELECT c.context, concat_ws('|', CASE WHEN regexp_matches(lower(f.found), '(^|\\W)winner') THEN 'awards' END,
  CASE WHEN regexp_matches(lower(f.found), '(^|\\W)measured') THEN 'benchmark' END) AS proposed
FROM contexts c LEFT JOIN found f USING (context)""", "tagged", "corpus"))
def evidence_proposals(spark, sf_dir):
    return proposals(_contexts(spark, sf_dir), A.corpus(spark, sf_dir)).select(
        "context", F.array_join("proposed", "|").alias("proposed"))


def _contexts(spark, sf_dir):
    return A.items(spark, sf_dir).select(
        paths.context_from_path(F.col("path"), A.CATEGORIES).alias("context")).distinct()


@query(sql("SELECT ord, 'Category: ' || category || ', Model: ' || product AS context FROM tagged", "tagged"))
def context_from_path(spark, sf_dir):
    return A.items(spark, sf_dir).select("ord", paths.context_from_path(F.col("path"), A.CATEGORIES).alias("context"))


@query(sql("SELECT ord, category, product AS model FROM tagged", "tagged"))
def split_context(spark, sf_dir):
    written_out = F.concat(F.lit("Category: old, category:  "), "category", F.lit(" , MODEL: "), "product")
    return A.items(spark, sf_dir).select("ord", paths.split_context(written_out).alias("c")).select(
        "ord", "c.category", "c.model")


@query(sql("""
SELECT ord, category || '   ' || product || ': has it won any awards, what do benchmark or lab test results say, '
  || 'and what is its energy rating?' AS query FROM tagged""", "tagged"))
def lookup_queries(spark, sf_dir):
    context = paths.context_from_path(F.col("path"), A.CATEGORIES)
    return A.items(spark, sf_dir).select("ord", paths.lookup_query(context).alias("query"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE p_size END AS position FROM part")
def carousel_position(spark, sf_dir):
    size = F.col("p_size").cast("string")
    name = F.concat(F.lit("shots/"), F.regexp_replace("p_name", " ", "-"),
                    F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("_100"), size)).otherwise(
                        F.concat(F.lit("_"), size, F.lit("_99"))), F.lit(".jpg"))
    return A.table(spark, sf_dir, "part").select("p_partkey", paths.carousel_position(name).alias("position"))


@query(sql("""
SELECT ord, CASE WHEN len(dropped) = 0
  THEN 'The last answer held no usable tag. Look once more and name at least one vocabulary tag.'
  ELSE 'The last answer named ' || array_to_string(list_transform(dropped, lambda x: '''' || x || ''''), ', ')
    || ', which the vocabulary does not hold. ' || CASE WHEN len(kept) > 0
      THEN 'Valid tags kept: ' || CAST(len(kept) AS VARCHAR) || '.' ELSE 'No valid tag was left.' END
    || ' Answer again with vocabulary tags only, spelled as listed.' END AS feedback FROM checked""", "tagged", "checked"))
def feedback_text(spark, sf_dir):
    rows = validated(A.items(spark, sf_dir), A.VOCABULARY)
    return rows.select("ord", feedback(F.col("dropped"), F.col("kept")).alias("feedback"))


@query(sql("""
SELECT ord, 'Tag it.' || chr(10) || 'Product context: Category: ' || category || ', Model: ' || product || '.' || chr(10) || chr(10)
  || 'Controlled vocabulary:' || chr(10) || '- colour: red, blue' || chr(10) || chr(10) || 'As JSON.'
  || CASE WHEN ord % 2 = 0 THEN chr(10) || chr(10) || 'again' ELSE '' END AS prompt FROM tagged""", "tagged"))
def prompt_text(spark, sf_dir):
    context = paths.context_from_path(F.col("path"), A.CATEGORIES)
    again = F.when(F.col("ord") % 2 == 0, "again").otherwise("")
    return A.items(spark, sf_dir).select("ord", prompt(
        context, again, wording=Wording("Tag it.", "As JSON.", ""), vocabulary="- colour: red, blue").alias("prompt"))


def _items(spark, sf_dir):
    """Items whose bytes hold the answers they get; many are exact copies.

    By size: 0 mod 11 fails, 0 mod 7 first answers without an array, 0 mod 5
    first answers with more unknown tags than known ones.
    """
    first, second = F.get(F.split("p_name", " "), F.lit(0)), F.get(F.split("p_name", " "), F.lit(1))
    size = F.col("p_size")
    listed = F.concat(F.lit('["'), first, F.lit('", "'), second, F.lit('"]'))
    one = (F.when(size % 11 == 0, "FAIL").when(size % 7 == 0, "I see nothing I know.")
           .when(size % 5 == 0, F.concat(F.lit('["shiny", "glossy", "'), first, F.lit('"]')))
           .otherwise(F.concat(first, F.lit(" - seen\nModel: read off\n"), listed)))
    two = F.concat(first, F.lit(" - on a second look\n"), listed)
    path = F.concat(F.lit("catalog/"), "p_type", F.lit("/"), F.lpad(F.col("p_partkey").cast("string"), 8, "0"), F.lit(".jpg"))
    return A.table(spark, sf_dir, "part").select(
        path.alias("path"), F.concat(one, F.lit(BREAK), two).cast("binary").alias("content"),
        F.split("p_name", " ").alias("truth"))


ITEMS = f"""
WITH items AS (
  SELECT 'catalog/' || p_type || '/' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') || '.jpg' AS path, p_type AS category,
    w[1] AS a, w[2] AS b, p_size AS s, list_filter(w, lambda x: list_contains({A.VOCABULARY}, x)) AS known,
    p_size % 11 <> 0 AND (p_size % 7 = 0 OR p_size % 5 = 0) AS again, p_size % 11 = 0 AS failed, w AS truth,
    CASE WHEN p_size % 11 = 0 THEN 0 WHEN p_size % 7 = 0 THEN 1 WHEN p_size % 5 = 0 THEN 2 ELSE 3 END AS kind
  FROM (SELECT *, string_split(p_name, ' ') AS w FROM part)),
final AS (
  SELECT path, category, kind, a, b, again, failed, truth, CASE WHEN failed THEN [] ELSE known END AS tags,
    CASE WHEN failed OR NOT list_contains(known, a) THEN '' WHEN again THEN a || '=on a second look' ELSE a || '=seen' END AS rationale,
    CASE WHEN failed OR again THEN '' ELSE 'read off' END AS product,
    CASE WHEN failed THEN 1 WHEN again THEN 2 ELSE 1 END AS attempts,
    CASE WHEN failed THEN 'RuntimeError: no answer' END AS error FROM items)"""
FAMILY_SQL = "list_filter(tags, lambda x: list_contains(['widget', 'gear', 'plate', 'bolt', 'ring', 'rod'], x))"


def _shown(rows):
    return rows.select(
        "path", F.array_join("tags", "|").alias("tags"), F.array_join("highlights", "|").alias("highlights"),
        _pairs("rationale").alias("rationale"), "category", "product", "attempts", "cached", "error")


OPTIONS = {"model_id": "alpha-mini-1", "vocabulary": A.VOCABULARY, "highlight_family": A.FAMILY,
           "known_folders": A.CATEGORIES}


@query(ITEMS + f"""
SELECT path, array_to_string(tags, '|') AS tags, array_to_string({FAMILY_SQL}, '|') AS highlights, rationale, category,
  product, attempts, false AS cached, error FROM final""")
def two_pass_tagging(spark, sf_dir):
    return _shown(tag_items(_items(spark, sf_dir), ReplayScorer, **OPTIONS).rows)


@query(ITEMS + f"""
, first AS (SELECT *, row_number() OVER (PARTITION BY category, a, b, kind ORDER BY path) AS r FROM final)
SELECT path, array_to_string(tags, '|') AS tags, array_to_string({FAMILY_SQL}, '|') AS highlights, rationale, category,
  product, CASE WHEN r > 1 AND NOT failed THEN 0 ELSE attempts END AS attempts, r > 1 AND NOT failed AS cached, error
FROM first""")
def tagging_with_memory(spark, sf_dir):
    """An empty memory: copies inside the batch share one request."""
    empty = spark.createDataFrame([], "key string, tags array<string>, rationale map<string,string>, "
                                  "details struct<category:string,product:string,description:string,specs:string>")
    return _shown(tag_items(_items(spark, sf_dir), ReplayScorer, memory=empty, **OPTIONS).rows)


@query(ITEMS + """
SELECT path, array_to_string(tags, '|') AS tags, CASE WHEN failed THEN 1 ELSE 0 END AS attempts, NOT failed AS cached
FROM final""")
def tagging_again(spark, sf_dir):
    """A second run over the memory the first one left: only failures are asked again."""
    empty = spark.createDataFrame([], "key string, tags array<string>, rationale map<string,string>, "
                                  "details struct<category:string,product:string,description:string,specs:string>")
    items = _items(spark, sf_dir)
    left = written(tag_items(items, ReplayScorer, memory=empty, **OPTIONS).memory_rows, "memory")
    again = tag_items(items, ReplayScorer, memory=left, **OPTIONS)
    return again.rows.select("path", F.array_join("tags", "|").alias("tags"), "attempts", "cached")


@query(ITEMS + """
SELECT path, array_to_string(tags, '|') AS tags, CASE WHEN failed THEN 1 ELSE 0 END AS attempts, NOT failed AS cached
FROM final""")
def tagging_from_table(spark, sf_dir):
    """A second run over a memory table, into which the first run's answers were put."""
    table = MemoryTable(spark, fresh_path(spark, "memory"))
    items = _items(spark, sf_dir)
    table.put(tag_items(items, ReplayScorer, memory=table, **OPTIONS).memory_rows)
    again = tag_items(items, ReplayScorer, memory=table, **OPTIONS)
    return again.rows.select("path", F.array_join("tags", "|").alias("tags"), "attempts", "cached")


@query(ITEMS + """
SELECT count(*) AS tasks, count(*) FILTER (len(tags) > 0) AS successes, count(*) FILTER (failed) AS failures,
  0 AS cache_hits, CAST(sum(attempts) AS BIGINT) AS model_calls FROM final""")
def tagging_counters(spark, sf_dir):
    run = tag_items(_items(spark, sf_dir), ReplayScorer, **OPTIONS)
    return runs.workflow_counters(to_tasks(run), "run_id").select(
        "tasks", "successes", "failures", F.col("cache_hits").cast("int").alias("cache_hits"), "model_calls")


@query(ITEMS + """
, s AS (SELECT len(list_filter(tags, lambda x: list_contains(truth, x))) AS tp,
  len(list_filter(tags, lambda x: NOT list_contains(truth, x))) AS fp,
  len(list_filter(truth, lambda x: NOT list_contains(tags, x))) AS fn FROM final),
f AS (SELECT t.tag, count(*) FILTER (list_contains(tags, t.tag)) AS tp, count(*) FILTER (NOT list_contains(tags, t.tag)) AS fn
  FROM (SELECT unnest(truth) AS tag, tags FROM final) t GROUP BY t.tag)
SELECT (SELECT count(*) FROM s) AS n, (SELECT 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) FROM s) AS micro_f1,
  (SELECT avg(2 * tp / (2 * tp + fn)) FROM f) AS macro_f1""")
def evaluation_job(spark, sf_dir):
    report = evaluate(_items(spark, sf_dir), ReplayScorer, few_shot=3, **OPTIONS)
    return report.metrics


def _followed(spark, sf_dir):
    path = F.concat(F.lit("catalog/"), "p_type", F.lit("/"), F.lpad(F.col("p_partkey").cast("string"), 8, "0"), F.lit(".jpg"))
    return A.table(spark, sf_dir, "part").select(
        path.alias("path"), F.col("p_name").cast("binary").alias("content"), F.split("p_name", " ").alias("truth"))


FOLLOWED = f"""
WITH items AS (
  SELECT 'catalog/' || p_type || '/' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') || '.jpg' AS path, string_split(p_name, ' ') AS w
  FROM part),
one AS (SELECT list(path ORDER BY path) AS paths, list(w[-1] ORDER BY path) AS tags
  FROM (SELECT * FROM items ORDER BY path LIMIT 3)),
two AS (SELECT list(path ORDER BY k, path) AS paths, list(w[-1] ORDER BY k, path) AS tags
  FROM (SELECT *, sha256(encode('17') || '\\x00'::BLOB || encode(path)) AS k FROM items ORDER BY k, path LIMIT 3)),
answers AS (
  SELECT i.path, len(w) AS words,
    list_distinct([x FOR x IN [w[1], CASE WHEN one.paths[1] = i.path THEN one.tags[2] ELSE one.tags[1] END]
      IF list_contains({A.VOCABULARY}, x)]) AS a,
    list_distinct([x FOR x IN [w[1], CASE WHEN two.paths[1] = i.path THEN two.tags[2] ELSE two.tags[1] END]
      IF list_contains({A.VOCABULARY}, x)]) AS b
  FROM items i, one, two),
agreed AS (SELECT *, CASE WHEN len(a) + len(b) = 0 THEN 1.0
    ELSE len(list_intersect(a, b)) / len(list_distinct(a || b)) END AS agreement FROM answers)"""


@query(FOLLOWED + """
SELECT count(*) AS images, avg(agreement) AS mean_agreement, count(*) FILTER (agreement < 0.7) AS unstable FROM agreed""")
def stability_job(spark, sf_dir):
    """Two runs whose examples are drawn differently, by a scorer whose answers depend on them."""
    labelled = _followed(spark, sf_dir)
    items = labelled.drop("truth")
    first = tag_items(items, FollowingScorer, pool=draw_pool(labelled, 2), **OPTIONS)
    return summary(stability(first, items, FollowingScorer, labelled=labelled, few_shot=2, **OPTIONS))


@query(FOLLOWED + """
SELECT path, array_to_string(list_sort(a), '|') AS tags, CAST(words AS BIGINT) AS retries FROM agreed""")
def tagging_with_examples(spark, sf_dir):
    """Tags of a run with examples, fingerprinted with them, and the retries its scorer reports."""
    labelled = _followed(spark, sf_dir)
    empty = spark.createDataFrame([], "key string, tags array<string>, rationale map<string,string>, "
                                  "details struct<category:string,product:string,description:string,specs:string>")
    run = tag_items(labelled.drop("truth"), FollowingScorer, pool=draw_pool(labelled, 2), memory=empty, passes=1, **OPTIONS)
    # Copies share one request, and so the retries of the one that was asked.
    asked = run.rows.join(run.calls.select("path", "retries"), "path", "left").groupBy("key").agg(F.max("retries").alias("retries"))
    return run.rows.join(asked, "key").select("path", F.array_join(F.array_sort("tags"), "|").alias("tags"), "retries")


def _refused(spark, sf_dir):
    status = F.element_at(F.array(*[F.lit(s) for s in ("200", "429", "400", "503", "200")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    path = F.concat(F.lit("catalog/"), F.lpad(F.col("p_partkey").cast("string"), 8, "0"), F.lit(".jpg"))
    return A.table(spark, sf_dir, "part").select(path.alias("path"), F.concat_ws(" ", status, "p_name").cast("binary").alias("content"))


REFUSED = f"""
WITH items AS (
  SELECT 'catalog/' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') || '.jpg' AS path, [200, 429, 400, 503, 200][p_partkey % 5 + 1] AS status,
    CASE WHEN list_contains({A.VOCABULARY}, string_split(p_name, ' ')[1]) THEN string_split(p_name, ' ')[1] ELSE '' END AS tag FROM part)"""


@query(REFUSED + """
SELECT path, CASE WHEN status = 400 THEN '' ELSE tag END AS tags, CASE WHEN status = 400 THEN 'Refused: refused' END AS error,
  CASE WHEN status = 400 THEN 0 ELSE 1 END AS attempts FROM items""")
def tagging_quarantine(spark, sf_dir):
    """A run after one in which requests were refused: those refused for good keep their error, all others are asked."""
    items = _refused(spark, sf_dir)
    left = written(tag_items(items, lambda: RefusingScorer(True), passes=1, **OPTIONS).failures, "quarantine")
    again = tag_items(items, lambda: RefusingScorer(False), passes=1, quarantine=left, **OPTIONS)
    return again.rows.select("path", F.array_join("tags", "|").alias("tags"), "error", "attempts")


@query(REFUSED + """
SELECT path, 'Refused: refused' AS error, status, status <> 400 AS transient, CASE WHEN status = 400 THEN 1 ELSE 2 END AS calls
FROM items WHERE status <> 200""")
def tagging_failures(spark, sf_dir):
    """What a run leaves in quarantine: transient failures were asked twice."""
    run = tag_items(_refused(spark, sf_dir), lambda: RefusingScorer(True), passes=2, ask_again=True, **OPTIONS)
    calls = run.calls.groupBy("path").agg(F.count(F.lit(1)).cast("int").alias("calls"))
    return run.failures.join(calls, "path").select("path", "error", "status", "transient", "calls")


@query("WITH" + A.SQL["corpus"] + f"""
, items AS (
  SELECT CASE WHEN p_partkey % 3 = 0 THEN 'upload/' ELSE 'catalog/' || p_type || '/' || p_brand || '/' END
    || lpad(CAST(p_partkey AS VARCHAR), 8, '0') || '.jpg' AS path, p_type, p_brand, string_split(p_name, ' ') AS w,
    p_partkey % 3 <> 0 AS placed FROM part),
found AS (SELECT p_type, p_brand, lower(arg_min(found, ord)) AS found FROM (SELECT DISTINCT p_type, p_brand FROM part)
  JOIN corpus ON contains(lower(p_type || '   ' || p_brand), key) GROUP BY ALL),
said AS (
  SELECT path, CASE WHEN list_contains({A.VOCABULARY}, w[1]) THEN [w[1]] ELSE [] END
    || CASE WHEN placed AND regexp_matches(found, '(^|\\W)winner') THEN ['hot'] ELSE [] END
    || CASE WHEN placed AND regexp_matches(found, '(^|\\W)measured') THEN ['cold'] ELSE [] END AS tags
  FROM items LEFT JOIN found USING (p_type, p_brand))
SELECT path, array_to_string(list_sort(list_distinct(tags)), '|') AS tags FROM said""")
def tagging_with_corpus(spark, sf_dir):
    """Tags of a run that also takes what a corpus says about an item's product; items without a context are not looked up."""
    folder = F.concat(F.lit("catalog/"), "p_type", F.lit("/"), "p_brand", F.lit("/"))
    path = F.concat(F.when(F.col("p_partkey") % 3 == 0, "upload/").otherwise(folder),
                    F.lpad(F.col("p_partkey").cast("string"), 8, "0"), F.lit(".jpg"))
    items = A.table(spark, sf_dir, "part").select(path.alias("path"), F.col("p_name").cast("binary").alias("content"))
    run = tag_items(items, FollowingScorer, corpus=A.corpus(spark, sf_dir), rules={"hot": ["winner"], "cold": ["measured"]},
                    passes=1, **OPTIONS)
    return run.rows.select("path", F.array_join(F.array_sort("tags"), "|").alias("tags"))


@query(ITEMS + f"""
SELECT path, category, '' AS model, array_to_string(tags, '|') AS tags, array_to_string({FAMILY_SQL}, '|') AS highlights FROM final""")
def projected_results(spark, sf_dir):
    """Rows of a run as saved results: category and model as the path tells them."""
    rows = to_results(tag_items(_items(spark, sf_dir), ReplayScorer, **OPTIONS).rows)
    return rows.select("path", "category", F.coalesce("model", F.lit("")).alias("model"),
                       F.array_join("tags", "|").alias("tags"), F.array_join("highlights", "|").alias("highlights"))
