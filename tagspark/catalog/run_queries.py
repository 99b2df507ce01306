"""Runs, costs, latency, memory and the results history."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagspark.catalog import adapters as A
from tagspark.catalog.adapters import sql
from tagspark.catalog.registry import query
from tagspark.functions.images import base64_text, media_type
from tagspark.functions.tags import is_transient
from tagspark.functions.text import run_id
from tagspark.operators import memory as mem
from tagspark.operators import results, runs
from tagspark.plans.reports import run_report, score_records
from tagspark.session import fresh_path, written
from tagspark.sources import records, stores
from tagspark.sources.memory_table import MemoryTable
from tagspark.sources.sheet import read_sheet


@query(sql("""
SELECT run_id, count(*) AS tasks, count(*) FILTER (n_tags > 0) AS successes,
  count(*) FILTER (n_tags > 0) / count(*) AS success_rate FROM actions GROUP BY run_id""", "actions"))
def success_rate(spark, sf_dir):
    return runs.success_rate(A.actions(spark, sf_dir), "run_id")


COUNTERS = """
count(*) AS tasks, count(*) FILTER (n_tags > 0) AS successes, count(*) FILTER (failed) AS failures,
  CAST(sum(retries) AS BIGINT) AS retries, count(*) FILTER (cached) AS cache_hits,
  CAST(sum(model_calls) AS BIGINT) AS model_calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
  CAST(sum(output_tokens) AS BIGINT) AS output_tokens"""


@query(sql(f"SELECT run_id, {COUNTERS} FROM actions GROUP BY run_id", "actions"))
def workflow_counters(spark, sf_dir):
    return runs.workflow_counters(A.actions(spark, sf_dir), "run_id")


COSTS = """
, used AS (SELECT run_id, model_id, count(*) AS tasks, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
    CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM actions GROUP BY run_id, model_id),
card(prefix, usd_in, usd_out) AS (VALUES ('alpha', 5.0::DOUBLE, 25.0::DOUBLE), ('alpha-mini', 1.0, 5.0)),
rates AS (SELECT model_id, usd_in, usd_out FROM (SELECT DISTINCT model_id FROM actions)
  LEFT JOIN card ON starts_with(model_id, prefix)
  QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY length(prefix) DESC) = 1),
costs AS (SELECT *, (input_tokens * usd_in + output_tokens * usd_out) / 1000000 AS cost_usd
  FROM used JOIN rates USING (model_id))"""


@query(sql(COSTS + """
SELECT run_id, model_id, tasks, input_tokens, output_tokens, cost_usd, cost_usd / tasks AS cost_per_task_usd
FROM costs""", "actions"))
def cost_per_task(spark, sf_dir):
    return runs.costs(A.actions(spark, sf_dir), A.prices(spark), "run_id")


@query(sql(COSTS + "SELECT * FROM rates", "actions"))
def longest_prefix_rates(spark, sf_dir):
    return runs.priced(A.actions(spark, sf_dir), A.prices(spark))


LATENCY = """
, ranked AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY ms) AS r, count(*) OVER (PARTITION BY {by}) AS n
  FROM actions)
SELECT {by}, count(*) AS calls,
  max(ms) FILTER (r = CAST(round_even(0.5 * (n - 1), 0) AS BIGINT) + 1) AS p50,
  max(ms) FILTER (r = CAST(round_even(0.95 * (n - 1), 0) AS BIGINT) + 1) AS p95
FROM ranked GROUP BY {by}"""


@query(sql(LATENCY.format(by="action"), "actions"))
def latency_per_action(spark, sf_dir):
    return runs.latency_per_action(A.actions(spark, sf_dir))


@query(sql(LATENCY.format(by="run_id, action"), "actions"))
def latency_per_run(spark, sf_dir):
    return runs.latency_per_action(A.actions(spark, sf_dir), "run_id")


@query(sql(COSTS + f"""
, counters AS (SELECT run_id, {COUNTERS} FROM actions GROUP BY run_id),
total AS (SELECT run_id, CASE WHEN count(cost_usd) = count(*) THEN sum(cost_usd) END AS cost_usd FROM costs GROUP BY run_id)
SELECT c.*, successes / tasks AS success_rate, cost_usd, cost_usd / tasks AS cost_per_task_usd
FROM counters c JOIN total USING (run_id)""", "actions"))
def run_metrics(spark, sf_dir):
    tasks = A.actions(spark, sf_dir)
    return run_report(tasks, tasks, A.prices(spark))[0]


@query(sql("""
SELECT task_id, status, status IN (408, 409, 429) OR status >= 500 AS by_status,
  failed AND k_type = 'Timeout' AS by_type
FROM (SELECT *, CASE WHEN n_tags = 0 THEN 'Timeout' ELSE 'ValueError' END AS k_type FROM actions)""", "actions"))
def transient_errors(spark, sf_dir):
    kind = F.when(F.col("n_tags") == 0, "Timeout").otherwise("ValueError")
    none = F.lit(None).cast("int")
    return A.actions(spark, sf_dir).select(
        "task_id", "status", is_transient(F.col("status"), kind).alias("by_status"),
        (F.col("failed") & is_transient(none, kind)).alias("by_type"))


@query(sql("SELECT action AS event, count(*) AS n, avg(ms) AS mean_ms FROM actions GROUP BY action", "actions"))
def log_rollup(spark, sf_dir):
    """Events written as a JSON-lines log by Spark, read back and rolled up."""
    path = fresh_path(spark, "log")
    A.actions(spark, sf_dir).select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.col("action").alias("event"), "ms").write.json(path)
    return runs.log_rollup(records.read_log(spark, path))


@query(sql("SELECT ord, key FROM requests", "requests"))
def request_keys(spark, sf_dir):
    return A.requests(spark, sf_dir)


SPLIT = """
, split AS (SELECT r.ord, CASE WHEN r.key IN (SELECT key FROM memory) THEN 'memory'
    WHEN row_number() OVER (PARTITION BY r.key ORDER BY r.ord) = 1 THEN 'scorer' ELSE 'batch' END AS source
  FROM requests r)"""


@query(sql(SPLIT + "SELECT ord, source, source <> 'scorer' AS cached FROM split", "requests"))
def memory_split(spark, sf_dir):
    requests = written(A.requests(spark, sf_dir), "requests")
    return mem.split_requests(requests, A.memory(spark, sf_dir, requests)).select("ord", "source", "cached")


@query(sql(SPLIT + """
SELECT count(*) FILTER (source <> 'scorer') AS hits, count(*) FILTER (source = 'scorer') AS misses,
  100 * (count(*) FILTER (source <> 'scorer') / count(*)) AS reused_percent,
  (SELECT count(*) FROM memory) + count(*) FILTER (source = 'scorer') AS entries FROM split""", "requests"))
def memory_summary(spark, sf_dir):
    requests = written(A.requests(spark, sf_dir), "requests")
    known = A.memory(spark, sf_dir, requests)
    return mem.memory_summary(mem.split_requests(requests, known), known)


@query(sql(SPLIT + "SELECT ord, source, source <> 'scorer' AS cached FROM split", "requests"))
def memory_probe(spark, sf_dir):
    """The split against a memory table of buckets, of which only those the requests fall into are read."""
    requests = written(A.requests(spark, sf_dir), "requests")
    table = MemoryTable(spark, fresh_path(spark, "memory"), "key string, created timestamp")
    table.put(A.memory(spark, sf_dir, requests).withColumn("created", F.timestamp_seconds(F.lit(0))))
    return mem.split_requests(requests, table).select("ord", "source", "cached")


@query("""
WITH writes AS (SELECT CAST(user_id AS VARCHAR) AS key, event_type AS tag, event_id, (event_id % 3 = 0)::INT + 1 AS version FROM events),
held AS (SELECT v.version, w.* EXCLUDE (version) FROM (VALUES (1), (2)) v(version) JOIN writes w ON w.version <= v.version)
SELECT version, key, arg_max(tag, event_id) AS tag, max(event_id) AS written FROM held GROUP BY version, key""")
def memory_versions(spark, sf_dir):
    """Two puts into a memory table, each state read by its version."""
    rows = A.table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("tag"), "event_id",
        F.timestamp_seconds("event_id").alias("created"))
    table = MemoryTable(spark, fresh_path(spark, "memory"), "key string, tag string, event_id bigint, created timestamp")
    first = table.put(rows.filter(F.col("event_id") % 3 != 0))
    second = table.put(rows.filter(F.col("event_id") % 3 == 0))
    states = [table.read(n).withColumn("version", F.lit(n)) for n in (first, second)]
    return states[0].unionByName(states[1]).select("version", "key", "tag", F.col("event_id").alias("written"))


@query("""
WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS w, p_brand, p_partkey % 2 = 0 AS listed FROM part)
SELECT p_partkey, w[1] || '|' || w[2] AS tags, CASE WHEN listed THEN '' ELSE w[1] || '=seen' END AS rationale,
  CASE WHEN NOT listed THEN p_brand END AS product FROM w""")
def memory_payloads(spark, sf_dir):
    """Remembered answers as JSON text in both shapes, read as one."""
    words = F.split("p_name", " ")
    listed = F.to_json(words)
    whole = F.to_json(F.struct(
        words.alias("tags"), F.create_map(F.get(words, F.lit(0)), F.lit("seen")).alias("rationale"),
        F.struct(F.col("p_brand").alias("product")).alias("details")))
    read = A.table(spark, sf_dir, "part").select(
        "p_partkey", stores.remembered_payload(
            F.when(F.col("p_partkey") % 2 == 0, listed).otherwise(whole)).alias("r"))
    pairs = F.transform(F.map_entries("r.rationale"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return read.select("p_partkey", F.array_join("r.tags", "|").alias("tags"),
                       F.array_join(F.array_sort(pairs), "|").alias("rationale"), F.col("r.details.product").alias("product"))


@query(sql("SELECT run_id, image_path, created, value FROM latest", "history"))
def latest_results(spark, sf_dir):
    return results.latest_results(A.history(spark, sf_dir)).select("run_id", "image_path", "created", "value")


@query(sql("SELECT run_id, count(*) AS images, max(created) AS created FROM latest GROUP BY run_id", "history"))
def runs_summary(spark, sf_dir):
    return results.runs_summary(A.history(spark, sf_dir))


@query(sql("""
SELECT run_id, image_path AS image_name, value FROM latest WHERE run_id = (
  SELECT run_id FROM latest GROUP BY run_id ORDER BY max(created) DESC, run_id LIMIT 1)""", "history"))
def newest_run_rows(spark, sf_dir):
    return results.run_rows(A.history(spark, sf_dir)).select("run_id", "image_name", "value")


def _history_rows(spark, sf_dir):
    none = F.lit(None).cast("string")
    return A.history(spark, sf_dir).select(
        "run_id", "image_path", F.array(F.col("image_path")).alias("tags"), F.array().cast("array<string>").alias("highlights"),
        F.create_map(F.col("image_path"), F.lit("seen")).alias("rationale"), none.alias("category"), none.alias("product"),
        none.alias("description"), F.col("value").cast("string").alias("specs"), F.lit("m1").alias("model"),
        F.lit(1).alias("attempts"), F.lit(False).alias("cached"), "created", "write_ord")


@query(sql("""
SELECT run_id, image_path, image_path AS tags, CASE WHEN write_ord % 2 = 1 THEN CAST(value AS VARCHAR) END AS specs
FROM latest""", "history"))
def results_history(spark, sf_dir):
    """Two appends to the history, the first without the newer columns, read as one."""
    path = fresh_path(spark, "history")
    rows = _history_rows(spark, sf_dir)
    stores.append_results(rows.filter(F.col("write_ord") % 2 == 0).drop("description", "specs"), path)
    stores.put_results(rows.filter(F.col("write_ord") % 2 == 1), path)
    return stores.read_history(spark, path).select("run_id", "image_path", F.array_join("tags", "|").alias("tags"), "specs")


@query("""
SELECT CAST(user_id AS VARCHAR) AS key, arg_max(event_type, event_id) AS tags, max(event_id) AS written
FROM events GROUP BY user_id""")
def memory_store(spark, sf_dir):
    """Answers appended to the request memory; the last per key is read."""
    path = fresh_path(spark, "memory")
    blank = F.lit("")
    rows = A.table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("key"), F.array("event_type").alias("tags"),
        F.create_map(F.lit("written"), F.col("event_id").cast("string")).alias("rationale"),
        F.struct(*[blank.alias(c) for c in ("category", "product", "description", "specs")]).alias("details"),
        F.lit("m1").alias("model"), F.timestamp_seconds("event_id").alias("created"))
    stores.remember(rows.filter(F.col("created") < F.timestamp_seconds(F.lit(500))), path)
    stores.remember(rows.filter(F.col("created") >= F.timestamp_seconds(F.lit(500))), path)
    return stores.read_memory(spark, path).select(
        "key", F.array_join("tags", "|").alias("tags"), F.element_at("rationale", "written").cast("bigint").alias("written"))


@query("""
WITH s AS (SELECT l_partkey, CAST(sum(l_quantity) AS BIGINT) AS sold FROM lineitem GROUP BY l_partkey)
SELECT p_name || '.jpg' AS file, p_type AS category, p_brand AS product, CAST(p_retailprice AS DOUBLE) AS price,
  CASE WHEN p_partkey % 10 > 1 THEN CAST(sold AS DOUBLE) END AS views FROM part LEFT JOIN s ON l_partkey = p_partkey""")
def sheet_scan(spark, sf_dir):
    """The sheet written as CSV under other headers, and read back by its headers."""
    path = fresh_path(spark, "sheet")
    A.metadata(spark, sf_dir).select(
        F.concat(F.lit("shots/"), "file", F.lit(" ")).alias("Name"), F.col("category").alias("Category"),
        F.col("product").alias("Model"), F.col("views").alias("Image views"), F.col("price").alias("Product price"),
        F.lit("x").alias("Remarks")).write.csv(path, header=True, escape='"', ignoreTrailingWhiteSpace=False)
    return read_sheet(spark, path).select(
        "file", "category", "product", F.col("price").try_cast("double").alias("price"),
        F.col("views").try_cast("double").alias("views"))


@query(sql("""
, saved AS (SELECT ord, path, category, product AS model, array_to_string(truth, '; ') AS tags,
    CASE WHEN truth[2] IN ('gizmo', 'anvil') THEN '' ELSE truth[2] END AS highlights FROM tagged)
SELECT * FROM saved UNION ALL SELECT * REPLACE (NULL AS ord) FROM saved""", "tagged"))
def saved_results(spark, sf_dir):
    """Results written as JSON lines and read back with their ordinals; those written as CSV and read back without."""
    family = F.filter("truth", lambda t: t.isin(A.FAMILY))
    rows = A.items(spark, sf_dir).select("path", "category", F.col("product").alias("model"), F.col("truth").alias("tags"),
                                          family.alias("highlights"), F.col("ord").cast("bigint").alias("ord"))
    as_json, as_csv = fresh_path(spark, "results"), fresh_path(spark, "results") + ".csv"
    records.write_results(rows, as_json)
    read = records.read_results(spark, as_json)
    records.write_results(read, as_csv)
    back = spark.read.csv(as_csv, header=True, escape='"').select(
        "path", "category", "model", "tags", F.coalesce("highlights", F.lit("")).alias("highlights"))
    lines = read.withColumns({c: F.array_join(c, "; ") for c in ("tags", "highlights")})
    return lines.unionByName(back.withColumn("ord", F.lit(None).cast("bigint")))


@query("SELECT event_id, strftime(ts, '%Y%m%d-%H%M%S') AS run_id FROM events")
def run_ids(spark, sf_dir):
    return A.table(spark, sf_dir, "events").select("event_id", run_id(F.col("ts")).alias("run_id"))


@query("""
SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'image/png' WHEN 2 THEN 'image/gif' WHEN 3 THEN 'image/gif'
  WHEN 4 THEN 'image/webp' ELSE 'image/jpeg' END AS media_type, base64(encode(text)) AS content_b64 FROM documents""")
def media_types(spark, sf_dir):
    """Every kind of magic bytes put before a document, and its base64 text."""
    heads = [b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff", b"GIF87a", b"GIF89a", b"RIFF....WEBP", b"RIFF....WAVE", b"none"]
    head = F.element_at(F.array(*[F.lit(h) for h in heads]), (F.col("doc_id") % 7 + 1).cast("int"))
    text = F.col("text").cast("binary")
    return A.table(spark, sf_dir, "documents").select(
        "doc_id", media_type(F.concat(head, text)).alias("media_type"), base64_text(text).alias("content_b64"))


@query(sql("SELECT 'tag' AS command, 5 AS \"limit\", count(*) AS tasks, 'limit' AS settings FROM actions", "actions"))
def run_record(spark, sf_dir):
    """Records of two commands; the newest of one of them is read back."""
    folder = fresh_path(spark, "runs")
    payload = A.actions(spark, sf_dir).agg(F.count(F.lit(1)).alias("tasks"))
    for day, command in ((1, "tag"), (2, "tag"), (3, "eval")):
        records.write_run_record(payload, command, {"limit": day + 3, "enrich": False, "few_shot": 0}, folder,
                                 dt.datetime(2026, 1, day))
    newest = records.newest_record(spark, folder, "tag")
    return newest.select("command", F.col("settings.limit").cast("int").alias("limit"), "tasks",
                         F.lit(",".join(newest.schema["settings"].dataType.names)).alias("settings"))


REPORT = """
, pairs AS (SELECT unnest(truth) AS tag, predicted, true AS own FROM judged),
given AS (SELECT unnest(predicted) AS tag, truth FROM judged),
names AS (SELECT tag FROM pairs UNION SELECT tag FROM given),
hits AS (SELECT (SELECT count(*) FROM pairs p WHERE p.tag = n.tag AND list_contains(p.predicted, n.tag)) AS tp,
    (SELECT count(*) FROM pairs p WHERE p.tag = n.tag) AS support, n.tag FROM names n),
totals AS (SELECT sum(len(list_intersect(truth, predicted))) AS tp, sum(len(truth)) AS t, sum(len(predicted)) AS p FROM judged)
SELECT 'records' AS part, path AS name, array_to_string(predicted, '|') AS said, CAST(NULL AS DOUBLE) AS number FROM judged
UNION ALL SELECT 'metrics', 'micro_f1', '', 2 * tp / (t + p) FROM totals
UNION ALL SELECT 'per_tag', tag, '', CAST(support AS DOUBLE) FROM hits
UNION ALL SELECT 'workflow', 'run', '', CAST(count(*) AS DOUBLE) FROM judged
UNION ALL SELECT 'baselines', 'parts', '', 1
UNION ALL SELECT 'verdict', 'parts', '', 1"""


@query(sql(REPORT, "judged"))
def evaluation_report(spark, sf_dir):
    """A whole evaluation written part by part, and every part read back."""
    path = fresh_path(spark, "evaluation")
    judged = A.judged(spark, sf_dir).withColumn("error", F.lit(None).cast("string"))
    counters = judged.agg(F.lit("run").alias("run_id"), F.count(F.lit(1)).alias("tasks"))
    report = score_records(judged, counters)
    records.write_evaluation(path, metrics=report.metrics, per_tag=report.per_tag, baselines=report.baselines,
                             verdict=report.verdict, workflow=report.workflow, records=report.records)

    def part(name, key, said, number):
        read = spark.read.json(f"{path}/{name}")
        return read.select(F.lit(name).alias("part"), key.alias("name"), said.alias("said"), number.cast("double").alias("number"))

    none, blank = F.lit(None).cast("double"), F.lit("")
    parts = [part("records", F.col("path"), F.array_join("predicted", "|"), none),
             part("metrics", F.lit("micro_f1"), blank, F.col("micro_f1")),
             part("per_tag", F.col("tag"), blank, F.col("support")),
             part("workflow", F.col("run_id"), blank, F.col("tasks"))]
    # Two more parts, whose figures other queries check: that they were written and hold rows.
    parts += [part(name, F.lit("parts"), blank, F.lit(1)).distinct() for name in ("baselines", "verdict")]
    return reduce(DataFrame.unionByName, parts)
