"""JOB-1: tag items in at most two looks, reusing earlier answers."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagspark import fixed
from tagspark.functions import tags as T
from tagspark.functions.images import base64_text, media_type, request_key
from tagspark.functions.paths import context_from_path, split_context
from tagspark.functions.text import blank, filled
from tagspark.functions.answers import prediction
from tagspark.operators.evidence import Rules
from tagspark.operators.examples import Pool
from tagspark.operators.keyed import last_per_key, lookup
from tagspark.operators.slots import maybe_in, slot_filter
from tagspark.plans.evidence_job import proposals
from tagspark.plans.scoring import ask
from tagspark.sources.images import ImageFolder
from tagspark.sources.memory_table import MemoryTable
from tagspark.session import written
from tagspark.sources.vocabulary import allowed_tags, family

NO_TAGS = "array<string>"
# Requests of a look (a path, a context and a feedback each) that are handed to
# every task; with more of them the items asked about are shuffled instead.
BROADCAST_REQUESTS = 200_000
# Items of one partition that are asked about one after the other whatever the other cores do,
# and how many times a core's share of the items one partition may hold.
IN_A_ROW = 1_000
MOST_SHARES = 1.25


@dataclass(frozen=True)
class TaggingRun:
    """What a run leaves: a row per item, new memory rows, a row per call, and a row per request that failed.

    `failures` (key, path, error, status, transient, created) may be kept and given to a later run as its quarantine.
    """

    rows: DataFrame
    memory_rows: DataFrame
    calls: DataFrame
    failures: DataFrame


def _transient() -> Column:
    """S-21: whether the failure of a row is worth another try, by its status or else by the name of its error."""
    return F.coalesce(T.is_transient(F.col("status"), F.regexp_extract("error", r"\A([^:]*):", 1)), F.lit(False))


def _no_tags() -> Column:
    return F.array().cast(NO_TAGS)


def _uneven(items: DataFrame) -> bool:
    """Whether a partition of `items` holds well over a core's share of them; no content is read for that."""
    sizes = items.select(F.spark_partition_id().alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    found = sizes.agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    return found["most"] > max(IN_A_ROW, MOST_SHARES * found["n"] / items.sparkSession.sparkContext.defaultParallelism)


def _read(answers: DataFrame, vocabulary: Sequence[str], proposed: DataFrame | None) -> DataFrame:
    """Answers as validated tags, with reasons, details and whether they look weak.

    A text is parsed here, on the JVM; other fields count where there is none.
    """
    by_text = F.col("text").isNotNull()
    read = F.when(by_text, prediction(F.col("text"), vocabulary))
    fields = answers.select(
        "path", "key", "context", "attempts", "error", "status", read.alias("_read"), by_text.alias("_by_text"),
        "tags", "reasons", "category", "product", "description", "specs")
    facts = {c: F.when(F.col("_by_text"), F.col("_read")[c]).otherwise(blank(F.col(c)))
             for c in ("category", "product", "description", "specs")}
    parsed = fields.withColumns({
        "raw": F.coalesce(F.when(F.col("_by_text"), F.col("_read.tags")).otherwise(F.col("tags")), _no_tags()),
        "reasons": F.coalesce(F.when(F.col("_by_text"), F.col("_read.reasons")).otherwise(F.col("reasons")),
                              F.create_map().cast("map<string, string>")),
        **facts,
    })
    if proposed is not None:
        parsed = (lookup(parsed, proposed, ["context"], F.col("path"))
                  .withColumn("raw", F.concat("raw", F.coalesce("proposed", _no_tags()))))
    kept = T.kept_tags(F.col("raw"), vocabulary)
    return (parsed
            .withColumns({"kept": F.when(F.col("error").isNull(), kept).otherwise(_no_tags()),
                          "dropped": T.dropped_tags(F.col("raw"), vocabulary)})
            .select("path", "key", "context", "attempts", "error", "status", "kept", "dropped",
                    T.reasons_for(F.col("kept"), F.col("reasons")).alias("rationale"),
                    "category", "product", "description", "specs",
                    (F.col("error").isNull() & T.looks_weak(F.col("kept"), F.col("dropped"))).alias("weak")))


def tag_items(items: DataFrame | ImageFolder, scorer: Callable[[], Any], *, model_id: str,
              vocabulary: Sequence[str] | None = None, highlight_family: Sequence[str] | None = None,
              memory: DataFrame | MemoryTable | None = None, corpus: DataFrame | None = None,
              rules: Rules = fixed.EVIDENCE_RULES, brand: str = "",
              known_folders: Sequence[str] = tuple(fixed.KNOWN_CATEGORIES),
              passes: int = fixed.MAX_PASSES, pool: Pool | None = None,
              quarantine: DataFrame | None = None, ask_again: bool = False) -> TaggingRun:
    """Tag every item: look, check against the vocabulary, look again when weak.

    `items` has a unique `path`, `content`, and optionally `context`; a `pool`
    gives the examples shown with each. Of an image folder only those files are
    opened that are asked about or, with a memory, whose fingerprint is not in the folder's manifest. With a `memory` an identical request is
    asked once: earlier answers (the last per key) and repeats inside the batch
    are reused, an identical request shares its outcome even when that is an
    error. A memory table is read only in the buckets that the requests fall into. Of the requests in a `quarantine` (failures of
    earlier runs) only those whose last failure was transient are asked; the
    others keep their error. With `ask_again` a transient failure of one look is
    asked again in the next. As many requests run side by side as the items have partitions; items that lie in a few large
    ones are dealt out over all cores first. Every answer is written to the shared folder
    before it is used, so no later step asks the scorer again.
    """
    vocabulary = allowed_tags() if vocabulary is None else list(vocabulary)
    highlight_family = family() if highlight_family is None else list(highlight_family)
    folder = items if isinstance(items, ImageFolder) else None
    listed = written(folder.listing(), "listing") if folder else items
    told = filled(F.col("context")) if "context" in listed.columns else F.lit(None).cast("string")
    context = F.coalesce(told, filled(context_from_path(F.col("path"), known_folders)))
    kept = ["path", "uri", "length", "modified"] if folder else ["path", "content"]
    source = listed.select(*kept, context.alias("context"))
    uneven = folder is None and _uneven(listed)

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, "path") if uneven else rows

    if memory is None:
        requests = source.select("path", "context", F.col("path").alias("key"))
        work = requests
    else:
        shown = None if pool is None else pool.key(F.col("path"))
        extra = "enrich" if corpus is not None else ""

        def request(content: Column) -> Column:
            return request_key(content, F.lit(model_id), F.col("context"), examples=shown, extra=extra)

        if folder is None:
            # Hashing reads every byte once; from here on the table is narrow.
            requests = written(source.select("path", "context", request(base64_text(F.col("content"))).alias("key")), "requests")
        else:
            # The fingerprint of no content names all else that it depends on.
            asked = source.withColumn("asked", request(F.lit("")))
            keys = folder.fingerprints(asked, lambda rows: request(base64_text(rows["content"])))
            requests = written(source.join(keys, "path").select("path", "context", F.col("request").alias("key")), "requests")
        if isinstance(memory, MemoryTable):
            # One state of the table for the whole run, and only the buckets these requests fall into.
            memory = written(memory.matching(requests), "remembered")
        else:
            order = F.col("created") if "created" in memory.columns else F.col("key")
            memory = last_per_key(memory, ["key"], order)
        heads = requests.groupBy("key").agg(F.min_by(F.struct("path", "context"), "path").alias("_head"))
        work = written(heads.join(memory.select("key"), "key", "left_anti")
                       .select("_head.path", "_head.context", "key"), "work")

    held = None
    if quarantine is not None:
        last = last_per_key(quarantine.select("key", "error", "status", "created"), ["key"], F.col("created"))
        held = written(work.join(last.filter(~_transient()).drop("created"), "key"), "held")
        work = written(work.join(held.select("key"), "key", "left_anti"), "work")

    proposed = None if corpus is None else written(
        proposals(requests, corpus, rules, brand), "proposals")

    def look(todo: DataFrame, attempt: int) -> DataFrame:
        # Without a memory the first look is at everything: no join, and no shuffle
        # of the images unless they are to be dealt out. Otherwise images are picked where they lie. Only with
        # very many requests they move, and then only those asked about: a
        # filter of fixed size keeps the others out of the shuffle.
        if folder is not None:
            wanted = todo.join(source.select("path", "uri"), "path")
            sent = folder.content(wanted).join(todo, "path")
        elif memory is None and attempt == 1 and held is None:
            sent = dealt(listed).select(*kept, context.alias("context")).withColumn("key", F.col("path")).withColumn("feedback", F.lit(None).cast("string"))
        elif todo.count() <= BROADCAST_REQUESTS:
            sent = dealt(source.drop("context").join(F.broadcast(todo), "path"))
        else:
            asked = slot_filter(todo, F.xxhash64("path"))
            sent = maybe_in(source.drop("context"), F.xxhash64("path"), asked).filter("maybe").drop("maybe")
            sent = dealt(sent.join(todo, "path"))
        sent = sent.select(
            "path", "key", "context", "feedback",
            base64_text(F.col("content")).alias("content_b64"), media_type(F.col("content")).alias("media_type"))
        shown = None if pool is None else (pool.entries, pool.limit)
        return written(ask(sent, scorer, shown), f"answers-{attempt}").withColumn("attempts", F.lit(attempt))

    answers = look(work.withColumn("feedback", F.lit(None).cast("string")), 1)
    calls = [answers]
    state = _read(answers, vocabulary, proposed)
    for attempt in range(2, passes + 1):
        state = written(state, f"state-{attempt}")
        again = (F.col("weak") | (_transient() & F.col("error").isNotNull()) if ask_again else F.col("weak")) & (
            F.col("attempts") == attempt - 1)
        todo = state.filter(again).select(
            "path", "key", "context", F.when(F.col("error").isNull(), T.feedback(F.col("dropped"), F.col("kept"))).alias("feedback"))
        answers = look(todo, attempt)
        calls.append(answers)
        state = state.filter(~again).unionByName(_read(answers, vocabulary, proposed))

    if held is not None:
        nothing = {f.name: F.lit(None).cast(f.dataType) for f in state.schema}
        kept_back = held.select(*[F.col(c) if c in held.columns else nothing[c].alias(c) for c in state.columns])
        state = state.unionByName(kept_back.withColumns({
            "attempts": F.lit(0), "kept": _no_tags(), "dropped": _no_tags(), "rationale": F.create_map().cast("map<string, string>")}))
    failures = state.filter(F.col("error").isNotNull()).select(
        "key", "path", "error", "status", _transient().alias("transient"), F.current_timestamp().alias("created"))

    done = state.select(
        "key", F.col("path").alias("_asked"), F.col("kept").alias("tags"), "rationale",
        F.struct("category", "product", "description", "specs").alias("details"), "attempts", "error")
    if memory is None:
        rows = (state.withColumnRenamed("kept", "tags")
                .withColumn("details", F.struct("category", "product", "description", "specs"))
                .withColumn("cached", F.lit(False)))
    else:
        done = written(done, "done")
        earlier = (memory.join(requests.select("key").distinct(), "key", "left_semi")
                   .select("key", F.lit(None).cast("string").alias("_asked"), "tags", "rationale", "details",
                           F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("error")))
        rows = lookup(requests, done.unionByName(earlier), ["key"], F.col("path"))
        own = F.col("_asked").eqNullSafe(F.col("path"))
        rows = (rows.withColumn("cached", F.col("error").isNull() & ~own)
                .withColumn("attempts", F.when(F.col("cached"), 0).otherwise(F.col("attempts"))))

    place = split_context(F.col("context"))
    all_calls = calls[0]
    for more in calls[1:]:
        all_calls = all_calls.unionByName(more)
    return TaggingRun(
        rows=rows.select(
            "path", "context", "key", "tags",
            T.highlights(F.col("tags"), highlight_family).alias("highlights"), "rationale",
            F.coalesce(filled(place["category"]), F.col("details.category"), F.lit("")).alias("category"),
            F.coalesce(filled(place["model"]), F.col("details.product"), F.lit("")).alias("product"),
            blank(F.col("details.description")).alias("description"),
            blank(F.col("details.specs")).alias("specs"),
            F.lit(model_id).alias("model"), "attempts", "cached", "error"),
        memory_rows=done.filter(F.col("error").isNull()).select(
            "key", "tags", "rationale", "details", F.lit(model_id).alias("model"),
            F.current_timestamp().alias("created")),
        calls=all_calls.select(
            "path", F.lit("model").alias("action"), "attempts", "ms",
            F.coalesce("input_tokens", F.lit(0)).alias("input_tokens"),
            F.coalesce("output_tokens", F.lit(0)).alias("output_tokens"),
            F.coalesce("retries", F.lit(0)).alias("retries"), "error"),
        failures=failures,
    )


def to_results(rows: DataFrame) -> DataFrame:
    """PRJ-5: rows as saved results, category and model as the path tells them."""
    place = split_context(F.col("context"))
    return rows.select("path", place["category"].alias("category"), place["model"].alias("model"),
                       "tags", "highlights")


def to_history(rows: DataFrame, run_id: str) -> DataFrame:
    """PRJ-4, PRJ-5: rows for the results history; failed items leave none."""
    return rows.filter(F.col("error").isNull()).select(
        F.lit(run_id or "adhoc").alias("run_id"), F.col("path").alias("image_path"), "tags", "highlights",
        "rationale", "category", "product", "description", "specs", "model", "attempts", "cached",
        F.current_timestamp().alias("created"), F.lit(0).cast("bigint").alias("write_ord"))


def to_tasks(run: TaggingRun, run_id: str = "adhoc") -> DataFrame:
    """AG-14..16: one row per item with what it took."""
    used = run.calls.groupBy("path").agg(
        F.count(F.lit(1)).alias("model_calls"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.sum("retries").alias("retries"))
    none = F.lit(0).cast("bigint")
    return (run.rows.select("path", "tags", "cached", "error", F.col("model").alias("model_id"))
            .join(used, "path", "left")
            .select(F.lit(run_id).alias("run_id"), F.col("path").alias("task_id"), "model_id",
                    F.size("tags").alias("n_tags"), F.col("error").isNotNull().alias("failed"), "cached",
                    *[F.coalesce(c, none).alias(c) for c in ("retries", "model_calls", "input_tokens", "output_tokens")]))
