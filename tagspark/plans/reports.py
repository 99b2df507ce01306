"""JOB-2 to JOB-6: evaluation, insights, stability, review and run metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagspark import fixed
from tagspark.operators import consistency, engagement, metadata as sheet, quality, review, runs
from tagspark.operators.examples import draw_pool
from tagspark.plans.tagging_job import TaggingRun, tag_items, to_tasks
from tagspark.session import written


@dataclass(frozen=True)
class Evaluation:
    metrics: DataFrame
    per_tag: DataFrame
    baselines: DataFrame
    verdict: DataFrame
    failures: DataFrame
    workflow: DataFrame
    records: DataFrame


def score_records(records: DataFrame, workflow: DataFrame | None = None) -> Evaluation:
    """Every quality figure of (path, truth, predicted, error) rows."""
    rows = records.withColumn("ord", F.col("path"))
    scores = quality.compare_baselines(rows)
    micro = quality.micro_scores(rows).select("n", "micro_f1")
    macro = quality.macro_f1(rows).select("macro_f1").scalar()
    return Evaluation(
        metrics=micro.withColumn("macro_f1", macro),
        per_tag=quality.per_tag_scores(rows),
        baselines=scores.filter(F.col("name") != "agent"),
        verdict=quality.verdict(scores),
        failures=quality.failure_kinds(rows),
        workflow=records.sparkSession.createDataFrame([], "run_id string") if workflow is None else workflow,
        records=quality.exact_matches(records))


def evaluate(labelled: DataFrame, scorer, *, model_id: str, few_shot: int = 0, **options) -> Evaluation:
    """JOB-2: tag labelled items, none of them shown its own answer, and score.

    `labelled` has path, content and truth. Labels are not part of what the
    scorer is sent.
    """
    pool = draw_pool(labelled, few_shot) if few_shot else None
    run = tag_items(labelled.select("path", "content"), scorer, model_id=model_id, pool=pool, **options)
    records = written(
        labelled.select("path", "truth").join(
            run.rows.select("path", F.col("tags").alias("predicted"), "error"), "path"), "records")
    return score_records(records, runs.workflow_counters(to_tasks(run), "run_id"))


def insights_from_sheet(metadata: DataFrame, metric: str = "views",
                        min_support: int = fixed.MIN_SUPPORT) -> DataFrame:
    """JOB-3: engagement per tag, tags read off the sheet's own file names."""
    return engagement.tag_engagement(sheet.rows_from_sheet(metadata), metric, min_support)


def insights(results: DataFrame, metadata: DataFrame, metric: str = "views",
             min_support: int = fixed.MIN_SUPPORT, row_id: str = "ord") -> DataFrame:
    """JOB-3: engagement per tag of tagged results, matched to the sheet."""
    return engagement.tag_engagement(
        sheet.join_two_tier(results, metadata, row_id), metric, min_support, order=row_id)


def stability(first: TaggingRun, items: DataFrame, scorer, *, model_id: str, labelled: DataFrame | None = None,
              few_shot: int = 0, seed: int = fixed.SECOND_DRAW_SEED, **options) -> DataFrame:
    """JOB-4: ask everything once more, without memory and with another draw of examples, and compare by path."""
    pool = draw_pool(labelled, few_shot, seed) if few_shot else None
    second = tag_items(items, scorer, model_id=model_id, memory=None, pool=pool, **options)
    return consistency.compare_passes(
        first.rows.withColumn("ord", F.col("path")), second.rows.withColumn("ord", F.col("path")))


def review_report(rows: DataFrame, metadata: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JOB-5: the review table without blank columns, and its headline counts."""
    known = written(review.with_metadata(rows, metadata), "review")
    return review.without_blank_columns(review.review_table(known)), review.headline(known)


def run_report(tasks: DataFrame, actions: DataFrame, prices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JOB-6: counters, success rate and cost per run, and latency per action."""
    counters = runs.workflow_counters(tasks, "run_id").withColumn(
        "success_rate", F.when(F.col("tasks") == 0, 0.0).otherwise(F.col("successes") / F.col("tasks")))
    cost = (runs.costs(tasks, prices, "run_id")
            .groupBy("run_id")
            .agg(F.when(F.count("cost_usd") == F.count(F.lit(1)), F.sum("cost_usd")).alias("cost_usd")))
    report = (counters.join(cost, "run_id", "left")
              .withColumn("cost_per_task_usd", F.col("cost_usd") / F.col("tasks")))
    return report, runs.latency_per_action(actions, "run_id")
