"""How a run behaved: success, cost, latency, errors and log events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagspark.functions.tags import ratio
from tagspark.operators.order_stats import counted, nearest_rank, values_at_ranks

def success_rate(tasks: DataFrame, *by: str) -> DataFrame:
    """AG-14: tasks with at least one tag over all tasks."""
    return tasks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("tasks"), F.count_if(F.col("n_tags") > 0).alias("successes")
    ).withColumn("success_rate", ratio(F.col("successes"), F.col("tasks")))


def workflow_counters(tasks: DataFrame, *by: str) -> DataFrame:
    """AG-16: every counter of a run in one aggregate."""
    return tasks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("tasks"),
        F.count_if(F.col("n_tags") > 0).alias("successes"),
        F.count_if("failed").alias("failures"),
        F.coalesce(F.sum("retries"), F.lit(0)).cast("bigint").alias("retries"),
        F.count_if("cached").alias("cache_hits"),
        F.coalesce(F.sum("model_calls"), F.lit(0)).cast("bigint").alias("model_calls"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).cast("bigint").alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).cast("bigint").alias("output_tokens"))


def priced(models: DataFrame, prices: DataFrame, model: str = "model_id") -> DataFrame:
    """JN-5: rate of each distinct model id, by the longest prefix in the card.

    Every prefix of an id is looked up, so this is an equi-join; an id the card
    does not cover has NULL rates.
    """
    ids = models.select(model).distinct()
    found = (
        ids.withColumn("prefix", F.explode(F.transform(
            F.sequence(F.lit(0), F.length(model)), lambda n: F.substring(F.col(model), F.lit(1), n))))
        .join(prices, "prefix")
        .groupBy(model)
        .agg(F.max_by(F.struct("usd_in", "usd_out"), F.length("prefix")).alias("_rate")))
    return ids.join(found, model, "left").select(model, "_rate.usd_in", "_rate.usd_out")


def costs(tasks: DataFrame, prices: DataFrame, *by: str, model: str = "model_id") -> DataFrame:
    """AG-15: cost and cost per task by run and model; NULL when unpriced.

    Tokens are summed before the price is looked up, so the join sees one row
    per group.
    """
    used = tasks.groupBy(*by, model).agg(
        F.count(F.lit(1)).alias("tasks"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).cast("bigint").alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).cast("bigint").alias("output_tokens"))
    cost = (F.col("input_tokens") * F.col("usd_in") + F.col("output_tokens") * F.col("usd_out")) / 1_000_000
    return (used.join(priced(used, prices, model), model, "left")
            .withColumn("cost_usd", cost)
            .withColumn("cost_per_task_usd", F.when(
                F.col("tasks") == 0, F.when(F.col("cost_usd").isNotNull(), 0.0)
            ).otherwise(F.col("cost_usd") / F.col("tasks")))
            .select(*by, model, "tasks", "input_tokens", "output_tokens", "cost_usd", "cost_per_task_usd"))


def latency_per_action(actions: DataFrame, *by: str, ms: str = "ms") -> DataFrame:
    """AG-17, WN-3: calls and nearest-rank p50 and p95 of each action seen."""
    keys = [*by, "action"]
    return (values_at_ranks(counted(actions, keys, ms), keys, ms,
                            {"p50": nearest_rank(50), "p95": nearest_rank(95)})
            .select(*keys, F.col("_n").alias("calls"), "p50", "p95"))


def log_rollup(log: DataFrame) -> DataFrame:
    """AG-22: how often each event was logged and how long it took on average."""
    return log.groupBy("event").agg(F.count(F.lit(1)).alias("n"), F.avg("ms").alias("mean_ms"))
