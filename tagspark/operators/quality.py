"""Multi-label quality: micro, macro and per-tag scores, baselines, failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagspark import fixed
from tagspark.functions.tags import f1, ratio, same_set
from tagspark.operators.tagging import median_label_size, ranked, tag_counts
from tagspark.session import written


def matches(truth: DataFrame, predicted: DataFrame, item: str = "path", tags: str = "tags") -> DataFrame:
    """JN-4: every (item, tag) of two tables, and which of the two it is in.

    A union and a combinable aggregate rather than a full outer join: one
    shuffle on (item, tag), in which no single tag or item is gathered.
    """
    def side(df: DataFrame, in_truth: bool) -> DataFrame:
        return df.select(
            F.col(item), F.explode(F.array_distinct(tags)).alias("tag"),
            F.lit(in_truth).alias("in_truth"), F.lit(not in_truth).alias("in_predicted"))

    return (side(truth, True).unionByName(side(predicted, False))
            .groupBy(item, "tag")
            .agg(F.bool_or("in_truth").alias("in_truth"), F.bool_or("in_predicted").alias("in_predicted")))


def _outcomes(truth: Column, predicted: Column) -> Column:
    """Each tag of a row once, with whether it is hit, spurious or missed."""
    def marked(tags: Column, tp: int, fp: int, fn: int) -> Column:
        return F.transform(tags, lambda t: F.struct(
            t.alias("tag"), F.lit(tp).alias("tp"), F.lit(fp).alias("fp"), F.lit(fn).alias("fn")))

    return F.concat(
        marked(F.array_intersect(truth, predicted), 1, 0, 0),
        marked(F.array_except(predicted, truth), 0, 1, 0),
        marked(F.array_except(truth, predicted), 0, 0, 1))


def _with_scores(df: DataFrame) -> DataFrame:
    return (df
            .withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp")))
            .withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
            .withColumn("f1", f1(F.col("precision"), F.col("recall"))))


def _tag_sums(df: DataFrame, *by: str) -> DataFrame:
    return (df.select(*by, F.explode_outer("_outcomes").alias("_o"))
            .groupBy(*by, F.col("_o.tag").alias("tag"))
            .agg(*[F.sum(f"_o.{c}").alias(c) for c in ("tp", "fp", "fn")]))


def per_tag_scores(df: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """AG-5: support, precision, recall and F1 per tag in truth or prediction."""
    rows = df.select(_outcomes(F.col(truth), F.col(predicted)).alias("_outcomes"))
    return (_with_scores(_tag_sums(rows).filter(F.col("tag").isNotNull()))
            .withColumn("support", F.col("tp") + F.col("fn"))
            .select("tag", "support", "precision", "recall", "f1"))


def micro_scores(df: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """AG-4: pooled counts and scores; sizes are summed in place, no tag is shuffled."""
    t, p = F.col(truth), F.col(predicted)
    total = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.coalesce(F.sum(F.size(c)), F.lit(0)).alias(name) for name, c in (
            ("tp", F.array_intersect(t, p)), ("fp", F.array_except(p, t)), ("fn", F.array_except(t, p)))])
    return _with_scores(total).withColumnRenamed("f1", "micro_f1")


def macro_f1(df: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """AG-6: mean F1 over every tag in truth or prediction, 0 when there is none."""
    return per_tag_scores(df, truth, predicted).agg(
        F.count(F.lit(1)).alias("tags"), F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"))


def _named_scores(named: DataFrame) -> DataFrame:
    """Micro and macro F1 per prediction set, from one aggregate on (set, tag)."""
    sums = _with_scores(_tag_sums(
        named.select("name", _outcomes(F.col("truth"), F.col("predicted")).alias("_outcomes")), "name"))
    pooled = sums.groupBy("name").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")],
        F.coalesce(F.avg(F.when(F.col("tag").isNotNull(), F.col("f1"))), F.lit(0.0)).alias("macro_f1"))
    return (_with_scores(pooled).withColumnRenamed("f1", "micro_f1")
            .select("name", "micro_f1", "macro_f1"))


def baseline_tags(df: DataFrame, truth: str = "truth", order: str = "ord") -> list[Column]:
    """JN-10: the constant answers to compare with, as one struct each.

    The only thing read here is one number, the median label size; the tags
    themselves stay in one-row subqueries over the written tag counts.
    """
    size = median_label_size(df, truth).first()["median_size"]
    counts = written(tag_counts(df, truth, order), "tag-counts")

    def best(k: int) -> Column:
        return (ranked(counts).limit(k)
                .agg(F.transform(
                    F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "first_seen", "tag"))),
                    lambda s: s["tag"]).alias("tags"))
                .scalar())

    one, prior = best(1), best(size)
    return [
        F.struct(F.concat(F.lit("constant ("), F.array_join(one, ", "), F.lit(")")).alias("name"),
                 one.alias("predicted")),
        F.struct(F.concat(F.lit("prior top-"), F.size(prior).cast("string"), F.lit(" ("),
                          F.array_join(prior, ", "), F.lit(")")).alias("name"),
                 prior.alias("predicted")),
    ]


def compare_baselines(df: DataFrame, truth: str = "truth", predicted: str = "predicted",
                      order: str = "ord") -> DataFrame:
    """AG-7: the predictions and the two label-prior baselines, scored alike.

    A baseline is a constant, so it is written next to each row's own answer
    instead of being joined to it.
    """
    sets = F.array(
        F.struct(F.lit("agent").alias("name"), F.col(predicted).alias("predicted")),
        *baseline_tags(df, truth, order))
    named = (df.select(F.col(truth).alias("truth"), sets.alias("_sets"))
             .select("truth", F.explode("_sets").alias("_set"))
             .select("truth", F.col("_set.name").alias("name"), F.col("_set.predicted").alias("predicted")))
    return _named_scores(named)


def verdict(scores: DataFrame, micro_target: float = fixed.TARGET_MICRO_F1,
            macro_target: float = fixed.TARGET_MACRO_F1) -> DataFrame:
    """AG-7: does the agent beat the best baseline, and both targets?"""
    agent = F.col("name") == "agent"
    return (scores.agg(
        F.max(F.when(agent, F.col("micro_f1"))).alias("micro_f1"),
        F.max(F.when(agent, F.col("macro_f1"))).alias("macro_f1"),
        F.coalesce(F.max(F.when(~agent, F.col("micro_f1"))), F.lit(0.0)).alias("best_baseline"))
        .withColumn("beats_baseline", F.col("micro_f1") > F.col("best_baseline"))
        .withColumn("micro_target_met", F.col("micro_f1") >= micro_target)
        .withColumn("macro_target_met", F.col("macro_f1") >= macro_target))


def exact_matches(df: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """AG-9: add `exact`, whether both name the same tags."""
    return df.withColumn("exact", same_set(F.col(truth), F.col(predicted)))


def failure_kinds(df: DataFrame, error: str = "error", order: str = "ord") -> DataFrame:
    """FLT-5, AG-8, SL-8: failed rows per kind of error, commonest first."""
    return (df.filter(F.coalesce(F.col(error), F.lit("")) != "")
            .groupBy(F.substring_index(error, ":", 1).alias("kind"))
            .agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"))
            .orderBy(F.desc("n"), "_first").select("kind", "n"))


def failure_summary(df: DataFrame, error: str = "error", order: str = "ord") -> DataFrame:
    """AG-8: failed and total rows, and the first error met."""
    failed = F.coalesce(F.col(error), F.lit("")) != ""
    return df.agg(
        F.count_if(failed).alias("failed"), F.count(F.lit(1)).alias("rows"),
        F.min_by(F.when(failed, F.col(error)), F.when(failed, F.col(order))).alias("first_error"))
