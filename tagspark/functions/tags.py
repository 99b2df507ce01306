"""Expressions over arrays of tags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagspark import fixed
from tagspark.functions.text import let, normalise, one_of


def kept_tags(raw: Column, vocabulary: Sequence[str]) -> Column:
    """PRJ-1: normalised tags inside the vocabulary, each once, in order."""
    return F.array_distinct(
        F.filter(F.transform(raw, normalise), lambda t: one_of(t, vocabulary)))


def dropped_tags(raw: Column, vocabulary: Sequence[str]) -> Column:
    """PRJ-1: tags outside the vocabulary, as spelled, repeats and all."""
    return F.filter(raw, lambda t: ~one_of(normalise(t), vocabulary))


def highlights(tags: Column, family: Sequence[str]) -> Column:
    """PRJ-2: the tags that belong to one family, as spelled and in order."""
    return F.filter(tags, lambda t: one_of(normalise(t), family))


def reasons_for(kept: Column, why: Column) -> Column:
    """PRJ-3: only the reasons of tags that were kept."""
    return F.map_filter(why, lambda tag, _: F.array_contains(kept, tag))


def looks_weak(kept: Column, dropped: Column) -> Column:
    """FLT-1: nothing kept, or more dropped than kept."""
    return (F.size(kept) == 0) | (F.size(dropped) > F.size(kept))


def jaccard(first: Column, second: Column) -> Column:
    """SET-3: shared tags over all tags; two empty answers agree."""
    either = F.size(F.array_union(first, second))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(first, second)) / either)


def same_set(first: Column, second: Column) -> Column:
    """AG-9: the same tags, whatever their order."""
    return F.array_sort(F.array_distinct(first)) == F.array_sort(F.array_distinct(second))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 when there is no whole."""
    return F.when(whole == 0, 0.0).otherwise(part / whole)


def f1(precision: Column, recall: Column) -> Column:
    """S-19."""
    return F.when(precision + recall == 0, 0.0).otherwise(
        2 * precision * recall / (precision + recall))


def feedback(dropped: Column, kept: Column, most: int | None = None) -> Column:
    """S-10: what to tell the scorer about its last answer; all dropped tags are named, or the first `most`."""
    named = F.array_join(
        F.transform(dropped if most is None else F.slice(dropped, 1, most),
                    lambda t: F.concat(F.lit("'"), t, F.lit("'"))), ", ")
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("Valid tags kept: "), F.size(kept).cast("string"), F.lit(".")))
    tail = tail.otherwise("No valid tag was left.")
    return F.when(
        F.size(dropped) == 0,
        "The last answer held no usable tag. Look once more and name at least one vocabulary tag.",
    ).otherwise(F.concat(
        F.lit("The last answer named "), named,
        F.lit(", which the vocabulary does not hold. "), tail,
        F.lit(" Answer again with vocabulary tags only, spelled as listed.")))


def warnings(tags: Column, reasons: Column, attempts: Column) -> Column:
    """S-18: what a reviewer should know about one row, as an array of texts."""
    tags = F.coalesce(tags, F.array().cast("array<string>"))
    unexplained = F.exists(tags, lambda t: ~F.array_contains(F.map_keys(reasons), t))
    return F.array_compact(F.array(
        F.when(F.coalesce(attempts, F.lit(1)) > 1, fixed.WARNING_TEXTS["again"]),
        F.when((F.size(F.map_keys(reasons)) > 0) & unexplained, fixed.WARNING_TEXTS["unexplained"]),
        F.when(F.size(tags) == 1, fixed.WARNING_TEXTS["single"]),
    ))


def confidence(tags: Column, reasons: Column, attempts: Column) -> Column:
    """S-18: struct of verdict and why."""
    untagged = F.coalesce(F.size(tags), F.lit(0)) <= 0

    def judged(found: Column) -> Column:
        verdict = (F.when(untagged, fixed.VERDICTS["none"])
                   .when(F.size(found) == 0, fixed.VERDICTS["clean"])
                   .when(F.size(found) == 1, fixed.VERDICTS["one"])
                   .otherwise(fixed.VERDICTS["more"]))
        why = (F.when(untagged, fixed.WARNING_TEXTS["untagged"])
               .when(F.size(found) == 0, fixed.WARNING_TEXTS["clean"])
               .otherwise(F.array_join(found, ", ")))
        return F.struct(verdict.alias("verdict"), why.alias("why"))

    return let(warnings(tags, reasons, attempts), judged)


def is_transient(status: Column, error_type: Column) -> Column:
    """S-21: would the same request stand a chance if sent again?"""
    return F.when(
        status.isNotNull(), status.isin(fixed.TRANSIENT_STATUS) | (status >= 500)
    ).otherwise(F.coalesce(error_type.isin(fixed.TRANSIENT_TYPES), F.lit(False)))
