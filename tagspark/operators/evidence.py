"""Tags that no picture shows, earned by texts found about a product."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagspark import fixed
from tagspark.functions.text import let
from tagspark.operators.keyed import HOT_ROWS, lookup
from tagspark.operators.keywords import automaton_fits, first_keyword, rules_met

Rules = Mapping[str, Sequence[str]]


def _quoted(keyword: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", keyword)


def rule_pattern(keywords: Sequence[str]) -> str:
    """Any of the keywords, at the start of a word; a longer word may follow."""
    return r"(?U)(?<!\w)(?:" + "|".join(_quoted(k) for k in keywords) + ")"


def _supports(text: Column, keywords: Sequence[str]) -> Column:
    """Does the lower-case text hold a keyword at the start of a word?

    Plain containment is far cheaper than the pattern and rules most texts out.
    """
    held = F.lit(False)
    for keyword in keywords:
        held = held | F.contains(text, F.lit(keyword))
    return held & text.rlike(rule_pattern(keywords))


def _earned(hits: Mapping[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(hit, tag) for tag, hit in hits.items()])).cast("array<string>")


def tags_from_results(results: Column, rules: Rules = fixed.EVIDENCE_RULES) -> Column:
    """S-9: tags one search answer earns; its texts are read as one."""
    read = F.lower(F.array_join(F.transform(
        results, lambda r: F.concat_ws(" ", r["title"], r["snippet"])), " "))
    return let(read, lambda text: _earned(
        {tag: F.coalesce(_supports(text, words), F.lit(False)) for tag, words in rules.items()}))


def tags_by_entity(evidence: DataFrame, entity: str = "entity", rules: Rules = fixed.EVIDENCE_RULES) -> DataFrame:
    """S-9 over a table with one text per row: tags each entity earns.

    Each row is tested by itself and the outcomes are combined, so texts are
    neither shuffled nor gathered; a phrase split over two rows is not seen.
    """
    read = evidence.select(entity, F.lower(F.concat_ws(" ", "title", "snippet")).alias("_text"))
    flags = [F.bool_or(_supports(F.col("_text"), words)).alias(f"_r{i}")
             for i, words in enumerate(rules.values())]
    return (read.groupBy(entity).agg(*flags)
            .select(entity, _earned({tag: F.col(f"_r{i}") for i, tag in enumerate(rules)}).alias("tags")))


def tags_by_keywords(evidence: DataFrame, entity: str = "entity", rules: Rules = fixed.EVIDENCE_RULES) -> DataFrame:
    """`tags_by_entity` for rules of many keywords: one pass over a text whatever their number.

    The rules are held by the caller and travel to every task. Tasks send a
    rule of an entity once.
    """
    read = evidence.select(entity, F.concat_ws(" ", "title", "snippet").alias("_text"))
    met = rules_met(read, list(rules.values()), "_text")
    earned = (met.select(entity, F.explode_outer("rules").alias("_rule")).groupBy(entity)
              .agg(F.array_sort(F.collect_set("_rule")).alias("_rules")))
    names = list(rules)
    return earned.select(entity, F.transform(
        "_rules", lambda i: F.get(F.split(F.lit("\n".join(names)), "\n"), i)).alias("tags"))


def find_evidence(queries: DataFrame, corpus: DataFrame, row_id: str = "query",
                  hot_rows: int = HOT_ROWS) -> DataFrame:
    """JN-9: the first corpus entry whose key is part of the query, as `results`.

    `queries` has one row per distinct `query`, `corpus` has `key`, `ord` and
    `results`. Keys that fit an automaton are found in one pass over a query;
    more of them are joined to its substrings (`find_by_parts`). A query
    without a match has NULL results.
    """
    entries = corpus.filter(F.col("key").isNotNull() & F.col("ord").isNotNull()).groupBy("key").agg(
        F.min_by(F.struct("ord", "results"), "ord").alias("_entry"))
    if not automaton_fits(entries):
        return find_by_parts(queries, corpus, row_id, hot_rows)
    found = first_keyword(queries, entries.select("key", F.col("_entry.ord").alias("ord")))
    return (lookup(found, entries, ["key"], F.col(row_id), hot_rows)
            .select(*queries.columns, F.col("_entry.results").alias("results")))


def find_by_parts(queries: DataFrame, corpus: DataFrame, row_id: str = "query", hot_rows: int = HOT_ROWS) -> DataFrame:
    """`find_evidence` for keys of any number.

    The substrings of a query that are as long as some key are joined to the
    keys, so the work does not grow with queries times keys.
    """
    entries = corpus.groupBy("key").agg(F.min_by(F.struct("ord", "results"), "ord").alias("_entry"))
    lengths = entries.agg(F.array_sort(F.collect_set(F.length("key"))).alias("lengths")).scalar()
    size = F.length("query")
    parts = F.array_distinct(F.flatten(F.transform("_lengths", lambda n: F.when(
        n <= size,
        F.transform(F.sequence(F.lit(1), size - n + 1),
                    lambda at: F.substring(F.lower("query"), at, n))
    ).otherwise(F.array().cast("array<string>")))))
    # explode_outer: a plain explode makes Spark filter on the array first, and
    # that filter would be worked out on every row below the queries.
    probes = (queries.select("query", lengths.alias("_lengths"))
              .select("query", parts.alias("_parts"))
              .select("query", F.explode_outer("_parts").alias("key")))
    best = (lookup(probes, entries, ["key"], F.col(row_id), hot_rows)
            .filter(F.col("_entry").isNotNull())
            .groupBy("query").agg(F.min_by("_entry", F.col("_entry.ord")).alias("_best")))
    return (queries.join(best, "query", "left")
            .select(*queries.columns, F.col("_best.results").alias("results")))
