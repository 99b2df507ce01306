"""JOB-8: tags proposed by what is written about a product."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagspark import fixed
from tagspark.functions.paths import lookup_query
from tagspark.operators.evidence import Rules, find_evidence, tags_from_results
from tagspark.session import written


def proposals(contexts: DataFrame, corpus: DataFrame, rules: Rules = fixed.EVIDENCE_RULES,
              brand: str = "") -> DataFrame:
    """FLT-8, U-2: `proposed` tags of each distinct non-blank context.

    Many items share a product, so each context is looked up once.
    """
    asked = written(
        contexts.select("context").filter(F.coalesce("context", F.lit("")) != "").distinct()
        .withColumn("query", lookup_query(F.col("context"), brand)), "contexts")
    answered = find_evidence(asked.select("query").distinct(), corpus)
    return (asked.join(answered, "query", "left")
            .select("context", F.coalesce(
                tags_from_results(F.col("results"), rules), F.array().cast("array<string>")).alias("proposed")))
