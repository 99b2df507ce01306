"""The controlled vocabulary, as plain lists or as a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagspark import fixed

Taxonomy = Mapping[str, Sequence[str]]


def allowed_tags(taxonomy: Taxonomy = fixed.TAXONOMY, extra: Sequence[str] = tuple(fixed.OBSERVED_EXTRA)) -> list[str]:
    """SRC-7, SET-4: every term once, generals before their specifics."""
    terms = [t for general, specifics in taxonomy.items() for t in (general, *specifics)]
    return list(dict.fromkeys([*terms, *extra]))


def family(general: str = fixed.HIGHLIGHT_GENERAL, taxonomy: Taxonomy = fixed.TAXONOMY) -> list[str]:
    return list(taxonomy.get(general, []))


def vocabulary_text(taxonomy: Taxonomy = fixed.TAXONOMY) -> str:
    """S-11: the vocabulary as shown to a scorer, one general per line."""
    return "\n".join(
        f"- {general}" if list(specifics) == [general] else f"- {general}: {', '.join(specifics)}"
        for general, specifics in taxonomy.items())


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """SRC-7: (general, tag) rows of a vocabulary file; extras have no general."""
    book = spark.read.schema(
        "taxonomy map<string, array<string>>, observed_extra array<string>").json(path, multiLine=True)
    pairs = book.select(F.explode("taxonomy").alias("general", "specifics"))
    own = pairs.select("general", F.explode(F.array_union(F.array("general"), "specifics")).alias("tag"))
    extra = book.select(F.lit(None).cast("string").alias("general"), F.explode("observed_extra").alias("tag"))
    return own.unionByName(extra.join(own, "tag", "left_anti"))
