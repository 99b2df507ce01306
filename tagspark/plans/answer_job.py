"""JOB-7: raw answers to predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagspark.functions.answers import FIELDS, prediction


def parse_answers(answers: DataFrame, vocabulary: Sequence[str], text: str = "text",
                  fields: Sequence[str] = FIELDS) -> DataFrame:
    """Add `prediction`, of all fields or those named; a malformed answer has empty fields and never fails."""
    return answers.withColumn("prediction", prediction(F.col(text), vocabulary, fields))
