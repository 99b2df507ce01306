"""S-11: the text a scorer is asked with, as a column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagspark.functions.text import filled
from tagspark.sources.vocabulary import vocabulary_text


@dataclass(frozen=True)
class Wording:
    """The fixed blocks of a prompt; replace any of them to tune a scorer."""

    instruction: str = (
        "Tag this product image. Pick every vocabulary tag the image supports: the general term and "
        "each of its specifics that can be seen. Expect one to four tags. Use no other words as tags.")
    answer_format: str = (
        'Reply with a JSON array of tags and nothing else, e.g. ["physical design", "top"]. '
        "One tag per element, spelled as in the vocabulary.")
    reasoned_format: str = (
        "First give one line per tag: the tag, a dash, and a short reason. Then four lines labelled "
        "Category, Model, Description and Specs, with what the image shows or unknown. Close with a "
        'line holding only the JSON array of the tags, e.g. ["physical design", "top"]; use square '
        "brackets nowhere else.")


def prompt(context: Column, feedback: Column, with_reasons: bool = False, wording: Wording = Wording(),
           vocabulary: str | None = None) -> Column:
    """Instruction, context, vocabulary, answer format and feedback, in this order."""
    terms = vocabulary_text() if vocabulary is None else vocabulary
    form = wording.reasoned_format if with_reasons else wording.answer_format
    return F.concat(
        F.lit(wording.instruction),
        F.coalesce(F.concat(F.lit("\nProduct context: "), filled(context), F.lit(".")), F.lit("")),
        F.lit(f"\n\nControlled vocabulary:\n{terms}\n\n{form}"),
        F.coalesce(F.concat(F.lit("\n\n"), filled(feedback)), F.lit("")))
