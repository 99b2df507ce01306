"""Text and number expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space plus the four ASCII separators, as a regex class body.
SPACE = r"\s\x1C-\x1F"
_SPACES = rf"(?U)[{SPACE}]+"
_EDGES = rf"(?U)\A[{SPACE}]+|[{SPACE}]+\z"
_LINE_END = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85\u2028\u2029]"
_DIGITS = r"[0-9]+(?:_[0-9]+)*"
_FLOAT = (rf"\A[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})"
          rf"(?:[eE][+-]?{_DIGITS})?\z")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, with `value` worked out once however often it is used.

    A Column used twice is evaluated twice, and once per element inside a
    lambda; an array of one element makes it a lambda variable instead.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_array(values: Sequence[str]) -> Column:
    """A constant array of texts, made from one literal and folded by Spark."""
    if not values:
        return F.array().cast("array<string>")
    return F.split(F.lit("\n".join(values)), "\n")


def one_of(text: Column, values: Sequence[str]) -> Column:
    """Is the text among `values`?"""
    return F.array_contains(text_array(values), text)


def normalise(tag: Column) -> Column:
    """S-1: lower case, every run of white space one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(tag), _SPACES, " "))


def strip(text: Column) -> Column:
    """Drop white space at both ends."""
    return F.regexp_replace(text, _EDGES, "")


def lines(text: Column) -> Column:
    """Split on every line break, as an array."""
    return F.split(text, _LINE_END)


def basename(path: Column) -> Column:
    """S-2: what follows the last slash."""
    return F.substring_index(path, "/", -1)


def strict_number(value: Column) -> Column:
    """A decimal number, or NULL when the text is not one or is NaN."""
    text = strip(value.cast("string"))
    infinite = F.lower(F.regexp_replace(text, r"\A[+-]", ""))
    return (
        F.when(text.rlike(_FLOAT), F.regexp_replace(text, "_", "").try_cast("double"))
        .when(infinite.isin("inf", "infinity"),
              F.when(text.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
    )


def tolerant_number(value: Column) -> Column:
    """S-16: as strict_number, ignoring thousands separators."""
    return strict_number(F.regexp_replace(value.cast("string"), ",", ""))


def display_number(value: Column) -> Column:
    """S-17: thousands separators, no decimals, blank when there is no number."""
    number = strict_number(value)
    return (
        F.when(number.isNull(), "")
        .when(number == float("inf"), "inf")
        .when(number == float("-inf"), "-inf")
        .otherwise(F.format_number(number, 0))
    )


def run_id(created: Column) -> Column:
    """S-20: a sortable id for one batch, to the second."""
    return F.date_format(created, "yyyyMMdd-HHmmss")


def blank(text: Column) -> Column:
    """NULL as the empty text."""
    return F.coalesce(text, F.lit(""))


def filled(text: Column) -> Column:
    """The empty text as NULL."""
    return F.nullif(text, F.lit(""))
