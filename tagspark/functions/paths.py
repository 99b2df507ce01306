"""What a path says about an item: its category, model, labels and position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagspark import fixed
from tagspark.functions.text import SPACE, basename, blank, let, normalise, one_of, strip

_ONE = r"'[^'\\]*+(?:\\.[^'\\]*+)*+'"
_TWO = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_QUOTED = rf"(?:{_ONE}|{_TWO})"
_WORD = rf"(?:{_QUOTED}(?:[{SPACE}]*{_QUOTED})*|[+-]?(?:0|[1-9][0-9]*)|True|False|None)"
_GAP = rf"[{SPACE}]*"
_LIST = rf"(?s)\A\[{_GAP}(?:{_WORD}(?:{_GAP},{_GAP}{_WORD})*+{_GAP},?{_GAP})?\]\z"


def path_parts(path: Column) -> Column:
    """Folder and file names of a path, with `.` and `..` resolved."""
    def resolved(named: Column) -> Column:
        return F.aggregate(
            named,
            F.array().cast("array<string>"),
            lambda kept, p: F.when(
                (p == "..") & (F.size(kept) > 0) & ~F.try_element_at(kept, F.lit(-1)).eqNullSafe(F.lit("..")),
                F.slice(kept, 1, F.size(kept) - 1),
            ).otherwise(F.concat(kept, F.array(p))))

    return let(
        F.array_remove(F.array_remove(F.split(path, "/"), ""), "."),
        lambda named: F.when(F.array_contains(named, ".."), resolved(named)).otherwise(named))


def category_and_model(path: Column, known: Sequence[str] = tuple(fixed.KNOWN_CATEGORIES)) -> Column:
    """S-4: struct of the last known folder and the folder under it.

    The two are found separately: when the last known folder holds the file
    itself, the model named under an earlier known folder stands.
    """
    def read(parts: Column) -> Column:
        # The place of each known folder, NULL for any other part; a greatest place passes over those.
        own = F.size(parts) - 1
        places = F.transform(parts, lambda p, i: F.when((i < own) & one_of(F.lower(p), known), i))
        return let(places, lambda at: F.struct(
            F.get(parts, F.array_max(at)).alias("category"),
            F.get(parts, F.array_max(F.filter(at, lambda i: i + 1 < own)) + 1).alias("model")))

    return let(path_parts(path), read)


def describe(category: Column, model: Column) -> Column:
    """`Category: c, Model: m`, leaving out what is missing or blank."""
    return F.concat_ws(
        ", ",
        F.when(blank(category) != "", F.concat(F.lit("Category: "), category)),
        F.when(blank(model) != "", F.concat(F.lit("Model: "), model)),
    )


def context_from_path(path: Column, known: Sequence[str] = tuple(fixed.KNOWN_CATEGORIES)) -> Column:
    return let(category_and_model(path, known), lambda found: describe(found["category"], found["model"]))


def split_context(context: Column) -> Column:
    """S-5: struct of category and model read back from a context; last wins."""
    def last_value(facts: Column, label: str) -> Column:
        named = F.filter(facts, lambda p: F.lower(p).startswith(label))
        return blank(strip(F.substring(F.try_element_at(named, F.lit(-1)), len(label) + 1, 1 << 30)))

    return let(F.transform(F.split(blank(context), ","), strip), lambda facts: F.struct(
        last_value(facts, "category:").alias("category"), last_value(facts, "model:").alias("model")))


def tags_from_name(path: Column) -> Column:
    """S-3: tags from a file name holding a bracketed list of quoted words."""
    def plain(word: Column) -> Column:
        quoted = F.regexp_extract_all(word, F.lit(f"(?s){_QUOTED}"), 0)
        pieces = F.transform(
            quoted,
            lambda q: F.regexp_replace(F.substring(q, F.lit(2), F.length(q) - 2), r"\\(['\"\\])", "$1"),
        )
        return F.when(F.size(quoted) > 0, F.array_join(pieces, "")).otherwise(word)

    def listed(span: Column) -> Column:
        words = F.regexp_extract_all(span, F.lit(f"(?s){_WORD}"), 0)
        return F.when(span.rlike(_LIST), F.transform(words, lambda w: normalise(plain(w)))).otherwise(
            F.array().cast("array<string>"))

    return let(F.regexp_extract(basename(path), r"(?s)\[.*\]", 0), listed)


def carousel_position(path: Column) -> Column:
    """S-23: first part of the file name that is a number of one or two digits, else 1."""
    parts = F.split(basename(path), "[._]")
    return F.coalesce(
        F.get(F.filter(parts, lambda p: p.rlike(r"\A[0-9]{1,2}\z")), F.lit(0)).cast("int"), F.lit(1))


def lookup_query(context: Column, brand: str = "") -> Column:
    """S-12: the question put to an evidence provider about one product."""
    product = context
    for label, instead in (("Category:", ""), ("Model:", ""), (",", " ")):
        product = F.replace(product, F.lit(label), F.lit(instead))
    # fixed value: the question's wording, as corpus keys are looked for in it
    asked = (": has it won any awards, what do benchmark or lab test results say, "
             "and what is its energy rating?")
    return strip(F.concat(F.lit(f"{brand} "), strip(product), F.lit(asked)))
