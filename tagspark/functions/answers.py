"""Reading a model's raw answer: tags, a reason per tag, and labelled details."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagspark import fixed
from tagspark.functions.text import SPACE, blank, let, lines, normalise, one_of, strip

_GAP = rf"[{SPACE}]"
_INK = rf"[^{SPACE}]"
# fixed values: the shapes of a reason line and of a detail line
_REASON = (rf"(?sU)\A{_GAP}*(?:[-*\u2022]{_GAP}*)?(?:\d+[.)]{_GAP}*)?"
           rf"([A-Za-z][A-Za-z &']{{1,30}}?){_GAP}*[-\u2013:]{_GAP}+({_INK}.*)\z")
# Cheap necessary test: starts like a reason, and has a separator further on.
_MAY_REASON = rf"(?sU)\A[{SPACE}\-*\u2022\d.)]*+[A-Za-z][A-Za-z &']+{_GAP}*[-\u2013:]{_GAP}"
_DETAIL = (rf"(?siU)\A{_GAP}*\**{_GAP}*(category|model|description|specs)"
           rf"{_GAP}*\**{_GAP}*:{_GAP}*({_INK}.*)\z")


def tag_array(text: Column) -> Column:
    """S-6: the first JSON array of the answer, as texts.

    Nulls and objects are left out; an answer without a readable array gives
    an empty array, never an error.
    """
    bare = F.regexp_replace(blank(text), "```(?:json)?", "")

    def read(span: Column) -> Column:
        def written(value: Column, at: Column) -> Column:
            kind = F.schema_of_variant(value)
            # A variant forgets how a number was written, so its text is read again.
            digits = F.get(F.from_json(span, "array<string>"), at)
            number = F.when(digits.rlike("[.eE]"), digits.try_cast("double").cast("string")).otherwise(digits)
            return (F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))
                    .when(kind == "BOOLEAN", F.initcap(F.try_variant_get(value, "$", "string")))
                    .when(~kind.rlike(r"\A(OBJECT|ARRAY|VOID)"), number))

        values = F.try_variant_get(F.try_parse_json(F.nullif(span, F.lit(""))), "$", "array<variant>")
        return F.coalesce(
            F.array_compact(F.transform(values, written)), F.array().cast("array<string>"))

    return let(F.regexp_extract(bare, r"(?s)\[.*?\]", 0), read)


def _cut(text: Column, chars: int | None) -> Column:
    return text if chars is None else F.substring(text, 1, chars)


def clean_reason(text: Column, chars: int | None = None) -> Column:
    """S-22: a reason without closing dots, whole or cut to `chars`."""
    return _cut(F.rtrim(strip(text), F.lit(".")), chars)


def clean_detail(text: Column, chars: int | None = None) -> Column:
    """S-22: a detail without emphasis marks, whole or cut to `chars`; NULL when it says there is none."""
    def stated(value: Column) -> Column:
        nothing = one_of(F.rtrim(F.lower(value), F.lit(".")), fixed.NOTHING_WORDS)
        return F.when(~nothing, _cut(value, chars))

    return let(strip(F.trim(strip(text), F.lit("*"))), stated)


def _first_per_tag(entries: Column) -> Column:
    return let(F.transform(entries, lambda e: e["tag"]), lambda names: F.map_from_entries(F.transform(
        F.array_distinct(names),
        lambda n: F.struct(
            n.alias("key"), F.get(entries, F.array_position(names, n).cast("int") - 1)["why"].alias("value")))))


def reasons(text: Column, vocabulary: Sequence[str], chars: int | None = None) -> Column:
    """S-7: map of tag -> why from the answer's reason lines; first line wins.

    A second tag nested in the reason (`general: specific - why`) counts only
    when it is in the vocabulary.
    """
    def parts(line: Column) -> Column:
        return F.struct(
            normalise(F.regexp_extract(line, _REASON, 1)).alias("tag"),
            clean_reason(F.regexp_extract(line, _REASON, 2), chars).alias("why"))

    def with_nested(reason: Column) -> Column:
        return let(parts(reason["why"]), lambda inner: F.when(
            one_of(inner["tag"], vocabulary), F.array(reason, inner)).otherwise(F.array(reason)))

    found = F.filter(
        F.transform(
            F.filter(lines(blank(text)), lambda s: s.rlike(_MAY_REASON)), parts),
        lambda r: (r["tag"] != "") & ~one_of(r["tag"], fixed.DETAIL_LABELS))
    return let(F.flatten(F.transform(found, with_nested)), _first_per_tag)


def details(text: Column, chars: int | None = None) -> Column:
    """S-8: struct of the labelled facts, NULL where the answer states none."""
    found = F.filter(
        F.transform(
            F.filter(lines(blank(text)), lambda s: s.rlike(_DETAIL)),
            lambda s: F.struct(
                F.lower(F.regexp_extract(s, _DETAIL, 1)).alias("label"),
                clean_detail(F.regexp_extract(s, _DETAIL, 2), chars).alias("value"))),
        lambda d: d["value"].isNotNull())

    def first(stated: Column, label: str) -> Column:
        return F.get(F.filter(stated, lambda d: d["label"] == label), F.lit(0))["value"].alias(label)

    return let(found, lambda stated: F.struct(*[first(stated, label) for label in fixed.DETAIL_LABELS]))


FIELDS = ("tags", "reasons", "category", "product", "description", "specs")


def prediction(text: Column, vocabulary: Sequence[str], fields: Sequence[str] = FIELDS) -> Column:
    """A whole answer as one struct; what is missing is blank, never an error.

    Only the `fields` named are worked out. Spark does not drop them itself
    where a reader uses the struct more than once.
    """
    stated = {"category": "category", "product": "model", "description": "description", "specs": "specs"}

    def whole(facts: Column | None) -> Column:
        made = {"tags": lambda: tag_array(text), "reasons": lambda: reasons(text, vocabulary),
                **{name: lambda label=label: blank(facts[label]) for name, label in stated.items()}}
        return F.struct(*[made[f]().alias(f) for f in fields])

    return let(details(text), whole) if set(fields) & set(stated) else whole(None)
