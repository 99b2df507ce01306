"""Expressions over the bytes of an item, and the fingerprint of a request."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagspark import fixed

_NUL = b"\x00"


def media_type(content: Column, fallback: str = fixed.FALLBACK_MEDIA_TYPE) -> Column:
    """S-13: the type the bytes themselves show."""
    known = F.when(
        (F.substring(content, 1, 4) == F.lit(b"RIFF")) & (F.substring(content, 9, 4) == F.lit(b"WEBP")),
        "image/webp",
    )
    for signature, name in fixed.MAGIC_BYTES:
        known = known.when(F.substring(content, 1, len(signature)) == F.lit(signature), name)
    return known.otherwise(fallback)


def base64_text(content: Column) -> Column:
    """S-14: base64 on one line."""
    return F.regexp_replace(F.base64(content), r"[\r\n]", "")


def examples_part(examples: Sequence[tuple[str, Sequence[str]]] = ()) -> bytes:
    """The part of a fingerprint that a run's examples contribute.

    `examples` are (base64 content, tags), a handful per run, so this is one
    constant worked out before the job starts.
    """
    part = b""
    for content, tags in examples:
        part += _NUL + hashlib.sha256(content.encode()).digest()
        part += _NUL + json.dumps(sorted(tags)).encode()
    return part


def examples_key(examples: Column) -> Column:
    """As examples_part, for examples that differ from row to row; the two give the same bytes."""
    def unit(code: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))

    def escaped(char: Column) -> Column:
        code, above = F.ascii(char), F.ascii(char) - 0x10000
        short = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
        out = F
        for plain, written in short.items():
            out = out.when(char == F.lit(plain), F.lit(written))
        return (out.when(code.between(32, 126), char)
                .when(code < 0x10000, unit(code))
                .otherwise(F.concat(unit(F.shiftright(above, 10) + 0xD800), unit(above.bitwiseAND(F.lit(0x3FF)) + 0xDC00))))

    def quoted(tag: Column) -> Column:
        return F.concat(F.lit('"'), F.array_join(F.transform(F.split(tag, ""), escaped), ""), F.lit('"'))

    def part(e: Column) -> Column:
        listed = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(e["tags"]), quoted), ", "), F.lit("]"))
        return F.concat(F.lit(_NUL), F.unhex(F.sha2(e["content_b64"], 256)), F.lit(_NUL), listed.cast("binary"))

    return F.aggregate(F.coalesce(examples, F.array()), F.lit(b""), lambda whole, e: F.concat(whole, part(e)))


def request_key(content_b64: Column, model: Column, context: Column,
                examples: bytes | Column | None = None, extra: str = "") -> Column:
    """S-15: SHA-256 over everything that can change an answer."""
    def raw(text: Column) -> Column:
        return F.coalesce(text, F.lit("")).cast("binary")

    pieces = [raw(content_b64), F.lit(_NUL), raw(model), F.lit(_NUL), raw(context)]
    if examples is not None:
        pieces.append(examples if isinstance(examples, Column) else F.lit(examples))
    if extra:
        pieces.append(F.lit(_NUL + extra.encode()))
    return F.sha2(F.concat(*pieces), 256)
