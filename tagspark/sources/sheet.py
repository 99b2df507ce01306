"""The metadata sheet, whatever its columns are called."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagspark import fixed
from tagspark.functions.text import basename, strip

FIELDS = ("category", "product", "price", "views")


def recognise(headers: Sequence[str]) -> dict[str, str]:
    """Header -> field: the first hint found in it whose field is still free."""
    fields: dict[str, str] = {}
    for header in headers:
        name = header.strip().lower()
        free = (field for hint, field in fixed.COLUMN_HINTS
                if hint in name and field not in fields.values())
        if (field := next(free, None)) is not None:
            fields[header] = field
    return fields


def read_sheet(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """SRC-3: file, category, product, price, views as text, and `ord`, the row order.

    Only recognised columns are read; a field the sheet lacks is NULL. Numbers
    stay text, as a cell may hold `1,234` or `n/a`. Large files are read in
    many tasks, unless cells may hold line breaks: with `multi_line` each file is one task's.
    """
    sheet = spark.read.csv(path, header=True, inferSchema=False, multiLine=multi_line, escape='"')
    fields = recognise(sheet.columns)
    if "file" not in fields.values():
        raise ValueError(f"no file-name column in {path!r}; columns present: {sheet.columns}")
    header_of = {field: header for header, field in fields.items()}
    columns = [strip(basename(F.col(f"`{header_of['file']}`"))).alias("file")]
    for field in FIELDS:
        found = F.col(f"`{header_of[field]}`") if field in header_of else F.lit(None).cast("string")
        columns.append(found.alias(field))
    place = F.struct("_metadata.file_path", "_metadata.file_block_start",
                     F.monotonically_increasing_id().alias("row"))
    return sheet.select(*columns, place.alias("ord"))
