"""Few-shot examples for each item, never the item itself."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagspark.functions.images import base64_text, examples_part, media_type


def _draw_order(seed: int | None) -> Column:
    """What a draw is ordered by before the path: nothing, or the SHA-256 of seed, NUL and path."""
    return F.lit("") if seed is None else F.sha2(F.concat(F.lit(f"{seed}\0"), F.col("path")).cast("binary"), 256)


def draw(labelled: DataFrame, limit: int, seed: int | None = None) -> DataFrame:
    """SL-3, SL-4: the first `limit` examples by path, or by a seeded order.

    A limit of 0 draws none. The same seed always gives the same draw.
    """
    return labelled.orderBy(_draw_order(seed), "path").limit(limit)


def _pool(labelled: DataFrame, count: int, seed: int | None) -> Column:
    """The first examples in their order, as one array in a one-row subquery."""
    key = _draw_order(seed)
    content = [base64_text(F.col("content")).alias("content_b64"), media_type(F.col("content")).alias("media_type")]
    carried = [F.col("truth").alias("tags"), *(content if "content" in labelled.columns else [])]
    ordered = F.array_sort(F.collect_list(F.struct(key.alias("k"), "path", *carried)))
    return (draw(labelled, count, seed)
            .agg(F.transform(ordered, lambda e: e.dropFields("k")).alias("pool"))
            .scalar())


def leave_one_out(items: DataFrame, labelled: DataFrame, limit: int, seed: int | None = None) -> DataFrame:
    """JN-6, FLT-7, WN-4: add `examples`, the first `limit` without the item itself.

    An item can take at most its own place in the order, so the first
    `limit` + 1 examples are enough for every item and no join is needed.
    """
    others = F.filter("_pool", lambda e: e["path"] != F.col("path"))
    return (items.withColumn("_pool", _pool(labelled, limit + 1, seed))
            .withColumn("examples", F.slice(others, 1, limit)).drop("_pool"))


@dataclass(frozen=True)
class Pool:
    """The examples of a run, one more than an item is shown: whoever is in the pool is left out of its own."""

    entries: tuple[dict, ...]
    limit: int

    def of(self, path: str) -> list[dict]:
        return [e for e in self.entries if e["path"] != path][:self.limit]

    def key(self, path: Column) -> Column:
        """What an item's examples add to its fingerprint: one constant, and another for each item in the pool."""
        def part(shown: list[dict]) -> Column:
            return F.lit(examples_part([(e["content_b64"], e["tags"]) for e in shown]))

        out = F
        for e in self.entries[:self.limit]:
            out = out.when(path == e["path"], part(self.of(e["path"])))
        common = part(list(self.entries[:self.limit]))
        return out.otherwise(common) if self.entries[:self.limit] else common


def draw_pool(labelled: DataFrame, limit: int, seed: int | None = None) -> Pool:
    """A pool for `limit` examples per item; limit + 1 rows with their images reach the driver, and each task once."""
    rows = draw(labelled, limit + 1 if limit else 0, seed).select(
        "path", F.col("truth").alias("tags"), base64_text(F.col("content")).alias("content_b64"),
        media_type(F.col("content")).alias("media_type")).collect()
    return Pool(tuple(r.asDict() for r in rows), limit)
