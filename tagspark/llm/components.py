"""Connected components of links by contraction, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagspark.session import written


# Rows of two numbers (16 MB of them) that may be handed to every task; larger tables are joined by a shuffle.
BROADCAST_PAIRS = 1_000_000
# Files of a table of few rows, and rows of a file of one with more.
FILES, FILE_ROWS = 8, 250_000


def handed(pairs: DataFrame) -> DataFrame:
    """A written table of two numbers per row, marked for broadcast where its rows are counted and few enough."""
    return F.broadcast(pairs) if pairs.count() <= BROADCAST_PAIRS else pairs


def renamed(links: DataFrame, names: DataFrame) -> DataFrame:
    """`links` (a, b) with every node that `names` (node, root) lists by its root; links within a root go."""
    names = handed(names)
    ends = (links.join(names.select(F.col("node").alias("a"), F.col("root").alias("x")), "a", "left")
            .join(names.select(F.col("node").alias("b"), F.col("root").alias("y")), "b", "left")
            .select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y")))
    return ends.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def joined(first: DataFrame, second: DataFrame, few: bool = False) -> DataFrame:
    """The names (node, root) of `first`, with its roots renamed by `second`, and those that only `second` has."""
    moved = first.join(handed(second).select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select(
        "node", F.coalesce("to", "root").alias("root"))
    fresh = second.join(handed(first).select("node"), "node", "left_anti")
    return _kept(moved.unionByName(fresh.select("node", "root")), "roots", few)


def in_files(df: DataFrame, name: str, rows: int) -> DataFrame:
    """`df`, of at most `rows` narrow rows, written in as many files as they fill rather than one for each task before."""
    return written(df.coalesce(max(FILES, rows // FILE_ROWS)), name)


def _kept(df: DataFrame, name: str, few: bool) -> DataFrame:
    """`df` written; in a handful of files where its rows are known to be few, as each file costs more than it holds."""
    return written(df.coalesce(FILES) if few else df, name)


def flattened(hooks: DataFrame, few: bool = False) -> DataFrame:
    """`hooks` (node, root) with every node by the end of its chain of roots; each step halves the chains' lengths."""
    while True:
        above = handed(hooks).select(F.col("node").alias("root"), F.col("root").alias("to"))
        hooks = _kept(hooks.join(above, "root", "left").select(
            "node", F.coalesce("to", "root").alias("root"), (F.col("to") != F.col("root")).alias("moved")), "hooks", few)
        if hooks.filter("moved").isEmpty():
            return hooks.drop("moved")
        hooks = hooks.drop("moved")


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of `links` (columns a, b): root is the smallest node it can reach.

    Each round hooks every node to its smallest neighbour, follows the hooks to
    their ends by pointer jumping and renames the links by them; links inside a
    merged node vanish. A node that stays its own root while others of its
    component remain has a smaller neighbour in the next round, so the rounds,
    like the jumps of one, grow with the logarithm of the links. The smallest
    node of a component never moves, so it is what remains. The minimum combines
    before the shuffle, and a node with very many links is spread by the joins' skew handling.
    """
    few = links.count() <= BROADCAST_PAIRS
    links = _kept(links.filter("a <> b").select("a", "b"), "links", few)
    found = None
    while not links.isEmpty():
        ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = flattened(_kept(ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to"))
                                .select("node", F.least("node", "to").alias("root")), "hooks", few), few)
        found = hooks if found is None else joined(found, hooks, few)
        links = _kept(renamed(links, hooks), "links", few)
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")) if found is None else found
