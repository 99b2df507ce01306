"""Many keywords looked for in one pass over a text, by an automaton that every task builds once.

The keywords are the one table that travels to all tasks. `automaton_fits` tells whether they are few
enough for that; where they are not, callers take a way that joins. Executors need pyahocorasick.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
import regex
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# This module travels to the executors with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Keywords and their bytes that are sent to every task: about 100 MB as an automaton.
MOST_KEYWORDS = 500_000
MOST_BYTES = 16_000_000
# What counts as part of a word: the `\w` of a pattern with Unicode classes.
WORD = r"[\p{Alphabetic}\p{M}\p{Nd}\p{Pc}\p{Join_Control}]"


def automaton_fits(keywords: DataFrame, word: str = "key") -> bool:
    """Whether the rows of `keywords` are few and short enough to be sent to every task."""
    n, size = keywords.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(word)), F.lit(0))).first()
    return n <= MOST_KEYWORDS and size <= MOST_BYTES


def _automaton(shared: Broadcast):
    """The automaton over the shared list of (word, value); one per worker, as the broadcast value stays there."""
    import ahocorasick

    held = shared.value
    if "built" not in held:
        found = ahocorasick.Automaton()
        for word, value in held["words"]:
            if word and word not in found:
                found.add_word(word, (value, len(word)))
        found.make_automaton()
        held["built"] = found
    return held["built"]


def _matches(shared: Broadcast, text: str) -> Iterator[tuple[int, tuple[int, int]]]:
    """(place of the last character, (value, length)) of every keyword in the text."""
    built = _automaton(shared)
    return built.iter(text) if len(built) else iter(())


def _pass(df: DataFrame, columns: Sequence[str], text: Column, work, added: str) -> DataFrame:
    """`df` as `columns` and what `work` makes of each value of `text`."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            # One text at a time, and the columns that stay are copied: a batch lies in one piece of
            # memory, which is free again before the next batch comes.
            values = [work(t.as_py()) for t in rows.column(len(columns))]
            whole = pa.array(range(rows.num_rows), pa.int32())
            kept = [c.take(whole) for c in rows.columns[:-1]]
            del rows
            pa.default_memory_pool().release_unused()
            yield pa.RecordBatch.from_arrays([*kept, pa.array(values, kind)], [*columns, name])

    name, sql_type = added.split(" ", 1)
    kind = {"int": pa.int32(), "array<int>": pa.list_(pa.int32())}[sql_type]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*columns).schema)
    return df.select(*columns, text.alias("_text")).mapInArrow(step, f"{schema}, {added}")


def first_keyword(texts: DataFrame, keywords: DataFrame, text: str = "query", word: str = "key", order: str = "ord",
                  keep: Sequence[str] | None = None) -> DataFrame:
    """The texts with `key`, the keyword of least `order` that the lower-cased text holds (ties: the lesser word), or NULL.

    With `keep` only these columns of the texts are returned, and no others travel through Python.
    The empty keyword is part of every text but a NULL one. Rows of `keywords`
    without a word or an order are left out; of a repeated word the least order counts.
    """
    known = keywords.select(F.col(word).alias("_w"), F.col(order).alias("_o")).dropna().groupBy("_w").agg(F.min("_o").alias("_o"))
    # Bounded: callers ask `automaton_fits` first.
    words = [r._w for r in known.orderBy("_o", "_w").select("_w").collect()]
    shared = texts.sparkSession.sparkContext.broadcast({"words": [(w, i) for i, w in enumerate(words)]})
    empty = words.index("") if "" in words else len(words)

    def least(t: str | None) -> int | None:
        if t is None:
            return None
        best = min((v for _, (v, _) in _matches(shared, t)), default=empty)
        return min(best, empty) if min(best, empty) < len(words) else None

    keep = texts.columns if keep is None else list(keep)
    ranked = _pass(texts, keep, F.lower(F.col(text)), least, "_rank int")
    names = keywords.sparkSession.createDataFrame(list(enumerate(words)), f"_rank int, `{word}` string")
    return ranked.join(names, "_rank", "left").select(*keep, word)


def rules_met(texts: DataFrame, rules: Sequence[Sequence[str]], text: str = "text") -> DataFrame:
    """The texts with `rules`, the numbers of the rules of which the lower-cased text holds a keyword at the start of a word.

    A longer word may follow. A NULL text meets no rule.
    """
    # A word of several rules carries the number of its set of rules.
    owners: dict[str, list[int]] = {}
    for number, words in enumerate(rules):
        for w in words:
            if number not in owners.setdefault(w, []):
                owners[w].append(number)
    sets = list(owners.values())
    shared = texts.sparkSession.sparkContext.broadcast({"words": [(w, i) for i, w in enumerate(owners)]})
    inside = regex.compile(WORD)

    def met(t: str | None) -> list[int]:
        found: set[int] = set()
        for end, (value, size) in _matches(shared, t or ""):
            if value not in found and (end < size or not inside.match(t[end - size])):
                found.add(value)
        return sorted({n for v in found for n in sets[v]})

    return _pass(texts, [c for c in texts.columns if c != text], F.lower(F.col(text)), met, "rules array<int>")
