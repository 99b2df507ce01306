"""License texts in documents, by an exact set-similarity join. DataFrame functions only.

Blocks are windows of a text's words, each overlapping the next by half, wide
enough that a passage as long as the longest template lies wholly in one. A
block meets a template when it holds at least `threshold` of the template's
distinct tokens. Tokens are ordered by how often they occur in all documents, rare ones first, and then:

- prefix filter: a block that meets the threshold holds one of the template's
  |T| - need + 1 rarest tokens, so only those are looked up;
- length filter: it holds at least `need` tokens of the templates' vocabulary;
- positional filter: behind a shared token at place i of the template and j of
  the block, at most min(|T| - i, |B| - j) tokens (the shared one included) can
  be shared, and none before the first shared one.

Pairs that pass are verified on the whole sets. Tokens in no template cannot be
shared, so a block's set keeps only the others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagspark.llm.common import row_key
from tagspark.session import written

# fixed values: the phrases of the base rule, with their labels
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Statements and sentences of public licenses, with labels. Each is matched as a set of tokens.
TEMPLATES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the apache license version 2 0": "apache",
    "you may not use this file except in compliance with the license": "apache",
    "this work is licensed under the gnu general public license version 3": "gpl",
    "you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "under the terms of the gnu lesser general public license": "lgpl",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by 4 0": "cc-by",
    "licensed under a creative commons attribution 4 0 international license": "cc-by",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "subject to the terms of the mozilla public license v 2 0": "mpl",
    "all rights reserved no part may be reproduced without permission": "proprietary",
}
THRESHOLD = 0.8
DELIMITERS = "".join(c for c in map(chr, range(0x80)) if not ("0" <= c <= "9" or "a" <= c <= "z"))


def words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits and of characters beyond ASCII; none for a null text.

    One character beyond ASCII, the Kelvin sign, would become an ASCII letter by lower-casing and is replaced before.
    """
    plain = F.btrim(F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u212b"))), F.lit(DELIMITERS))
    split = F.split(plain, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
    return F.coalesce(F.array_remove(split, ""), F.array().cast("array<string>"))


def phrase_places(name: str, phrases: dict[str, str]) -> Column:
    """array<struct<first, label>> of the places where a phrase's words stand one behind another in the array column `name`."""
    out = []
    for phrase, label in phrases.items():
        parts = phrase.split()
        n = len(parts)
        stands = " AND ".join(f"{name}[i + {k}] = '{parts[k]}'" for k in reversed(range(n)))
        out.append(F.expr(f"CASE WHEN size({name}) >= {n} AND array_contains({name}, '{parts[-1]}') THEN "
                          f"transform(filter(sequence(0, size({name}) - {n}), i -> {stands}), i -> struct(i AS first, '{label}' AS label)) "
                          "ELSE array() END").cast("array<struct<first:int,label:string>>"))
    return F.concat(*out)


def _need(tokens: int, threshold: float) -> int:
    """The least number of shared tokens that is at least `threshold` of them."""
    return next(n for n in range(tokens + 1) if n >= threshold * tokens - 1e-9)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] = TEMPLATES,
         phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks.

    n_base counts the places of the phrases and first_word and last_word bound
    them; blocks (start, n_words, label, template, containment) are the
    text blocks that meet a template. score is 1 where a phrase stands, else the
    best containment of a block that meets its template, else 0. Null and empty texts
    have no words. Repeated rows, and rows with null ids, count for themselves;
    other columns are not read; an empty table gives no rows.
    """
    keyed, _ = row_key(docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("text")), "doc_id", "_row")
    sets = {t: sorted(set(t.split())) for t in templates}
    vocabulary = sorted({w for s in sets.values() for w in s})
    half = max(len(t.split()) for t in templates)

    # One pass over all words; as many rows come back as the templates have tokens.
    # The outer form, as for the inner one Spark adds a filter that splits every text a second time.
    seen = keyed.select(F.explode_outer(words(F.col("text"))).alias("word")).filter(F.col("word").isin(*vocabulary))
    counted = {r.word: r.n for r in seen.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counted.get(w, 0), w)))}
    ranked = {t: sorted(s, key=order.get) for t, s in sets.items()}
    need = {t: _need(len(s), threshold) for t, s in sets.items()}
    rare = sorted({w for t, s in ranked.items() for w in s[:len(s) - need[t] + 1]})

    ranks = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    spotted = F.filter(F.transform("words", lambda w, at: F.struct(at.alias("at"), F.element_at(ranks, w).alias("rank"))),
                       lambda s: s["rank"].isNotNull())
    probe = F.arrays_overlap("words", F.array(*[F.lit(w) for w in rare]))
    marked = written(keyed.select("doc_id", "_row", words(F.col("text")).alias("words")).select(
        "doc_id", "_row", F.size("words").cast("bigint").alias("n_words"), phrase_places("words", phrases).alias("places"),
        F.when(probe, spotted).alias("spots")), "template-tokens")
    # Each place lies in two blocks, the one that starts in its own half and the one before.
    half_of = F.floor(F.col("s.at") / half).cast("bigint")
    blocks = (marked.filter("spots IS NOT NULL").select("_row", F.explode("spots").alias("s"))
              .select("_row", F.explode(F.array(half_of, half_of - 1)).alias("block"), F.col("s.rank").alias("rank"))
              .filter("block >= 0").groupBy("_row", "block").agg(F.sort_array(F.collect_set("rank")).alias("tokens"))
              .filter(F.size("tokens") >= min(need.values())))
    prefixes = [(order[w], i, k) for k, (t, s) in enumerate(ranked.items()) for i, w in enumerate(s[:len(s) - need[t] + 1])]
    table = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(
        ("rank", "i", "template"), row)]) for row in prefixes]))
    spark = docs.sparkSession
    names = list(ranked)
    prefix = spark.range(1, numPartitions=1).select(table.alias("p")).select("p.*")
    sizes = F.array(*[F.lit(len(ranked[t])) for t in names])
    needs = F.array(*[F.lit(need[t]) for t in names])
    whole = F.array(*[F.array(*[F.lit(order[w]) for w in ranked[t]]) for t in names])
    probes = blocks.select("_row", "block", "tokens", F.posexplode("tokens").alias("j", "rank"))
    # As many rows as the templates have prefix tokens.
    candidates = (probes.join(F.broadcast(prefix), "rank")
                  .withColumn("size", F.get(sizes, F.col("template"))).withColumn("need", F.get(needs, F.col("template")))
                  .filter(F.size("tokens") >= F.col("need"))
                  .groupBy("_row", "block", "template").agg(F.min(F.struct("j", "i")).alias("first"), F.first("tokens").alias("tokens"),
                                                            F.first("size").alias("size"), F.first("need").alias("need"))
                  .filter(F.least(F.col("size") - F.col("first.i"), F.size("tokens") - F.col("first.j")) >= F.col("need")))
    shared = F.size(F.array_intersect("tokens", F.get(whole, F.col("template"))))
    met = (candidates.withColumn("shared", shared).filter(F.col("shared") >= F.col("need"))
           .select("_row", F.struct(
               (F.col("block") * half).alias("start"), F.lit(2 * half).alias("n_words"),
               F.get(F.array(*[F.lit(templates[t]) for t in names]), F.col("template")).alias("label"),
               F.get(F.array(*[F.lit(t) for t in names]), F.col("template")).alias("template"),
               (F.col("shared") / F.col("size")).alias("containment")).alias("block"))
           .groupBy("_row").agg(F.sort_array(F.collect_list("block")).alias("blocks")))
    base = F.transform("places", lambda p: p["label"])
    met_blocks = F.coalesce(F.col("blocks"), F.array().cast(met.schema["blocks"].dataType))
    return (marked.drop("spots").join(met, "_row", "left").withColumn("blocks", met_blocks)
            .select("doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"),
                    F.array_min(F.transform("places", lambda p: p["first"])).cast("bigint").alias("first_word"),
                    F.array_max(F.transform("places", lambda p: p["first"])).cast("bigint").alias("last_word"),
                    F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
                    F.array_join(F.array_sort(F.array_union(base, F.transform("blocks", lambda b: b["label"]))), ",").alias("labels"),
                    F.when(F.size("places") > 0, 1.0).otherwise(
                        F.coalesce(F.array_max(F.transform("blocks", lambda b: b["containment"])), F.lit(0.0))).alias("score"),
                    "blocks"))
