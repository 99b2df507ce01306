"""Keywords by automaton against plain loops, and against the joins they stand in for."""

import random
import re

import pytest

from tagspark.operators import evidence, keywords

TEXTS = "id int, query string"


def first_of(text, words):
    """The first word in order that the lower-cased text holds."""
    return next((w for w in words if text is not None and w in text.lower()), None)


def test_first_keyword_of_many(spark):
    rng = random.Random(1)
    word = lambda low, high: "".join(rng.choices("abcdé ", k=rng.randint(low, high)))
    words = list(dict.fromkeys(word(2, 6) for _ in range(400)))
    texts = [(i, word(0, 40).upper() if i % 2 else word(0, 40)) for i in range(300)] + [(-1, None), (-2, "")]
    order = {w: rng.random() for w in words}
    corpus = spark.createDataFrame([*order.items(), (words[0], 2.0), (None, 0.0), ("a", None)], "key string, ord double")
    got = {r.id: r.key for r in keywords.first_keyword(spark.createDataFrame(texts, TEXTS), corpus).collect()}
    ranked = sorted(words, key=order.get)
    assert got == {i: first_of(t, ranked) for i, t in texts}
    # The empty keyword is part of every text, and comes first only where its order does.
    more = spark.createDataFrame([*order.items(), ("", 0.5)], "key string, ord double")
    got = {r.id: r.key for r in keywords.first_keyword(spark.createDataFrame(texts, TEXTS), more).collect()}
    ranked = sorted([*words, ""], key={**order, "": 0.5}.get)
    assert got == {i: first_of(t, ranked) for i, t in texts}
    none = keywords.first_keyword(spark.createDataFrame(texts, TEXTS), corpus.limit(0))
    assert {r.key for r in none.collect()} == {None}


def test_a_hundred_thousand_keys_and_no_row_per_substring(spark):
    corpus = spark.range(100_000).selectExpr(
        "concat('key', lpad(id, 6, '0'), '.') AS key", "id AS ord", "array(named_struct('title', 't', 'snippet', '', 'url', cast(id AS string))) AS results")
    queries = spark.createDataFrame(
        [(f"Model KEY{i * 97 % 100_000:06d}. and key{(i * 31 + 5) % 100_000:06d}.",) for i in range(500)] + [("nothing",), (None,)], "query string")
    found = evidence.find_evidence(queries, corpus)
    got = {r["query"]: r["results"] and int(r["results"][0]["url"]) for r in found.collect()}
    for q, url in got.items():
        assert url == (min(map(int, re.findall(r"key(\d{6})\.", q.lower())), default=None) if q else None)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_both_ways_agree(spark, monkeypatch):
    rng = random.Random(2)
    word = lambda low, high: "".join(rng.choices("ab ", k=rng.randint(low, high)))
    corpus = spark.createDataFrame([(word(0 if i == 0 else 1, 4), i, [(f"t{i}", "", "")]) for i in range(20)],
                                   "key string, ord int, results array<struct<title: string, snippet: string, url: string>>")
    queries = spark.createDataFrame([(q,) for q in {word(0, 12) for _ in range(100)}], "query string")
    rows = lambda df: sorted((r["query"], r["results"][0]["title"] if r["results"] else "") for r in df.collect())
    by_automaton = rows(evidence.find_evidence(queries, corpus))
    monkeypatch.setattr(keywords, "MOST_KEYWORDS", 5)
    assert not keywords.automaton_fits(corpus)
    assert rows(evidence.find_evidence(queries, corpus)) == rows(evidence.find_by_parts(queries, corpus)) == by_automaton


@pytest.mark.parametrize("text", ["MIT license", "permit licenses", "_apache", "a-apache", "é́gpl", "1gpl", "‿gpl", "(GPL)", "gpl gpl", "", None,
                                  "ⓐgpl", "ⅷgpl", "x‍gpl", "\tunder the gnu general public", "apachelike"])
def test_rules_at_the_start_of_a_word(spark, text):
    rules = {"licence": ["license"], "permissive": ["mit license", "apache"], "copyleft": ["gnu general", "gpl", "license"]}
    rows = spark.createDataFrame([("e", "", text), ("f", "", "gpl"), ("f", "", "mit license"), ("g", None, None)],
                                 "entity string, title string, snippet string")
    tags = lambda df: sorted((r.entity, r.tags) for r in df.collect())
    assert tags(evidence.tags_by_keywords(rows, rules=rules)) == tags(evidence.tags_by_entity(rows, rules=rules))


def test_only_kept_columns_travel(spark, monkeypatch):
    given, plain = [], keywords._pass
    monkeypatch.setattr(keywords, "_pass", lambda df, columns, *rest: given.append(list(columns)) or plain(df, columns, *rest))
    texts = spark.createDataFrame([(1, "a red bolt", "x"), (2, None, "y"), (3, "nothing", None)], "id int, query string, more string")
    words = spark.createDataFrame([("bolt", 2), ("red", 1)], "key string, ord int")
    some = keywords.first_keyword(texts, words, keep=["more", "id"])
    assert given == [["more", "id"]] and some.columns == ["more", "id", "key"]
    assert sorted(some.collect(), key=lambda r: r.id) == [("x", 1, "red"), ("y", 2, None), (None, 3, None)]
