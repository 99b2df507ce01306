import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from tagspark.llm import language
from tagspark.llm.common import held_out

ALL = "true"


def test_bundles_are_sums_of_bound_vectors():
    grams = language.Grams(256)
    names, counts = grams.of("Abé, ab")
    want = np.zeros(256)
    text = " abé ab "
    for i in range(len(text) - 2):
        bound = np.ones(256)
        for place, c in enumerate(reversed(text[i:i + 3])):
            bound *= np.roll(grams.letter_vector(ord(c)), place)
        want += bound
    assert (grams.bundle([(names, counts)])[0] == want).all()


def test_a_full_table_changes_nothing():
    small, large = language.Grams(128, entries=12), language.Grams(128)
    for text in ("the cat sat", "on a mat", "un chien noir", "the cat sat"):
        found = small.of(text)
        assert (small.bundle([found]) == large.bundle([found])).all()


def test_more_grams_than_the_table_holds_are_added_run_by_run():
    small, large = language.Grams(64, entries=7), language.Grams(64)
    texts = [small.of(t) for t in ("the cat sat on a mat, the cat sat", "un chien noir et un chat", "x")]
    assert (small.bundle(texts) == large.bundle(texts)).all()
    assert len(small.known) <= 7


def test_memory_does_not_grow_with_a_text():
    grams = language.Grams(256, entries=1000)
    long = "".join(chr(0x4E00 + (i * 7919 + i // 20_000) % 20_000) for i in range(30_000))
    found = grams.of(long)
    assert len(found[0]) > 20_000
    grams.bundle([grams.of("ab")])
    tracemalloc.start()
    grams.bundle([found])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(grams.vectors) <= 1000 and peak < 30e6


def test_order_of_letters_counts():
    grams = language.Grams()
    a, b = (grams.bundle([grams.of(t)])[0] for t in ("abc", "cba"))
    assert abs(a @ b) / (np.linalg.norm(a) * np.linalg.norm(b)) < 0.2


def test_held_out_rows_of_a_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    names, vectors = language.prototypes(language.learn(docs, ~held_out("doc_id", 5, 0)))
    out = language.predict(docs, names, vectors).filter(held_out("doc_id", 5, 0)).collect()
    assert np.mean([r.lang_pred == r.lang for r in out]) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_learning_splits_as_one_would(spark, make, prose):
    docs = make(*[(i + 1, prose(i, 40)) for i in range(50)]).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b"))
    one = {(r.lang, r.dim): r.value for r in language.learn(docs.repartition(1), F.expr(ALL)).collect()}
    many = {(r.lang, r.dim): r.value for r in language.learn(docs.repartition(7), F.expr(ALL)).collect()}
    assert one == many


def test_edges(make, prose):
    docs = make((1, None), (2, ""), (3, "12 ;"), (4, prose(1, 20_000)), (4, "é"), (None, "x"))
    none = language.predict(docs, *language.prototypes(language.learn(docs.filter("false"), F.expr(ALL))))
    assert {(r.lang_pred, r.score) for r in none.collect()} == {("und", 0.0)}
    names, vectors = language.prototypes(language.learn(docs, F.expr(ALL)))
    assert names == ["en"]
    out = language.predict(docs, names, vectors).collect()
    assert sorted((r.doc_id or 0, r.lang_pred) for r in out) == [(0, "en"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en")]
    assert language.predict(make(), names, vectors).collect() == []
