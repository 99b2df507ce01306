import random

import numpy as np
from pyspark.sql import functions as F

from tagspark.llm import toxicity
from tagspark.llm.common import held_out

ALL = "true"


def test_pairs_are_learned_that_no_sum_can_hold():
    """Toxic is one of two terms alone would not be: both together count, and so does neither."""
    rng = random.Random(1)
    terms = toxicity.Terms(prefixes=())
    rows, labels = [], []
    for _ in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        text = " ".join(["calm", "talk"] + ["insult"] * a + ["group"] * b)
        rows.append(terms.of(text))
        labels.append(float(a and b))
    m = toxicity.fit(rows, np.array(labels), epochs=20)
    used = toxicity.Terms(prefixes=(), used=m.used)
    both, one, other = (m.score(*used.of(t)) for t in ("insult group", "insult", "group"))
    assert both > 0.8 and one < 0.2 and other < 0.2
    at, x = used.of("insult group")
    linear = m.bias + m.weights[at] @ x
    assert 1 / (1 + np.exp(-linear)) != both


def test_score_is_the_formula():
    rng = np.random.default_rng(2)
    m = toxicity.Machine(0.3, np.arange(6), rng.normal(size=6), rng.normal(size=(6, 4)))
    at, x = np.array([0, 2, 5]), np.array([0.7, 1.1, 2.0])
    z = 0.3 + m.weights[at] @ x + sum(m.factors[at[i]] @ m.factors[at[j]] * x[i] * x[j] for i in range(3) for j in range(i + 1, 3))
    assert abs(m.score(at, x) - 1 / (1 + np.exp(-z))) < 1e-12


def test_held_out_rows_of_a_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    m = toxicity.train(docs, labels, ~held_out("doc_id", 4, 2))
    scored = toxicity.score(docs, m).join(labels, "doc_id").filter(held_out("doc_id", 4, 2)).collect()
    caught = [r.score >= 0.3 for r in scored if r.toxic == 1]
    wrong = [r.score >= 0.3 for r in scored if r.toxic == 0]
    assert np.mean(wrong) < 0.02 and np.mean(caught) > 0.5


def test_labels_of_held_out_rows_change_nothing(spark, make, prose):
    docs = make(*[(i, prose(i, 30) + (" slur" if i % 3 == 0 else "")) for i in range(200)])
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    turned = labels.withColumn("toxic", F.when(held_out("doc_id", 4, 2), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (toxicity.train(docs, l, ~held_out("doc_id", 4, 2)) for l in (labels, turned))
    assert one.bias == two.bias and (one.weights == two.weights).all() and (one.factors == two.factors).all()


def test_edges(spark, make, prose):
    docs = make((1, None), (2, ""), (3, "123 !"), (4, prose(1, 20_000)), (4, "x"), (None, "x"))
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, None), (None, 1), (9, 1), (2, 7)], "doc_id bigint, toxic int")
    m = toxicity.train(docs, labels, F.expr(ALL))
    out = toxicity.score(docs, m).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 for r in out)
    assert set(out[0].asDict()) == set(docs.columns)
    none = toxicity.train(make(), labels.limit(0), F.expr(ALL))
    assert none.score(np.zeros(0, int), np.zeros(0)) == 0.5
    assert toxicity.score(make(), none).collect() == []


def test_the_sample_has_its_bound(spark, make, prose):
    docs = make(*[(i, prose(i, 5)) for i in range(60)])
    labels = docs.select("doc_id", F.lit(1).alias("toxic"))
    m = toxicity.train(docs, labels, F.expr(ALL), sample=20)
    assert abs(m.bias - np.log(20.5 / 0.5)) < 1e-9
