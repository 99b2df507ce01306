import hashlib
import math

import numpy as np
import pytest

from tagspark.llm import vector_codes as V

SCHEMA = "vec_id bigint, vector array<float>, label int, code string, error int, part int, entry string"


def plain(rows, parts=4, entries=256, rounds=4):
    """The rules in plain loops over Python integers: rows by id, and the digest of the codebooks."""
    kept = [(i, [math.floor(1024 * x) for x in v], y) for i, v, y in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    size = len(kept[0][1]) // parts
    cut = lambda v: [v[p * size:(p + 1) * size] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda part, book: min((far(part, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        members = [{} for _ in range(parts)]
        for _, v, _ in kept:
            for p, part in enumerate(cut(v)):
                members[p].setdefault(near(part, books[p])[1], []).append(part)
        for p in range(parts):
            for k, own in members[p].items():
                books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    out = []
    for i, v, y in kept:
        found = [near(part, books[p]) for p, part in enumerate(cut(v))]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), y))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    totals = {}
    for *_, error, y in out:
        totals[y] = totals.get(y, 0) + error
    return sorted(((i, c, e, totals[y], sha) for i, c, e, y in out), key=repr)


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, v, y, "x", 7, 8, "z") for i, v, y in rows], SCHEMA)
    return sorted(map(tuple, V.with_label_errors(*V.compress(df, **more)).collect()), key=repr)


def test_nearest_is_that_of_all_entries():
    rng = np.random.default_rng(3)
    for d, spread in ((1, 5), (3, 4), (16, 200), (16, 3)):
        book, x = rng.integers(-spread, spread, (50, d)), rng.integers(-spread, spread, (400, d))
        far = ((x[:, None] - book[None]) ** 2).sum(2)
        who, best = V.nearest(x, book)
        assert (who == far.argmin(1)).all() and (best == far.min(1)).all()


def test_every_entry_is_looked_at_only_where_it_must_be():
    # The first entry met lies at distance 0, and all others have other sums: one look is enough.
    book = np.arange(100)[:, None] * np.ones((1, 4), np.int64)
    assert V.nearest(book.astype(np.int64), book.astype(np.int64))[1].sum() == 0
    # An entry of equal sum and distance, but lower index, is found behind the first.
    assert V.nearest(np.array([[0, 0]]), np.array([[1, -1], [-1, 1], [0, 9]]))[0].tolist() == [0]
    # The bound is met exactly by the lower index: it must still be looked at.
    assert V.nearest(np.array([[0, 0]]), np.array([[-1, -1], [1, 1]]))[0].tolist() == [0]


def test_given_table_against_plain_loops(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert run(spark, rows) == plain(rows)


def test_edges(spark):
    rng = np.random.default_rng(5)
    vec = lambda: [float(np.float32(x)) for x in rng.normal(0, 0.5, 8)]
    good = [(i, vec(), i % 3 or None) for i in range(40)] + [(7, vec(), 1), (7, [0.5] * 8, 1), (8, [0.5] * 8, 1), (-3, [-0.25] * 8, None), (None, vec(), 2)]
    bad = [(50, None, 1), (51, [float("nan")] + [0.0] * 7, 1), (52, [float("inf")] * 8, None), (53, [None] + [0.0] * 7, 2)]
    assert run(spark, good + bad) == plain(good + bad)
    assert run(spark, good + bad, entries=3) == plain(good + bad, entries=3)
    # Another dimension than the first, no component, or one too large for exact distances: dropped.
    assert run(spark, good + [(60, [1.0] * 12, 1), (61, [], 1), (62, [3e38] * 8, 1)]) == plain(good)
    assert run(spark, []) == [] and run(spark, bad) == []
    assert len(run(spark, [(1, [0.5, 0.25, 0.125], 1), (2, [0.5, 0.5, 0.5], 1)])) == 2


def test_codes_stand_for_vectors(spark):
    rows = [(i, [float(i), 0.0, 0.0, 1.0], 0) for i in range(5)]
    coded, books = V.compress(spark.createDataFrame([(i, v, y, "x", 7, 8, "z") for i, v, y in rows], SCHEMA))
    for r in coded.collect():
        assert r.error == 0 and V.decoded(r.code, books).tolist() == [1024 * r.vec_id, 0, 0, 1024]
