import hashlib

import numpy as np
import pytest

from tagspark.llm import exact


def test_golomb_round_trip():
    rng = np.random.default_rng(3)
    for n, bits in ((0, 7), (1, 5), (1000, 40), (1000, 0), (5000, 59)):
        top = 2 ** min(62, bits + 12) if bits else 5000
        values = np.sort(rng.integers(0, top, n).astype(np.uint64))
        assert (exact.golomb_decode(exact.golomb_encode(values, bits), n, bits) == values).all()
    repeated = np.array([4, 4, 4, 9], np.uint64)
    assert (exact.golomb_decode(exact.golomb_encode(repeated, 2), 4, 2) == repeated).all()


def test_groups_of_the_given_table(spark, documents):
    got = {r.doc_id: r for r in exact.exact_groups(documents).collect()}
    by_text = {}
    for r in documents.collect():
        by_text.setdefault(r.text or "", []).append(r.doc_id)
    assert len(got) == sum(map(len, by_text.values()))
    for text, ids in by_text.items():
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(ids), len(ids), i == max(ids))
            assert got[i].text_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_nulls_are_empty_and_the_largest_stays(make):
    docs = make((5, None), (7, ""), (6, "a"), (9, "a "), (8, "a"))
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact.exact_groups(docs).collect()}
    assert got == {5: (7, 2, False), 7: (7, 2, True), 6: (8, 2, False), 8: (8, 2, True), 9: (9, 1, True)}
    kept = exact.exact_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [7, 8, 9]
    small = exact.exact_dedup(docs, keep_largest=False)
    assert sorted(r.doc_id for r in small.collect()) == [5, 6, 9]


def test_repeated_rows_and_null_ids_keep_one(make, prose):
    text = prose(1, 20_000)
    docs = make((1, text), (1, text), (None, text), (2, "b"), (None, None), (None, None))
    got = exact.exact_groups(docs).collect()
    assert len(got) == 6
    assert [(r.doc_id, r.keep_id, r.group_size) for r in got if r.kept and r.group_size == 3] == [(1, 1, 3)]
    assert sum(r.kept for r in got if r.group_size == 2) == 1
    assert exact.exact_dedup(docs).count() == 3


def test_empty_table(make):
    assert exact.exact_groups(make()).collect() == []
    assert exact.exact_dedup(make()).collect() == []


@pytest.mark.parametrize("block", [3, 1000])
def test_a_copy_within_one_block_is_found_by_all(spark, make, block):
    docs = make(*[(i, f"t{i % 40}") for i in range(120)], *[(1000 + i, f"u{i}") for i in range(50)])
    keyed = docs.select("text")
    sent = exact.fingerprints(keyed, "text", 16, block)
    sent = spark.createDataFrame(sent.collect(), sent.schema)
    marked = exact.suspect_hashes(sent, exact.answers(sent), 16).distinct().count()
    assert marked == 40


def test_equal_blocks_are_met_once_each(spark, make):
    docs = make(*[(i, "the same") for i in range(60)]).repartition(10).select("text")
    sent = exact.fingerprints(docs, "text", 16, 2)
    sent = spark.createDataFrame(sent.collect(), sent.schema)
    assert sent.count() == sent.select("block", "owner").distinct().count() == 10
    assert exact.suspect_hashes(sent, exact.answers(sent), 16).count() == sent.count()
