import hashlib

import pytest
import xxhash
from pyspark.sql import functions as F

from tagspark.llm import syncmers

K, S = syncmers.K, syncmers.S


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain_anchors(text):
    """(place, hash) of every closed syncmer, by its definition."""
    data = (text or "").encode()
    low = lambda part: (xxhash.xxh64_intdigest(part, seed=42) & 0x7FFFFFFF) + 0x80000000
    if len(data) < K:
        return [(0, low(data))] if data else []
    found = []
    for i in range(len(data) - K + 1):
        inner = [signed(xxhash.xxh64_intdigest(data[j:j + S], seed=42)) for j in range(i, i + K - S + 1)]
        if min(inner) in (inner[0], inner[-1]):
            found.append((i, low(data[i:i + K])))
    return found


def plain_elements(found):
    return [(h << 4) + min(15, p - (found[i - 1][0] if i else 0)) for i, (p, h) in enumerate(found)]


def alike(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_force(pairs):
    """Rows of the operator for (doc_id, text) pairs with unique ids."""
    order = sorted(((i, t or "") for i, t in pairs), reverse=True)
    out = {}
    for n, (i, text) in enumerate(order):
        after = order[(n + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        own, changed, other = (plain_elements(plain_anchors(t)) for t in (text, edited, after))
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), "".join(f"{x:X}" for x in own),
                  "".join(f"{x:X}" for x in changed), pytest.approx(alike(own, changed)), pytest.approx(alike(own, other)))
    return out


def compare(rows, pairs):
    wanted = brute_force(pairs)
    got = {r.doc_id: tuple(r)[1:] for r in rows}
    assert got.keys() == wanted.keys() and len(rows) == len(pairs)
    for i in wanted:
        assert got[i] == wanted[i]


def test_given_table_against_the_definition(documents):
    pairs = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    compare(syncmers.compare_neighbours(documents).collect(), pairs)


def test_edges(make, prose):
    pairs = [(1, None), (2, ""), (3, "é"), (4, "ab" * 200), (5, "a" * 19), (6, "a" * 20), (7, "中文字" * 40), (8, prose(1, 4000)),
             (9, prose(1, 4000)), (-10, "😀 x"), (11, "a" * 21), (12, prose(2, 3)), (13, prose(3, 5)), (14, " \n\x00")]
    compare(syncmers.compare_neighbours(make(*pairs), run_rows=2).collect(), pairs)
    assert syncmers.compare_neighbours(make()).collect() == []
    alone = syncmers.compare_neighbours(make((5, prose(4, 50)))).collect()
    compare(alone, [(5, prose(4, 50))])
    assert alone[0].near_next == 1.0


def test_repeated_and_null_ids(make, prose):
    docs = make((1, prose(1, 30)), (1, prose(2, 30)), (None, prose(3, 30)), (None, None), (2, prose(4, 30)))
    got = syncmers.compare_neighbours(docs).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == sorted(
        (i or 0, len(t or "")) for i, t in [(1, prose(1, 30)), (1, prose(2, 30)), (None, prose(3, 30)), (None, None), (2, prose(4, 30))])
    # The document with the largest id is followed by one of those with the next smaller id.
    first = next(r for r in got if r.doc_id == 2)
    own = prose(4, 30)
    edits = [own[:len(own) - len(own) // 2] + prose(n, 30)[:len(own) // 2] for n in (1, 2)]
    assert first.edited_sha256 in [hashlib.sha256(e.encode()).hexdigest() for e in edits]


def test_an_edit_changes_only_the_anchors_that_touch_it(spark, prose):
    text = prose(7, 300)
    changed = text[:700] + "XYZ" + text[700:]
    row = spark.createDataFrame([(text, changed)], "a string, b string").select(
        syncmers.anchors(F.col("a")).alias("a"), syncmers.anchors(F.col("b")).alias("b")).select(
        "*", syncmers.shared_places("a", "b").alias("places")).first()
    spots = [(x >> 32, x & 0xFFFFFFFF) for x in row.a]
    assert spots == plain_anchors(text)
    other = {(x >> 32, x & 0xFFFFFFFF) for x in row.b}
    for place, value in spots:
        if place + K <= 700:
            assert (place, value) in other
        elif place >= 700:
            assert (place + 3, value) in other
    assert {b - a for a, b in row.places} == {0, 3}
    assert max(b - a for a, b in zip([p for p, _ in spots], [p for p, _ in spots][1:])) <= K - S


def test_half_of_a_document_is_seen_and_a_stranger_is_not(documents):
    rows = syncmers.compare_neighbours(documents).filter("n_chars > 200").collect()
    assert sum(r.near_edited for r in rows) / len(rows) > 0.25
    assert sum(r.near_edited > r.near_next for r in rows) / len(rows) > 0.95
