import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tagspark.llm import decontaminate as d


def words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower()) if w]


def bag(w):
    return Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def by_hand(docs, items, least=0.8):
    """(doc, item): best similarity and its first place, over all windows of the item's size."""
    out = {}
    for doc, text in docs:
        w = words(text)
        for item, body in items:
            v = words(body)
            b = bag(v)
            if not b or not set(b) & set(bag(w)):
                continue
            for at in range(max(0, len(w) - len(v)) + 1):
                a = bag(w[at:at + len(v)])
                s = sum((a & b).values()) / max(1, sum((a | b).values()))
                if s >= least and s > out.get((doc, item), (0, 0))[0]:
                    out[doc, item] = (s, at)
    return out


def test_given_tables(spark, documents):
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = by_hand([(r.doc_id, r.text) for r in documents.collect()], [(r.item_id, r.text) for r in benchmark.collect()])
    got = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in d.leaks(documents, benchmark).collect()}
    assert got == want and want
    left = d.decontaminate(documents, benchmark)
    assert left.columns == documents.columns
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in documents.collect()} - {doc for doc, _ in want}


def test_changed_passages_edges_and_repeats(spark, make, prose):
    rng = random.Random(1)
    items = [(i, prose(900 + i, 30 + i)) for i in range(8)] + [(50, "too few words here"), (51, None), (52, "x y z x y z x y z x y z"), (0, prose(900, 30))]
    docs = []
    for i in range(60):
        w = items[i % 8][1].split()
        for _ in range(i % 3):
            w[rng.choice([0, 1, -1, -2, len(w) // 2])] = "changed"
        docs.append((i, prose(i, 40) + " " + ("### " if i % 2 else " ").join(w).upper() + " " + prose(1000 + i, i)))
    docs += [(100, None), (101, ""), (102, " ".join(items[3][1].split()[2:])), (103, items[2][1]), (104, "x y z " * 40), (105, items[4][1] * 1)]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    want = by_hand(docs, items)
    got = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in d.leaks(make(*docs), benchmark).collect()}
    assert got == want and len(want) > 40
    left = d.decontaminate(make(*docs), benchmark)
    assert {r.doc_id for r in left.collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_moved_parts_insertions_and_repeats(spark, make, prose):
    """Windows are found wherever the shared shingles stand in the item."""
    w = prose(70, 80).split()
    items = [(1, " ".join(w)), (2, prose(71, 24) + " " + prose(71, 24)), (3, prose(72, 60))]
    docs = [(1, prose(1, 30) + " " + " ".join(w[40:] + w[:40]) + " " + prose(2, 30)),
            (2, " ".join(w[:20] + ["new"] + w[20:50] + ["newer"] + w[50:])), (3, " ".join(w[3:] + w[:3])),
            (4, " ".join([prose(71, 24)] * 4)), (5, " ".join(prose(72, 60).split()[20:] + prose(72, 60).split()[:20])),
            (6, " ".join(w[:60])), (7, " ".join(w[:75]))]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    want = by_hand(docs, items)
    got = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in d.leaks(make(*docs), benchmark).collect()}
    assert got == want and {(1, 1), (3, 1), (4, 2), (5, 3), (7, 1)} <= set(want) and (6, 1) not in want


def test_recall_at_the_threshold(spark, make, prose):
    """Passages with changed words in different places, down to the similarity of 0.8: at least 99 of 100 lie within the radius."""
    rng = random.Random(5)
    items = [(i, prose(800 + i, rng.randint(60, 120))) for i in range(40)]
    docs = []
    for i in range(400):
        w = items[i % 40][1].split()
        for at in rng.sample(range(len(w)), rng.randint(0, 2)):
            w[at] = "changed"
        docs.append((i, prose(i, rng.randint(0, 9)) + " " + " ".join(w)))
    want = by_hand(docs, items)
    got = {(r.doc_id, r.item_id): r.similarity for r in d.leaks(make(*docs), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    near = {k for k, (s, _) in want.items() if s < 0.9}
    assert set(got) <= set(want) and len(near) > 60
    assert len(near & set(got)) >= 0.99 * len(near)


def test_repeated_rows_null_ids_and_empty_tables(spark, make, prose):
    item = prose(77, 25)
    benchmark = spark.createDataFrame([(1, item), (1, item), (2, prose(78, 25))], "item_id bigint, text string")
    docs = make((3, item), (3, item), (None, item), (4, prose(5, 50)), (None, None))
    assert sorted((r.doc_id or 0, r.item_id) for r in d.leaks(docs, benchmark).collect()) == [(0, 1), (3, 1), (3, 1)]
    left = d.decontaminate(docs, benchmark)
    assert left.columns == docs.columns and sorted((r.doc_id or 0) for r in left.collect()) == [0, 4]
    assert d.leaks(make(), benchmark).collect() == []
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert d.leaks(docs, none).collect() == [] and d.decontaminate(docs, none).count() == 5


def test_blocks_find_everything_within_the_radius(spark):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), d.RADIUS):
            b ^= 1 << bit
        signed = lambda x: x - 2**64 if x >= 2**63 else x
        rows.append((i, signed(a), signed(b)))
    df = spark.createDataFrame(rows, "i int, a bigint, b bigint")
    one = df.select("i", F.inline(d._blocks(F.col("a"))))
    two = df.select("i", F.inline(d._near_blocks(F.col("b"), d.RADIUS // len(d.BLOCKS))))
    assert one.join(two, ["i", "block", "value"]).select("i").distinct().count() == 300


def test_simhash(spark):
    rng = random.Random(3)
    hashes = [[rng.getrandbits(64) - 2**63 for _ in range(n)] for n in (1, 2, 7, 30)]
    got = [r.s for r in spark.createDataFrame([(h,) for h in hashes], "h array<bigint>").select(d.simhash("h").alias("s")).collect()]
    want = [sum(1 << b for b in range(64) if 2 * sum((x >> b) & 1 for x in h) > len(h)) for h in hashes]
    assert [g % 2**64 for g in got] == want


def test_items_with_a_null_id(spark, make, prose):
    items = [(None, prose(950, 30)), (None, prose(951, 30)), (7, prose(952, 30))]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    docs = make((1, prose(1, 20) + " " + items[0][1]), (2, items[1][1] + " " + items[0][1]), (3, items[2][1]), (4, prose(4, 60)))
    got = sorted((r.doc_id, r.item_id or 0, r.similarity, r.start) for r in d.leaks(docs, benchmark).collect())
    assert got == [(1, 0, 1.0, 20), (2, 0, 1.0, 0), (2, 0, 1.0, 30), (3, 7, 1.0, 0)]
    assert [r.doc_id for r in d.decontaminate(docs, benchmark).collect()] == [4]
