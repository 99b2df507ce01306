from collections import Counter, defaultdict

import numpy as np
import pytest

from tagspark.llm import minhash
from tagspark.llm.common import WordHashes, words_of
from tagspark.llm.components import components


def shingles(text):
    w = words_of(text)
    k = min(5, len(w))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()


def by_hand(texts, percent):
    """doc_id: (size, smallest id in reach), by comparing all pairs that share a shingle."""
    sets = {d: shingles(t) for d, t in texts.items()}
    where, shared, root = defaultdict(list), Counter(), {d: d for d in texts}
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    for ids in where.values():
        shared.update((a, b) for i, b in enumerate(ids) for a in ids[:i])

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {d: (len(sets[d]), find(d)) for d in texts}


def check(docs, percent):
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_groups(docs, percent=percent).collect()}
    assert got == by_hand(texts, percent)


@pytest.mark.parametrize("percent", [85, 60])
def test_given_table_against_all_pairs(documents, percent):
    check(documents, percent)


def test_chains_edges_and_short_texts(make, prose):
    base = prose(5, 120).split()
    chain = [(100 + i, " ".join(base[2 * i:2 * i + 90])) for i in range(12)]
    edits = [(200 + i, " ".join(base[:i * 9] + ["X%d" % i] + base[i * 9 + 1:])) for i in range(12)]
    short = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "two one"), (8, "a b c d e"), (9, "A B c d e")]
    check(make(*short, *chain, *edits), 85)


def test_bands_of_many_members(make, prose):
    base = prose(6, 200).split()
    docs = [(i, " ".join(base[:40 + 5 * (i % 8)] + prose(50 + i // 3, 60).split() + base[80:])) for i in range(40)]
    check(make(*docs), 80)


def test_repeated_rows_and_null_ids(make, prose):
    text = prose(7, 50)
    docs = make((2, text), (2, text), (None, text), (1, text + " more"), (None, None), (None, ""))
    got = minhash.near_groups(docs).collect()
    assert len(got) == 6
    linked = [r for r in got if r.n_shingles > 0]
    assert {r.component_id for r in linked} == {1} and sum(r.kept for r in linked) == 1
    kept = minhash.near_dedup(docs)
    assert kept.columns == docs.columns and kept.count() == 3


def test_empty_table(make):
    assert minhash.near_groups(make()).collect() == []
    assert minhash.near_dedup(make()).collect() == []


def test_registers_hold_the_smallest_hash_of_a_bucket():
    hashes = np.unique(np.random.default_rng(1).integers(0, 2**63, 3000).astype(np.uint64) * np.uint64(2))
    regs = minhash.registers(hashes)
    for bucket in range(128):
        least = min(int(h) % 2**57 for h in hashes if int(h) >> 57 == bucket) >> 4
        zeros = 53 - least.bit_length()
        mantissa = (least << zeros) >> (52 - 10) & 1023
        assert int(regs[bucket]) == ((zeros + 1) << 10) | mantissa


def test_estimate_is_near_and_corrected():
    rng = np.random.default_rng(2)
    for jaccard in (0.2, 0.5, 0.9):
        found = []
        for _ in range(60):
            pool = rng.integers(0, 2**63, 4000).astype(np.uint64) * np.uint64(2)
            common = int(4000 * jaccard)
            rest = (4000 - common) // 2
            a, b = np.unique(pool[:common + rest]), np.unique(np.concatenate([pool[:common], pool[common + rest:]]))
            ra, rb = minhash.registers(a), minhash.registers(b)
            found.append(minhash.estimate(ra[None], rb[None], np.array([len(a)]), np.array([len(b)]))[0][0])
        assert abs(np.mean(found) - jaccard) < 0.03
    # Disjoint sets agree by chance as often as `chance` says.
    hits = []
    for _ in range(400):
        a, b = (minhash.registers(np.unique(rng.integers(0, 2**63, 2000).astype(np.uint64) * np.uint64(2))) for _ in range(2))
        hits.append((a == b).mean())
    assert abs(np.mean(hits) - minhash.chance(np.array([2000.0]), np.array([2000.0]))[0]) < 2.5e-4


def pair_at(rng, percent, n):
    """Two sets of n shingles or a few more that are linked, as close to the threshold as the sizes allow."""
    common = next(c for c in range(n, 0, -1) if 100 * (c - 1) < percent * (2 * n - c + 1))
    pool = np.unique(rng.integers(0, 2**63, 2 * n + 8).astype(np.uint64) * np.uint64(2))
    rng.shuffle(pool)
    return np.sort(pool[:n]), np.sort(np.concatenate([pool[:common], pool[n:2 * n - common]]))


@pytest.mark.parametrize("percent", [85, 80])
def test_short_and_long_sets_share_a_band_at_the_threshold(percent):
    rng = np.random.default_rng(3)
    missed = 0
    for n in (5, 7, 10, 13, 20, 26, 40, 64, 100, 400):
        for _ in range(300):
            a, b = pair_at(rng, percent, n)
            missed += not (minhash.bands(a, percent) == minhash.bands(b, percent)).any()
    # 3,000 pairs, each missed with a probability of at most MISS.
    assert missed == 0


def test_places_agree_as_often_as_the_sets_are_alike():
    rng = np.random.default_rng(5)
    for n in (1, 2, 6, 30, 300):
        found = []
        for _ in range(200):
            pool = rng.integers(0, 2**63, 2 * n).astype(np.uint64) * np.uint64(2)
            a, b = np.unique(pool[:n + n // 2]), np.unique(pool[n // 2:])
            found.append((minhash.places(a, 400) == minhash.places(b, 400)).mean())
        assert abs(np.mean(found) - 0.5) < 0.02


def test_short_texts_at_the_threshold(make, prose):
    docs = []
    for i in range(300):
        w = prose(7000 + i, 17 + i % 20).split()
        docs += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w, "more", "words"]))]
    check(make(*docs), 85)
    check(make(*docs), 80)


def test_fewer_than_five_words_are_one_shingle():
    table = WordHashes()
    assert len(minhash.shingle_hashes(table.of([]))) == 0
    assert [len(minhash.shingle_hashes(table.of([b"a"] * n))) for n in (1, 4, 5, 9)] == [1, 1, 1, 1]
    assert len({int(minhash.shingle_hashes(table.of([b"a"] * n))[0]) for n in (1, 2, 3, 4, 5)}) == 5


def test_components(spark):
    import random
    rng = random.Random(4)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, 500 + i) for i in range(1, 80)]
    root = {x: x for e in links for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for e in links if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    from tagspark.llm import components as c
    rounds, jumps = [], []
    plain_renamed, plain_handed = c.renamed, c.handed
    monkeypatch.setattr(c, "renamed", lambda *a: rounds.append(1) or plain_renamed(*a))
    monkeypatch.setattr(c, "handed", lambda *a: jumps.append(1) or plain_handed(*a))
    got = c.components(spark.range(1000).selectExpr("id AS a", "id + 1 AS b")).collect()
    assert {r.root for r in got} == {0} and len(got) == 1001
    assert len(rounds) <= 2 and len(jumps) <= 15


def test_registers_of_places_are_those_of_their_definition():
    rng = np.random.default_rng(6)
    values = np.concatenate([rng.integers(0, 1 << 44, 2000), 2 ** np.arange(44), [0]]).astype(np.uint64) | (rng.integers(0, 9, 2045).astype(np.uint64) << np.uint64(44))
    for value, register in zip(values.tolist(), minhash.compressed(values).tolist()):
        low = value & (1 << 44) - 1
        size = low.bit_length()
        behind = low - (1 << size - 1) if size else 0
        ten = behind << 10 >> size - 1 if size else 0
        assert (register >> 16, register >> 10 & 63, register & 1023) == (value >> 44, 44 - size, ten)
