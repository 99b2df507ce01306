import math
import mmap
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagspark.llm import lm
from tagspark.llm.common import held_out, words_of
from tagspark.llm.trie import EliasFano, Trie, ef_encode, trie_encode


def test_elias_fano_round_trip_and_search():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (1, 2**63), (5, 3), (1000, 2**64 - 1), (1000, 50), (70_000, 2**40)):
        values = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
        e = EliasFano(ef_encode(values))
        assert (e.all() == values).all()
        asked = np.concatenate([values, rng.integers(0, top, 500, dtype=np.uint64, endpoint=True), np.array([0, top], np.uint64)])
        at = e.find(asked)
        known = np.isin(asked, values)
        assert ((at >= 0) == known).all()
        assert (values[at[known]] == asked[known]).all()


def test_trie_reads_a_memory_mapped_file(tmp_path):
    rng = np.random.default_rng(2)
    contexts = np.unique(rng.integers(0, 2**63, 200).astype(np.uint64) * np.uint64(2))
    of = np.sort(rng.integers(0, 200, 3000))
    keys = np.unique((of.astype(np.uint64) << np.uint64(32)) | rng.integers(0, 5000, 3000).astype(np.uint64))
    of, words = (keys >> np.uint64(32)).astype(np.int64), keys & np.uint64(0xFFFFFFFF)
    payload = rng.integers(1, 256, len(keys)).astype(np.uint8)
    (tmp_path / "trie").write_bytes(trie_encode(contexts, of, words, payload))
    with open(tmp_path / "trie", "rb") as f:
        trie = Trie(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
        assert (trie.look_up(contexts[of], words) == payload).all()
        known = {(int(contexts[c]), int(w)): int(p) for c, w, p in zip(of, words, payload)}
        asked = contexts[rng.integers(0, 200, 4000)], rng.integers(0, 5000, 4000).astype(np.uint64)
        assert trie.look_up(*asked).tolist() == [known.get((int(c), int(w)), 0) for c, w in zip(*asked)]
        assert (trie.look_up(contexts + np.uint64(1), np.zeros(200, np.uint64)) == 0).all()


def test_codes_are_near():
    counts = np.unique(np.concatenate([np.arange(1, 2000), 10 ** np.arange(3, 7)]))
    codes = lm.quantise(counts)
    assert codes.min() == 1 and (lm.CODEBOOK[codes[counts <= lm.EXACT]] == counts[counts <= lm.EXACT]).all()
    assert np.abs(np.log(lm.CODEBOOK[codes] / counts)).max() < 0.04


def test_frequent_bigrams_are_not_capped():
    counts = np.array([2_410_152, 2_500_000, 24_000_000, 3_000_000_000, 2**60])
    assert np.abs(lm.CODEBOOK[lm.quantise(counts)] / counts - 1).max() < 6e-4
    # Three blocks' messages about one bigram add up in the levels.
    keys = trie_encode(np.array([5], np.uint64), np.array([0]), np.array([7], np.uint64), np.zeros(0))
    trie = Trie(lm.bigram_levels([keys] * 3, [lm._pack(np.array([8_000_000]))] * 3))
    assert abs(lm.CODEBOOK[trie.look_up(np.array([5], np.uint64), np.array([7], np.uint64))[0]] / 24_000_000 - 1) < 6e-4


def by_hand(rows, held):
    texts = [(d, words_of(t) + [None]) for d, t in rows]
    c, pairs, starts = Counter(), Counter(), 0
    for d, w in texts:
        if not held(d):
            starts += 1
            c.update(w)
            pairs.update(zip(["start", *w], w))
    n, v, out = sum(c.values()), len(c), []
    for d, w in texts:
        base = total = 0.0
        for before, word in zip(["start", *w], w):
            u = (c[word] + 0.5) / (n + 0.5 * (v + 1))
            of = starts if before == "start" else c[before]
            kept = lm.CODEBOOK[lm.quantise(np.array([pairs[before, word]]))[0]] if pairs[before, word] else 0
            base += math.log10(u)
            total += math.log10((1 - lm.BACKOFF) * min(kept / of, 1) + lm.BACKOFF * u) if of else math.log10(u)
        out.append((-1 if d is None else d, held(d), len(w), sum(c[x] > 0 for x in w), n, base, total))
    return sorted(out)


def compare(docs, flag, held):
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)
                 for r in lm.score(docs, flag).collect())
    want = by_hand([(r.doc_id, r.text) for r in docs.collect()], held)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=0, atol=1e-7)


def test_given_table_against_plain_counting(documents):
    from zlib import crc32
    compare(documents, held_out("doc_id", 5, 1), lambda d: crc32(str(d).encode()) % 5 == 1)


@pytest.mark.parametrize("tokens", [1, 60])
def test_small_blocks_and_edges(make, prose, monkeypatch, tokens):
    monkeypatch.setattr(lm, "BLOCK_TOKENS", tokens)
    docs = make((1, None), (2, ""), (3, "a b a b A B a b"), (3, "a b a b A B a b"), (4, "b a"), (5, prose(1, 3000)), (6, "a " * 300),
                *[(10 + i, "a b c") for i in range(200)])
    compare(docs, F.col("doc_id") % 4 == 0, lambda d: d % 4 == 0)


def test_nothing_to_learn_from(make):
    got = {r.doc_id: r for r in lm.score(make((1, "a b"), (2, None)), F.lit(True)).collect()}
    assert (got[1].n_tokens, got[1].n_known, got[1].train_tokens, got[1].base_score, got[1].score) == (3, 0, 0, 0.0, 0.0)
    assert lm.score(make(), F.lit(True)).collect() == []


def test_the_model_beats_the_words_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    base, score = lm.score(docs, held_out("doc_id", 5, 1)).filter("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert score > base
