import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tagspark.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(A, B)


@pytest.fixture(scope="module")
def reference():
    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    return library


def plain(pair, reference, rows):
    """Every row of the operator by comparing byte ranges of all tokens."""
    docs = []
    for i, text in rows:
        whole = " " + (text or "")
        a = reference.encode(whole, add_special_tokens=False).ids if text else []
        b = pair.b.library.encode(text) if text else []
        if b"".join(pair.a.bytes[x] for x in a) != whole.encode() or b"".join(pair.b.bytes[x] for x in b) != whole.encode():
            a, b = [], []
        spans = []
        for ids, table in ((a, pair.a.bytes), (b, pair.b.bytes)):
            at, out = 0, []
            for x in ids:
                out.append((at, at + len(table[x])))
                at += len(table[x])
            spans.append(out)
        links = [(x, y) for x, (s, e) in zip(a, spans[0]) for y, (f, g) in zip(b, spans[1]) if s < g and f < e]
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, low = [], 0
        for c in cuts:
            inside = [",".join(str(x) for x, (s, e) in zip(ids, sp) if low <= s and e <= c) for ids, sp in zip((a, b), spans)]
            groups.append("|".join(inside))
            low = c
        docs.append((i, len(a), len(b), links, groups))
    held = Counter(p for *_, links, _ in docs for p in set(links))
    top = {}
    for (x, _), n in held.items():
        top[x] = max(top.get(x, 0), n)
    return sorted(((i, na, nb, len(g), len(ls), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "",
                    sum(held[p] == top[p[0]] for p in ls), sum(held[p] for p in ls)) for i, na, nb, ls, g in docs), key=repr)


def test_given_table_against_all_ranges(documents, pair, reference):
    some = documents.filter("length(text) < 2500")
    rows = [(r.doc_id, r.text) for r in some.select("doc_id", "text").collect()]
    for chars in (alignment.BLOCK_CHARS, 5000):
        got = alignment.compare(some, A, B, block_chars=chars).collect()
        assert sorted(map(tuple, got), key=repr) == plain(pair, reference, rows)


def test_edges(make, pair, reference, prose):
    rows = [(1, None), (2, ""), (3, " "), (4, "a▁b"), (5, "<|endoftext|> <s>é</s>"), (6, "中文 😀\n\n\tx"), (6, "中文 😀\n\n\tx"), (None, prose(1, 40)),
            (8, "<0x0A>"), (9, "x" * 1500), (10, "\x00a"), (11, "  two  spaces  ")]
    got = sorted(map(tuple, alignment.compare(make(*rows), A, B).collect()), key=repr)
    assert got == plain(pair, reference, rows)
    assert [r for r in got if r[0] == 4] == [(4, 0, 0, 0, 0, "", 0, 0)]
    assert alignment.compare(make(), A, B).collect() == []
    long = prose(2, 30_000)
    row = alignment.compare(make((1, long)), A, B).first()
    assert row.n_a == len(reference.encode(" " + long).ids) and row.n_links >= max(row.n_a, row.n_b) and row.count_sum == row.n_links


def test_ids_are_those_of_the_file(pair, reference):
    rng = random.Random(4)
    alphabet = list(" \n\r\t\x85\xa0 　᠎​\x1c'.,1½é中😀٣ⅷ_́") + ["the", "'s", "'LL", " \n", "<|endoftext|>"]
    for _ in range(5000):
        text = " " + "".join(rng.choices(alphabet + [chr(rng.choice([rng.randrange(0x3000), rng.randrange(0xE000, 0x20000)]))], k=rng.randint(0, 15)))
        assert pair.a.encode(text) == reference.encode(text, add_special_tokens=False).ids
    assert pair.a.encode("y" * 2000) == reference.encode("y" * 2000, add_special_tokens=False).ids


def test_lockstep_on_ends():
    a_ends, b_ends = np.array([1, 3, 4, 2, 5]), np.array([3, 4, 1, 5])
    doc, a, b, cut = alignment.lockstep(a_ends, np.array([0, 3, 3, 5]), b_ends, np.array([0, 2, 2, 4]))
    assert list(zip(doc.tolist(), a.tolist(), b.tolist(), cut.tolist())) == [
        (0, 0, 0, False), (0, 1, 0, True), (0, 2, 1, True), (2, 3, 2, False), (2, 3, 3, False), (2, 4, 3, True)]


def test_links_of_texts(make, pair):
    row = alignment.links(make((1, "unbelievable stories"), (2, None)), A, B).orderBy("doc_id").collect()
    first = row[0]
    ends = lambda ids, table: np.cumsum([len(table[i]) for i in ids]).tolist()
    a, b = ends(first.a_ids, pair.a.bytes), ends(first.b_ids, pair.b.bytes)
    assert a[-1] == b[-1] == 21 and [a[i - 1] for i in first.cut_a] == sorted(set(a) & set(b)) == [b[i - 1] for i in first.cut_b]
    assert set(first.link_a) == set(range(len(a))) and set(first.link_b) == set(range(len(b)))
    assert (row[1].a_ids, row[1].link_a, row[1].cut_b) == ([], [], []) and row[0].lang == "en"
