import re

import pytest

from tagspark.llm import pii

# The base rules as they are given, without the changes that keep them linear.
RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base(text):
    out = []
    for rank, (kind, rule) in enumerate(RULES.items()):
        for m in re.finditer(rule, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),
                    "card": lambda: 14 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 10 <= len(digits) <= 15}[kind]():
                out.append((m.start(), rank, kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(out)]


def found(docs, part="base"):
    return {r.doc_id: [tuple(s) for s in r[part]] for r in pii.find(docs).collect()}


def test_base_of_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id: base(r.text) for r in docs.collect()}
    assert found(docs) == want and {k for s in want.values() for k, _, _ in s} == set(RULES)


def test_hard_places(make, prose):
    texts = ["a@b.c%d@e.f", "x@y@z.com", "@a.b", "a@b", "a@b.", "..@-.-", "a@b.c.d@e.f", "é@ü.x a@b.cé", "1.2.3.4.5.6.7.8", "300.1.1.1 1.1.1.1", "01.002.0003.255",
             "1.2.3.256", "1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111112", "4111  1111 1111 1111", "5 5", "+1 (743) 555-3824",
             "+1 (743) 555-3824 4111111111111111", "++1 743 555 3824-", "+1 743", "+12345678901234567890", "", None, "😀 a@b.co 😀 1.2.3.4", "0" * 3000, "1" * 3000 + "@" + "a" * 3000,
             "1." * 2000, "5 " * 3000, "a@" * 1000 + "b.c", "+1" * 500, "+1 2 3 4 5 6 7 8 9 0", prose(1, 20_000) + " 10.0.0.1",
             "9" * 18 + " " + "a.b@c-d.e-f.g"]
    docs = make(*enumerate(texts))
    assert found(docs) == {i: base(t) for i, t in enumerate(texts)}


def test_patterns_find_unseen_identifiers(make):
    seeds = [(i, f"please dial +1 743 555-38{i:02d} today") for i in range(10, 20)]
    unseen = [(30, "please dial 555-3824-77 today"), (31, "we dial (5553824) now"), (32, "about 5553999 today"), (33, "dial twelve"), (34, "dial 12")]
    got = found(make(*seeds, *unseen), "spans")
    assert got[30] == [("id", 12, 23)] and got[31] == [("id", 9, 16)]
    assert got[32] == got[33] == got[34] == []
    assert all(k[0] == "phone" for i, _ in seeds for k in got[i])


def test_the_word_in_front_is_whole_and_may_hold_digits(make):
    long = "x" * 90
    seeds = [(i, f"passport no4 +1 743 555-38{i}") for i in range(10, 20)] + [(i, f"{long}a +1 743 555-39{i}") for i in range(20, 30)]
    others = [(40, "passport no4 55538247"), (41, f"{long}a 55538248"), (42, f"{long}b 55538249"), (43, "no4\t55538250 11 no4 55538251"), (44, "+1 743 555-3810 no4 55538252")]
    got = found(make(*seeds, *others), "spans")
    assert got[40] == [("id", 13, 21)] and got[41] == [("id", 92, 100)] and got[42] == []
    assert got[43] == [("id", 4, 12), ("id", 20, 28)] and got[44] == [("phone", 0, 15), ("id", 20, 28)]


def test_mixed_patterns_are_not_trusted(make):
    docs = make(*[(i, f"see +1 743 555-38{i}") for i in range(10, 14)], *[(i, f"see 77{i}00{i}") for i in range(20, 40)])
    assert not any(s[0] == "id" for spans in found(docs, "spans").values() for s in spans)


def test_graph_by_hand(spark):
    edges = [("a", "s1", 1.0), ("a", "s2", 1.0), ("a", "s3", 1.0), ("a", "u", 0.0), ("b", "s1", 1.0), ("b", "v", 0.0), ("b", "u", 0.0), ("c", "v", 0.0)]
    pattern, instance = {}, {i: max(s for _, j, s in edges if j == i) for _, i, _ in edges}
    for _ in range(pii.TURNS):
        for w in "abc":
            own = [(i, s) for v, i, s in edges if v == w]
            pattern[w] = sum(instance[i] for i, _ in own) / len(own) if sum(s for _, s in own) >= pii.SUPPORT else 0.0
        for i in instance:
            ws = [w for w, j, _ in edges if j == i]
            instance[i] = 1.0 if i[0] == "s" else sum(pattern[w] for w in ws) / len(ws)
    p, q = pii.score_graph(spark.createDataFrame(edges, "word string, instance string, seed double"))
    assert {r.word: r.confidence for r in p.collect()} == pytest.approx(pattern)
    assert {r.instance: r.confidence for r in q.collect()} == pytest.approx(instance)


def test_repeated_rows_null_ids_and_empty_table(make):
    rows = pii.find(make((1, "a@b.c"), (1, "a@b.c"), (None, "a@b.c 1.1.1.1"), (None, None))).collect()
    assert sorted((r.doc_id or 0, len(r.spans)) for r in rows) == [(0, 0), (0, 2), (1, 1), (1, 1)]
    assert pii.find(make()).collect() == []
