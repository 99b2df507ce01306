import re

import pytest

from tagspark.llm import licences


def words(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def by_hand(text):
    w = words(text)
    places = sorted((i, l) for p, l in licences.PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split())
    half = max(len(t.split()) for t in licences.TEMPLATES)
    met = []
    for at in range(0, len(w), half):
        for t, label in licences.TEMPLATES.items():
            s = set(t.split())
            share = len(s & set(w[at:at + 2 * half])) / len(s)
            if share >= licences.THRESHOLD:
                met.append((at, 2 * half, label, t, share))
    base = sorted({l for _, l in places})
    return (len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(base),
            ",".join(sorted({*base, *[m[2] for m in met]})), 1.0 if places else max([m[4] for m in met], default=0.0), sorted(met))


def check(docs):
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score, [tuple(b) for b in r.blocks])
           for r in licences.scan(docs).collect()}
    want = {r.doc_id: by_hand(r.text) for r in docs.collect()}
    assert got == want
    return want


def test_given_table(spark):
    want = check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert {"mit", "apache", "gpl", "cc-by-nc"} <= {l for w in want.values() for l in w[5].split(",")}


def test_changed_passages_and_edges(make, prose):
    docs = [(1, None), (2, ""), (3, "--- !"), (4, "MIT\nLicense, mit--license MIT LICENSE"), (5, "the mit (R) license"),
            (6, prose(1, 20_000) + " Permission is granted, free of charge, to any person obtaining a copy of this software! " + prose(2, 50)),
            (7, "under the terms of the GNU Lesser General Public License"), (8, "General public. General Public License"),
            (9, "Licensed K under cc BY nc 4"), (10, "miİt license"), (11, "worK is licensed under the gnu general public"),
            (12, "License apache " * 40)]
    for i, t in enumerate(licences.TEMPLATES):
        w = t.split()
        docs += [(100 + i, prose(i, 15 + i) + " " + t.title() + ". " + prose(90 + i, 20)), (200 + i, " ".join(w[1:])), (300 + i, " ".join(w[::2])),
                 (400 + i, (prose(i, 3) + " ").join(x + " " for x in w))]
    check(make(*docs))


@pytest.mark.parametrize("threshold", [0.5, 1.0])
def test_other_thresholds(make, prose, monkeypatch, threshold):
    monkeypatch.setattr(licences, "THRESHOLD", threshold)
    docs = make(*[(i, prose(i, i) + " " + " ".join(t.split()[i % 3:])) for i, t in enumerate([*licences.TEMPLATES] * 3)])
    got = {r.doc_id: (r.labels, r.score) for r in licences.scan(docs, threshold=threshold).collect()}
    assert got == {r.doc_id: by_hand(r.text)[5:7] for r in docs.collect()}


def test_repeated_rows_null_ids_and_empty_table(make):
    rows = licences.scan(make((1, "mit license"), (1, "mit license"), (None, "mit license"), (None, None))).collect()
    assert sorted((r.doc_id or 0, r.n_base) for r in rows) == [(0, 0), (0, 1), (1, 1), (1, 1)]
    assert licences.scan(make()).collect() == []
