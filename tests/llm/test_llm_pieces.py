import hashlib
import random

import public_tokenizers
import pytest

from tagspark.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def table():
    return pieces.ChunkTable(MODEL)


def test_chunks_give_the_ids_of_the_library(table):
    rng = random.Random(2)
    alphabet = list(" \n\r\t▁ab.,1é中😀\0{});") + ["the ", " \r\n", "<s>", "  ", "</s>", "<0x0A>"]
    texts = ["", " ", "\n", "▁", "a" * 5000, " \n" * 300] + ["".join(rng.choices(alphabet, k=rng.randint(0, 20))) for _ in range(3000)]
    for text in texts:
        assert table.encode(text) == table.library.encode(text)


def test_a_full_table_starts_afresh(table):
    small = pieces.ChunkTable(MODEL, entries=3)
    for text in ("one two three four", "five six seven", "one two"):
        assert small.encode(text) == small.library.encode(text)


def test_round_trip_of_the_given_table(documents, table):
    got = {r.doc_id: r for r in pieces.round_trip(documents, MODEL).collect()}
    for r in documents.collect():
        ids = table.library.encode(r.text)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256, got[r.doc_id].same) == (
            len(ids), digest(",".join(map(str, ids))), digest(table.library.decode(ids)), True)


def test_edges(make, table, prose):
    long = prose(4, 30_000)
    docs = make((1, None), (2, ""), (3, long), (3, long), (None, "▁ x"))
    got = pieces.round_trip(docs, MODEL).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == sorted(
        [(1, 0), (2, 0), (3, len(table.library.encode(long))), (3, len(table.library.encode(long))), (0, len(table.library.encode("▁ x")))])
    coded = pieces.encode_texts(docs, MODEL, ids="hash")
    assert set(coded.columns) == set(docs.columns)
    back = pieces.decode_ids(coded, MODEL, ids="hash", text="word").collect()
    assert sorted((r.doc_id or 0, r.word) for r in back) == sorted([(1, ""), (2, ""), (3, long), (3, long), (0, "  x")])
    assert pieces.round_trip(make(), MODEL).collect() == []


def test_a_model_whose_pieces_cross_markers_is_refused(tmp_path, table):
    with open(MODEL, "rb") as f:
        spec = pieces.model_pb.ModelProto.FromString(f.read())
    spec.pieces[500].piece = "a▁b"
    (tmp_path / "m.model").write_bytes(spec.SerializeToString())
    with pytest.raises(ValueError):
        pieces.ChunkTable(str(tmp_path / "m.model"))
