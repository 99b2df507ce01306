import zlib

import pytest
from pyspark.sql import functions as F

from tagspark.llm import hilbert


@pytest.mark.parametrize("n,bits", [(2, 4), (3, 3), (4, 2), (2, 1), (3, 1)])
def test_the_curve_visits_every_cell_and_steps_to_a_neighbour(spark, n, bits):
    dims = [F.shiftright("id", bits * i).bitwiseAND(F.lit((1 << bits) - 1)) for i in range(n)]
    rows = spark.range(1 << (n * bits)).select(hilbert.hilbert_index(dims, bits).alias("h"), *[d.alias(f"d{i}") for i, d in enumerate(dims)])
    rows = sorted(tuple(r) for r in rows.collect())
    assert [r[0] for r in rows] == list(range(1 << (n * bits)))
    assert all(sum(abs(a - b) for a, b in zip(x[1:], y[1:])) == 1 for x, y in zip(rows, rows[1:]))


def check(docs, got, shards):
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(r.doc_id for r in got) == sorted(texts)
    by = {}
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
        by.setdefault(r.shard, []).append(r)
    counts = [len(by.get(s, [])) for s in range(shards)]
    assert set(by) <= set(range(shards)) and max(counts) - min(counts) <= 1
    for rows in by.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    ordered = [r.curve for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert ordered == sorted(ordered)


@pytest.mark.parametrize("shards", [1, 7, 24, 300])
def test_given_table(documents, shards):
    check(documents, hilbert.shard_documents(documents, shards).collect(), shards)


def test_copies_nulls_and_long_texts(make, prose):
    docs = make(*[(i, "same") for i in range(300)], (400, None), (401, ""), (402, prose(1, 20_000)))
    check(docs, hilbert.shard_documents(docs, 24).collect(), 24)
    assert hilbert.shard_documents(make(), 24).collect() == []
    repeated = hilbert.shard_documents(make((1, "a"), (1, "a"), (None, "a"), (None, None)), 3).collect()
    assert sorted((r.shard, r.slot) for r in repeated) == [(0, 0), (0, 1), (1, 0), (2, 0)]


def test_manifest_prunes_on_each_dimension(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    placed = hilbert.shard_documents(docs, 24).withColumn("lang_cell", hilbert.category(F.col("label0")))
    placed = spark.createDataFrame(placed.collect(), placed.schema)
    listed = hilbert.manifest(placed, ["size", "lang_cell"])
    assert listed.agg(F.sum("rows")).first()[0] == docs.count()
    for column in ("size", "lang_cell"):
        values = [r[0] for r in placed.select(column).collect()]
        touched = []
        for value in values[:20]:
            shards = {r.shard for r in hilbert.prune(listed, **{column: (value, value)}).collect()}
            assert {r.shard for r in placed.filter(F.col(column) == value).collect()} <= shards
            touched.append(len(shards))
        assert sum(touched) / len(touched) < 20


def test_written_shards(make, tmp_path, spark):
    docs = make(*[(i, "t" * (i % 9)) for i in range(50)])
    hilbert.write_shards(docs, hilbert.shard_documents(docs, 4), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50 and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}
