import hashlib
import os
import sys

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import corpus_pipeline  # noqa: E402
from tagspark.llm import toxicity  # noqa: E402
from tagspark.llm.common import held_out  # noqa: E402
from test_llm_decontaminate import by_hand as leaked  # noqa: E402
from test_llm_minhash import by_hand as near  # noqa: E402

SF = "/root/testdata/sf0.001"


def by_hand(docs, labels, items, machine):
    terms = toxicity.Terms(used=machine.used)
    docs = {d: t for d, t in docs if machine.score(*terms.of(t)) < corpus_pipeline.TOXIC}
    last = {t or "": max(e for e, u in docs.items() if (u or "") == (t or "")) for t in docs.values()}
    docs = {d: t for d, t in docs.items() if last[t or ""] == d}
    groups = near(docs, corpus_pipeline.NEAR_PERCENT)
    docs = {d: t for d, t in docs.items() if groups[d][1] == d}
    gone = {d for d, _ in leaked(docs.items(), items)}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = {}
    for d, t in docs.items():
        if d not in gone:
            ids = library.encode(t or "")
            out[d] = (len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids) if ids else ""))
    return out


def test_run_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, benchmark = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    machine = toxicity.train(docs, labels, ~held_out("doc_id", 4, 2))
    want = by_hand([(r.doc_id, r.text) for r in docs.collect()], labels, [(r.item_id, r.text) for r in benchmark.collect()], machine)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and 100 < len(want) < docs.count()


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(40), SF)
        assert out.columns == docs.columns, name


def test_hard_rows_pass_every_stage(spark, make, prose):
    docs = make((1, None), (2, ""), (3, prose(1, 20_000)), (3, "again"), (3, "again"), (None, "x"), (None, None)).withColumn(
        "n_chars", F.lit(None).cast("int"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns, name
        # Copies go in the two stages about copies; nothing else does.
        assert kept.count() == {"exact dedup": 4, "near dedup": 6}.get(name, 7), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 7
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, make(), SF).count() == 0, name
