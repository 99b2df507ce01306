"""The operators as queries on the given tables, with production parameters, and the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagspark.llm import alignment, decontaminate, exact, hilbert, language, licences, lm, minhash, pieces, pii, syncmers, toxicity, vector_codes
from tagspark.llm.common import held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(run):
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLES[run.__name__] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 5], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, CASE WHEN len(w) > 0 THEN 1 ELSE 0 END))) AS i FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
reach AS (SELECT doc_id, doc_id AS root FROM documents
  UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.doc_id),
roots AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM roots LEFT JOIN sizes USING (doc_id)""")
def op1_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near copies; the SQL compares all pairs that share a shingle, which suits small tables."""
    return minhash.near_groups(table(spark, sf_dir, "documents"))


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _licence_sql() -> str:
    """Every block of every text against every template, without any filter."""
    half = max(len(t.split()) for t in licences.TEMPLATES)
    vocabulary = sorted({w for t in licences.TEMPLATES for w in t.split()})
    templates = ", ".join(f"({_sql_list(sorted(set(t.split())))}, '{label}')" for t, label in licences.TEMPLATES.items())
    places = " || ".join(
        f"[{{'first': i, 'label': '{label}'}} for i in range(len(w) - {len(phrase.split()) - 1}) if "
        + " AND ".join(f"w[i + {k + 1}] = '{p}'" for k, p in enumerate(phrase.split())) + "]"
        for phrase, label in licences.PHRASES.items())
    return f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
places AS (SELECT doc_id, len(w) AS n_words, {places} AS p FROM words),
templates(tokens, label) AS (VALUES {templates}),
blocks AS (
  SELECT doc_id, list_distinct(list_filter(w[b * {half} + 1:(b + 2) * {half}], lambda x: list_contains({_sql_list(vocabulary)}, x))) AS tokens
  FROM (SELECT doc_id, w, unnest(range(CAST(ceil(len(w) / {half}) AS BIGINT))) AS b FROM words)),
met AS (
  SELECT doc_id, label, len(list_intersect(blocks.tokens, templates.tokens)) / len(templates.tokens) AS containment
  FROM blocks JOIN templates ON len(list_intersect(blocks.tokens, templates.tokens)) >= {licences.THRESHOLD} * len(templates.tokens)),
scored AS (SELECT doc_id, list(label) AS labels, max(containment) AS best, count(*) AS n FROM met GROUP BY doc_id)
SELECT doc_id, n_words, CAST(len(p) AS BIGINT) AS n_base,
  CAST(list_min(list_transform(p, lambda x: x.first)) AS BIGINT) AS first_word,
  CAST(list_max(list_transform(p, lambda x: x.first)) AS BIGINT) AS last_word,
  array_to_string(list_sort(list_distinct(list_transform(p, lambda x: x.label))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_transform(p, lambda x: x.label) || coalesce(labels, []))), ',') AS labels,
  CASE WHEN len(p) > 0 THEN 1.0 ELSE coalesce(best, 0.0) END AS score, coalesce(n, 0) AS n_blocks
FROM places LEFT JOIN scored USING (doc_id)"""


@query(_licence_sql())
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases, and the text blocks that meet a template."""
    return licences.scan(table(spark, sf_dir, "documents")).withColumn("n_blocks", F.size("blocks").cast("bigint")).drop("blocks")


@query()
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text by the distinct-chunk table, and their decoding; tested against the library itself."""
    return pieces.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""")
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


@query()
def op5_factorization_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text; fitted on labelled rows whose checksum is not 2 modulo 4."""
    docs = table(spark, sf_dir, "documents")
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id", 4, 2))
    scored = toxicity.score(docs.select("doc_id", "text"), machine)
    return scored.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query()
def op6_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 shards along the curve through language, source and size."""
    return hilbert.shard_documents(table(spark, sf_dir, "documents"), 24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve")


@query()
def op8_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text; learned from rows whose checksum is not 0 modulo 5."""
    docs = table(spark, sf_dir, "documents")
    names, vectors = language.prototypes(language.learn(docs, ~held_out("doc_id", 5, 0)))
    return language.predict(docs.select("doc_id", "text"), names, vectors).select(
        "doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")


@query("""
WITH bodies AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
items AS (SELECT DISTINCT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
spots AS (SELECT doc_id, len(w) AS n, p, array_to_string(w[p + 1:p + 5], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 0))) AS p FROM bodies)),
parts AS (SELECT item_id, size, o, array_to_string(w[o + 1:o + 5], ' ') AS s
  FROM (SELECT item_id, w, len(w) AS size, unnest(range(greatest(len(w) - 4, 0))) AS o FROM items)),
hits AS (SELECT DISTINCT doc_id, n, item_id, size, p, s FROM spots JOIN parts USING (s)),
windows AS (SELECT doc_id, n, item_id, size, unnest(range(greatest(n - size, 0) + 1)) AS start FROM (SELECT DISTINCT doc_id, n, item_id, size FROM hits)),
held AS (SELECT w.doc_id, w.n, w.item_id, w.size, start, s, count(*) AS c FROM windows w JOIN hits h ON h.doc_id = w.doc_id AND h.item_id = w.item_id
  AND h.size = w.size AND p >= start AND p <= start + least(w.size, w.n) - 5 GROUP BY ALL),
wanted AS (SELECT item_id, size, s, count(*) AS c FROM parts GROUP BY ALL),
common AS (SELECT doc_id, n, size, start, item_id, CAST(sum(least(held.c, wanted.c)) AS DOUBLE) AS m
  FROM held JOIN wanted USING (item_id, size, s) GROUP BY ALL),
alike AS (SELECT *, m / (least(size, n) + size - 8 - m) AS similarity FROM common)
SELECT doc_id, item_id, max(similarity) AS similarity, first(start ORDER BY similarity DESC, start) AS start,
  first(least(size, n) ORDER BY similarity DESC, start) AS n_words, count(*) AS n_windows
FROM alike WHERE similarity >= 0.8 GROUP BY doc_id, item_id""")
def op10_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds; the SQL compares every window without fingerprints."""
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("hamming").withColumns({"start": F.col("start").cast("bigint"), "n_words": F.col("n_words").cast("bigint")})


@query()
def op4_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every text; tested against the base rules and a graph worked out by hand."""
    return pii.find(table(spark, sf_dir, "documents")).select(
        "doc_id", *[pii.counted(k).alias(f"n_{k}") for k in pii.PATTERNS],
        F.sha2(pii.joined("base").cast("binary"), 256).alias("base_sha256"), pii.joined("spans").alias("spans"))


@query()
def op7_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigram scores of every text; learned from rows whose checksum is not 1 modulo 5; tested against plain counting."""
    return lm.score(table(spark, sf_dir, "documents"), held_out("doc_id", 5, 1))


@query()
def op13_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every text next to those of its edited text and of its neighbour; tested against the definition."""
    return syncmers.compare_neighbours(table(spark, sf_dir, "documents"))


def _codes_sql() -> str:
    """Every part against every entry, round by round."""
    far = "list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c)"
    steps = []
    for r in range(vector_codes.ROUNDS + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT id, p, x, min({{'far': far, 'e': e}}) AS best FROM (SELECT id, parts.p, e, x, {far} AS far "
                     f"FROM parts JOIN b{r} ON parts.p = b{r}.p) GROUP BY id, p, x)")
        if r < vector_codes.ROUNDS:
            steps.append(f"""m{r} AS (SELECT p, e, list(floor(s / n) ORDER BY i) AS c FROM (
  SELECT p, best.e AS e, i, sum(x[i]) AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, 17)) AS i) GROUP BY ALL) GROUP BY p, e),
b{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{r}.c, b{r}.c) AS c FROM b{r} LEFT JOIN m{r} USING (p, e))""")
    last = vector_codes.ROUNDS
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT id, p, v[p * 16 + 1:(p + 1) * 16] AS x FROM kept, (SELECT unnest(range(4)) AS p)),
b0 AS MATERIALIZED (SELECT p, id - 1 AS e, x AS c FROM parts WHERE id <= {vector_codes.ENTRIES}),
{", ".join(steps)},
coded AS (SELECT id, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.far) AS BIGINT) AS error FROM a{last} GROUP BY id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda y: CAST(CAST(y AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, e)) FROM b{last}) AS codebooks_sha256
FROM coded JOIN kept USING (id)"""


@query(_codes_sql())
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors by equal-average search; the SQL compares every part with every entry."""
    vectors = table(spark, sf_dir, "embeddings")
    return vector_codes.with_label_errors(*vector_codes.compress(vectors, vector="embedding"))


@query()
def op11_lockstep_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of the two tokenizations of every text; tested against comparing all byte ranges."""
    return alignment.compare(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                             public_tokenizers.path("piece_bpe_32k.model"))
