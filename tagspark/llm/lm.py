"""Bigram language model in Elias-Fano tries, trained on and scoring whole corpora.

Texts become blocks: a row per 800,000 tokens or so with the block's
sorted word hashes and its texts as places in that list. Blocks send each shard
of words and each shard of bigrams the distinct entries they hold with their
counts in the texts that are learned from, once. A shard adds up the counts,
keeps them as Elias-Fano levels with quantised probabilities, looks every block's
entries up in these levels, and answers with arrays in the block's order, so that
nothing is joined per token. Shards grow in number with the corpus; a frequent
context's words are spread over `PARTS` shards.

    p(w | v) = (1 - BACKOFF) P(v w) / P(v) + BACKOFF p(w),    p(w) = (c + 0.5) / (N + 0.5 (V + 1))

P(v w) is the quantised joint probability that the trie keeps, in codes of 16 bits: counts up to
`EXACT` are kept exactly and larger ones, up to 2**63, within 0.06 percent.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagspark.llm.common import WordHashes, arrow_pass, batch, mix, row_key, shards_for, words_of
from tagspark.llm.trie import EliasFano, Trie, ef_encode, trie_encode
from tagspark.session import written

BLOCK_TOKENS = 800_000
SHARD_TOKENS = 2_000_000
PARTS = 8
BACKOFF = 0.6
EXACT = (1 << 15) - 1
# Counts that the codes stand for: each itself up to EXACT, then equal steps on a logarithmic scale up to 2**63, which no corpus reaches.
CODEBOOK = np.concatenate([np.arange(EXACT + 1), np.geomspace(EXACT, 2.0 ** 63, (1 << 16) - EXACT)[1:]])
# Hashes of words keep 56 bits, those of contexts 44, and those of words within a context 32.
HASH_SHIFT, CONTEXT_SHIFT = np.uint64(8), np.uint64(20)
START, END = np.uint64(0x5BF03635D1A5C3E1), np.uint64(0xA24BAED4963EE407)


def quantise(counts: np.ndarray) -> np.ndarray:
    """Codes 1 to 65535 of counts of at least one, nearest on a logarithmic scale."""
    edges = np.sqrt(CODEBOOK[1:-1] * CODEBOOK[2:])
    return (np.searchsorted(edges, counts) + 1).astype(np.uint16)


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32, byte by byte of all of them, as high bytes are mostly 0."""
    return zstandard.compress(np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpack(code: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(code), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _pack_tokens(tokens: np.ndarray, words: int) -> tuple[bytes, bytes]:
    """Tokens as ranks by frequency, and the counts that tell the ranks."""
    counts = np.bincount(tokens, minlength=words)
    rank = np.empty(words, np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(words)
    return _pack(rank[tokens]), _pack(counts)


def _unpack_tokens(ranks: bytes, counts: bytes) -> np.ndarray:
    return np.argsort(-_unpack(counts).astype(np.int64), kind="stable")[_unpack(ranks)]


class Block:
    """Distinct words (sorted hashes), the texts' tokens as places among them, and the distinct bigrams by shard."""

    def __init__(self, vocab: np.ndarray, tokens: np.ndarray, lengths: np.ndarray, held: np.ndarray):
        self.vocab, self.tokens, self.lengths, self.held = vocab, tokens, lengths, held

    @classmethod
    def of(cls, row) -> Block:
        return cls(EliasFano(row["vocab"]).all() << HASH_SHIFT, _unpack_tokens(row["tokens"], row["counts"]),
                   np.array(row["lengths"]), np.array(row["held"], bool))

    def bigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """Every bigram as two places; the start of a text is the place behind the last word."""
        first = np.cumsum(self.lengths) - self.lengths
        before = np.empty(len(self.tokens), np.int64)
        before[1:] = self.tokens[:-1]
        before[first] = len(self.vocab)
        return before, self.tokens

    def by_shard(self, shards: int):
        """The distinct bigrams in order of shard, context hash and word hash, and where each token's bigram is among them."""
        before, after = self.bigrams()
        pair, inverse = np.unique((before << 32) | after, return_inverse=True)
        context = np.append(self.vocab, START)[pair >> 32] >> CONTEXT_SHIFT
        full = self.vocab[pair & 0xFFFFFFFF]
        word = (full >> np.uint64(20)) & np.uint64(0xFFFFFFFF)
        shard = ((mix(context) + (full >> np.uint64(64 - PARTS.bit_length() + 1))) & np.uint64(shards - 1)).astype(np.int64)
        order = np.lexsort((word, context, shard))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return shard[order], context[order], word[order], place[inverse]


def blocks(keyed: DataFrame, held: Column) -> DataFrame:
    """block, doc_ids, held, lengths (end token included), vocab, tokens, counts. `held` marks texts that are not learned from."""
    def step(batches):
        table = WordHashes()
        parts, lengths, ids, flags, name, size = [], [], [], [], None, 0

        def flush():
            hashes = np.concatenate(parts)
            vocab, tokens = np.unique(hashes >> HASH_SHIFT, return_inverse=True)
            ranks, counts = _pack_tokens(tokens, len(vocab))
            return batch(block=pa.array([name], pa.int64()), doc_ids=pa.array([ids], pa.list_(pa.int64())),
                         held=pa.array([flags], pa.list_(pa.bool_())), lengths=pa.array([lengths], pa.list_(pa.int32())),
                         vocab=pa.array([ef_encode(vocab)], pa.binary()), tokens=pa.array([ranks], pa.binary()),
                         counts=pa.array([counts], pa.binary()))

        for rows in batches:
            for row, doc_id, text, flag in zip(*(rows.column(i).to_pylist() for i in range(4))):
                found = np.append(table.of(words_of(text)), END)
                name = row if name is None else name
                parts.append(found)
                lengths.append(len(found))
                ids.append(doc_id)
                flags.append(flag)
                size += len(found)
                if size >= BLOCK_TOKENS:
                    yield flush()
                    parts, lengths, ids, flags, name, size = [], [], [], [], None, 0
        if parts:
            yield flush()

    return arrow_pass(keyed.select("_row", "doc_id", F.col("text"), held.alias("held")), step,
                      "block bigint, doc_ids array<bigint>, held array<boolean>, lengths array<int>, vocab binary, tokens binary, counts binary")


def _rows_of(batches):
    for rows in batches:
        for row in rows.to_pylist():
            yield row


def _word_ranges(vocab: np.ndarray, shards: int) -> np.ndarray:
    """Words are sharded by their top bits, so that a block's list falls into ranges."""
    return np.searchsorted(vocab >> np.uint64(64 - shards.bit_length() + 1), np.arange(shards + 1, dtype=np.uint64))


def sent(blocked: DataFrame, shards: int) -> DataFrame:
    """What blocks send: block, kind (0 words, 1 bigrams), shard, keys (Elias-Fano), counts in the texts that are learned from."""
    def step(batches):
        for row in _rows_of(batches):
            b = Block.of(row)
            learned = np.repeat(~b.held, b.lengths)
            out = []

            def put(kind, edges, encode, counts):
                for s in range(shards):
                    part = slice(edges[s], edges[s + 1])
                    if edges[s] < edges[s + 1]:
                        out.append((row["block"], kind, s, encode(part), _pack(counts[part])))

            put(0, _word_ranges(b.vocab, shards), lambda part: ef_encode(b.vocab[part] >> HASH_SHIFT),
                np.bincount(b.tokens[learned], minlength=len(b.vocab)))
            shard, context, word, place = b.by_shard(shards)

            def levels(part):
                names, of = np.unique(context[part], return_inverse=True)
                return trie_encode(names, of, word[part], np.zeros(0))

            put(1, np.searchsorted(shard, np.arange(shards + 1)), levels, np.bincount(place[learned], minlength=len(word)))
            block, kind, s, keys, counts = zip(*out)
            yield batch(block=pa.array(block, pa.int64()), kind=pa.array(kind, pa.int32()), shard=pa.array(s, pa.int32()),
                        keys=pa.array(keys, pa.binary()), counts=pa.array(counts, pa.binary()))

    return arrow_pass(blocked, step, "block bigint, kind int, shard int, keys binary, counts binary")


def word_level(keys: list[bytes], counts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The words learned from as one Elias-Fano level, and their counts."""
    words, where = np.unique(np.concatenate([EliasFano(k).all() for k in keys]), return_inverse=True)
    total = np.bincount(where, np.concatenate([_unpack(c) for c in counts])).astype(np.int64)
    return ef_encode(words[total > 0]), total[total > 0]


def bigram_levels(keys: list[bytes], counts: list[bytes]) -> bytes:
    """The bigrams learned from as a trie: contexts, pointers, words within their context, quantised probabilities."""
    pairs = [Trie(k).pairs() for k in keys]
    names, of = np.unique(np.concatenate([c for c, _ in pairs]), return_inverse=True)
    joined, where = np.unique((of.astype(np.uint64) << np.uint64(32)) | np.concatenate([w for _, w in pairs]), return_inverse=True)
    total = np.bincount(where, np.concatenate([_unpack(c) for c in counts])).astype(np.int64)
    joined, total = joined[total > 0], total[total > 0]
    return trie_encode(names, (joined >> np.uint64(32)).astype(np.int64), joined & np.uint64(0xFFFFFFFF), quantise(total))


def answers(messages: DataFrame) -> DataFrame:
    """block, kind, shard, found, n, total: for each key of a message, in its order, the count of the word or the code of the bigram.

    n and total are those of the shard's words and stand in one row of each shard.
    """
    def reply(rows: pd.DataFrame) -> pd.DataFrame:
        kind, out, n, total = int(rows.kind.iloc[0]), [], 0, 0
        if kind == 0:
            level, counts = word_level(list(rows["keys"]), list(rows["counts"]))
            known, n, total = EliasFano(level), len(counts), int(counts.sum())
            counts = np.append(counts, 0)
            for k in rows["keys"]:
                at = known.find(EliasFano(k).all())
                out.append(zstandard.compress(counts[at].astype(np.uint64).tobytes(), 1))
        else:
            trie = Trie(bigram_levels(list(rows["keys"]), list(rows["counts"])))
            for k in rows["keys"]:
                out.append(zstandard.compress(trie.look_up(*Trie(k).pairs()).tobytes(), 1))
        first = np.arange(len(rows)) == 0
        return pd.DataFrame({"block": rows["block"], "kind": kind, "shard": rows["shard"], "found": out,
                             "n": np.where(first, n, 0), "total": np.where(first, total, 0)})

    return messages.groupBy("kind", "shard").applyInPandas(
        reply, "block bigint, kind int, shard int, found binary, n bigint, total bigint")


def score(docs: DataFrame, held: Column, doc_id: str = "doc_id", text: str = "text", backoff: float = BACKOFF) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    `held` is a condition on doc_id; texts for which it is true are scored but not learned
    from. Words stand between ASCII white space, A-Z lower-cased, and every text ends with one end
    token; null and empty texts are that token alone. Repeated rows count as often
    as they stand. With nothing to learn from every probability is that of an
    unseen word. An empty table gives no rows; other columns are not read.
    """
    keyed, _ = row_key(docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("text")), "doc_id", "_row")
    blocked = written(blocks(keyed, held), "blocks")
    tokens = blocked.select(F.sum(F.expr("aggregate(lengths, 0L, (a, n) -> a + n)"))).first()[0] or 0
    shards = shards_for(tokens, SHARD_TOKENS, 2 * PARTS)
    found = written(answers(sent(blocked, shards)), "answers")
    total, distinct = found.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    starts = blocked.select(F.sum(F.expr("size(filter(held, h -> NOT h))"))).first()[0] or 0

    def finish(own: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        row = own.iloc[0]
        b = Block.of(row)
        replies = replies.sort_values(["kind", "shard"])
        counts = np.concatenate([np.frombuffer(zstandard.decompress(f), np.uint64)
                                 for f in replies.found[replies.kind == 0]]).astype(np.float64)
        codes = np.concatenate([np.frombuffer(zstandard.decompress(f), "<u2") for f in replies.found[replies.kind == 1]])
        before, after = b.bigrams()
        *_, place = b.by_shard(shards)
        unigram = (counts + 0.5) / (total + 0.5 * (distinct + 1))
        context = np.append(counts, starts)[before]
        joint = CODEBOOK[codes[place]]
        relative = np.where(context > 0, joint / np.maximum(context, 1), 0)
        # A context never seen leaves all to the word alone.
        share = np.where(context > 0, backoff, 1.0)
        p = (1 - share) * np.minimum(relative, 1) + share * unigram[after]
        first = np.cumsum(b.lengths) - b.lengths
        return pd.DataFrame({
            "doc_id": pd.array(list(row["doc_ids"]), "Int64"), "held_out": b.held, "n_tokens": b.lengths.astype(np.int64),
            "n_known": np.add.reduceat((counts[after] > 0).astype(np.int64), first),
            "base_score": np.add.reduceat(np.log10(unigram)[after], first), "score": np.add.reduceat(np.log10(p), first)})

    replies = found.select("block", "kind", "shard", "found")
    scored = blocked.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(
        finish, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score")
