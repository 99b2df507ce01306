"""Aligning two tokenizers' segmentations of the same bytes, many documents in lockstep.

Tokens of a byte-level BPE (A, of a space and the text) and of a SentencePiece model (B, of the text,
which adds that space) are byte ranges. Two tokens are linked where their ranges overlap; offsets at
which tokens of both end are cuts. One state vector per side holds the current token of every
document of a batch: a step emits the links and cuts of all of them, moves each pointer whose token
ends first (both at a cut), and drops the documents that are finished.

How many documents hold a pair of ids linked is counted in blocks: a block sends each distinct pair
once, gets its count back, and its documents look the counts up by place. A pair that all documents
hold thus costs one row per block.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb

from tagspark.llm.common import add_columns, arrow_pass
from tagspark.llm.pieces import MARK
from tagspark.session import written

# Characters of a batch that is merged in lockstep, and of a block.
SLICE_CHARS = 2_000_000
BLOCK_CHARS = 8_000_000
# The split of a byte-level BPE into words.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: itself where it prints, else the next free one from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


class ByteTokens:
    """Ids of a byte-level BPE file without its special tokens, and the bytes of each id.

    Where ids are in the order of the merges, which is checked, merging by rank
    gives the same ids and is several times faster than the file's own library.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        special = {t["id"] for t in spec["added_tokens"]}
        model = spec["model"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if (spec["pre_tokenizer"].get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or spec["normalizer"]
                or [model["vocab"][a + b] for a, b in pairs] != list(range(256, 256 + len(pairs)))):
            raise ValueError("not a byte-level BPE whose ids follow its merges")
        ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if i not in special}
        self.bytes = {i: b for b, i in ranks.items()}
        self.fast = tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        return self.fast.encode_ordinary(text)


class PieceTokens:
    """Ids of a SentencePiece model, and the bytes of each id."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            spec = model_pb.ModelProto.FromString(f.read())
        self.bytes = {i: bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace(MARK, " ").encode()
                      for i, p in enumerate(spec.pieces)}
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        rules = spec.normalizer_spec
        # Then pieces give back all bytes but those of a marker, which stands for a space.
        self.lossless = (not rules.precompiled_charsmap and not rules.remove_extra_whitespaces and rules.add_dummy_prefix
                         and rules.escape_whitespaces and sum(p.type == 6 for p in spec.pieces) == 256
                         and all(p.type in (1, 2, 3, 6) for p in spec.pieces))

    def gives_back(self, text: str, ids: list[int]) -> bool:
        """Whether the ids' bytes are a space and the text."""
        return MARK not in text if self.lossless else b"".join(map(self.bytes.__getitem__, ids)) == b" " + text.encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


class Pair:
    """Two tokenizers, with the texts and lengths of their ids as tables."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteTokens(a_path), PieceTokens(b_path)
        size = lambda t: np.array([len(t.bytes.get(i, b"")) for i in range(max(t.bytes) + 1)], np.int64)
        self.a_len, self.b_len = size(self.a), size(self.b)
        # Each id as text with what may follow it.
        self.names = [f"{i}{end}" for i in range(max(len(self.a_len), len(self.b_len))) for end in ",|;"]

    def tokens(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides; none for a text that is empty or that the tokens' bytes do not give back."""
        # Byte-level tokens always give back their text.
        a, b = [self.a.encode(" " + t) if t else [] for t in texts], self.b.encode(texts)
        for i, t in enumerate(texts):
            if not t or not self.b.gives_back(t, b[i]):
                a[i], b[i] = [], []
        return a, b


@lru_cache(maxsize=2)
def tokenizers(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids in one array, and where each document's begin and end."""
    edges = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    return np.fromiter(chain.from_iterable(lists), np.int64, edges[-1]), edges


def lockstep(a_ends: np.ndarray, a_edges: np.ndarray, b_ends: np.ndarray, b_edges: np.ndarray) -> tuple[np.ndarray, ...]:
    """Links of a batch as (document, a, b, cut), in order of document and place.

    `*_ends` are the byte ends of all tokens within their documents, `*_edges`
    where the documents begin and end in them. `a` and `b` are places in these
    arrays; `cut` tells that both tokens of the link end there.
    """
    docs = np.flatnonzero(np.diff(a_edges))
    pa_, pb, stop = a_edges[docs], b_edges[docs], a_edges[docs + 1]
    out = []
    while len(docs):
        a, b = a_ends[pa_], b_ends[pb]
        first, last = a <= b, b <= a
        out.append((docs, pa_, pb, first & last))
        pa_, pb = pa_ + first, pb + last
        on = pa_ < stop
        if not on.all():
            docs, pa_, pb, stop = docs[on], pa_[on], pb[on], stop[on]
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))
    doc, a, b, cut = (np.concatenate(x) for x in zip(*out))
    order = np.argsort(doc, kind="stable")
    return doc[order], a[order], b[order], cut[order]


class Aligned:
    """A batch of texts in both tokenizations, with their links."""

    def __init__(self, pair: Pair, texts: list[str]):
        self.pair, self.n = pair, len(texts)
        a, b = pair.tokens(texts)
        (self.a, self.a_edges), (self.b, self.b_edges) = _flat(a), _flat(b)

        def ends(ids, edges, lengths):
            total = np.concatenate([[0], np.cumsum(lengths[ids])])
            return total[1:] - np.repeat(total[edges[:-1]], np.diff(edges))

        self.doc, self.at_a, self.at_b, self.cut = lockstep(
            ends(self.a, self.a_edges, pair.a_len), self.a_edges, ends(self.b, self.b_edges, pair.b_len), self.b_edges)

    def cuts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, and places behind the last A and B token, of every cut."""
        return self.doc[self.cut], self.at_a[self.cut] + 1, self.at_b[self.cut] + 1

    def groups(self) -> list[str]:
        """The groups of each document, as `a1,a2|b1;a3|b2,b3`."""
        end_a, end_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        end_a[self.at_a[self.cut]] = end_b[self.at_b[self.cut]] = 1
        # Number of the group of each token, and its place where the A tokens of a group stand before its B tokens.
        of_a, of_b = np.cumsum(end_a) - end_a, np.cumsum(end_b) - end_b
        in_a, in_b = np.bincount(of_a), np.bincount(of_b)
        text = np.zeros(len(self.a) + len(self.b), np.int64)
        text[np.arange(len(self.a)) + (np.cumsum(in_b) - in_b)[of_a]] = 3 * self.a + end_a
        text[np.arange(len(self.b)) + np.cumsum(in_a)[of_b]] = 3 * self.b + 2 * end_b
        names, text, edges = self.pair.names, text.tolist(), (self.a_edges + self.b_edges).tolist()
        return ["".join([names[x] for x in text[i:j]])[:-1] for i, j in zip(edges, edges[1:])]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, pair (id of A << 32 | id of B) and number of links, for each distinct pair of a document."""
        pair = (self.a[self.at_a] << 32) | self.b[self.at_b]
        order = np.lexsort((pair, self.doc))
        doc, pair = self.doc[order], pair[order]
        new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])])) if len(doc) else np.zeros(0, int)
        return doc[new], pair[new], np.diff(np.append(new, len(doc)))


def slices(texts: list[str], most: int = SLICE_CHARS) -> Iterable[list[int]]:
    """Places of `texts` in runs of about `most` characters, texts of similar length together."""
    run, size = [], 0
    for i in sorted(range(len(texts)), key=lambda i: len(texts[i])):
        if run and size + len(texts[i]) > most:
            yield run
            run, size = [], 0
        run.append(i)
        size += len(texts[i])
    if run:
        yield run


def links(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """`docs` with a_ids, b_ids, link_a, link_b (places of linked tokens), cut_a, cut_b (places behind each group).

    Null and empty texts, and those whose tokens' bytes are not the text's,
    have empty lists. Other columns pass through; columns of these names are replaced.
    """
    names = ["a_ids", "b_ids", "link_a", "link_b", "cut_a", "cut_b"]

    def start():
        pair = tokenizers(a_path, b_path)

        def work(values):
            texts = [v or "" for v in values]
            out = [[None] * len(texts) for _ in names]
            for run in slices(texts):
                x = Aligned(pair, [texts[i] for i in run])
                doc, to_a, to_b = x.cuts()
                at = np.searchsorted(x.doc, np.arange(x.n + 1))
                cut = np.searchsorted(doc, np.arange(x.n + 1))
                for n, i in enumerate(run):
                    a, b = x.a_edges[n], x.b_edges[n]
                    own, ends = slice(at[n], at[n + 1]), slice(cut[n], cut[n + 1])
                    for column, found in zip(out, (x.a[a:x.a_edges[n + 1]], x.b[b:x.b_edges[n + 1]], x.at_a[own] - a, x.at_b[own] - b,
                                                   to_a[ends] - a, to_b[ends] - b)):
                        column[i] = found.astype(np.int32)
            return [pa.array(c, pa.list_(pa.int32())) for c in out]

        return work

    return add_columns(docs, text, start, dict.fromkeys(names, "array<int>"))


SENT = ("block bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
        "places array<int>, times array<int>, pairs array<bigint>, holders array<int>")


def blocks(docs: DataFrame, a_path: str, b_path: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows of documents (places of their pairs in the block's list, links of each) and one row per block (pairs, holders) of `docs` (doc_id, text)."""
    kinds = [pa.int64()] * 6 + [pa.string()] + [pa.list_(t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.int32())]
    names = [f.split(" ")[0] for f in SENT.split(", ")]

    def step(batches):
        pair, task = tokenizers(a_path, b_path), TaskContext.get().partitionId()
        rows, found, chars, n = [], [], 0, 0

        def flush():
            sizes = [len(p) for p in found]
            known, place, holders = np.unique(np.concatenate([*found, np.zeros(0, np.int64)]), return_inverse=True, return_counts=True)
            ends = np.cumsum(sizes)
            block = (task << 32) + n
            out = [(block, *r[:-1], place[e - s:e].astype(np.int32), r[-1], None, None) for r, s, e in zip(rows, sizes, ends)]
            out.append((block, *[None] * 8, known, holders.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

        for b in batches:
            ids, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            for run in slices(texts):
                x = Aligned(pair, [texts[i] for i in run])
                doc, pairs, times = x.pairs()
                ends = np.searchsorted(doc, np.arange(x.n + 1))
                n_links, n_groups = np.bincount(x.doc, minlength=x.n), np.bincount(x.doc[x.cut], minlength=x.n)
                for k, (i, groups) in enumerate(zip(run, x.groups())):
                    own = slice(ends[k], ends[k + 1])
                    found.append(pairs[own])
                    rows.append((ids[i], int(x.a_edges[k + 1] - x.a_edges[k]), int(x.b_edges[k + 1] - x.b_edges[k]), int(n_groups[k]),
                                 int(n_links[k]), hashlib.sha256(groups.encode()).hexdigest() if groups else "", times[own].astype(np.int32)))
                chars += sum(len(texts[i]) for i in run)
                if chars >= block_chars:
                    yield from flush()
                    rows, found, chars, n = [], [], 0, n + 1
        if rows:
            yield from flush()

    return arrow_pass(docs, step, SENT)


def pair_counts(sent: DataFrame) -> DataFrame:
    """pair, count (documents that hold it), best (whether no pair of the same A id has more)."""
    entries = sent.filter("pairs IS NOT NULL").select(F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("holders").alias("n"))))
    totals = entries.toDF("pair", "n").groupBy("pair").agg(F.sum("n").alias("count"))
    # As many rows of an A id as B ids are ever linked to it, whatever the number of documents.
    same = Window.partitionBy(F.shiftright("pair", 32))
    return totals.withColumn("best", F.col("count") == F.max("count").over(same))


def compare(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per row of `docs`: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    `n_best` are links whose pair is held by as many documents as any pair of
    its A id, `count_sum` adds up the counts of all links. Texts that are null
    or empty or that the tokens' bytes do not give back count 0 and have an
    empty checksum. Rows that repeat an id, or have none, are documents of
    their own. Other columns are not read; an empty table gives no rows.
    """
    rows = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("text"))
    sent = written(blocks(rows, a_path, b_path, block_chars), "aligned")
    asked = (sent.filter("pairs IS NOT NULL").select(F.col("block").alias("of"), F.posexplode("pairs").alias("place", "pair")))
    answers = asked.join(pair_counts(sent), "pair").select("of", "place", "count", "best")

    def finish(own: pa.Table, told: pa.Table) -> pa.Table:
        size = told.num_rows
        count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
        place = told.column("place").to_numpy()
        count[place], best[place] = told.column("count").to_numpy(), told.column("best").to_numpy()
        own = own.combine_chunks()
        sums = [[], []]
        for places, times in zip(own.column("places"), own.column("times")):
            p, t = places.values.to_numpy(), times.values.to_numpy()
            sums[0].append(int((t * best[p]).sum()))
            sums[1].append(int((t * count[p]).sum()))
        kept = own.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
        return kept.append_column("n_best", pa.array(sums[0], pa.int64())).append_column("count_sum", pa.array(sums[1], pa.int64()))

    return (sent.filter("places IS NOT NULL").drop("pairs", "holders").groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(
        finish, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint"))
