"""Encode texts to the ids of a SentencePiece model and back, by a table of distinct chunks.

In a BPE model whose pieces hold the white-space marker only in front, no merge
crosses from a letter to a following marker. A text therefore falls into chunks
(a run of markers and what follows up to the next one) that are segmented
independently. Characters that occur in no piece longer than one character,
such as the line break in most models, are cut points as well.

Per batch the chunks of all texts are reduced to the distinct ones; those that
the task has not met yet are segmented once by the library, and the ids are
joined back by position. The table lives in the task, because joining through
a shuffle would move one row per chunk occurrence, several times the input.
It has a bound on its entries; when full it starts afresh, which costs
time and never changes a result.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2 as model_pb

from tagspark.llm.common import add_columns, arrow_pass, batch

MARK = "▁"
TABLE_ENTRIES = 80_000


class ChunkTable:
    """Ids of the distinct chunks a task has met, and what is derived from them.

    `model` is the path of the model file, the same on every machine.
    """

    def __init__(self, model: str, entries: int = TABLE_ENTRIES):
        with open(model, "rb") as f:
            spec = model_pb.ModelProto.FromString(f.read())
        pieces = [p.piece for p in spec.pieces if p.type in (1, 4)]
        rules = spec.normalizer_spec
        if (spec.trainer_spec.model_type != model_pb.TrainerSpec.BPE or rules.precompiled_charsmap
                or rules.remove_extra_whitespaces or not rules.add_dummy_prefix
                or not rules.escape_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix
                or any(MARK in p.lstrip(MARK) for p in pieces) or any(p.type == 4 for p in spec.pieces)):
            raise ValueError("pieces of this model can cross white-space markers; chunks are not independent")
        joined = {c for p in pieces if len(p) > 1 for c in p}
        # A line break that no longer piece holds stands alone; so does whatever is next to it.
        self.cuts = "".join(c for c in "\n" if c not in joined)
        cut = re.escape(self.cuts)
        self.chunks = re.compile(
            (f"[{cut}]|" if cut else "") + f"{MARK}*[^{MARK}{cut}]+|{MARK}+").findall
        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        self.entries = entries
        self.ids: dict[str, array] = {}
        self.text: dict[str, str] = {}
        self.guard = self.library.encode("\n") if self.cuts else None

    def split(self, text: str) -> list[str]:
        return self.chunks(MARK + text.replace(" ", MARK)) if text else []

    def meet(self, texts: list[list[str]]) -> None:
        """Segment every chunk of `texts` that the table lacks, once."""
        if len(self.ids) > self.entries:
            self.ids.clear()
            self.text.clear()
        new = [c for c in {c for chunks in texts for c in chunks} if c not in self.ids]
        # The library puts a marker in front of every text; one without it follows a cut point.
        marked = [c for c in new if c[0] == MARK]
        bare = [c for c in new if c[0] != MARK]
        found = self.library.encode([c[1:] for c in marked], num_threads=1)
        # A lone marker is what the library adds in front of a cut point.
        found = [ids if len(c) > 1 else self._alone(c) for c, ids in zip(marked, found)]
        found += [ids[len(self.guard):] for ids in self.library.encode(["\n" + c for c in bare], num_threads=1)] if bare else []
        for chunk, ids in zip(marked + bare, found):
            self.ids[chunk] = array("i", ids)
            self.text[chunk] = ",".join(map(str, ids))

    def _alone(self, mark: str) -> list[int]:
        return [self.library.piece_to_id(mark)]

    def encode(self, text: str) -> list[int]:
        chunks = self.split(text)
        self.meet([chunks])
        return [i for c in chunks for i in self.ids[c]]


@lru_cache(maxsize=2)
def table(model: str) -> ChunkTable:
    return ChunkTable(model)


def slices(texts: list[str | None], most: int = 1_000_000) -> Iterator[list[str]]:
    """Runs of whole texts of about `most` characters, so that a batch of long texts stays small in memory."""
    part, size = [], 0
    for t in texts:
        part.append(t or "")
        size += len(part[-1])
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode_texts(docs: DataFrame, model: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """`docs` with a column `ids` (array<int>) for its whole texts; a null or empty text has no ids.

    Other columns, whatever their names, pass through; one named as `ids` is replaced.
    """

    def start():
        chunks = table(model)

        def work(values):
            out = []
            for part in slices(values):
                split = [chunks.split(t) for t in part]
                chunks.meet(split)
                out += [np.fromiter((i for c in s for i in chunks.ids[c]), np.int32) for s in split]
            return [pa.array(out, pa.list_(pa.int32()))]

        return work

    return add_columns(docs, text, start, {ids: "array<int>"})


def decode_ids(docs: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """`docs` with a column `text`, the library's decoding of `ids`; a null list decodes to the empty text."""

    def start():
        library = table(model).library
        return lambda values: [pa.array([library.decode(x) if x else "" for x in values], pa.string())]

    return add_columns(docs, ids, start, {text: "string"})


def round_trip(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_tokens, ids_sha256, decoded_sha256, same (whether decoding gave the text back).

    Encodes and decodes in one pass, so that the ids of long texts are never
    stored. Null texts count as empty; repeated rows give repeated rows.
    """

    def step(batches):
        chunks = table(model)
        for rows in batches:
            n, of_ids, of_text, same = [], [], [], []
            for part in slices(rows.column(1).to_pylist()):
                split = [chunks.split(t) for t in part]
                chunks.meet(split)
                for t, s in zip(part, split):
                    ids = [i for c in s for i in chunks.ids[c]]
                    decoded = chunks.library.decode(ids) if ids else ""
                    n.append(len(ids))
                    of_ids.append(hashlib.sha256(",".join([chunks.text[c] for c in s]).encode()).hexdigest())
                    of_text.append(hashlib.sha256(decoded.encode()).hexdigest())
                    same.append(decoded == t)
            yield batch(doc_id=rows.column(0), n_tokens=pa.array(n, pa.int64()), ids_sha256=pa.array(of_ids, pa.string()),
                        decoded_sha256=pa.array(of_text, pa.string()), same=pa.array(same, pa.bool_()))

    narrow = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("text"))
    return arrow_pass(narrow, step, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, same boolean")
