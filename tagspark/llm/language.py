"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter n-gram is bound by
permuting (rotating) each letter's vector by its place and multiplying; a text
bundles its n-grams by adding their vectors; a language's prototype bundles
its texts. A text gets the language whose prototype has the largest cosine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagspark.llm.common import add_columns, arrow_pass, batch
from tagspark.llm.pieces import slices

DIMENSIONS = 1024
ORDER = 3
# n-gram vectors a task keeps; more make it start afresh, which changes no result.
TABLE_GRAMS = 16_384
CHUNK_TEXTS = 64


class Grams:
    """Letter n-grams of texts, and their vectors."""

    def __init__(self, dimensions: int = DIMENSIONS, order: int = ORDER, entries: int = TABLE_GRAMS):
        self.dimensions, self.order, self.entries = dimensions, order, entries
        self.letter = np.frombuffer(b"".join(b"\1" if chr(c).isalpha() else b"\0" for c in range(0x110000)), np.uint8) == 1
        self.letters: dict[int, np.ndarray] = {}
        self.start()

    def start(self) -> None:
        self.known = np.zeros(0, np.int64)
        self.row_of = np.zeros(0, np.int64)
        self.vectors = np.zeros((0, self.dimensions), np.float32)

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of the lower-cased letters, all else being one space between words, and their counts; none without letters."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        points = np.where(self.letter[points], points, 32)
        points = np.concatenate(([32], points, [32]))
        points = points[~((points == 32) & (np.concatenate(([0], points[:-1])) == 32))]
        if len(points) < 3:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        grams = np.zeros(max(1, len(points) - self.order + 1), np.int64)
        for i in range(self.order):
            part = points[i:i + len(grams)]
            grams[:len(part)] = (grams[:len(part)] << 21) | part
        return np.unique(grams, return_counts=True)

    def letter_vector(self, point: int) -> np.ndarray:
        if point not in self.letters:
            if len(self.letters) > 20_000:
                self.letters.clear()
            self.letters[point] = np.random.default_rng(point).integers(0, 2, self.dimensions).astype(np.int8) * 2 - 1
        return self.letters[point]

    def vector(self, gram: int) -> np.ndarray:
        out = np.ones(self.dimensions, np.int8)
        for place in range(self.order):
            out = out * np.roll(self.letter_vector((gram >> (21 * place)) & 0x1FFFFF), place)
        return out

    def rows(self, grams: np.ndarray) -> np.ndarray:
        """Rows of `vectors` that hold these n-grams; call `start` first where the table may overflow."""
        at = np.searchsorted(self.known, grams)
        known = np.zeros(len(grams), bool) if not len(self.known) else self.known[np.minimum(at, len(self.known) - 1)] == grams
        if not known.all():
            new = np.unique(grams[~known])
            self.vectors = np.concatenate([self.vectors, np.stack([self.vector(int(g)) for g in new]).astype(np.float32)])
            names = np.concatenate([self.known, new])
            places = np.concatenate([self.row_of, np.arange(len(self.row_of), len(names))])
            order = np.argsort(names)
            self.known, self.row_of = names[order], places[order]
            at = np.searchsorted(self.known, grams)
        return self.row_of[at]

    def bundle(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """One vector per text, the sum of its n-grams' vectors.

        More n-grams than the table holds are added up run by run, so that memory does not grow with a text. The sums are exact.
        """
        grams, at = np.unique(np.concatenate([g for g, _ in texts]), return_inverse=True)
        text = np.repeat(np.arange(len(texts)), [len(g) for g, _ in texts])
        times = np.concatenate([c for _, c in texts])
        # Whole numbers below 2**24 are exact in the narrow type.
        kind = np.float32 if times.sum() < 1 << 24 else np.float64
        sums = np.zeros((len(texts), self.dimensions))
        for first in range(0, len(grams), self.entries):
            run = grams[first:first + self.entries]
            if len(self.known) + len(run) > self.entries:
                self.start()
            rows = self.rows(run)
            here = (at >= first) & (at < first + len(run))
            counts = np.zeros((len(texts), len(self.vectors)), kind)
            counts[text[here], rows[at[here] - first]] = times[here]
            sums += counts @ self.vectors
        return sums


def learn(docs: DataFrame, may_learn: Column, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS) -> DataFrame:
    """Prototypes: lang, dim, value. All texts with a language for which `may_learn` (on the columns of `docs`) holds.

    Tasks add up their texts' vectors per language; Spark adds up the tasks'.
    """
    def step(batches):
        grams, sums = Grams(dimensions), {}
        for rows in batches:
            texts, langs = rows.column(0).to_pylist(), rows.column(1).to_pylist()
            for start in range(0, len(texts), CHUNK_TEXTS):
                for name in set(langs[start:start + CHUNK_TEXTS]):
                    found = [grams.of(t) for t, l in zip(texts[start:start + CHUNK_TEXTS], langs[start:start + CHUNK_TEXTS]) if l == name]
                    of_all, where = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
                    if len(of_all):
                        counts = np.bincount(where, np.concatenate([c for _, c in found]))
                        sums[name] = sums.get(name, 0) + grams.bundle([(of_all, counts)])[0].astype(np.float64)
        for name, vector in sums.items():
            yield batch(lang=pa.array([name] * dimensions), dim=pa.array(np.arange(dimensions, dtype=np.int32)),
                        value=pa.array(np.rint(vector).astype(np.int64)))

    rows = docs.filter(may_learn).select(docs[text].cast("string").alias("text"), docs[lang].cast("string").alias("lang")).filter(
        F.col("text").isNotNull() & F.col("lang").isNotNull())
    return arrow_pass(rows, step, "lang string, dim int, value bigint").groupBy("lang", "dim").agg(F.sum("value").alias("value"))


def prototypes(learned: DataFrame, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages in order of their names, and their vectors of length one. As many numbers as languages times dimensions reach the driver."""
    vectors: dict[str, np.ndarray] = {}
    for row in learned.collect():
        vectors.setdefault(row.lang, np.zeros(dimensions))[row.dim] = row.value
    names = sorted(n for n, v in vectors.items() if v.any())
    return names, np.array([vectors[n] / np.linalg.norm(vectors[n]) for n in names]).reshape(len(names), dimensions)


def predict(docs: DataFrame, names: list[str], vectors: np.ndarray, text: str = "text") -> DataFrame:
    """`docs` with lang_pred and score (the cosine, at least 0) of each whole text.

    A null text, one without letters, or an empty set of languages gives `und`
    and 0. Of equal cosines the first name counts. Other columns pass through;
    those named lang_pred and score are replaced.
    """
    dimensions = vectors.shape[1] if len(names) else DIMENSIONS

    def start():
        grams = Grams(dimensions)

        def work(values):
            preds, scores = [], []
            for part in slices(values, 1_000_000):
                for first in range(0, len(part), CHUNK_TEXTS):
                    found = [grams.of(t) for t in part[first:first + CHUNK_TEXTS]]
                    some = [i for i, (g, _) in enumerate(found) if len(g)] if names else []
                    best, cosine = np.full(len(found), -1), np.zeros(len(found))
                    if some:
                        bundles = grams.bundle([found[i] for i in some]).astype(np.float64)
                        size = np.linalg.norm(bundles, axis=1)
                        cosines = np.round(bundles @ vectors.T / np.where(size > 0, size, 1)[:, None], 9)
                        best[some] = cosines.argmax(1)
                        cosine[some] = np.clip(cosines.max(1), 0, 1)
                    preds += [names[b] if b >= 0 else "und" for b in best]
                    scores += cosine.tolist()
            return [pa.array(preds, pa.string()), pa.array(scores, pa.float64())]

        return work

    return add_columns(docs, text, start, {"lang_pred": "string", "score": "double"})
