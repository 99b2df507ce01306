"""Toxicity by a factorization machine over hashed terms.

A text's terms are its words and their first letters, hashed into a fixed number of
slots. The score is the logistic function of

    w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j,    x_i = log(1 + count of slot i)

so a pair of terms can weigh more (or less) than both alone. It is fitted by
stochastic gradients on a bounded sample of labelled texts, `SAMPLE` rows at most,
drawn by a hash of the id; scoring reads every whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagspark.llm.common import add_columns, arrow_pass, batch

SAMPLE = 20_000
# Words a task keeps with their slots; more make it start afresh.
TERM_ENTRIES = 150_000
SLOTS = 1 << 18
FACTORS = 8
PREFIXES = (4, 5, 6)
LETTERS = re.compile(r"[^\W\d_]+")


class Terms(dict):
    """Slots of a word: its own, and those of its first letters. `used` keeps only the slots of a model."""

    def __init__(self, slots: int = SLOTS, prefixes: Sequence[int] = PREFIXES, used: np.ndarray | None = None):
        super().__init__()
        self.slots, self.prefixes = slots, prefixes
        self.places = None if used is None else {int(s): i for i, s in enumerate(used)}

    def __missing__(self, word: str) -> tuple[int, ...]:
        names = [f"={word}"] + [word[:n] for n in self.prefixes if len(word) >= n]
        found = tuple(xxhash.xxh3_64_intdigest(n.encode("utf-8", "surrogatepass")) % self.slots for n in names)
        if self.places is not None:
            found = tuple(self.places[s] for s in found if s in self.places)
        self[word] = found
        return found

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Slots of a text, sorted, and log(1 + count) of each."""
        if len(self) > TERM_ENTRIES:
            self.clear()
        counts: Counter = Counter()
        for word, n in Counter(LETTERS.findall((text or "").lower())).items():
            for slot in self[word]:
                counts[slot] += n
        slots = np.array(sorted(counts), np.int64)
        return slots, np.log1p(np.array([counts[s] for s in slots.tolist()], np.float64))


class Machine:
    """A fitted model. `used` are the slots that have weights."""

    def __init__(self, bias: float, used: np.ndarray, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.used, self.weights, self.factors = bias, used, weights, factors

    def score(self, at: np.ndarray, x: np.ndarray) -> float:
        """`at` are positions in `used`, not slots."""
        if not len(at):
            return float(_logistic(self.bias))
        vx = self.factors[at] * x[:, None]
        pairs = 0.5 * float((vx.sum(0) ** 2 - (vx ** 2).sum(0)).sum())
        return float(_logistic(self.bias + float(self.weights[at] @ x) + pairs))


def _logistic(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def select_slots(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, least_rows: int = 3, least_z: float = 2.5,
                 slots: int = SLOTS) -> np.ndarray:
    """Slots in at least `least_rows` texts whose share of texts differs between the classes by `least_z` standard errors."""
    n = np.array([[(labels == 0).sum()], [(labels == 1).sum()]], float)
    if not n.all():
        return np.zeros(0, np.int64)
    seen = np.zeros((2, slots))
    for (found, _), y in zip(rows, labels.astype(int)):
        seen[y, found] += 1
    share, total = seen / n, seen.sum(0) / n.sum()
    error = np.sqrt(total * (1 - total) * (1 / n).sum()) + 1e-12
    return np.flatnonzero((seen.sum(0) >= least_rows) & (np.abs(share[1] - share[0]) / error >= least_z))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, factors: int = FACTORS, epochs: int = 30,
        rate: float = 0.1, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Adaptive stochastic gradients of the logistic loss, in a fixed order of rows."""
    used = select_slots(rows, labels)
    rng = np.random.default_rng(seed)
    prior = (labels.sum() + 0.5) / (len(labels) + 1)
    bias, w, v = float(np.log(prior / (1 - prior))), np.zeros(len(used)), rng.normal(0, 0.01, (len(used), factors))
    gb, gw, gv = 1e-8, np.full(len(used), 1e-8), np.full(v.shape, 1e-8)
    data = []
    for slots, x in rows:
        at = np.searchsorted(used, slots)
        ok = (at < len(used)) & (used[np.minimum(at, len(used) - 1)] == slots) if len(used) else np.zeros(len(slots), bool)
        data.append((at[ok], x[ok].astype(np.float64)))
    for _ in range(epochs if len(used) else 0):
        for r in rng.permutation(len(data)):
            at, x = data[r]
            vx = v[at] * x[:, None]
            total = vx.sum(0)
            z = bias + w[at] @ x + 0.5 * (total ** 2 - (vx ** 2).sum(0)).sum()
            g = _logistic(z) - labels[r]
            if abs(g) < 1e-3:
                continue
            gb += g * g
            bias -= rate * g / np.sqrt(gb)
            dw = g * x + decay * w[at]
            gw[at] += dw * dw
            w[at] -= rate * dw / np.sqrt(gw[at])
            dv = g * x[:, None] * (total - vx) + decay * v[at]
            gv[at] += dv * dv
            v[at] -= rate * dv / np.sqrt(gv[at])
    return Machine(bias, used, w, v)


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, doc_id: str = "doc_id", text: str = "text",
          label: str = "toxic", sample: int = SAMPLE) -> Machine:
    """Fit on at most `sample` labelled texts, those with the smallest hash of their id.

    `may_learn` is a condition on the column doc_id. Labels that are null or
    not 0 or 1 are left out; of contradicting labels of one id the larger
    counts. Texts become slots on the executors; the fit runs in one task, as the sample is bounded.
    """
    chosen = (labels.select(labels[doc_id].cast("bigint").alias("doc_id"), labels[label].cast("int").alias("label"))
              .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).filter(may_learn)
              .groupBy("doc_id").agg(F.max("label").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    # At most `sample` rows of two numbers.
    texts = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("text")).join(
        F.broadcast(chosen), "doc_id")

    def slots(batches):
        terms = Terms()
        for rows in batches:
            found = [terms.of(t) for t in rows.column(2).to_pylist()]
            yield batch(doc_id=rows.column(0), label=rows.column(1),
                        slots=pa.array([s.astype(np.int32) for s, _ in found], pa.list_(pa.int32())),
                        x=pa.array([x.astype(np.float32) for _, x in found], pa.list_(pa.float32())))

    narrow = arrow_pass(texts.select("doc_id", "label", "text"), slots,
                        "doc_id bigint, label int, slots array<int>, x array<float>")

    def learn(batches):
        ids, ys, rows = [], [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            ys += b.column(1).to_pylist()
            for s, x in zip(b.column(2), b.column(3)):
                # Copies, so that the batch can go.
                rows.append((s.values.to_numpy().copy(), x.values.to_numpy().copy()))
        order = sorted(range(len(ids)), key=lambda i: ids[i])
        m = fit([rows[i] for i in order], np.array([ys[i] for i in order], float))
        yield batch(bias=pa.array([m.bias]), used=pa.array([m.used], pa.list_(pa.int64())),
                    weights=pa.array([m.weights], pa.list_(pa.float64())),
                    factors=pa.array([m.factors.ravel()], pa.list_(pa.float64())))

    row = arrow_pass(narrow.repartition(1), learn,
                     "bias double, used array<bigint>, weights array<double>, factors array<double>").first()
    if row is None:
        return Machine(0.0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS)))
    used = np.array(row.used, np.int64)
    return Machine(row.bias, used, np.array(row.weights), np.array(row.factors).reshape(len(used), FACTORS))


def score(docs: DataFrame, machine: Machine, text: str = "text", name: str = "score") -> DataFrame:
    """`docs` with the machine's score (0 to 1) of each whole text; null and empty texts get the score of no terms.

    Other columns pass through; one named as `name` is replaced. The model has
    at most SLOTS * (FACTORS + 1) numbers and travels with the code.
    """

    def start():
        terms = Terms(used=machine.used)
        return lambda values: [pa.array([machine.score(*terms.of(t)) for t in values], pa.float64())]

    return add_columns(docs, text, start, {name: "double"})
