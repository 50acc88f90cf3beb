"""Toxicity by a factorization machine over hashed terms.

Terms are a text's distinct lower-cased words and the first letters of its longer words, hashed to ``BITS`` bits.
The machine scores  w0 + sum w_i + sum_{i<j} <v_i, v_j>  over the terms of a text, so a pair such as an insult with a
group's name can count more than its parts.  It is fitted on a bounded sample of labelled training rows: of each
class about ``PER_CLASS`` rows, chosen by a hash of doc_id among all of them and weighted back to the class's share.
All terms in at least ``MIN_DOCS`` sampled texts get parameters, however little they tell alone.  Single weights are
fitted with a lasso (threshold by the standard error of a term's gradient), factors with a shrinkage that grows with
the terms a text has and falls with the number of texts.  Scoring is one Arrow pass without a shuffle.

Edge cases: a null or empty text has no terms and gets the score of the bias; null labels are no labels, and of
several labels of a doc_id the highest counts; a null doc_id has no label; very long texts count with all their distinct terms; a score of exactly the threshold is predicted 1; repeated rows are scored row by row;
without labelled rows of both classes every score is the training share of label 1 (0 without any); an empty table
gives an empty result.  Of documents only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm import common
from vecspark.llm.decontam import terms_of

BITS = 18
FACTORS = 8
PER_CLASS = 6000
MIN_DOCS = 4
PREFIXES = (4, 6)              # first letters that are terms of their own
EPOCHS = 12
STEPS = 300                    # steps at least, however few texts
BATCH = 256
STEP = 0.02
EVEN = 5e-4                    # Adam's denominator grows by it, so terms of few texts move in proportion to their gradients
SPARSE = 2.0                   # a weight is 0 while its gradient is within so many standard errors of chance (lasso)
NOISE = 5.0                    # shrinkage of factors, as a share of mean terms of a text / texts: pairs below that are chance


class Terms:
    """Hashed term numbers of texts; a word's numbers are remembered within a task."""

    def __init__(self):
        from xxhash import xxh3_64_intdigest

        def slot(kind: bytes, w: bytes) -> int:
            return xxh3_64_intdigest(kind + w) >> (64 - BITS)

        class Numbers(dict):
            def __missing__(self, w):
                got = [slot(b"w", w)]
                got += [slot(b"p", w[:n]) for n in PREFIXES if len(w) > n]
                self[w] = got = tuple(got)
                return got

        self._make, self._of = Numbers, Numbers()

    def __call__(self, text: bytes | None, chosen: np.ndarray | None = None) -> np.ndarray:
        """Distinct term numbers of a text (of ``chosen``, a flag per number), ascending."""
        if len(self._of) > common.WORDS_HELD:
            self._of = self._make()
        of = self._of
        seen: set[int] = set()
        for w in set(terms_of(text)):
            seen.update(of[w])
        t = np.fromiter(seen, np.int64, len(seen))
        t.sort()
        return t if chosen is None else t[chosen[t]]


@dataclass
class Machine:
    """Parameters by term number; terms without ``chosen`` count nothing."""
    bias: float
    chosen: np.ndarray
    w: np.ndarray
    v: np.ndarray

    def raw(self, flat: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Scores of texts whose terms are flat[start[i]:start[i+1]]."""
        n = len(start) - 1
        doc = np.repeat(np.arange(n), np.diff(start))
        linear = np.bincount(doc, self.w[flat], minlength=n)
        pairs = np.zeros(n)
        for f in range(self.v.shape[1]):
            x = self.v[flat, f]
            s = np.bincount(doc, x, minlength=n)
            pairs += 0.5 * (s * s - np.bincount(doc, x * x, minlength=n))
        return self.bias + linear + pairs

    def probability(self, flat: np.ndarray, start: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.raw(flat, start), -60, 60)))


def common_terms(rows: list[np.ndarray], size: int) -> np.ndarray:
    """Flag of every term that is in at least ``MIN_DOCS`` texts."""
    return np.bincount(np.concatenate(rows), minlength=size) >= MIN_DOCS


def fit(rows: list[np.ndarray], label: np.ndarray, weight: np.ndarray, seed: int = 10) -> Machine:
    """Mini-batch Adam on the weighted log loss with lasso and shrinkage; rows are distinct term numbers."""
    size = 1 << BITS
    share = float((weight * label).sum() / weight.sum()) if len(label) else 0.0
    empty = Machine(float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))), np.zeros(size, bool), np.zeros(size), np.zeros((size, 1)))
    if not 0 < label.sum() < len(label):
        return empty
    chosen = common_terms(rows, size)
    names = np.flatnonzero(chosen)
    local = np.full(size, -1, np.int64)
    local[names] = np.arange(len(names))
    rows = [local[r[chosen[r]]] for r in rows]
    rng = np.random.default_rng(seed)
    k = len(names)
    theta = np.concatenate([np.zeros((k, 1)), rng.normal(0, 0.01, (k, FACTORS))], axis=1)
    bias = empty.bias
    m, s, mb, sb, t = np.zeros_like(theta), np.zeros_like(theta), 0.0, 0.0, 0
    weight = weight / weight.mean()
    seen = np.bincount(np.concatenate(rows), minlength=k)
    least = SPARSE * np.sqrt((weight ** 2 * (label - share) ** 2).mean() * seen) / len(rows)
    shrink = max(3e-4, NOISE * seen.sum() / len(rows) ** 2)
    batches = max(1, len(rows) // BATCH)
    epochs = max(EPOCHS, -(-STEPS // batches))
    for epoch in range(epochs):
        step = STEP * (1 - epoch / epochs)
        for part in np.array_split(rng.permutation(len(rows)), batches):
            flat = np.concatenate([rows[i] for i in part])
            doc = np.repeat(np.arange(len(part)), [len(rows[i]) for i in part])
            x = theta[flat]
            sums = np.stack([np.bincount(doc, x[:, f], minlength=len(part)) for f in range(1 + FACTORS)], axis=1)
            squares = np.bincount(doc, (x[:, 1:] ** 2).sum(axis=1), minlength=len(part))
            z = bias + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(axis=1) - squares)
            g = weight[part] * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - label[part]) / len(part)
            per = np.concatenate([np.ones((len(flat), 1)), sums[doc, 1:] - x[:, 1:]], axis=1) * g[doc, None]
            grad = np.stack([np.bincount(flat, per[:, f], minlength=k) for f in range(1 + FACTORS)], axis=1)
            grad[:, 1:] += shrink * theta[:, 1:]
            t += 1
            m = 0.9 * m + 0.1 * grad
            s = 0.999 * s + 0.001 * grad * grad
            pace = step / (np.sqrt(s / (1 - 0.999 ** t)) + EVEN)
            theta -= pace * (m / (1 - 0.9 ** t))
            theta[:, 0] = np.sign(theta[:, 0]) * np.maximum(np.abs(theta[:, 0]) - pace[:, 0] * least, 0)
            gb = float(g.sum())
            mb, sb = 0.9 * mb + 0.1 * gb, 0.999 * sb + 0.001 * gb * gb
            bias -= step * (mb / (1 - 0.9 ** t)) / (np.sqrt(sb / (1 - 0.999 ** t)) + 1e-6)
    w, v = np.zeros(size), np.zeros((size, FACTORS), np.float32)
    w[names], v[names] = theta[:, 0], theta[:, 1:]
    return Machine(float(bias), chosen, w, v)


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def sampled_labels(labels: DataFrame, mod: int, per_class: int = PER_CLASS) -> DataFrame:
    """(id, y, weight): about ``per_class`` training labels of each class, by hash of the id."""
    known = (labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("y"))
             .filter(F.col("id").isNotNull() & F.col("y").isin(0, 1)).filter(~common.held_out("id", mod))
             .groupBy("id").agg(F.max("y").alias("y")))
    n = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rate = {y: min(1.0, per_class / n[y]) for y in n}
    part = [rate.get(y, 1.0) for y in (0, 1)]
    return (known.filter(place < F.when(F.col("y") == 1, part[1]).otherwise(part[0]))
            .withColumn("weight", F.when(F.col("y") == 1, 1 / part[1]).otherwise(1 / part[0])))


def train(docs: DataFrame, labels: DataFrame, mod: int = 4, per_class: int = PER_CLASS) -> Machine:
    """Fit on the sampled labels' texts; the driver sees at most about 2 * per_class rows of term numbers."""

    def termed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for b in batches:
            got = [terms(t).astype(np.int32).tobytes() for t in common.binary(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary()), b.column(2), b.column(3)],
                                             names=["doc_id", "terms", "y", "weight"])

    picked = F.broadcast(sampled_labels(labels, mod, per_class))     # a fixed number of small rows
    rows = (_source(docs).join(picked, F.col("doc_id") == F.col("id")).select("doc_id", "text", "y", "weight")
            .mapInArrow(termed, "doc_id long, terms binary, y int, weight double").collect())
    rows.sort(key=lambda r: (r.doc_id, bytes(r.terms)))
    return fit([np.frombuffer(r.terms, np.int32).astype(np.int64) for r in rows], np.array([r.y for r in rows], dtype=float),
               np.array([r.weight for r in rows], dtype=float))


def toxicity(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, model = Terms(), sent.value
        for b in batches:
            got = [terms(t, model.chosen) for t in common.binary(b.column(1))]
            start = np.concatenate(([0], np.cumsum([len(g) for g in got]))).astype(np.int64)
            flat = np.concatenate(got) if got else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.probability(flat, start))], names=["doc_id", "score"])

    return _source(docs).mapInArrow(scored, "doc_id long, score double")
