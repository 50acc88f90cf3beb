"""Language identification by nearest centroid over normalised TF-IDF n-gram vectors.

N-grams are 2 to 4 bytes of the text's letters (ASCII lower-cased, everything else one space), hashed to ``SLOTS``
slots; a text's vector is log(1 + occurrences) x idf, of length 1.  Every language has several centroids, from
spherical k-means over a bounded sample of its training texts; a text gets the language of the centroid with the
greatest cosine.  Distance-based rejection: a text further from its centroid than all but ``REJECT`` of the
language's own sampled texts is marked ``rejected`` (its nearest language is still given).

idf counts all training documents (one row a slot and task is shuffled).  The fitting sample is at most ``SAMPLE``
texts of each language, chosen by a hash of doc_id among all of them; each language, however rare, is learned and
clustered in a task of its own.  The counts of the at most ``RAREST`` languages that have 1/RAREST of the training texts
are broadcast to thin their texts before the shuffle; texts of rarer ones all go to the choice.  The centroids
(languages x clusters x slots) are broadcast; prediction is one Arrow pass.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; null languages are not learned from;
very long texts are counted whole, 128 texts at a time; of equally near centroids the first language in order wins;
repeated rows are answered row by row; without training rows everything is ``und``; an empty table gives an empty
result.  Only doc_id, text and (for training) lang are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecspark.llm import common

SLOTS = 1 << 12
LENGTHS = (2, 3, 4)
CLUSTERS = 3
SAMPLE = 400
ROUNDS = 12
REJECT = 0.005
RAREST = 100_000               # texts of a language in less than one of so many training texts are not thinned beforehand
UND = "und"
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
#: letters lowered, other ASCII bytes a space, bytes from 0x80 on as they are
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0x80 else 32 for c in range(256))


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(c.isalpha() for c in text.decode(errors="replace") if ord(c) > 127)


def counts(texts: list[bytes]) -> np.ndarray:
    """Occurrences of hashed n-grams, a row a text."""
    out = np.zeros((len(texts), SLOTS), np.float32)
    if not texts:
        return out
    folded = [b" " + t.translate(FOLD) + b" " for t in texts]
    flat = np.frombuffer(b"".join(folded), np.uint8)
    n = np.array([len(t) for t in folded])
    doc = np.repeat(np.arange(len(texts)), n)
    keep = np.ones(len(flat), bool)
    keep[1:] = (flat[1:] != 32) | (flat[:-1] != 32) | (doc[1:] != doc[:-1])
    flat, doc = flat[keep].astype(np.uint32), doc[keep]
    bits = int(SLOTS).bit_length() - 1
    gram = flat
    total = np.zeros(len(texts) * SLOTS, np.int64)
    for length in range(2, max(LENGTHS) + 1):
        gram = (gram[:-1] << np.uint32(8)) | flat[length - 1:]
        if length in LENGTHS:
            inside = doc[:len(gram)] == doc[length - 1:]
            slot = ((gram + np.uint32(length * 0x1F35)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
            total += np.bincount(doc[:len(gram)][inside] * SLOTS + slot[inside], minlength=len(total))
    return total.reshape(len(texts), SLOTS).astype(np.float32)


def vectors(texts: list[bytes], idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts(texts)) * idf
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.maximum(norm, 1e-9)


def cluster(x: np.ndarray, k: int, seed: int = 3) -> np.ndarray:
    """Spherical k-means; the first centroid is the mean, further ones start at the farthest text."""
    def unit(c: np.ndarray) -> np.ndarray:
        return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)

    c = unit(x.mean(axis=0, keepdims=True))
    while len(c) < min(k, len(x)):
        c = np.concatenate([c, x[[int((x @ c.T).max(axis=1).argmin())]]])
    for _ in range(ROUNDS):
        near = (x @ c.T).argmax(axis=1)
        c = unit(np.stack([x[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(len(c))]))
    return c


@dataclass
class Centroids:
    idf: np.ndarray
    vectors: np.ndarray
    langs: list[str]
    least: np.ndarray


def _source(docs: DataFrame, *more) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def _training(docs: DataFrame, mod: int) -> DataFrame:
    return (_source(docs, F.col("lang").cast("string").alias("lang")).filter(~common.held_out("doc_id", mod))
            .filter(F.col("lang").isNotNull() & F.col("text").isNotNull()))


def train(docs: DataFrame, mod: int = 4, sample: int = SAMPLE) -> Centroids:
    rows = _training(docs, mod)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS + 1, np.int64)          # the last entry counts documents
        for b in batches:
            texts = [t for t in common.binary(b.column(0)) if has_letter(t)]
            for a in range(0, len(texts), 128):
                part = counts(texts[a:a + 128])
                total[:-1] += (part > 0).sum(axis=0)
                total[-1] += len(part)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLOTS + 1)), pa.array(total)], names=["slot", "n"])

    df = np.zeros(SLOTS + 1)
    for r in rows.select("text").mapInArrow(seen, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        df[r.slot] = r.n
    idf = (np.log((df[-1] + 1) / (df[:-1] + 1)) + 0.1).astype(np.float32)
    if not df[-1]:
        return Centroids(idf, np.zeros((0, SLOTS), np.float32), [], np.zeros(0))

    per_lang = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    total = per_lang.agg(F.sum("n")).first()[0]
    common_langs = F.broadcast(per_lang.filter(F.col("n") * RAREST >= total))      # at most RAREST rows
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    likely = (rows.withColumn("place", place).join(common_langs, "lang", "left")   # a small superset of a common language's sample
              .filter(F.col("n").isNull() | (F.col("place") < F.lit(4.0 * sample) / F.col("n"))))
    first = Window.partitionBy("lang").orderBy("place", "doc_id", F.xxhash64("text"))
    picked = likely.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= sample).select("lang", "text")
    sent = docs.sparkSession.sparkContext.broadcast(idf)

    def clustered(table: pa.Table) -> pa.Table:
        lang = table.column("lang")[0].as_py()
        texts = sorted(t for t in common.binary(table.column("text").combine_chunks()) if has_letter(t))
        parts = [vectors(texts[a:a + 128], sent.value) for a in range(0, len(texts), 128)]
        if not parts:
            return pa.table({"lang": pa.array([], pa.string()), "centroid": pa.array([], pa.binary()), "least": pa.array([], pa.float64())})
        x = np.concatenate(parts)
        c = cluster(x, CLUSTERS).astype(np.float32)
        least = float(np.quantile((x @ c.T).max(axis=1), REJECT))
        return pa.table({"lang": [lang] * len(c), "centroid": pa.array([v.tobytes() for v in c], pa.binary()), "least": [least] * len(c)})

    got = sorted((r.lang, bytes(r.centroid), r.least) for r in
                 picked.groupBy("lang").applyInArrow(clustered, "lang string, centroid binary, least double").collect())
    return Centroids(idf, np.stack([np.frombuffer(c, np.float32) for _, c, _ in got]) if got else np.zeros((0, SLOTS), np.float32),
                     [x for x, _, _ in got], np.array([v for _, _, v in got]))


def predict(docs: DataFrame, model: Centroids) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            texts = common.binary(b.column(1))
            pred, score, far = [UND] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            mine = [i for i, t in enumerate(texts) if t and has_letter(t)] if m.langs else []
            for a in range(0, len(mine), 128):
                some = mine[a:a + 128]
                sim = vectors([texts[i] for i in some], m.idf) @ m.vectors.T
                best = sim.argmax(axis=1)
                for i, k, s in zip(some, best.tolist(), sim.max(axis=1).tolist(), strict=True):
                    pred[i], score[i], far[i] = m.langs[k], min(max(s, 0.0), 1.0), s < m.least[k]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred), pa.array(score), pa.array(far)],
                                             names=["doc_id", "lang_pred", "score", "rejected"])

    return _source(docs).mapInArrow(nearest, "doc_id long, lang_pred string, score double, rejected boolean")
