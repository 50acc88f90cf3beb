"""Embedding whitening: blockwise QR of the centred rows, then the bidiagonal qd solver of ``bidiagonal``.

Every usable vector becomes whole numbers x = floor(256 c).  The fit list is each distinct x vector once: its number
n and sums S are exact.  Each task centres its rows, (n x - S) / n, and folds them block by block into a triangle R by
QR; the triangles of all tasks are folded in two levels the same way.  R'R / n is the covariance; it is never formed.  The
singular values of R come from dqds on its Householder bidiagonal form, the directions from twisted factorisations.

How it scales: one shuffle makes the vectors distinct (combined before it, so a vector that a third of all rows share
is one row a task); everything else is a scan.  A task keeps one d x d triangle and one block of rows; GROUPS triangles at
most reach the driver, each of 8 d^2 bytes; the model (d sums, up to k directions) goes to the tasks in the closure.

Edge cases: a null vector, one with a null, infinite or NaN entry, or an empty one is left out; so is one whose length
is not the commonest of the rest (of equals the greatest); entries beyond a long saturate.  Repeated rows each get their result and count
once in the fit; tied eigenvalues get orthogonal directions; a component without variance (e <= e_1 d EPS) is not
returned, so a table with fewer than two distinct vectors, or none, gives no rows; a deviation beyond a long is null; a
null vec_id is kept; other columns are not read.  A vector's length is its only size: there is no text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm import bidiagonal, common

GROUPS = 128                   # partial results that reach the driver at most
SCALE = 256
LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Whitening:
    """What was fitted: ``n`` distinct vectors, their exact ``sums``, directions (d x k), eigenvalues and their shares."""
    n: int
    sums: list[int]
    directions: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float


def whole(vec: str) -> F.Column:
    """The x vector of an embedding, null where it cannot be used."""
    c = F.col(vec).cast("array<double>")
    sound = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))) & (F.size(c) > 0)
    return F.when(sound, F.transform(c, lambda e: F.floor(e * F.lit(float(SCALE))).cast("long")))


def usable(vectors: DataFrame, vec: str, *keep: str) -> DataFrame:
    return vectors.select(*keep, whole(vec).alias("x")).filter(F.col("x").isNotNull())


def matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.Array) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, d)


def differences(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: as longs where they fit, else as Python numbers."""
    top = max(abs(int(x.min())), abs(int(x.max()))) * n + max(abs(s) for s in sums) if len(x) else 0
    if top < 1 << 62:
        return x * np.int64(n) - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (differences(x, n, sums) / n).astype(float)


def squares(diff: np.ndarray) -> list[int | None]:
    """Sum of the squares of every row, exact; None where it is beyond a long."""
    if diff.dtype == object or (len(diff) and float(np.abs(diff).max()) ** 2 * diff.shape[1] > LONG / 2):
        exact = [sum(v * v for v in row) for row in diff.astype(object).tolist()]
        return [s if s <= LONG else None for s in exact]
    return (diff * diff).sum(axis=1).tolist()


def folded(df: DataFrame, name: str, first, merge) -> list:
    """Fold a table to at most GROUPS results: ``first(batches)`` in each task, ``merge(a, b)`` in each group of tasks.

    Results travel pickled; a group streams its tasks' results one by one.
    """
    import pickle

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = first(batches)
        if found is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([pickle.dumps(found)], pa.binary())})

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column("part").to_pylist():
                one = pickle.loads(raw)
                total = one if total is None else merge(total, one)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([pickle.dumps(total)], pa.binary())})

    parts = df.mapInArrow(task, "part binary").withColumn("g", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    few = parts.repartition(GROUPS, "g").select("part").mapInArrow(group, "part binary")
    return [pickle.loads(r["part"]) for r in few.collect()]


def column_sums(x: np.ndarray) -> list[int]:
    if len(x) and max(abs(int(x.min())), abs(int(x.max()))) * len(x) >= 1 << 62:
        x = x.astype(object)
    return [int(s) for s in x.sum(axis=0)]


def triangle(block: np.ndarray, above: np.ndarray | None) -> np.ndarray:
    """The R of ``above`` stacked on ``block``."""
    return np.linalg.qr(block if above is None else np.vstack([above, block]), mode="r")


def merge_moments(a: tuple, b: tuple) -> tuple:
    """(count, mean, centred product sum) of two parts together."""
    n = a[0] + b[0]
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def fold_all(parts: list, merge):
    total = None
    for one in parts:
        total = one if total is None else merge(total, one)
    return total


def fit(distinct: DataFrame, d: int, k: int = 4) -> Whitening | None:
    """Whitening of a table of distinct x vectors of length ``d``; None where no direction has variance."""
    def sums_of(batches):
        n, total = 0, [0] * d
        for b in batches:
            x = matrix(b.column("x"), d)
            n += len(x)
            total = [s + t for s, t in zip(total, column_sums(x), strict=True)]
        return n, total

    got = fold_all(folded(distinct, "sums", sums_of, lambda a, b: (a[0] + b[0], [s + t for s, t in zip(a[1], b[1], strict=True)])),
                   lambda a, b: (a[0] + b[0], [s + t for s, t in zip(a[1], b[1], strict=True)]))
    if got is None or got[0] == 0:
        return None
    n, sums = got

    def triangle_of(batches):
        r = None
        for b in batches:
            x = matrix(b.column("x"), d)
            if len(x):
                r = triangle(centred(x, n, sums), r)
        return r

    r = fold_all(folded(distinct, "triangles", triangle_of, lambda a, b: triangle(b, a)), lambda a, b: triangle(b, a))
    if len(r) < d:
        r = np.vstack([r, np.zeros((d - len(r), d))])
    squared, directions = bidiagonal.solve(r, min(k, d))
    trace = float((r * r).sum())
    live = int(sum(v > squared[0] * d * bidiagonal.EPS for v in squared[:min(k, d)])) if trace > 0 else 0
    if live == 0:
        return None
    directions, values = directions[:, :live], squared[:live] / n

    def moments_of(batches):
        total = None
        for b in batches:
            x = matrix(b.column("x"), d)
            if len(x):
                w = centred(x, n, sums) @ directions / np.sqrt(values)
                mean = w.mean(axis=0)
                part = (len(w), mean, (w - mean).T @ (w - mean))
                total = part if total is None else merge_moments(total, part)
        return total

    m = fold_all(folded(distinct, "moments", moments_of, merge_moments), merge_moments)
    error = float(np.abs(m[2] / n - np.eye(live)).max())
    return Whitening(n, sums, directions, values, squared[:live] / trace, error)


def whiten(vectors: DataFrame, vec: str = "embedding", key: str = "vec_id", k: int = 4) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of every usable row, components from 1."""
    spark = vectors.sparkSession
    rows = usable(vectors, vec, F.col(key).cast("long").alias("vec_id"))
    shape = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    distinct = common.stored(rows.groupBy("x").agg(F.count(F.lit(1)).alias("copies")), "vectors")
    lengths = distinct.groupBy(F.size("x").alias("d")).agg(F.sum("copies").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], shape)
    d = lengths["d"]
    model = fit(distinct.filter(F.size("x") == d).select("x"), d, k)
    if model is None:
        return spark.createDataFrame([], shape)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live = len(model.values)
        for b in batches:
            x = matrix(b.column("x"), d)
            diff = differences(x, model.n, model.sums)
            w = (diff / model.n).astype(float) @ model.directions / np.sqrt(model.values)
            m = len(x)
            spots = pa.array(np.repeat(np.arange(m), live))
            yield pa.RecordBatch.from_pydict({
                "vec_id": b.column("vec_id").take(spots),
                "component": pa.array(np.tile(np.arange(1, live + 1), m), pa.int32()),
                "n": pa.array(np.full(m * live, model.n), pa.int64()),
                "deviation": pa.array(squares(diff), pa.int64()).take(spots),
                "whitened": pa.array(w.reshape(-1), pa.float64()),
                "explained": pa.array(np.tile(model.explained, m), pa.float64()),
                "identity_error": pa.array(np.full(m * live, model.identity_error), pa.float64())})

    return rows.filter(F.size("x") == d).mapInArrow(apply, shape)
