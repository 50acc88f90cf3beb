"""Sparse (bag-of-words) vectors: pruning and inner-product search.

Two forms: *rows* ``(id, dims, ws)`` — one row a vector, entries by weight descending, then dim — and *long*
``(id, dim, w)``.  Search works on rows: a task compares a batch of vectors with a block of queries through one
matrix product over the block's dims and emits the k best per query, so neither postings nor (query, vector)
pairs are shuffled, however frequent a term is; the shuffle is ``nq * k * partitions`` rows.  Query blocks reach the
tasks through a grid of (batch, block) pairs, not through the driver; they travel as their entries, and a task makes the
matrices of its ``BLOCKS_HELD`` blocks once.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecspark.session import cut_lineage, ship_package

QUERY_ROWS = 512              # queries of one block
BLOCKS_HELD = 2               # query blocks of one grid task
BASE_ROWS = 256               # vectors of one block
CELLS = 1 << 19               # entries of a dense batch (vectors x dims of the query block)


def long_form(rows: DataFrame) -> DataFrame:
    """``(id, dim, w)`` of row-form vectors."""
    return rows.select("id", F.explode(F.arrays_zip("dims", "ws")).alias("e")).select(
        "id", F.col("e.dims").alias("dim"), F.col("e.ws").alias("w"))


def query_rows(queries: DataFrame) -> DataFrame:
    """Row form ``(qid, dims, ws)`` of long-form queries."""
    entry = F.struct((-F.col("w")).alias("nw"), "dim")
    return (queries.groupBy("qid").agg(F.sort_array(F.collect_list(entry)).alias("e"))
            .select("qid", F.col("e.dim").alias("dims"), F.transform("e.nw", lambda x: -x).alias("ws")))


def _pack_queries(batches):
    """Blocks of queries: ids, place of each dim, and the entries ``(query, place, weight, number in the query)``."""
    from pyspark import TaskContext
    number = TaskContext.get().partitionId() << 32
    for pdf in batches:
        for lo in range(0, len(pdf), QUERY_ROWS):
            part = pdf.iloc[lo:lo + QUERY_ROWS]
            at = {d: i for i, d in enumerate(sorted({d for ds in part["dims"] for d in ds}))}
            n = np.array([len(ds) for ds in part["dims"]], dtype=np.int64)
            entries = (np.repeat(np.arange(len(part)), n), np.array([at[d] for ds in part["dims"] for d in ds], dtype=np.int64),
                       np.concatenate([np.asarray(ws, dtype=np.float64) for ws in part["ws"]]), np.concatenate([np.arange(x) for x in n]))
            yield pd.DataFrame({"block": [number], "queries": [pickle.dumps((part["qid"].to_numpy(np.int64), at, entries))]})
            number += 1


def _matrices(packed: bytes, terms: int | None):
    """Ids, places of the dims, and the weights as a matrix: of all entries, and of the first ``terms`` of each query."""
    qid, at, (row, col, w, nth) = pickle.loads(packed)
    m = np.zeros((len(qid), len(at)))
    np.add.at(m, (row, col), w)
    short = m
    if terms is not None:
        short = np.zeros_like(m)
        first = nth < terms
        np.add.at(short, (row[first], col[first]), w[first])
    return qid, at, m, short


def _pack_rows(batches):
    """Blocks of vectors as flat arrays: ids, entries a row, number of each entry's term, weights, and the distinct terms."""
    for batch in batches:
        for lo in range(0, batch.num_rows, BASE_ROWS):
            part = batch.slice(lo, BASE_ROWS)
            dims, ws = part.column(1), part.column(2)
            names = dims.flatten().dictionary_encode()
            n = np.diff(dims.offsets.to_numpy())
            block = (part.column(0).to_numpy(zero_copy_only=False), n, names.indices.to_numpy(zero_copy_only=False), ws.flatten().to_numpy(zero_copy_only=False), names.dictionary.to_pylist())
            yield pa.RecordBatch.from_pydict({"rows": pa.array([pickle.dumps(block)], pa.binary())})


def _best(qid, ids, score, full, k: int):
    """The k best of each query: score descending, then id."""
    order = np.lexsort((ids, -score, qid))
    qid, ids, score, full = qid[order], ids[order], score[order], full[order]
    first = np.r_[True, qid[1:] != qid[:-1]] if len(qid) else np.zeros(0, bool)
    rank = np.arange(len(qid)) - np.maximum.accumulate(np.where(first, np.arange(len(qid)), 0)) if len(qid) else np.zeros(0, int)
    return qid[rank < k], ids[rank < k], score[rank < k], full[rank < k]


def top_scores(rows: DataFrame, queries: DataFrame, k: int, weight=None, digits: int | None = None,
               terms: tuple[int, int] | None = None) -> DataFrame:
    """Partial results ``(qid, id, score, full)``: at most k per query and task; ``weight`` maps an array of weights.

    ``queries`` is in row form ``(qid, dims, ws)``.  With ``digits`` vectors are ranked on the rounded score.  With
    ``terms = (doc_t, query_t)`` the score counts the first entries of each side only and ``full`` all of them: rows are whole in
    a task, so candidates are re-scored where they are found.
    """
    def scan(batches):
        blocks, held, base = {}, {}, None
        for batch in batches:
            for row_of in range(batch.num_rows):                    # one row's bytes at a time
                raw, number = (batch.column(i)[row_of].as_py() for i in range(2))
                if number not in blocks:
                    blocks[number] = _matrices(batch.column(2)[row_of].as_py(), terms and terms[1])
                qid, at, m, short = blocks[number]
                if raw != base:
                    base, (ids, n, code, ws, names) = raw, pickle.loads(raw)
                    ends = np.concatenate(([0], np.cumsum(n)))
                place = np.array([at.get(t, -1) for t in names], dtype=np.int64)       # a look-up a distinct term
                size = max(1, CELLS // max(1, len(at)))
                for lo in range(0, len(ids), size):
                    hi = min(lo + size, len(ids))
                    a, z = ends[lo], ends[hi]
                    if a == z:
                        continue
                    row = np.repeat(np.arange(hi - lo), n[lo:hi])
                    col, w = place[code[a:z]], ws[a:z]
                    ok = col >= 0
                    dense = np.zeros((hi - lo, len(at)))
                    dense[row[ok], col[ok]] = w[ok] if weight is None else weight(w[ok])
                    full = m @ dense.T
                    score = full
                    if terms is not None:
                        nth = np.arange(a, z) - ends[lo:hi][row]
                        dense[row[ok & (nth >= terms[0])], col[ok & (nth >= terms[0])]] = 0
                        score = short @ dense.T
                    if digits is not None:
                        score = np.round(score, digits)
                    if score.shape[1] > k:               # the k-th best of each query, ties included
                        least = -np.partition(-score, k - 1, axis=1)[:, k - 1:k]
                        qi, xj = np.nonzero((score >= least) & (score > 0))
                    else:
                        qi, xj = np.nonzero(score > 0)
                    found = (qid[qi], ids[lo:hi][xj], score[qi, xj], full[qi, xj])
                    old = held.get(number)
                    held[number] = _best(*(found if old is None else [np.concatenate(x) for x in zip(old, found, strict=True)]), k)
        for q, i, v, f in held.values():
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(i, pa.int64(), mask=pd.isna(i)), pa.array(v), pa.array(f)], names=["qid", "id", "score", "full"])

    ship_package(rows.sparkSession)
    blocks = cut_lineage(queries.repartition("qid").mapInPandas(_pack_queries, "block long, queries binary"))
    blocks = blocks.repartition(max(1, -(-blocks.count() // BLOCKS_HELD)))
    grid = rows.select("id", "dims", "ws").mapInArrow(_pack_rows, "rows binary").crossJoin(blocks.hint("shuffle_replicate_nl"))
    return grid.mapInArrow(scan, "qid long, id long, score double, full double")


def rank_by_score(s: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("id"))
    return s.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)


def mips(rows: DataFrame, queries: DataFrame, k: int = 10, weight=None, digits: int | None = None) -> DataFrame:
    """Exact sparse top-k by inner product ``(qid, rk, id, score)`` of row-form vectors and long-form queries."""
    return rank_by_score(top_scores(rows, query_rows(queries), k, weight, digits), k).select("qid", "rk", "id", "score")


def prune_mass(sp: DataFrame, alpha: float) -> DataFrame:
    """Per row, the fewest largest entries whose cumulative weight reaches ``alpha`` of the row total."""
    w = Window.partitionBy("id").orderBy(F.col("w").desc(), F.col("dim"))
    before = F.coalesce(F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    total = F.sum("w").over(Window.partitionBy("id"))
    return sp.withColumn("_before", before).withColumn("_total", total) \
             .where(F.col("_before") < F.lit(alpha) * F.col("_total")).select("id", "dim", "w")


def prune_topt(sp: DataFrame, t: int, scale: float | None = None) -> DataFrame:
    """Top-t entries per row (weight desc, dim); optional integer quantisation ``floor(w·scale)``, drop ≤ 0."""
    w = Window.partitionBy("id").orderBy(F.col("w").desc(), F.col("dim"))
    out = sp.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= t).drop("_r")
    if scale is not None:
        out = out.withColumn("w", F.floor(F.col("w") * scale).cast("double")).where(F.col("w") > 0)
    return out


def two_stage(rows: DataFrame, queries: DataFrame, k: int, doc_t: int, query_t: int, r: int) -> DataFrame:
    """The ``r`` best by pruned lists (top ``doc_t`` / ``query_t`` terms), ranked anew by their full lists."""
    cand = rank_by_score(top_scores(rows, query_rows(queries), r, terms=(doc_t, query_t)), r)
    full = cand.where(F.col("full") > 0).select("qid", "id", F.col("full").alias("score"))
    return rank_by_score(full, k).select("qid", "rk", "id", "score")


def saturated(k1: float):
    """Term weight ``w / (w + k1)`` (saturating term frequency) on an array of weights."""
    return lambda w: w / (w + k1)


def validate(sp: DataFrame, n_rows: int) -> DataFrame:
    """Violations of the CSR contract: non-positive weights, ids outside [0, n), empty dims."""
    checks = sp.select(
        F.sum(F.when(F.col("w") <= 0, 1).otherwise(0)).alias("nonpositive_weight"),
        F.sum(F.when((F.col("id") < 0) | (F.col("id") >= n_rows), 1).otherwise(0)).alias("id_out_of_range"),
        F.sum(F.when(F.col("dim") == "", 1).otherwise(0)).alias("empty_dim"))
    return checks.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("check"), F.coalesce(F.col(c), F.lit(0)).cast("long").alias("violations"))
        for c in ("nonpositive_weight", "id_out_of_range", "empty_dim")])).alias("x")).select("x.*")
