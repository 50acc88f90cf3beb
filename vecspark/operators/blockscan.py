"""Exact distance scans of a partitioned base table against a partitioned query table.

This is the physical operator behind every dense k-NN / range / multi-vector
job.  The plan is always

    base rows     --mapInPandas-->  blocks of at most BASE_ROWS rows     \
    query rows    --mapInPandas-->  blocks of at most QUERY_ROWS queries  >  grid of (base, query) blocks
        --mapInPandas-->  partial results per task  --shuffle on qid-->  final per-query window (row_number <= k)

* Neither side passes through the driver and neither is broadcast: a task of the
  grid reads one partition of base blocks and one of query blocks.  The grid has
  one row per pair of *blocks*, never one per pair of vectors.
* Inside a task a base block is compared with a query block through one BLAS
  product.  Those approximate distances only *screen*: every row that can be in
  the answer (approximate distance within a proven error bound of the k-th
  best) is re-scored with the exact sequential double sum, which is the value
  reported and ranked on.  Results are therefore exact and deterministic.
* A task emits at most ``k`` rows per query (top-k modes), so the shuffle
  is ``nq * k * partitions`` rows regardless of the base size; radius results
  leave a task chunk by chunk.
* A task holds ``BLOCKS_HELD`` query blocks with at most ``3 * k`` results a query and works on chunks of
  ``PAIR_BUDGET`` cells, so its memory depends neither on the number of rows nor on that of queries.  A query's k-th best
  distance so far screens the chunks that follow.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

METRICS = ("l2", "ip", "cosine")
KERNELS: dict = {}               # own distances: name -> function of row-paired matrices
BASE_ROWS = 2048                 # rows of one base block
QUERY_ROWS = 1024                # queries of one query block
BLOCKS_HELD = 2                  # query blocks of one grid task
CELLS_HELD, ROWS_HELD = 16, 1 << 20   # a task that meets more query blocks (cells) leaves its results beyond so many rows
PAIR_BUDGET = 1 << 18            # approximate-distance cells (matrix elements of an own distance) per in-task chunk
SCREEN_TOL = 1e-9                # bound on the BLAS screening error, relative

PARTIAL_SCHEMA = "qid long, id long, dist double"


@dataclass
class QueryBlock:
    """What a task needs to know about the queries of one block."""

    qid: np.ndarray
    Q: np.ndarray
    ftags: list | None = None           # per query: array of required tags
    is_and: np.ndarray | None = None
    ranges: np.ndarray | None = None    # (nq, 4) lo0 hi0 lo1 hi1, nan = unbounded
    qattr: np.ndarray | None = None     # (nq, m) attribute codes for fusion distances
    radius: np.ndarray | None = None    # per-query radius for radius modes
    extra: dict = field(default_factory=dict)


def register_kernel(name: str, pairs) -> None:
    """Plug in a distance: ``pairs(Q, X)`` gives the distances of row-paired float matrices, smaller is closer.

    It is evaluated for every pair of a block (no matrix product can screen for it).
    """
    if name in METRICS:
        raise ValueError(f"{name!r} is built in")
    KERNELS[name] = pairs


# ------------------------------------------------------------------ numpy kernels

def as_matrix(col: pd.Series) -> np.ndarray:
    if len(col) == 0:
        return np.zeros((0, 0))
    return np.vstack(col.to_numpy()).astype(np.float64, copy=False)


def exact_pairs(Qp: np.ndarray, Xp: np.ndarray, metric: str) -> np.ndarray:
    """Exact distance of row-paired matrices, summing dimensions in order (matches SQL list sums)."""
    if callable(metric):
        return metric(Qp, Xp)
    m, d = Qp.shape
    if metric == "l2":
        acc = np.zeros(m)
        for j in range(d):
            t = Qp[:, j] - Xp[:, j]
            acc += t * t
        return acc
    dot = np.zeros(m)
    for j in range(d):
        dot += Qp[:, j] * Xp[:, j]
    if metric == "ip":
        return 1.0 - dot
    qq = np.zeros(m)
    xx = np.zeros(m)
    for j in range(d):
        qq += Qp[:, j] * Qp[:, j]
        xx += Xp[:, j] * Xp[:, j]
    norm = np.sqrt(qq * xx)
    return 1.0 - dot / np.where(norm == 0, 1.0, norm)      # a zero vector counts as its own unit vector


def checked_pairs(Q, X, qi, xj, metric) -> np.ndarray:
    """Exact distances of the pairs ``(qi, xj)``, gathered in slices of at most ``PAIR_BUDGET`` elements."""
    step = max(1, PAIR_BUDGET // max(1, Q.shape[1]))
    QT, XT = np.ascontiguousarray(Q.T), np.ascontiguousarray(X.T)          # a column of the gathered pairs is one piece of memory
    parts = [exact_pairs(np.take(QT, qi[a:a + step], axis=1).T, np.take(XT, xj[a:a + step], axis=1).T, metric)
             for a in range(0, len(qi), step)]
    return np.concatenate(parts) if parts else np.zeros(0)


def approx_block(Q, X, metric, qn, xn):
    """Screening distances through one matrix product, and their error bound."""
    if callable(metric):
        A = np.empty((len(Q), len(X)))
        step = max(1, PAIR_BUDGET // max(1, X.size))         # queries of one call; they meet the same repeated rows
        rows = np.tile(X.T, (1, min(step, len(Q))))
        for a in range(0, len(Q), step):
            some = Q[a:a + step]
            pairs = len(some) * len(X)
            A[a:a + step] = metric(np.repeat(some.T, len(X), axis=1).T, rows[:, :pairs].T).reshape(len(some), len(X))
        return np.where(np.isnan(A), np.inf, A), np.zeros((len(Q), 1))
    G = Q @ X.T
    if metric == "l2":
        A = qn[:, None] + xn[None, :] - 2.0 * G
        tol = SCREEN_TOL * (qn[:, None] + xn.max(initial=0.0) + 1.0)
    elif metric == "ip":
        A = 1.0 - G
        tol = SCREEN_TOL * (np.sqrt(qn)[:, None] * np.sqrt(xn.max(initial=0.0)) + 1.0)
    else:
        norm = np.sqrt(qn[:, None] * xn[None, :])
        A = 1.0 - G / np.where(norm == 0, 1.0, norm)
        tol = np.full((len(Q), 1), SCREEN_TOL)
    A = np.where(np.isnan(A), np.inf, A)
    return A, tol


def topk_triples(qi, ids, d, k):
    """Keep the k best (d, id) per qi."""
    if len(qi) == 0:
        return qi, ids, d
    order = np.lexsort((ids, d, qi))
    qi, ids, d = qi[order], ids[order], d[order]
    starts = np.r_[0, np.flatnonzero(np.diff(qi)) + 1]
    sizes = np.diff(np.r_[starts, len(qi)])
    rank = np.arange(len(qi)) - np.repeat(starts, sizes)
    keep = rank < k
    return qi[keep], ids[keep], d[keep]


def filter_groups(ftags: list, is_and: np.ndarray) -> tuple[list, np.ndarray]:
    """Distinct normalised filters of a query block and each query's index into them (once per block)."""
    keys: dict = {}
    fidx = np.empty(len(ftags), dtype=np.int64)
    for qi, ft in enumerate(ftags):
        key = (bool(is_and[qi]), tuple(sorted({int(t) for t in ft})))
        fidx[qi] = keys.setdefault(key, len(keys))
    return list(keys), fidx


def _tag_masks(block: QueryBlock, row_tags: pd.Series, b: int) -> np.ndarray:
    """(nq, b) boolean: row satisfies the query's tag filter (AND / OR, empty = all).

    One mask per *distinct* filter of the block (precomputed groups), then gathered per query.
    """
    groups, fidx = block.extra["filter_groups"]
    lengths = row_tags.map(lambda a: 0 if a is None else len(a)).to_numpy()
    flat = (np.concatenate([np.asarray(a) for a in row_tags if a is not None and len(a)])
            if lengths.sum() else np.zeros(0, dtype=np.int64))
    owner = np.repeat(np.arange(b), lengths)
    wanted = np.array(sorted({t for _, ts in groups for t in ts}), dtype=np.int64)
    H = np.zeros((len(wanted), b), dtype=bool)          # row has tag: one scatter over the postings
    if len(wanted) and len(flat):
        pos = np.searchsorted(wanted, flat)
        ok = (pos < len(wanted)) & (wanted[np.minimum(pos, len(wanted) - 1)] == flat)
        H[pos[ok], owner[ok]] = True
    rows = np.empty((len(groups), b), dtype=bool)
    for g, (is_and, ts) in enumerate(groups):
        if not ts:
            rows[g] = True
            continue
        sub = H[np.searchsorted(wanted, ts)]
        rows[g] = sub.all(axis=0) if is_and else sub.any(axis=0)
    return rows[fidx]


def _range_masks(block: QueryBlock, a0: np.ndarray, a1: np.ndarray) -> np.ndarray:
    r = np.where(np.isnan(block.ranges), np.array([-np.inf, np.inf, -np.inf, np.inf]), block.ranges)
    m0 = (a0[None, :] >= r[:, 0:1]) & (a0[None, :] < r[:, 1:2])
    m1 = (a1[None, :] >= r[:, 2:3]) & (a1[None, :] < r[:, 3:4])
    return np.where(block.is_and[:, None], m0 & m1, m0 | m1)


def _fusion_counts(qattr: np.ndarray, rattr: np.ndarray) -> np.ndarray:
    return (qattr[:, None, :] != rattr[None, :, :]).sum(axis=2)


def _fuse(d, cnt, fusion):
    kind, param = fusion
    if kind == "mul":
        return d * (1.0 + cnt / param)
    return d + cnt * param


# ------------------------------------------------------------------ the per-partition operator

def _make_scan(metric: str, mode: str, k: int, cols: dict, fusion, exclude_self: bool, inclusive: bool):
    vec_col, id_col = cols["vec"], cols["id"]
    tag_col, a0_col, a1_col = cols.get("tags"), cols.get("a0"), cols.get("a1")
    attr_col, group_col = cols.get("attr"), cols.get("group")

    def compare(block: QueryBlock, part: pd.DataFrame, X: np.ndarray, bound: np.ndarray | None):
        """(query index, row id, distance, group) of the rows of one chunk that can be in the answer.

        ``bound``: the k-th best exact distance of each query so far (inf: fewer than k).
        """
        Q = block.Q
        ids = part[id_col].to_numpy(dtype=np.int64)
        b = len(ids)
        A, tol = approx_block(Q, X, metric, (Q * Q).sum(axis=1), (X * X).sum(axis=1))
        plain = A                               # an own distance is exact already
        mask = None
        if block.ftags is not None:
            mask = _tag_masks(block, part[tag_col], b)
        if block.ranges is not None:
            rm = _range_masks(block, part[a0_col].to_numpy(float), part[a1_col].to_numpy(float))
            mask = rm if mask is None else (mask & rm)
        if cols.get("live"):
            from vecspark.streaming.replay import live_mask
            lm = live_mask(part["live_a"], part["live_b"], block.extra["step"], b)
            mask = lm if mask is None else (mask & lm)
        if cols.get("route"):
            code = {r: i for i, r in enumerate(dict.fromkeys(block.extra["route"]))}
            mine = np.array([code.get(p, -1) for p in part["pid"]])
            rm = mine[None, :] == np.array([code[r] for r in block.extra["route"]])[:, None]
            mask = rm if mask is None else (mask & rm)
        if exclude_self:
            sm = ids[None, :] != block.qid[:, None]
            mask = sm if mask is None else (mask & sm)
        cnt = None
        if fusion is not None:
            rattr = np.vstack(part[attr_col].to_numpy()).astype(np.int64)
            cnt = _fusion_counts(block.qattr, rattr)
            A = _fuse(A, cnt, fusion)
            grown = 1.0 / abs(fusion[1]) if fusion[0] == "mul" else max(abs(fusion[1]), 1.0)
            tol = tol * (1.0 + grown * rattr.shape[1])
        if mask is not None:
            A = np.where(mask, A, np.inf)
        cand = np.isfinite(A)
        if mode == "radius":
            cand &= A <= block.radius[:, None] + 2.0 * tol
        elif bound is not None:
            cand &= A <= bound[:, None] + 2.0 * tol
        if mode == "topk" and np.count_nonzero(cand) > len(Q) * k:
            kk = min(k, b)
            cand &= A <= np.partition(A, kk - 1, axis=1)[:, kk - 1:kk] + 2.0 * tol
        grp = None
        if mode == "topk_groups":
            # screen per (query, group): keep rows within tolerance of the group's best
            grp = part[group_col].to_numpy(dtype=np.int64)
            order = np.argsort(grp, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(grp[order]) != 0])
            place = np.empty(b, dtype=np.int64)
            place[order] = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, b]))
            cand &= A <= np.minimum.reduceat(A[:, order], starts, axis=1)[:, place] + 2.0 * tol
        qi, xj = np.nonzero(cand)
        g = None if grp is None else grp[xj]
        E = plain[qi, xj] if callable(metric) else checked_pairs(Q, X, qi, xj, metric)
        if fusion is not None:
            E = _fuse(E, cnt[qi, xj], fusion)
        if mode == "radius":
            ok = (E <= block.radius[qi]) if inclusive else (E < block.radius[qi])
            qi, xj, E = qi[ok], xj[ok], E[ok]
        return qi, ids[xj], E, g

    def reduced(acc: list) -> list:
        """The accumulated results of one query block, cut to what can still be in the answer."""
        if mode == "topk":
            return [(*topk_triples(*(np.concatenate([a[i] for a in acc]) for i in range(3)), k), None)]
        q, i, d, g = _reduce_groups(*([a[i] for a in acc] for i in range(4)), k)
        return [(q[0], i[0], d[0], g[0])]

    def kth_best(nq: int, q, d) -> np.ndarray:
        """The k-th best distance of each query of a cut result, inf where it has fewer."""
        n = np.bincount(q, minlength=nq)
        ends = np.cumsum(n)
        out = np.full(nq, np.inf)
        full = n >= k
        out[full] = d[ends[full] - 1]
        return out

    def frame(block: QueryBlock, q, i, d, g) -> pd.DataFrame:
        out = {"qid": block.qid[q], "id": i, "dist": d}
        return pd.DataFrame(out if g is None else out | {"grp": g})

    def scan(batches):
        blocks: dict[int, QueryBlock] = {}
        held: dict[int, list] = {}
        bounds: dict[int, np.ndarray] = {}
        base = None
        for pdf in batches:
            for raw, number, packed in zip(pdf["rows"], pdf["block"], pdf["queries"], strict=True):
                if number not in blocks:
                    blocks[number] = pickle.loads(packed)
                block = blocks[number]
                if raw != base:
                    base, rows = raw, pickle.loads(raw)
                    matrix = as_matrix(rows[vec_col])
                # an own distance sees row-paired matrices: a call for one query has at most PAIR_BUDGET elements too
                width = block.Q.shape[1] if callable(metric) and len(block.Q) else 1
                chunk = max(1, PAIR_BUDGET // max(len(block.Q), width, 1))
                for lo in range(0, len(rows), chunk):
                    found = compare(block, rows.iloc[lo:lo + chunk], matrix[lo:lo + chunk], bounds.get(number))
                    if not len(found[0]):
                        continue
                    if mode == "radius":
                        yield frame(block, *found)
                        continue
                    acc = held.setdefault(number, [])
                    acc.append(found)
                    if number not in bounds or sum(len(a[0]) for a in acc) > 2 * len(block.Q) * k:
                        held[number] = reduced(acc)
                        bounds[number] = kth_best(len(block.Q), held[number][0][0], held[number][0][2])
                if len(blocks) > CELLS_HELD and sum(len(a[0]) for acc in held.values() for a in acc) > ROWS_HELD:
                    for n, acc in held.items():
                        yield frame(blocks[n], *reduced(acc)[0])
                    blocks, held, bounds = {}, {}, {}
        for number, acc in held.items():
            yield frame(blocks[number], *reduced(acc)[0])

    return scan


def _reduce_groups(acc_q, acc_i, acc_d, acc_g, k):
    """Best row per (query, group), then the k best groups per query."""
    qi, ids, d, g = (np.concatenate(acc_q), np.concatenate(acc_i),
                     np.concatenate(acc_d), np.concatenate(acc_g))
    order = np.lexsort((ids, d, g, qi))
    qi, ids, d, g = qi[order], ids[order], d[order], g[order]
    first = np.r_[True, (qi[1:] != qi[:-1]) | (g[1:] != g[:-1])]
    qi, ids, d, g = qi[first], ids[first], d[first], g[first]
    order = np.lexsort((ids, d, qi))
    qi, ids, d, g = qi[order], ids[order], d[order], g[order]
    starts = np.r_[0, np.flatnonzero(np.diff(qi)) + 1] if len(qi) else np.zeros(0, int)
    rank = np.arange(len(qi)) - np.repeat(starts, np.diff(np.r_[starts, len(qi)]))
    keep = rank < k
    return [qi[keep]], [ids[keep]], [d[keep]], [g[keep]]


# ------------------------------------------------------------------ blocks

def _pack_queries(qvec: str, kinds: set, radius):
    def pack(batches):
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        for pdf in batches:
            for lo in range(0, len(pdf), QUERY_ROWS):
                block = _build_block(pdf.iloc[lo:lo + QUERY_ROWS], qvec, kinds, radius)
                yield pd.DataFrame({"block": [number], "queries": [pickle.dumps(block)]})
                number += 1
    return pack


def _pack_rows(batches):
    for pdf in batches:
        for lo in range(0, len(pdf), BASE_ROWS):
            yield pd.DataFrame({"rows": [pickle.dumps(pdf.iloc[lo:lo + BASE_ROWS])]})


def _build_block(rows: pd.DataFrame, qvec: str, kinds: set, radius) -> QueryBlock:
    blk = QueryBlock(qid=rows["qid"].to_numpy(dtype=np.int64), Q=as_matrix(rows[qvec]))
    if "tags" in kinds:
        blk.ftags = [np.asarray([] if t is None else t, dtype=np.int64) for t in rows["ftags"]]
        blk.is_and = rows["is_and"].to_numpy(dtype=bool)
        blk.extra["filter_groups"] = filter_groups(blk.ftags, blk.is_and)
    if "range" in kinds:
        blk.ranges = rows[["lo0", "hi0", "lo1", "hi1"]].to_numpy(dtype=np.float64)
        blk.is_and = rows["is_and"].to_numpy(dtype=bool)
    if "live" in kinds:
        blk.extra["step"] = rows["step"].to_numpy(dtype=np.int64)
    if "route" in kinds:
        blk.extra["route"] = rows["route"].tolist()
    if "attr" in kinds:
        blk.qattr = np.vstack(rows["qattr"].to_numpy()).astype(np.int64)
    if radius is not None:
        blk.radius = (rows[radius].to_numpy(dtype=np.float64) if isinstance(radius, str)
                      else np.full(len(rows), float(radius)))
    return blk


def scan(base: DataFrame, queries: DataFrame, *, k: int = 10, metric: str = "l2",
         mode: str = "topk", qvec: str = "qv", vec: str = "v", id_col: str = "id",
         tag_filter: bool = False, range_filter: bool = False,
         fusion: tuple | None = None, attr_col: str | None = None,
         group_col: str | None = None, exclude_self: bool = False,
         radius=None, inclusive: bool = False, live_filter: bool = False, route_filter: bool = False) -> DataFrame:
    """Partial results ``(qid, id, dist[, grp])`` — at most k per (query, partition) in top-k modes.

    ``queries`` needs ``qid`` and the vector column, plus ``ftags, is_and`` for tag
    filters, ``lo0, hi0, lo1, hi1, is_and`` for range filters, ``qattr`` for fusion,
    ``route`` for ``route_filter`` (only base rows with that ``pid`` count), and a
    radius column when ``radius`` names one.
    """
    if metric not in METRICS and metric not in KERNELS:
        raise ValueError(f"unknown metric {metric!r}")
    metric = KERNELS.get(metric, metric)
    spark: SparkSession = base.sparkSession
    from vecspark.session import bound_batches, cut_lineage, ship_package
    ship_package(spark)
    bound_batches(spark)
    kinds, want = set(), []
    cols = {"vec": vec, "id": id_col}
    base_cols = [id_col, vec]
    if tag_filter:
        kinds.add("tags")
        want += ["ftags", "is_and"]
        cols["tags"] = "tags"
        base_cols.append("tags")
    if range_filter:
        kinds.add("range")
        want += ["lo0", "hi0", "lo1", "hi1"] + ([] if "is_and" in want else ["is_and"])
        cols["a0"], cols["a1"] = "a0", "a1"
        base_cols += ["a0", "a1"]
    if fusion is not None:
        kinds.add("attr")
        want.append("qattr")
        cols["attr"] = attr_col
        base_cols.append(attr_col)
    if group_col:
        cols["group"] = group_col
        base_cols.append(group_col)
    if live_filter:
        kinds.add("live")
        want.append("step")
        cols["live"] = True
        base_cols += ["live_a", "live_b"]
    if route_filter:
        kinds.add("route")
        want.append("route")
        cols["route"] = True
        base_cols.append("pid")
    if isinstance(radius, str):
        want.append(radius)
    schema = PARTIAL_SCHEMA + (", grp long" if mode == "topk_groups" else "")
    pruned = base.select(*base_cols)
    # query blocks are written once and dealt by number: each partition is one side of a grid task
    packed = cut_lineage(queries.select("qid", qvec, *want).repartition("qid")
                         .mapInPandas(_pack_queries(qvec, kinds, radius), "block long, queries binary"))
    packed = packed.repartition(max(1, -(-packed.count() // BLOCKS_HELD)))
    dealt = pruned.mapInPandas(_pack_rows, "rows binary").repartition(2 * spark.sparkContext.defaultParallelism)
    grid = dealt.crossJoin(packed.hint("shuffle_replicate_nl"))
    return grid.mapInPandas(_make_scan(metric, mode, k, cols, fusion, exclude_self, inclusive), schema)


def rank_topk(partial: DataFrame, k: int, key: str = "qid", rk: str = "rk") -> DataFrame:
    """Final per-query top-k over partial results: ``row_number() over (qid order by dist, id) <= k``."""
    w = Window.partitionBy(key).orderBy("dist", "id")
    return partial.withColumn(rk, F.row_number().over(w)).where(F.col(rk) <= k)


def knn(base: DataFrame, queries: DataFrame, k: int = 10, metric: str = "l2", **kw) -> DataFrame:
    """Exact k-NN join: ``(qid, rk, id, dist)``, closest first, ties by id."""
    part = scan(base, queries, k=k, metric=metric, mode="topk", **kw)
    return rank_topk(part, k).select("qid", "rk", "id", "dist")
