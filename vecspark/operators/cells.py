"""Coarse cells (IVF): assignment to centroids, probing, cell statistics and layouts.

Centroids are few (about the square root of the rows, broadcast); rows are assigned inside
their own partitions with one BLAS product per batch and an exact re-check of the
near-best centroids, so ties resolve by (distance, centroid id) exactly.
Probing is an equi-join on ``cell`` — with the base stored partitioned by cell
that join prunes every unprobed partition.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecspark.operators import blockscan
from vecspark.operators.ranking import global_row_number, per_group_offsets
from vecspark.session import cut_lineage

def assign(rows: DataFrame, centroids: DataFrame, metric: str = "l2", vec: str = "v") -> DataFrame:
    """Adds ``cell`` (nearest centroid ``cid``, ties by smaller cid) and ``cdist``."""
    cs = centroids.select("cid", "c").orderBy("cid").collect()
    cid = np.array([r["cid"] for r in cs], dtype=np.int64)
    C = np.array([list(r["c"]) for r in cs], dtype=np.float64)
    bc = rows.sparkSession.sparkContext.broadcast((cid, C))
    schema = rows.select("*").schema.add("cell", "long").add("cdist", "double")

    def run(batches):
        ids, Cm = bc.value
        cn = (Cm * Cm).sum(axis=1)
        for pdf in batches:
            if len(pdf) == 0:
                continue
            X = blockscan.as_matrix(pdf[vec])
            xn = (X * X).sum(axis=1)
            A, tol = blockscan.approx_block(X, Cm, metric, xn, cn)
            best = A.min(axis=1, keepdims=True)
            ri, ci = np.nonzero(A <= best + 2.0 * tol)
            E = blockscan.exact_pairs(X[ri], Cm[ci], metric)
            order = np.lexsort((ids[ci], E, ri))
            ri, ci, E = ri[order], ci[order], E[order]
            first = np.r_[True, ri[1:] != ri[:-1]]
            out = pdf.copy()
            out["cell"] = ids[ci[first]]
            out["cdist"] = E[first]
            yield out

    return rows.mapInPandas(run, schema)


def probes(queries: DataFrame, centroids: DataFrame, nprobe: int, metric: str = "l2") -> DataFrame:
    """``(qid, cell, prk)``: the ``nprobe`` nearest cells of each query."""
    cb = centroids.select(F.col("cid").alias("id"), F.col("c").alias("v"))
    p = blockscan.knn(cb, queries, nprobe, metric)
    return p.select("qid", F.col("id").alias("cell"), F.col("rk").alias("prk"))


def _cell_blocks(kind: str, rows_of):
    """Pack rows sorted by cell into blocks of one cell: ``rows_of(part, number)`` gives a block's columns."""
    size = blockscan.BASE_ROWS if kind == "base" else blockscan.QUERY_ROWS

    def pack(batches):
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        cell, held, n = None, [], 0

        def block():
            return pd.DataFrame({"cell": [cell]} | rows_of(pd.concat(held), number))
        for pdf in batches:
            cuts = np.flatnonzero(np.diff(pdf["cell"].to_numpy())) + 1
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(pdf)], strict=True):
                while lo < hi:
                    here = int(pdf["cell"].iloc[lo])
                    if held and (here != cell or n >= size):
                        yield block()
                        held, n, number = [], 0, number + 1
                    cell, take = here, min(hi - lo, size - n if held else size)
                    held.append(pdf.iloc[lo:lo + take].drop(columns="cell"))
                    n, lo = n + take, lo + take
        if held:
            yield block()
    return pack


def cell_scan(assigned: DataFrame, queries: DataFrame, probe: DataFrame, k: int, metric: str = "l2", tag_filter: bool = False) -> DataFrame:
    """Partial top-k ``(qid, id, dist)`` of every query in its probed cells, block by block.

    Rows of a cell are packed into blocks, and so are the queries that probe it; blocks meet on the cell's number and the block-scan
    kernel compares them.  What is joined are blocks, never pairs of vectors, and a task sends k rows a query and cell block.
    A large cell is several blocks in several tasks (the rebalancing splits it).
    """
    tags, filters = (["tags"], ["ftags", "is_and"]) if tag_filter else ([], [])
    rows = (assigned.select("cell", "id", "v", *tags).hint("rebalance", "cell").sortWithinPartitions("cell")
            .mapInPandas(_cell_blocks("base", lambda part, number: {"rows": [pickle.dumps(part)]}), "cell long, rows binary"))
    asked = probe.select("qid", "cell").join(queries.select("qid", "qv", *filters), "qid").select("cell", "qid", "qv", *filters)
    kinds = {"tags"} if tag_filter else set()

    def packed(part, number):
        return {"block": [number], "queries": [pickle.dumps(blockscan._build_block(part, "qv", kinds, None))]}
    blocks = (asked.hint("rebalance", "cell").sortWithinPartitions("cell")
              .mapInPandas(_cell_blocks("queries", packed), "cell long, block long, queries binary"))
    grid = rows.join(blocks, "cell").select("rows", "block", "queries")
    columns = {"vec": "v", "id": "id"} | ({"tags": "tags"} if tag_filter else {})
    return grid.mapInPandas(blockscan._make_scan(metric, "topk", k, columns, None, False, False), blockscan.PARTIAL_SCHEMA)


def ivf_knn(assigned: DataFrame, queries: DataFrame, probe: DataFrame, k: int, metric: str = "l2",
            tag_filter: bool = False, max_codes: int | None = None) -> DataFrame:
    """Exact top-k among rows of the probed cells (optionally with the query's tag filter).

    With ``max_codes`` a query stops probing once the cells before (nearest first, ``probe.prk``) hold so many rows.
    """
    if max_codes is not None:
        sizes = assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        before = F.sum("n").over(Window.partitionBy("qid").orderBy("prk").rowsBetween(Window.unboundedPreceding, -1))
        probe = (probe.join(sizes, "cell").withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < max_codes).select("qid", "cell"))
    found = cell_scan(assigned, queries, probe, k, metric, tag_filter)
    return blockscan.rank_topk(found, k).select("qid", "rk", "id", "dist")


def balance(assigned: DataFrame, n_cells: int) -> DataFrame:
    """Cell sizes: min, max and imbalance ``n_cells · Σ s² / N²`` (empty cells count as 0)."""
    sizes = assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("s"))
    return sizes.agg(F.lit(n_cells).alias("n_cells"),
                     F.when(F.count(F.lit(1)) < n_cells, F.lit(0)).otherwise(F.min("s")).cast("long").alias("min_size"),
                     F.max("s").alias("max_size"),
                     (F.lit(float(n_cells)) * F.sum(F.col("s") * F.col("s")) / (F.sum("s") * F.sum("s"))).alias("imbalance"))


def permute(assigned: DataFrame) -> DataFrame:
    """Cluster-contiguous new ids: ``offset(cell) + position of id inside its cell - 1``.

    Offsets are prefix sums over the per-cell counts; positions use bounded
    sub-buckets so a cell holding a third of all rows is not numbered in one task.
    """
    counts = assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    offs = per_group_offsets(counts, "cell")
    pos = global_row_number(assigned.select("id", "cell"), ["cell"], "id", "pos")
    # global_row_number numbers across all cells in (cell, id) order; rebase per cell
    first = pos.groupBy("cell").agg(F.min("pos").alias("p0"))
    return (pos.join(first, "cell").join(offs.select("cell", "offset"), "cell")
               .select("id", "cell", (F.col("offset") + F.col("pos") - F.col("p0")).alias("new_id")))


def top_property(assigned_tagged: DataFrame) -> DataFrame:
    """Most frequent tag per cell (ties: smaller tag) — an aggregate of per-(cell, tag) counts."""
    ct = assigned_tagged.select("cell", F.explode("tags").alias("tag")).groupBy("cell", "tag").agg(
        F.count(F.lit(1)).alias("cnt"))
    best = ct.groupBy("cell").agg(F.max(F.struct("cnt", (-F.col("tag")).alias("nt"))).alias("b"))
    return best.select("cell", (-F.col("b.nt")).cast("int").alias("tag"), F.col("b.cnt").alias("cnt"))


def tag_cell_index(assigned_tagged: DataFrame) -> DataFrame:
    """Posting layout: rows of each tag grouped by cell, with start offsets in (tag, cell) order."""
    from vecspark.operators.ranking import global_prefix_sum
    g = assigned_tagged.select("cell", F.explode("tags").alias("tag")).groupBy("tag", "cell").agg(
        F.count(F.lit(1)).alias("n"))
    # prefix sums in (tag, cell) order over bounded sub-buckets of a tag (tags × cells can be large)
    return global_prefix_sum(g, "cell", "n", "offset", keys=["tag"])


def _means(assigned: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, c)``: mean vector of each group — sums combine per task, no group is gathered."""
    d = assigned.select(*keys, F.posexplode(F.col("v").cast("array<double>")).alias("p", "x"))
    m = d.groupBy(*keys, "p").agg(F.avg("x").alias("x"))
    return m.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "x"))), lambda e: e["x"]).alias("c"))


def kmeans_cells(rows: DataFrame, centroids: DataFrame, rounds: int, metric: str = "l2") -> DataFrame:
    """``(id, cell)`` after Lloyd rounds over all rows; an empty cell keeps its centroid.

    With ``metric="cosine"`` this is spherical k-means (a mean's length does not matter to the cosine).
    """
    for _ in range(rounds):
        m = _means(assign(rows, centroids, metric), ["cell"])
        centroids = (centroids.join(m.select(F.col("cell").alias("cid"), F.col("c").alias("m")), "cid", "left")
                     .select("cid", F.coalesce("m", F.col("c").cast("array<double>")).alias("c")).checkpoint())
    return assign(rows, centroids, metric).select("id", "cell")


def two_level(rows: DataFrame, centroids: DataFrame, k2: int, rounds: int = 4) -> DataFrame:
    """Second-level cells ``(id, cell, subcell)``, trained by Lloyd rounds on all rows of each cell.

    A cell's sub-centroids start at its ``k2`` rows of least id; every round is one pass and one aggregate per
    (cell, sub-cell, dimension).
    """
    a = assign(rows, centroids).select("id", "cell", "v").checkpoint()
    starts = None
    for i in range(k2):          # the i-th least id of each cell: one aggregate a round, no cell is gathered
        rest = a.select("id", "cell")
        if starts is not None:
            rest = rest.join(starts.groupBy("cell").agg(F.max("id").alias("_last")), "cell").where(F.col("id") > F.col("_last"))
        nxt = rest.groupBy("cell").agg(F.min("id").alias("id")).select("cell", F.lit(i).cast("long").alias("sid"), "id")
        starts = (nxt if starts is None else starts.unionByName(nxt)).checkpoint()
    subs = starts.join(a.select("id", F.col("v").cast("array<double>").alias("c")), "id").select("cell", "sid", "c").checkpoint()
    for _ in range(rounds):
        m = _means(_assign_sub(a, subs), ["cell", "subcell"])
        subs = (subs.join(m.select("cell", F.col("subcell").alias("sid"), F.col("c").alias("m")), ["cell", "sid"], "left")
                .select("cell", "sid", F.coalesce("m", "c").alias("c")).checkpoint())
    return _assign_sub(a, subs).select("id", "cell", "subcell")


def _assign_sub(a: DataFrame, subs: DataFrame) -> DataFrame:
    """Adds ``subcell``: the nearest sub-centroid of the row's own cell (cells x k2 of them, broadcast)."""
    table: dict[int, tuple] = {}
    for r in subs.orderBy("cell", "sid").collect():
        table.setdefault(r["cell"], []).append((r["sid"], np.asarray(r["c"], dtype=np.float64)))
    table = {c: (np.array([s for s, _ in v]), np.vstack([x for _, x in v])) for c, v in table.items()}
    bc = a.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        t = bc.value
        for pdf in batches:
            if len(pdf) == 0:
                continue
            X = blockscan.as_matrix(pdf["v"])
            sub = np.empty(len(pdf), dtype=np.int64)
            for cell, idx in pdf.groupby("cell").indices.items():
                sids, C = t[cell]
                D2 = np.zeros((len(idx), len(C)))
                for j in range(X.shape[1]):        # exact ordered sums, ties to the smaller sub-centroid id
                    diff = X[idx, j][:, None] - C[None, :, j]
                    D2 += diff * diff
                sub[idx] = sids[np.lexsort((np.broadcast_to(sids, D2.shape), D2), axis=1)[:, 0]]
            out = pdf.copy()
            out["subcell"] = sub
            yield out
    return a.mapInPandas(run, T.StructType([*a.schema.fields, T.StructField("subcell", T.LongType())]))


def property_buckets(assigned_tagged: DataFrame, n_props: int) -> DataFrame:
    """Per cell, the most frequent remaining tag opens the next bucket, ``n_props`` times.

    ``(id, cell, bucket, prop)``: a row goes to the first bucket whose property it
    carries; rows with none of them form the last bucket (prop null).  Each round is
    one (cell, tag) count over the rows not yet placed.
    """
    remaining = cut_lineage(assigned_tagged.select("id", "cell", "tags"))
    placed = []
    for b in range(n_props):
        props = top_property(remaining).select("cell", F.col("tag").alias("prop"))
        hit = remaining.join(props, "cell").where(F.array_contains("tags", F.col("prop")))
        placed.append(hit.select("id", "cell", F.lit(b).alias("bucket"), "prop"))
        remaining = cut_lineage(remaining.join(hit.select("id"), "id", "left_anti"))
    placed.append(remaining.select("id", "cell", F.lit(n_props).alias("bucket"), F.lit(None).cast("int").alias("prop")))
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    return out


def _matches_per_cell(assigned_tagged: DataFrame, filters: DataFrame) -> DataFrame:
    """``(qid, cell, n)``: rows of each cell that match the query's filter, counted once per distinct filter."""
    from vecspark.operators import predicates as P
    cells = assigned_tagged.select("id", "cell")
    asked = P.tagged_filters(filters, "qid")
    one = ["is_and", "nf", "ts"]
    distinct = cut_lineage(asked.select(*one).distinct().withColumn("fid", F.monotonically_increasing_id()))
    rows = P.tag_pairs(P.tagged_ids(assigned_tagged), distinct, "fid")
    per = rows.join(cells, "id").groupBy("fid", "cell").agg(F.count(F.lit(1)).alias("n"))
    named = distinct.select("fid", *[F.col(c).alias("d_" + c) for c in one])
    same = [F.col(c).eqNullSafe(F.col("d_" + c)) for c in one]
    found = asked.join(named, same).select("qid", "fid").join(per, "fid").select("qid", "cell", "n")
    empty = filters.where(F.size("ftags") == 0).select("qid").distinct()
    every = assigned_tagged.select("id").join(cells, "id").groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    found = found.unionByName(every.crossJoin(empty.hint("shuffle_replicate_nl")).select("qid", "cell", "n"))
    return found.groupBy("qid", "cell").agg(F.sum("n").alias("n"))


def budget_probe_knn(assigned_tagged: DataFrame, queries_f: DataFrame, centroids: DataFrame, k: int,
                     budget: int, metric: str = "l2") -> DataFrame:
    """Probe cells nearest-first until ``budget`` filter-matching rows are gathered, then exact top-k.

    A cell is probed while the matching rows of the cells before it are fewer than
    the budget.  Per (query, cell) match counts are an aggregate; the probe order
    is the k-NN of the query over the (few) centroids.
    """
    ncell = centroids.count()
    order = probes(queries_f.select("qid", "qv"), centroids, int(ncell), metric)
    cnt = _matches_per_cell(assigned_tagged, queries_f.select("qid", "ftags", "is_and"))
    o = order.join(cnt, ["qid", "cell"], "left").fillna({"n": 0})
    w = Window.partitionBy("qid").orderBy("prk").rowsBetween(Window.unboundedPreceding, -1)   # <= n_cells rows per query
    keep = o.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).where(F.col("before") < budget) \
            .where("n > 0").select("qid", "cell")
    found = cell_scan(assigned_tagged, queries_f, keep, k, metric, tag_filter=True)
    return blockscan.rank_topk(found, k).select("qid", "rk", "id", "dist")
