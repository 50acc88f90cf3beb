"""Dense nearest-neighbour joins.

Two physical paths give the same exact answer:

* **scan** — ``blockscan.scan``: one distributed pass over the base, the per-query
  filter evaluated as a mask inside the task; emits k rows per query per partition.
* **prefilter** — candidate pairs from the tag postings (equi-join on tag, driven
  by the query's rarest tag), checked against the row's full tag array, scored
  with a JVM distance expression, then ranked.  Its work is the filter
  cardinality, so it is only used for queries whose cardinality is at most the
  brute-force cutoff ``B`` (candidate rows are bounded by ``nq * B``).

``knn_filtered(..., strategy="auto")`` routes each query by the pre-filter's
work (the postings of its driving tags) against the brute-force cutoff; the
exact-cardinality routing of the workload plans is in ``plans.workload``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecspark.functions import distance as dist
from vecspark.operators import blockscan
from vecspark.operators import predicates as P

rank_topk = blockscan.rank_topk


def knn(base: DataFrame, queries: DataFrame, k: int = 10, metric: str = "l2", **kw) -> DataFrame:
    """Exact k-NN join ``(qid, rk, id, dist)``."""
    return blockscan.knn(base, queries, k=k, metric=metric, **kw)


def round_dist(df: DataFrame, col: str = "dist", digits: int = 6) -> DataFrame:
    return df.withColumn(col, F.round(F.col(col), digits))


# ------------------------------------------------------------------ filtered k-NN

def query_tag_freq(tag_freq: DataFrame, query_tags: DataFrame) -> DataFrame:
    """Frequencies of the tags the queries use: the big table is probed with the broadcast (query-sized) tag set."""
    return tag_freq.join(query_tags.select("tag").distinct(), "tag")


def _prefilter_candidates(base_tagged: DataFrame, postings: DataFrame, qf: DataFrame,
                          tag_freq: DataFrame) -> DataFrame:
    """(qid, id) candidates of tag filters: rarest tag's postings, then full check on the row's tags."""
    # the query's driving tag: the rarest of its tags (ties: smallest tag)
    # the query side is broadcast (bounded by the query block); tag frequencies grow with the vocabulary
    qt = qf.where(F.size("ftags") > 0).select("qid", "ftags", "is_and", F.explode("ftags").alias("tag"))
    drive = qt.join(query_tag_freq(tag_freq, qt), "tag", "left").fillna({"df": 0})
    # AND: one driving tag suffices; OR: every tag drives (union, de-duplicated)
    w = Window.partitionBy("qid").orderBy("df", "tag")
    drive = (drive.withColumn("r", F.row_number().over(w))
                  .where((F.col("r") == 1) | ~F.col("is_and"))
                  .select("qid", "tag", "ftags", "is_and"))
    cand = drive.join(postings, "tag").select("qid", "id", "ftags", "is_and").dropDuplicates(["qid", "id"])
    rows = base_tagged.select("id", "tags")
    cand = cand.join(rows, "id")
    return cand.where(P.tag_match(F.col("tags"), F.col("ftags"), F.col("is_and"))).select("qid", "id")


def knn_prefilter(base: DataFrame, queries: DataFrame, cand: DataFrame, k: int, metric: str,
                  vec: str = "v", qvec: str = "qv") -> DataFrame:
    """Score candidate pairs with a JVM distance expression and rank."""
    scored = (cand.join(base.select("id", vec), "id")
                  .join(queries.select("qid", qvec), "qid")
                  .select("qid", "id", dist.distance(metric, F.col(qvec), F.col(vec)).alias("dist")))
    return rank_topk(scored, k).select("qid", "rk", "id", "dist")


def knn_filtered(base_tagged: DataFrame, queries_f: DataFrame, k: int = 10, metric: str = "l2",
                 strategy: str = "auto", cutoff: int = 30) -> DataFrame:
    """Filtered k-NN over tag filters ``(ftags, is_and)``; base needs ``id, v, tags``.

    strategy: ``scan`` (masked scan for all), ``prefilter`` (candidate join for all),
    ``auto`` (prefilter when the filter's cardinality <= cutoff, else scan).
    """
    if strategy == "scan":
        return knn(base_tagged, queries_f, k, metric, tag_filter=True)
    postings = base_tagged.select("id", F.explode("tags").alias("tag"))
    tag_freq = postings.groupBy("tag").agg(F.count(F.lit(1)).alias("df"))
    if strategy == "prefilter":
        cand = _prefilter_candidates(base_tagged, postings, queries_f, tag_freq)
        empty = queries_f.where(F.size("ftags") == 0)
        parts = [knn_prefilter(base_tagged, queries_f, cand, k, metric)]
        if not empty.isEmpty():
            parts.append(knn(base_tagged, empty, k, metric, tag_filter=True))
        return _union(parts)
    # auto: route on the pre-filter's own work — the postings it would read: the rarest
    # tag's frequency for AND (also an upper bound on the cardinality), the sum for OR
    ex = queries_f.where(F.size("ftags") > 0).select("qid", "is_and", F.explode(F.array_distinct("ftags")).alias("tag"))
    work = (ex.join(query_tag_freq(tag_freq, ex), "tag", "left").fillna({"df": 0})
              .groupBy("qid", "is_and").agg(F.min("df").alias("mn"), F.sum("df").alias("sm"))
              .select("qid", F.when(F.col("is_and"), F.col("mn")).otherwise(F.col("sm")).alias("work")))
    # written once to the checkpoint folder so each route re-reads it, not its plan
    routed = queries_f.join(work, "qid", "left").checkpoint()
    small = routed.where(F.col("work").isNotNull() & (F.col("work") <= cutoff)).drop("work")
    large = routed.where(F.col("work").isNull() | (F.col("work") > cutoff)).drop("work")
    parts = []
    cand = _prefilter_candidates(base_tagged, postings, small, tag_freq)
    parts.append(knn_prefilter(base_tagged, small, cand, k, metric))
    parts.append(knn(base_tagged, large, k, metric, tag_filter=True))
    return _union(parts)


def knn_filtered_range(base_attrs: DataFrame, queries_r: DataFrame, k: int = 10,
                       metric: str = "l2") -> DataFrame:
    """Filtered k-NN with the two-attribute half-open range filter (masked scan)."""
    return knn(base_attrs, queries_r, k, metric, range_filter=True)


def knn_postfilter(base_tagged: DataFrame, queries_f: DataFrame, k: int = 10, m: int = 3,
                   metric: str = "l2") -> DataFrame:
    """Search first (k·m nearest, unfiltered), then keep those passing the filter, top-k."""
    over = blockscan.scan(base_tagged, queries_f, k=k * m, metric=metric)
    over = rank_topk(over, k * m).drop("rk")
    qf = queries_f.select("qid", "ftags", "is_and")
    kept = (over.join(base_tagged.select("id", "tags"), "id")
                .join(qf, "qid")
                .where(P.tag_match(F.col("tags"), F.col("ftags"), F.col("is_and")))
                .select("qid", "id", "dist"))
    return rank_topk(kept, k).select("qid", "rk", "id", "dist")


def knn_grouped_by_filter(base_tagged: DataFrame, queries_f: DataFrame, k: int = 10,
                          metric: str = "l2") -> DataFrame:
    """Queries grouped by their normalised filter; each group's candidate rows are fetched once.

    Candidate rows of a filter are materialised once per *distinct* filter
    (``pred_rows``), then every query of the group is scored against them: blocks of a
    group's rows meet blocks of its queries, never single pairs.
    """
    from vecspark.operators.cells import cell_scan
    from vecspark.session import cut_lineage
    qn = queries_f.withColumn("ftags", F.array_sort("ftags"))
    filters = cut_lineage(qn.select("ftags", "is_and").distinct().withColumn("fid", F.monotonically_increasing_id()))
    rows = P.pred_rows(base_tagged, filters, key="fid")
    qg = qn.join(filters, ["ftags", "is_and"]).select("qid", F.col("fid").alias("cell"))
    base, asked = base_tagged.select("id", "v"), queries_f.select("qid", "qv")
    dim = base.agg(F.max(F.size("v"))).first()[0]

    def plain(v: str):
        """Whether blocks can hold the vector; a pair with another has a distance that is null or not finite, and ranks by it."""
        x = F.col(v).cast("array<double>")
        return F.coalesce((F.size(x) == dim) & F.forall(x, lambda e: e.isNotNull() & (F.abs(e) < float("inf"))), F.lit(False))
    fetched = rows.join(base.where(plain("v")), "id").select(F.col("fid").alias("cell"), "id", "v")
    found = cell_scan(fetched, asked.where(plain("qv")), qg, k, metric)
    of = rows.withColumnRenamed("fid", "cell")
    odd_rows = of.join(base.where(~plain("v")), "id").join(qg, "cell").join(asked, "qid")
    odd_queries = qg.join(asked.where(~plain("qv")), "qid").join(of, "cell").join(base.where(plain("v")), "id")
    odd = odd_rows.select("qid", "id", "qv", "v").unionByName(odd_queries.select("qid", "id", "qv", "v"))
    found = found.unionByName(odd.select("qid", "id", dist.distance(metric, F.col("qv"), F.col("v")).alias("dist")))
    return rank_topk(found, k).select("qid", "rk", "id", "dist")


def _union(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ------------------------------------------------------------------ range / epsilon

def range_search(base: DataFrame, queries: DataFrame, radius, metric: str = "l2") -> DataFrame:
    """All ``(qid, id, dist)`` with ``dist < radius``."""
    return blockscan.scan(base, queries, metric=metric, mode="radius", radius=radius)


def epsilon_search(base: DataFrame, queries: DataFrame, eps, min_candidates: int = 0,
                   max_candidates: int | None = None, metric: str = "l2") -> DataFrame:
    """Rows with ``dist <= eps``, plus the nearest ``min_candidates`` regardless, capped at ``max_candidates``.

    The cap is the operator's own parameter (the reference's stop condition), ranked by (dist, id).
    """
    within = blockscan.scan(base, queries, metric=metric, mode="radius", radius=eps, inclusive=True)
    parts = within
    if min_candidates:
        nearest = rank_topk(blockscan.scan(base, queries, k=min_candidates, metric=metric),
                            min_candidates).drop("rk")
        parts = within.unionByName(nearest).dropDuplicates(["qid", "id"])
    out = parts.withColumn("rk", F.row_number().over(Window.partitionBy("qid").orderBy("dist", "id")))
    if max_candidates is not None:
        out = out.where(F.col("rk") <= max_candidates)
    return out.select("qid", "rk", "id", "dist")


def range_from_knn(base: DataFrame, queries: DataFrame, radius: float, k: int = 100,
                   metric: str = "l2") -> DataFrame:
    """Capped range truth: the k nearest, then keep ``dist < radius``."""
    return knn(base, queries, k, metric).where(F.col("dist") < radius)


# ------------------------------------------------------------------ multi-vector documents

def multivector_docs(base: DataFrame, queries: DataFrame, num_docs: int, doc_col: str = "doc_id",
                     metric: str = "l2") -> DataFrame:
    """Nearest vectors until ``num_docs`` distinct documents are seen.

    Keeps every vector ranked before the first vector of the (n+1)-th document.
    Pass 1 finds, per query, the n+1 best documents (best vector per document)
    with a per-partition group top-k; pass 2 returns the rows ranked before the
    cutoff vector.  No per-query running-distinct window over the whole base.
    """
    n1 = num_docs + 1
    part = blockscan.scan(base, queries, k=n1, metric=metric, mode="topk_groups", group_col=doc_col)
    w = Window.partitionBy("qid", "grp").orderBy("dist", "id")
    best = part.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
    wd = Window.partitionBy("qid").orderBy("dist", "id")
    docs = best.withColumn("drk", F.row_number().over(wd)).where(F.col("drk") <= n1)
    cut = (docs.where(F.col("drk") == n1)
               .select("qid", F.col("dist").alias("cut_d"), F.col("id").alias("cut_id")))
    # queries with <= n documents overall keep everything of those documents
    qcut = queries.join(cut, "qid", "left").withColumn(
        "radius", F.coalesce(F.col("cut_d"), F.lit(float("inf"))))
    rows = blockscan.scan(base, qcut, metric=metric, mode="radius", radius="radius", inclusive=True)
    rows = rows.join(cut, "qid", "left").where(
        F.col("cut_d").isNull() | (F.col("dist") < F.col("cut_d"))
        | ((F.col("dist") == F.col("cut_d")) & (F.col("id") < F.col("cut_id"))))
    rows = rows.join(base.select("id", doc_col), "id")
    out = rows.withColumn("rk", F.row_number().over(Window.partitionBy("qid").orderBy("dist", "id")))
    return out.select("qid", "rk", "id", F.col(doc_col).alias("doc_id"), "dist")


# ------------------------------------------------------------------ self join / shards / fusion

def knn_graph(vectors: DataFrame, k: int = 10, metric: str = "l2", **kw) -> DataFrame:
    """k-NN graph: every row's k nearest other rows, ``(src, rk, dst, dist)``."""
    q = vectors.select(F.col("id").alias("qid"), F.col("v").alias("qv"),
                       *[c for c in vectors.columns if c in ("qattr",)])
    part = blockscan.scan(vectors, q, k=k, metric=metric, exclude_self=True, **kw)
    return rank_topk(part, k).select(F.col("qid").alias("src"), "rk", F.col("id").alias("dst"), "dist")


def knn_sharded(base: DataFrame, queries: DataFrame, k: int, n_shards: int, metric: str = "l2") -> DataFrame:
    """Per-shard exact top-k (shard p = ids ``[nb*p//n, nb*(p+1)//n)``), merged to the global top-k.

    Each shard is a pushed-down id-range scan; global ids are kept (no per-shard renumbering).
    """
    nb = base.agg(F.max("id")).first()[0] + 1
    per = []
    for p in range(n_shards):
        lo, hi = nb * p // n_shards, nb * (p + 1) // n_shards
        part = blockscan.scan(base.where((F.col("id") >= lo) & (F.col("id") < hi)), queries, k=k, metric=metric)
        per.append(rank_topk(part, k).drop("rk"))
    return rank_topk(_union(per), k).select("qid", "rk", "id", "dist")


def fusion_knn(base: DataFrame, queries: DataFrame, k: int, kind: str, param: float,
               attr_col: str = "attr", metric: str = "l2") -> DataFrame:
    """k-NN on a fused distance: ``mul`` → d·(1 + cnt/m), ``add`` → d + cnt·w (cnt = attribute mismatches)."""
    return knn(base, queries, k, metric, fusion=(kind, float(param)), attr_col=attr_col)
