"""Routed execution over materialised subsets.

A materialised subset is the base rows matching one workload predicate, written once by ``store.SubsetStore``, so that
a query routed to it reads only that folder (partition pruning), exactly as an index over that subset would only touch
its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.operators import knn as K
from vecspark.operators import predicates as P
from vecspark.plans import cover
from vecspark.plans.store import SubsetStore


def subset_plan(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(pid, action)``: create (new only), keep (both), drop (old only)."""
    o = old.select("pid").distinct().withColumn("_o", F.lit(True))
    n = new.select("pid").distinct().withColumn("_n", F.lit(True))
    j = n.join(o, "pid", "full")
    return j.select("pid", F.when(F.col("_o").isNull(), "create").when(F.col("_n").isNull(), "drop")
                    .otherwise("keep").alias("action"))


def subset_append(subsets: DataFrame, delta_tagged: DataFrame) -> DataFrame:
    """``(pid, id)`` of new rows that belong to each subset (the delta is joined to the small subset list)."""
    return P.pred_rows(delta_tagged, subsets, key="pid").select("pid", "id")


def search(base_tagged: DataFrame, queries_f: DataFrame, strategies: DataFrame, routes: DataFrame, store: SubsetStore,
           k: int = 10, metric: str = "l2") -> DataFrame:
    """Execute every query by its strategy; the union equals the exact filtered k-NN.

    brute → candidate join on the postings (cardinality ≤ cutoff or cheapest);
    subset, cover → masked scan of the stored subsets in ``routes(qid, route)`` only, each hit counted once;
    root → masked scan of the base.
    """
    q = queries_f.join(strategies.select("qid", "strategy"), "qid").checkpoint()      # written once
    brute = q.where(F.col("strategy") == "brute")
    post = P.postings(base_tagged)
    tag_freq = post.groupBy("tag").agg(F.count(F.lit(1)).alias("df"))
    cand = K._prefilter_candidates(base_tagged, post, brute, tag_freq)
    found = K.knn_prefilter(base_tagged, brute, cand, k, metric)
    routed = q.join(routes, "qid").checkpoint()
    if routed.head(1):
        held = store.rows(routed.select(F.col("route").alias("pid")))
        hits = K.blockscan.scan(held, routed, k=k, metric=metric, tag_filter=True, route_filter=True).dropDuplicates(["qid", "id"])
        found = found.unionByName(K.rank_topk(hits, k).select("qid", "rk", "id", "dist"))
    return found.unionByName(K.knn(base_tagged, q.where(F.col("strategy") == "root"), k, metric, tag_filter=True))


def single_routes(strategies: DataFrame) -> DataFrame:
    """(qid, route) of the queries that search one subset."""
    return strategies.where(F.col("strategy") == "subset").select("qid", "route")


def knn_routed(base_tagged: DataFrame, queries_f: DataFrame, strategy: DataFrame, store: SubsetStore,
               k: int = 10, metric: str = "l2") -> DataFrame:
    """``search`` where every routed query has one subset."""
    return search(base_tagged, queries_f, strategy, single_routes(strategy), store, k, metric)


def knn_covering(base_tagged: DataFrame, queries_f: DataFrame, subsets: DataFrame, store: SubsetStore, p,
                 k: int = 10, metric: str = "l2") -> DataFrame:
    """Every query with a cover searches the subsets of its cover, whatever it costs; the others search the base."""
    from vecspark.operators.predicates import filter_key
    plan = cover.cover_plan(queries_f, subsets, base_tagged, p).checkpoint()
    keyed = queries_f.withColumn("qkey", filter_key(F.col("ftags"), F.col("is_and")))
    whole = plan.where("covered").select("qkey").distinct().withColumn("strategy", F.lit("cover"))
    st = keyed.select("qid", "qkey").join(whole, "qkey", "left").select("qid", "qkey", F.coalesce("strategy", F.lit("root")).alias("strategy"))
    return search(base_tagged, queries_f, st, cover.cover_routes(st, plan), store, k, metric)
