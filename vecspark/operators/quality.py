"""Search-quality metrics over long-form result tables.

``truth(qid, rk, id, dist)`` closest first; ``run(qid, rk, id[, dist])``.
All metrics are joins and aggregates; per-query work is keyed by ``qid``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecspark.operators.ranking import ordered_positions

TIE_EPS = 1e-6


def per_query_hits(truth: DataFrame, run: DataFrame, count: int) -> DataFrame:
    """``(qid, hits)`` with truth cut at ``count`` (no tie handling)."""
    t = truth.where(F.col("rk") <= count).select("qid", "id").withColumn("_t", F.lit(1))
    r = run.select("qid", "id").distinct()
    return r.join(t, ["qid", "id"], "left").groupBy("qid").agg(F.sum(F.coalesce("_t", F.lit(0))).alias("hits"))


def tie_extended_truth(truth: DataFrame, count: int) -> DataFrame:
    """Truth rows kept after extending rank ``count`` through contiguous distance ties (|d - d_k| < 1e-6)."""
    wq = Window.partitionBy("qid")
    t = truth.withColumn("_dk", F.max(F.when(F.col("rk") == count, F.col("dist"))).over(wq)) \
             .withColumn("_size", F.max("rk").over(wq))
    brk = F.min(F.when((F.col("rk") > count) & (F.abs(F.col("_dk") - F.col("dist")) >= TIE_EPS), F.col("rk"))).over(wq)
    t = t.withColumn("_end", F.when(F.col("_size") <= count, F.lit(count))
                     .otherwise(F.coalesce(brk - 1, F.col("_size"))))
    return t.where(F.col("rk") <= F.col("_end")).select("qid", "rk", "id", "dist",
                                                         (F.col("_end") > count).alias("tie"))


def recall(truth: DataFrame, run: DataFrame, count: int, ties: bool) -> DataFrame:
    """Mean and population std of per-query recall/count, and the number of queries with ties."""
    qs = truth.select("qid").distinct()
    if ties:
        ext = tie_extended_truth(truth, count)
        tie = ext.groupBy("qid").agg(F.max("tie").alias("tie"))
        t = ext.select("qid", "id").withColumn("_t", F.lit(1))
    else:
        tie = qs.withColumn("tie", F.lit(False))
        t = truth.where(F.col("rk") <= count).select("qid", "id").withColumn("_t", F.lit(1))
    h = run.select("qid", "id").distinct().join(t, ["qid", "id"]).groupBy("qid").agg(F.count(F.lit(1)).alias("hits"))
    per = qs.join(h, "qid", "left").fillna({"hits": 0}).join(tie, "qid", "left")
    return per.agg((F.avg("hits") / count).alias("mean"), (F.stddev_pop("hits") / count).alias("std"),
                   F.sum(F.when(F.col("tie"), 1).otherwise(0)).cast("long").alias("queries_with_ties"))


def one_recall_at(truth: DataFrame, run: DataFrame, rs: list[int]) -> DataFrame:
    """Fraction of queries whose true nearest is among the run's first R, for each R."""
    nn = truth.where(F.col("rk") == 1).select("qid", "id")
    pos = nn.join(run.select("qid", "id", F.col("rk").alias("prk")), ["qid", "id"], "left")
    return pos.select(F.explode(F.array(*[F.lit(r) for r in rs])).alias("r"), "prk") \
              .groupBy("r").agg(F.avg(F.when(F.col("prk") <= F.col("r"), 1.0).otherwise(0.0)).alias("recall"))


def intersection_at(truth: DataFrame, run: DataFrame, k: int) -> DataFrame:
    """``Σ_q |truth_k ∩ run_k| / (nq · k)``."""
    t = truth.where(F.col("rk") <= k).select("qid", "id")
    r = run.where(F.col("rk") <= k).select("qid", "id")
    nq = truth.select("qid").distinct().count()
    inter = t.join(r, ["qid", "id"]).count()
    spark = truth.sparkSession
    return spark.createDataFrame([(k, inter / (nq * k))], "k int, inter double")


def _pr_counts(gt: DataFrame, res: DataFrame, queries: DataFrame) -> DataFrame:
    """Per query ``(qid, ngt, nres, ninter)``."""
    ngt = gt.groupBy("qid").agg(F.count(F.lit(1)).alias("ngt"))
    hit = res.join(gt.select("qid", "id").withColumn("_g", F.lit(1)), ["qid", "id"], "left")
    nres = hit.groupBy("qid").agg(F.count(F.lit(1)).alias("nres"), F.sum(F.coalesce("_g", F.lit(0))).alias("ninter"))
    return queries.join(ngt, "qid", "left").join(nres, "qid", "left").fillna({"ngt": 0, "nres": 0, "ninter": 0})


def range_pr_overall(gt, res, queries) -> DataFrame:
    c = _pr_counts(gt, res, queries).agg(F.sum("ngt").alias("g"), F.sum("nres").alias("r"), F.sum("ninter").alias("i"))
    return c.select(
        F.when(F.col("r") > 0, F.col("i") / F.col("r")).otherwise(1.0).alias("precision"),
        F.when(F.col("g") > 0, F.col("i") / F.col("g")).when(F.col("r") == 0, 1.0).otherwise(0.0).alias("recall"))


def range_pr_average(gt, res, queries) -> DataFrame:
    c = _pr_counts(gt, res, queries)
    rec = F.when(F.col("ngt") == 0, F.when(F.col("nres") == 0, 1.0).otherwise(0.0)).otherwise(F.col("ninter") / F.col("ngt"))
    prec = F.when(F.col("nres") == 0, 1.0).otherwise(F.col("ninter") / F.col("nres"))
    return c.agg(F.avg(prec).alias("precision"), F.avg(rec).alias("recall"))


N_THRESH = 100


def range_ap(gt: DataFrame, res: DataFrame) -> DataFrame:
    """Average precision of a range result over 100 thresholds ``linspace(-0.001, max dist)``.

    A result row counts at threshold t iff ``dist < t``.  Each row's first
    counting threshold index is computed in closed form (and checked against the
    exact threshold values), so counts per threshold are a 100-row aggregate and
    a running sum — no rows × thresholds product.  Empty result → 0.
    """
    spark = res.sparkSession
    dmax = res.agg(F.max("dist")).first()[0]
    if dmax is None:
        return spark.createDataFrame([(0.0,)], "ap double")
    start, stop = -0.001, float(dmax)
    step = (stop - start) / (N_THRESH - 1)

    def t(i):
        return F.when(i == N_THRESH - 1, F.lit(stop)).otherwise(i.cast("double") * F.lit(step) + F.lit(start))
    c = F.floor((F.col("dist") - start) / step).cast("int")
    first = F.lit(None).cast("int")
    for off in (2, 1, 0, -1):   # smallest candidate index with t(i) > d wins (evaluated last)
        i = c + off
        first = F.when((i >= 0) & (i < N_THRESH) & (t(i) > F.col("dist")), i).otherwise(first)
    hit = res.join(gt.select("qid", "id").withColumn("_g", F.lit(1)), ["qid", "id"], "left")
    per = (hit.withColumn("i0", first).where(F.col("i0").isNotNull())
              .groupBy("i0").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("_g", F.lit(0))).alias("ok")))
    ngt = gt.count()
    th = spark.range(N_THRESH).select(F.col("id").cast("int").alias("i0"))
    w = Window.orderBy("i0").rowsBetween(Window.unboundedPreceding, 0)     # 100 rows
    cum = (th.join(per, "i0", "left").fillna({"n": 0, "ok": 0})
             .withColumn("nres", F.sum("n").over(w)).withColumn("ninter", F.sum("ok").over(w)))
    pr = cum.select("i0",
                    F.when(F.col("nres") > 0, F.col("ninter") / F.col("nres")).otherwise(1.0).alias("p"),
                    (F.col("ninter") / F.lit(float(ngt)) if ngt > 0 else
                     F.when(F.col("nres") == 0, 1.0).otherwise(0.0)).alias("r"))
    wl = Window.orderBy("i0")
    trap = pr.withColumn("p0", F.lag("p").over(wl)).withColumn("r0", F.lag("r").over(wl)) \
             .select(((F.col("r") - F.col("r0")) * (F.col("p") + F.col("p0")) / 2).alias("a"))
    return trap.agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias("ap"))


def recall_by_selectivity(per_query: DataFrame, n_bins: int = 5) -> DataFrame:
    """Queries sorted by cardinality, cut into equal bins (remainder dropped): mean card and recall per bin."""
    nq = per_query.count()
    size = nq // n_bins
    r = ordered_positions(per_query, ["card", "qid"], F.col("card"), "_r").withColumn("bin", ((F.col("_r") - 1) / size).cast("int"))
    return r.where(F.col("bin") < n_bins).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("card").alias("avg_card"), F.avg("recall").alias("mean_recall"))


def recall_stderr(per_query: DataFrame, ns: list[int]) -> DataFrame:
    """Sampling error of mean recall for a query count n: ``sqrt(var_pop / n)``."""
    v = per_query.agg(F.var_pop("recall").alias("v"))
    return v.select(F.explode(F.array(*[F.lit(n) for n in ns])).alias("n"), "v") \
            .select("n", F.sqrt(F.col("v") / F.col("n")).alias("stderr"))


def truth_diff(a: DataFrame, b: DataFrame, eps: float) -> DataFrame:
    """Tie-insensitive difference: ids compared within distance bins ``floor(d / eps)``; unmatched per side."""
    ka = a.select("qid", "id", F.floor(F.col("dist") / eps).alias("bin")).withColumn("_a", F.lit(1))
    kb = b.select("qid", "id", F.floor(F.col("dist") / eps).alias("bin")).withColumn("_b", F.lit(1))
    j = ka.join(kb, ["qid", "bin", "id"], "full")
    return j.groupBy("qid").agg(F.sum(F.when(F.col("_b").isNull(), 1).otherwise(0)).cast("long").alias("only_a"),
                                F.sum(F.when(F.col("_a").isNull(), 1).otherwise(0)).cast("long").alias("only_b"))


def monotone_violations(truth: DataFrame) -> DataFrame:
    w = Window.partitionBy("qid").orderBy("rk")
    x = truth.withColumn("_p", F.lag("dist").over(w))
    return x.agg(F.sum(F.when(F.col("_p") > F.col("dist"), 1).otherwise(0)).cast("long").alias("violations"),
                 F.countDistinct("qid").alias("queries"))
