"""Greedy weighted set cover of filters by materialised subsets, for all queries at once.

A query's rows may be searched in several subsets whose union holds them.  The greedy takes, round by round, the
subset with the least search cost per row that is still uncovered (``W.upward_cost(subset, rows shared with the
query) / rows shared with what is left``); subsets that already contain the whole query logically are left to the
single-subset route.  The result is a cover only where nothing is left.

Row sets are bitmaps of 32 768 ids.  One row per (id bucket, block of queries) holds the queries' bitmaps and those of the
subsets in that bucket; it is written once.  A round reads these rows, clears the rows that the chosen subsets hold
(and-not), counts what each open pair still shares, and shuffles only counts (query, subset, n).  Bitmaps are never
moved again, queries and subsets are never crossed outside a bucket, and the number of rounds is the longest cover.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.operators import predicates as P
from vecspark.plans import workload as W
from vecspark.session import cut_lineage

QUERY_BLOCK = 256              # queries whose bitmaps of one bucket lie in one row
RATIO_DIGITS = 9               # ratios equal to so many digits are ties (the smaller pid wins)
BITMAP = 4096                  # bytes of one bitmap


def _blocks(queries: DataFrame, subsets: DataFrame) -> DataFrame:
    """(bucket, block, qkeys, qbms, pids, bms): both sides' bitmaps of one bucket side by side."""
    q = queries.groupBy("bucket", "block").agg(F.collect_list(F.struct("qkey", "bm")).alias("q"))
    s = subsets.groupBy("bucket").agg(F.collect_list(F.struct("pid", "bm")).alias("s"))
    return q.join(s, "bucket", "left").select("bucket", "block", F.col("q.qkey").alias("qkeys"), F.col("q.bm").alias("qbms"),
                                              F.coalesce("s.pid", F.array().cast("array<string>")).alias("pids"),
                                              F.coalesce("s.bm", F.array().cast("array<binary>")).alias("bms"))


def _words(bitmaps: list) -> np.ndarray:
    raw = b"".join(bytes(b).ljust(BITMAP, b"\0") for b in bitmaps)
    return np.frombuffer(raw, dtype="<u8").reshape(len(bitmaps), BITMAP // 8)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(qkey, pid, both, left): rows that query and subset share, and those of them not yet covered; pid null: rows left."""
    for batch in batches:
        out: list[tuple] = []
        for row in batch.to_pylist():
            q, s = _words(row["qbms"]), _words(row["bms"]) if row["bms"] else np.zeros((0, BITMAP // 8), "<u8")
            spot = {p: i for i, p in enumerate(row["pids"])}
            left = q.copy()
            taken = {c["qkey"]: c["pids"] for c in row["chosen"] or []}
            for i, key in enumerate(row["qkeys"]):
                for pid in taken.get(key, ()):
                    if pid in spot:
                        left[i] &= ~s[spot[pid]]
            rest = np.bitwise_count(left).sum(axis=1)
            out += [(key, None, 0, int(n)) for key, n in zip(row["qkeys"], rest, strict=True) if n]
            for pid, j in spot.items():
                open_ = np.bitwise_count(left & s[j]).sum(axis=1)
                both = np.bitwise_count(q & s[j]).sum(axis=1)
                out += [(row["qkeys"][i], pid, int(both[i]), int(open_[i])) for i in np.flatnonzero(both)]
        columns = list(zip(*out, strict=True)) if out else [(), (), (), ()]
        yield pa.RecordBatch.from_pydict({"qkey": pa.array(columns[0], pa.string()), "pid": pa.array(columns[1], pa.string()),
                                          "both": pa.array(columns[2], pa.int64()), "left": pa.array(columns[3], pa.int64())})


def cover_plan(filters: DataFrame, subsets: DataFrame, base_tagged: DataFrame, p: W.Params) -> DataFrame:
    """(qkey, round, pid, cost, covered): the chosen subsets of every distinct filter; ``covered``: nothing is left.

    ``filters(ftags, is_and)`` (non-empty ones are covered), ``subsets(pid, ftags, is_and, card)``.
    """
    spark = base_tagged.sparkSession
    distinct = (filters.where(F.size("ftags") > 0)
                .select(F.array_sort(F.array_distinct("ftags")).alias("ftags"), "is_and").distinct()
                .withColumn("qkey", P.filter_key(F.col("ftags"), F.col("is_and"))))
    distinct = cut_lineage(distinct.withColumn("block", F.pmod(F.xxhash64("qkey"), F.lit(1 << 30))))
    blocks = max(1, -(-distinct.count() // QUERY_BLOCK))
    distinct = distinct.withColumn("block", F.col("block") % blocks)
    nodes = subsets.select("pid", "ftags", "is_and", "card")
    # subsets that contain the query logically are the single-subset route's
    both = distinct.select(F.col("qkey").alias("pid"), "ftags", "is_and").unionByName(nodes.select("pid", "ftags", "is_and")).distinct()
    contains = cut_lineage(P.subsumption_edges(both, key="pid").select(F.col("child").alias("qkey"), F.col("parent").alias("pid")))
    qb = P.filter_bitmaps(base_tagged, distinct.select(F.col("qkey").alias("pid"), "ftags", "is_and"))
    sb = P.filter_bitmaps(base_tagged, nodes.select("pid", "ftags", "is_and"))
    qb = qb.withColumnRenamed("pid", "qkey").join(distinct.select("qkey", "block"), "qkey")
    rows = cut_lineage(_blocks(qb, sb))
    chosen = spark.createDataFrame([], "qkey string, round int, pid string, cost double")
    done = 0
    while True:
        picked = (chosen.join(distinct.select("qkey", "block"), "qkey").groupBy("block", "qkey").agg(F.collect_list("pid").alias("pids"))
                  .groupBy("block").agg(F.collect_list(F.struct("qkey", "pids")).alias("chosen")))
        counts = rows.join(picked, "block", "left").mapInArrow(_shared, "qkey string, pid string, both long, left long")
        counts = cut_lineage(counts.groupBy("qkey", "pid").agg(F.sum("both").alias("both"), F.sum("left").alias("left")))
        options = (counts.where("pid is not null and left > 0").join(contains, ["qkey", "pid"], "left_anti")
                   .join(chosen.select("qkey", "pid"), ["qkey", "pid"], "left_anti")
                   .join(nodes.select("pid", "card"), "pid"))
        cost = W.upward_cost(F.col("card").cast("double"), F.col("both").cast("double"), p)
        best = (options.withColumn("cost", cost).withColumn("ratio", F.round(F.col("cost") / F.col("left"), RATIO_DIGITS))
                .groupBy("qkey").agg(F.min_by(F.struct("pid", "cost"), F.struct("ratio", "pid")).alias("b")))
        done += 1
        new = cut_lineage(best.select("qkey", F.lit(done).alias("round"), F.col("b.pid").alias("pid"), F.col("b.cost").alias("cost")))
        if not new.head(1):
            break
        chosen = cut_lineage(chosen.unionByName(new))
    open_ = counts.where("pid is null and left > 0").select("qkey", F.lit(False).alias("c"))
    return chosen.join(open_, "qkey", "left").select("qkey", "round", "pid", "cost", F.coalesce("c", F.lit(True)).alias("covered"))


def strategy_with_cover(routed: DataFrame, qcard: DataFrame, plan: DataFrame, p: W.Params) -> DataFrame:
    """(qid, qkey, card, route, strategy, cost): brute, cover, subset or root, whichever is cheapest.

    Brute force where ``card <= cutoff`` or it costs no more than the others; a cover (of all the rows) where it costs no
    more than brute force and the single subset; else the single subset or the root.
    """
    total = (plan.where("covered").groupBy("qkey").agg(F.sum("cost").alias("cover_cost")))
    x = routed.join(qcard, "qid").join(total, "qkey", "left")
    c = F.col("card").cast("double")
    index = F.when(F.col("route") != "root", W.upward_cost(F.col("route_card").cast("double"), c, p)).otherwise(W.root_cost(c, p))
    brute, cover = W.bf_cost(c, p), F.coalesce("cover_cost", F.lit(float("inf")))
    strat = (F.when((F.col("card") <= p.cutoff) | ((brute <= cover) & (brute <= index)), "brute")
             .when((cover <= brute) & (cover <= index), "cover")
             .when(F.col("route") != "root", "subset").otherwise("root"))
    return (x.withColumn("strategy", strat)
            .select("qid", "qkey", "card", "route", "strategy",
                    F.when(F.col("strategy") == "brute", brute).when(F.col("strategy") == "cover", cover).otherwise(index).alias("cost")))


def cover_routes(strategies: DataFrame, plan: DataFrame) -> DataFrame:
    """(qid, route): the subsets of the queries whose strategy is ``cover``."""
    chosen = plan.where("covered").select("qkey", F.col("pid").alias("route"))
    return strategies.where(F.col("strategy") == "cover").select("qid", "qkey").join(chosen, "qkey").select("qid", "route")

