"""Reports over benchmark run rows ``runs(run_id, algorithm, parameters, dataset, track, count, qps, recall, ...)``.

All per-group picks are aggregates (``min_by``-style on structs), which combine
map-side, so a group holding a large share of the runs is never sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def run_metrics(runs: DataFrame) -> DataFrame:
    return runs.select(
        "run_id", F.round("qps", 6).alias("qps"), "build", "indexsize",
        F.round(F.col("distcomps") / (F.col("run_count") * F.col("count")), 6).alias("dist_comps_per_query"),
        "mean_latency", F.round(F.col("count") / F.nullif(F.col("qps"), F.lit(0.0)), 9).alias("best_search_time"))


def best_run(runs: DataFrame) -> DataFrame:
    """Per (algorithm, dataset) the run with the smallest search time (ties: smallest run id)."""
    t = F.col("count") / F.col("qps")      # runs without a measured throughput (qps = 0) are not candidates
    return runs.where(F.col("qps") > 0).groupBy("algorithm", "dataset").agg(F.min(F.struct(t.alias("t"), F.col("run_id").alias("r"))).alias("b")) \
               .select("algorithm", "dataset", F.col("b.r").alias("run_id"), F.round("b.t", 9).alias("best_search_time"))


def pareto(runs: DataFrame, buckets_per_octave: int = 16) -> DataFrame:
    """Frontier per dataset: by qps desc then recall desc, keep rows whose recall beats every earlier row.

    Duplicate (recall, qps) points collapse to one (smallest run id).  A dataset may
    hold a third of all runs, so the running maximum is split: points are grouped in
    qps buckets (log scale, equal qps → same bucket), the best recall of all
    higher-qps buckets comes from a small per-bucket table, and the window runs
    inside one bucket only.
    """
    d = (runs.where((F.col("recall") > 0) & (F.col("qps") > 0))
             .groupBy("dataset", "recall", "qps").agg(F.min("run_id").alias("run_id"))
             .withColumn("_qb", F.floor(F.log2("qps") * buckets_per_octave).cast("long")))
    bmax = d.groupBy("dataset", "_qb").agg(F.max("recall").alias("_bm"))
    wb = Window.partitionBy("dataset").orderBy(F.col("_qb").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = bmax.select("dataset", "_qb", F.max("_bm").over(wb).alias("_carry"))     # buckets: few rows
    w = Window.partitionBy("dataset", "_qb").orderBy(F.col("qps").desc(), F.col("recall").desc()) \
              .rowsBetween(Window.unboundedPreceding, -1)
    m = d.join(carry, ["dataset", "_qb"]).withColumn("prev", F.greatest(F.max("recall").over(w), F.col("_carry")))
    return m.where(F.col("prev").isNull() | (F.col("recall") > F.col("prev"))).select("dataset", "run_id", "recall", "qps")


def operating_points(runs: DataFrame, recall_thr: float) -> DataFrame:
    return runs.where(F.col("recall") > recall_thr).groupBy("dataset", "algorithm").agg(F.max("qps").alias("qps_at_recall"))


def operating_points_recall(runs: DataFrame, qps_thr: float) -> DataFrame:
    return runs.where(F.col("qps") > qps_thr).groupBy("dataset", "algorithm").agg(F.max("recall").alias("recall_at_qps"))


def caching_detector(runs: DataFrame, thr: float) -> DataFrame:
    drop = (F.col("t_first") - F.col("t_last")) / F.nullif(F.col("t_first"), F.lit(0.0))
    return runs.where(drop > thr).select("run_id", F.round(drop, 6).alias("drop"))


def energy_stats(runs: DataFrame) -> DataFrame:
    w = F.col("watt_seconds") / F.col("count")
    return runs.groupBy("algorithm").agg(F.round(F.min(w), 6).alias("best_wspq"), F.round(F.avg(w), 6).alias("mean_wspq"),
                                         F.round(F.stddev_samp(w), 6).alias("std_wspq"))


def cost_projection(runs: DataFrame, recall_thr: float, target_qps: float, msrp: float, usd_kwh: float,
                    years: int) -> DataFrame:
    """Systems to reach the target QPS, capex and 5-year energy opex at the best qualifying operating point."""
    best = runs.where(F.col("recall") >= recall_thr).groupBy("algorithm", "dataset").agg(
        F.max("qps").alias("qps"), F.max_by(F.col("watt_seconds") / F.col("count"), "qps").alias("wspq"))
    systems = F.ceil(F.lit(target_qps) / F.nullif(F.col("qps"), F.lit(0.0)))
    opex = (F.col("qps") * (F.col("wspq") / 3600000.0) * 3600.0 * 8760.0 * years * usd_kwh * systems)
    return best.select("algorithm", "dataset", systems.cast("long").alias("systems"),
                       F.round(systems * msrp, 6).alias("capex"), F.round(opex, 6).alias("opex"))


def leaderboard(runs: DataFrame, qps_thr: float, baseline: str, min_datasets: int) -> DataFrame:
    best = runs.where(F.col("qps") >= qps_thr).groupBy("algorithm", "dataset").agg(F.max("recall").alias("recall"))
    base = best.where(F.col("algorithm") == baseline).select("dataset", F.col("recall").alias("b"))
    j = best.join(base, "dataset").where(F.col("algorithm") != baseline)
    return j.groupBy("algorithm").agg(F.round(F.sum(F.col("recall") - F.col("b")), 6).alias("score"),
                                      F.count(F.lit(1)).alias("datasets")).where(F.col("datasets") >= min_datasets)


def shard_qps_model(runs: DataFrame) -> DataFrame:
    """Two half-size shards: half the scan time plus the (unsplit) quantiser time."""
    tq = F.col("mean_latency") / 1000.0
    t2 = (F.col("count") / F.nullif(F.col("qps"), F.lit(0.0)) - tq) / 2 + tq
    return runs.select("run_id", F.round(1.0 / t2, 6).alias("qps_two_shards"))


def sweep_pivot(runs: DataFrame, params: list[str]) -> DataFrame:
    p = runs.groupBy("algorithm").pivot("parameters", params).agg(F.avg("recall"))
    return p.select("algorithm", *[F.round(c, 6).alias(c) for c in params])


def store_runs(runs: DataFrame, path: str) -> None:
    runs.write.mode("overwrite").partitionBy("track", "dataset").parquet(path)


def load_runs(spark: SparkSession, path: str, **eq) -> DataFrame:
    df = spark.read.parquet(path)
    for k, v in eq.items():
        df = df.where(F.col(k) == v)
    return df


def export_csv(runs: DataFrame, path: str) -> None:
    runs.select("algorithm", "dataset", "parameters", "recall", "qps") \
        .orderBy("algorithm", "dataset", "recall").write.option("header", True).csv(path)
