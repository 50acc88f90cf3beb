"""Catalog: benchmark run reports (A14, A15, E9, E10, E17-E20, E22-E24, F5) over the ``runs`` table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vecspark.catalog.oracle_fixtures import cte
from vecspark.catalog.registry import register
from vecspark.operators import reports as R
from vecspark.session import shared_dir
from vecspark.sources import fixtures as fx

# Fixed report parameters.
RECALL_THR = 0.9
QPS_THR = 10000.0
CACHE_THR = 0.5
BASELINE_ALGO = "click"
MIN_DATASETS = 3
MSRP_USD = 10000.0
TARGET_QPS = 100000.0
USD_PER_KWH = 0.10
YEARS = 5
PARAMS = [f"p{i}" for i in range(7)]


def _runs(spark, sf):
    return fx.runs(spark, sf)


@register("run_metrics", cte("runs") +
          "SELECT run_id, round(qps, 6) AS qps, build, indexsize, round(distcomps / (run_count * count), 6) AS dist_comps_per_query, "
          "mean_latency, round(count / NULLIF(qps, 0), 9) AS best_search_time FROM runs")
def run_metrics(spark, sf):
    return R.run_metrics(_runs(spark, sf))


@register("best_run", cte("runs") + """
SELECT algorithm, dataset, arg_min(run_id, struct_pack(t := count / qps, r := run_id)) AS run_id, round(min(count / qps), 9) AS best_search_time
FROM runs WHERE qps > 0 GROUP BY algorithm, dataset""")
def best_run(spark, sf):
    return R.best_run(_runs(spark, sf))


@register("pareto_frontier", cte("runs") + """
, d AS (SELECT dataset, recall, qps, min(run_id) AS run_id FROM runs WHERE recall > 0 AND qps > 0 GROUP BY dataset, recall, qps),
m AS (SELECT *, max(recall) OVER (PARTITION BY dataset ORDER BY qps DESC, recall DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM d)
SELECT dataset, run_id, recall, qps FROM m WHERE prev IS NULL OR recall > prev""")
def pareto_frontier(spark, sf):
    return R.pareto(_runs(spark, sf))


@register("operating_points", cte("runs") +
          f"SELECT dataset, algorithm, max(qps) AS qps_at_recall FROM runs WHERE recall > {RECALL_THR} GROUP BY dataset, algorithm")
def operating_points(spark, sf):
    return R.operating_points(_runs(spark, sf), RECALL_THR)


@register("operating_points_recall", cte("runs") +
          f"SELECT dataset, algorithm, max(recall) AS recall_at_qps FROM runs WHERE qps > {QPS_THR} GROUP BY dataset, algorithm")
def operating_points_recall(spark, sf):
    return R.operating_points_recall(_runs(spark, sf), QPS_THR)


@register("caching_detector", cte("runs") +
          f"SELECT run_id, round((t_first - t_last) / NULLIF(t_first, 0), 6) AS drop FROM runs WHERE (t_first - t_last) / NULLIF(t_first, 0) > {CACHE_THR}")
def caching_detector(spark, sf):
    return R.caching_detector(_runs(spark, sf), CACHE_THR)


@register("energy_stats", cte("runs") + """
SELECT algorithm, round(min(watt_seconds / count), 6) AS best_wspq, round(avg(watt_seconds / count), 6) AS mean_wspq,
       round(stddev_samp(watt_seconds / count), 6) AS std_wspq FROM runs GROUP BY algorithm""")
def energy_stats(spark, sf):
    return R.energy_stats(_runs(spark, sf))


@register("cost_projection", cte("runs") + f"""
, best AS (SELECT algorithm, dataset, max(qps) AS qps, arg_max(watt_seconds / count, qps) AS wspq FROM runs WHERE recall >= {RECALL_THR} GROUP BY algorithm, dataset)
SELECT algorithm, dataset, CAST(ceil({TARGET_QPS} / NULLIF(qps, 0)) AS BIGINT) AS systems, round(ceil({TARGET_QPS} / NULLIF(qps, 0)) * {MSRP_USD}, 6) AS capex,
       round(qps * (wspq / 3600000.0) * 3600.0 * 8760.0 * {YEARS} * {USD_PER_KWH} * ceil({TARGET_QPS} / NULLIF(qps, 0)), 6) AS opex FROM best""")
def cost_projection(spark, sf):
    return R.cost_projection(_runs(spark, sf), RECALL_THR, TARGET_QPS, MSRP_USD, USD_PER_KWH, YEARS)


@register("leaderboard_score", cte("runs") + f"""
, best AS (SELECT algorithm, dataset, max(recall) AS recall FROM runs WHERE qps >= {QPS_THR} GROUP BY algorithm, dataset),
base AS (SELECT dataset, recall AS b FROM best WHERE algorithm = '{BASELINE_ALGO}')
SELECT algorithm, round(sum(recall - b), 6) AS score, count(*) AS datasets FROM best JOIN base USING (dataset)
WHERE algorithm <> '{BASELINE_ALGO}' GROUP BY algorithm HAVING count(*) >= {MIN_DATASETS}""")
def leaderboard_score(spark, sf):
    return R.leaderboard(_runs(spark, sf), QPS_THR, BASELINE_ALGO, MIN_DATASETS)


@register("shard_qps_model", cte("runs") + """
SELECT run_id, round(1.0 / ((count / NULLIF(qps, 0) - mean_latency / 1000.0) / 2 + mean_latency / 1000.0), 6) AS qps_two_shards FROM runs""")
def shard_qps_model(spark, sf):
    return R.shard_qps_model(_runs(spark, sf))


@register("sweep_pivot", cte("runs") + "SELECT algorithm, " + ", ".join(
    f"round(avg(CASE WHEN parameters = '{p}' THEN recall END), 6) AS {p}" for p in PARAMS) + " FROM runs GROUP BY algorithm")
def sweep_pivot(spark, sf):
    return R.sweep_pivot(_runs(spark, sf), PARAMS)


@register("runs_scan", cte("runs") + "SELECT run_id, algorithm, dataset, recall, qps FROM runs WHERE track = 'filter' AND dataset = 'ds1'")
def runs_scan(spark, sf):
    """Result store partitioned by (track, dataset); reading one partition prunes the rest."""
    path = shared_dir(spark, f"runs-{uuid.uuid4().hex[:12]}")
    R.store_runs(_runs(spark, sf), path)
    return R.load_runs(spark, path, track="filter", dataset="ds1").select("run_id", "algorithm", "dataset", "recall", "qps")


@register("runs_export", cte("runs") + "SELECT algorithm, dataset, parameters, recall, qps FROM runs")
def runs_export(spark, sf):
    """CSV export sorted by algorithm, dataset, recall; read back."""
    path = shared_dir(spark, f"export-{uuid.uuid4().hex[:12]}")
    R.export_csv(_runs(spark, sf), path)
    return spark.read.schema("algorithm string, dataset string, parameters string, recall double, qps double") \
                .option("header", True).csv(path)


@register("parse_logs", cte("runs") + """
, g AS (SELECT *, algorithm || '_' || dataset || '_' || CAST(run_id % 4 AS VARCHAR) AS grp FROM runs),
h AS (SELECT grp, CAST(sum(indexsize) AS BIGINT) AS size, sum(build) AS build FROM g GROUP BY grp)
SELECT g.grp, g.algorithm AS indexkey, h.size AS index_size, round(h.build, 3) AS add_time,
       g.parameters || '-' || CAST(g.run_id AS VARCHAR) AS parameters, round(g.mean_latency * 1000.0, 4) AS time_ms,
       round(g.recall, 4) AS r1, round(g.recall, 4) AS r10, round(g.recall, 4) AS r100 FROM g JOIN h ON h.grp = g.grp""")
def parse_logs(spark, sf):
    """Run logs written per (algorithm, dataset, bucket) as text, parsed back into metric rows."""
    from vecspark.sources import logs as L
    folder = shared_dir(spark, f"logs-{uuid.uuid4().hex[:12]}")
    L.write_run_logs(_runs(spark, sf), folder)
    return L.parse_logs(spark, folder)
