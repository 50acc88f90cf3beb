"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is executed to completion with the ``noop`` sink (no collect to the
driver); the value is the sum of per-query wall times in seconds.  ``scaled`` is
a larger run of the exact scan: the base replicated ``COPIES`` times under new
ids, in rows compared per second, where job start-up no longer decides.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from vecspark import catalog  # noqa: E402
from vecspark.operators import blockscan  # noqa: E402
from vecspark.session import get_session  # noqa: E402
from vecspark.sources import fixtures as fx  # noqa: E402

HEADLINE = [
    "knn_l2", "knn_filtered_and", "knn_filtered_or", "knn_filtered_range", "knn_postfilter",
    "range_search", "multivector_docs", "knn_graph", "sparse_mips", "sparse_two_stage",
    "filter_and", "predicate_cardinality", "route_strategy", "knn_routed",
    "recall_with_ties", "range_ap", "stream_knn_steps", "tombstone_log", "pareto_frontier",
]
COPIES = 200


def run(df) -> float:
    t0 = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - t0


def scaled(spark, sf_dir: str) -> dict:
    """The filtered and the plain exact scan over a replicated base."""
    q, b = fx.split(fx.vectors(spark, sf_dir))
    n, nq = b.count(), q.count()
    copy = spark.range(COPIES).withColumnRenamed("id", "copy")
    big = fx.with_tag_array(b).crossJoin(copy).withColumn("id", F.col("id") + F.col("copy") * (n * 2)).drop("copy")
    big = big.repartition(4 * spark.sparkContext.defaultParallelism)
    out = {"rows": n * COPIES, "queries": nq}
    for name, df in (("knn_l2", blockscan.knn(big.drop("tags"), q, 10)),
                     ("knn_filtered_and", blockscan.knn(big, fx.filters_tag(q, True), 10, tag_filter=True))):
        s = run(df)
        out[name] = {"sec": round(s, 3), "rows_per_sec": round(n * COPIES / s), "pairs_per_sec": round(n * COPIES * nq / s)}
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("vecspark-bench", cpus=cpus, shuffle_partitions=int(cpus) * 2)
    qs = catalog.queries()
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in qs]
    # warm-up: JVM, Python workers and Arrow paths (not timed)
    run(qs["knn_l2"](spark, sf_dir))
    times = {}
    for name in names:
        t0 = time.time()                      # includes the jobs that the query runs while it is built
        run(qs[name](spark, sf_dir))
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "scaled": scaled(spark, sf_dir) if len(sys.argv) == 1 else None}))
    spark.stop()


if __name__ == "__main__":
    main()
