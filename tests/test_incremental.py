"""The streamed live set goes on after a restart and does not count a batch twice."""

import random
import tempfile

from vecspark.streaming import incremental


def test_restart_goes_on_where_it_stopped(spark):
    rng = random.Random(3)
    ops = [(s, rng.randrange(60), rng.choice(["insert", "delete", "search"])) for s in range(600)]
    base = tempfile.mkdtemp(prefix="stream-test-", dir="/tmp")
    src, root = f"{base}/in", f"{base}/state"

    def write(part):
        spark.createDataFrame(part, incremental.OPS).coalesce(1).write.mode("append").parquet(src)

    def want(part):
        last = {}
        for _, i, op in part:
            if op != "search":
                last[i] = op
        return sorted(i for i, op in last.items() if op == "insert")

    def count(live):
        return live.groupBy().count()

    write(ops[:200])
    incremental.run(spark, src, root, search=count)
    assert sorted(r.id for r in incremental.live_ids(spark, root).collect()) == want(ops[:200])
    write(ops[200:450])
    write(ops[450:])
    other = spark.newSession()                     # nothing is kept from the first run but its folder
    incremental.run(other, src, root, search=count)
    assert sorted(r.id for r in incremental.live_ids(other, root).collect()) == want(ops)
    incremental.run(other, src, root, search=count)       # nothing new: nothing changes
    assert sorted(r.id for r in incremental.live_ids(other, root).collect()) == want(ops)
    results = spark.read.parquet(f"{root}/results")
    assert results.count() == 3 and max(r["count"] for r in results.collect()) >= len(want(ops[:200]))
