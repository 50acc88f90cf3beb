"""Results off the usual path: zero vectors, ids beyond 32 bits, numbers that a format cannot hold, wide own distances."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vecspark.operators import blockscan, cells, knn, quality, ranking
from vecspark.sources import binary
from vecspark.session import posix_dir

FAR = 1 << 40


def test_cosine_of_a_zero_vector_on_both_paths(spark):
    base = spark.createDataFrame([(i, [0.0, 0.0] if i == 3 else [1.0, float(i)], [1]) for i in range(6)], "id long, v array<double>, tags array<int>")
    q = spark.createDataFrame([(0, [1.0, 1.0], [1], True), (1, [0.0, 0.0], [1], True)], "qid long, qv array<double>, ftags array<int>, is_and boolean")
    got = {s: [tuple(r) for r in knn.knn_filtered(base, q, 6, "cosine", strategy=s).orderBy("qid", "rk").collect()]
           for s in ("scan", "prefilter", "auto")}
    assert got["scan"] == got["prefilter"] == got["auto"]
    assert {r[2]: r[3] for r in got["scan"] if r[0] == 0}[3] == 1.0 and all(r[3] == 1.0 for r in got["scan"] if r[0] == 1)


def test_tag_cell_index_with_cells_beyond_32_bits(spark):
    rows = [(i, FAR + i % 3 * (1 << 33), [1, 2] if i % 2 else [2]) for i in range(30)]
    got = cells.tag_cell_index(spark.createDataFrame(rows, "id long, cell long, tags array<int>")).orderBy("tag", "cell").collect()
    total = 0
    assert [(r.tag, r.cell) for r in got] == [(t, FAR + c * (1 << 33)) for t in (1, 2) for c in range(3)]
    for r in got:
        assert r.offset == total
        total += r.n


def test_numbering_by_keys_with_far_ids(spark):
    rows = [(c, p, FAR * (9 - i)) for c in (0, 1) for p in (0, 3) for i in range(5)]
    df = spark.createDataFrame(rows, "cell int, props long, id long")
    got = ranking.global_row_number(df, ["cell", "props"], "id", "pos").orderBy("pos").collect()
    assert [(r.cell, r.props, r.id) for r in got] == sorted(rows)


def test_recall_by_struct_queries_beyond_32_bits(spark):
    truth = spark.createDataFrame([(s, q, r, 10 + r, float(r)) for s in (1, 2) for q in (7, (1 << 33) + 7) for r in range(1, 4)],
                                  "step int, qid long, rk int, id long, dist double")
    ext = quality.tie_extended_truth(truth.withColumn("qid", F.struct("step", F.col("qid").alias("q"))), 2)
    assert ext.groupBy("qid").count().count() == 4


def test_ids_beyond_the_truth_format_are_refused(spark):
    folder = posix_dir(spark, "overflow")
    found = spark.createDataFrame([(0, 1, 1 << 32, 0.5)], "qid long, rk int, id long, dist double")
    with pytest.raises(PySparkException, match="does not fit"):
        binary.write_knn_usbin(found, spark.createDataFrame([(0, 0)], "qid long, qpos long"), folder + "/t.ibin", 1)
    with pytest.raises(OverflowError):
        binary.checked_cast(np.array([-1]), "<u4")


def test_own_distance_memory_with_a_full_query_block(spark):
    seen = []

    def pairs(q, x):
        seen.append(q.size)
        return np.abs(q - x).sum(axis=1)

    blockscan.register_kernel("l1_memory", pairs)
    import pandas as pd
    import pickle
    d, nq = 64, 4096
    block = blockscan.QueryBlock(qid=np.arange(nq), Q=np.random.default_rng(0).normal(size=(nq, d)))
    part = pd.DataFrame({"id": np.arange(64), "v": list(np.random.default_rng(1).normal(size=(64, d)))})
    run = blockscan._make_scan(pairs, "topk", 2, {"vec": "v", "id": "id"}, None, False, False)
    batch = pd.DataFrame({"rows": [pickle.dumps(part)], "block": [0], "queries": [pickle.dumps(block)]})
    out = pd.concat(run([batch]))
    assert len(out) == 2 * nq and max(seen) <= blockscan.PAIR_BUDGET
    want = np.abs(block.Q[5] - np.vstack(part["v"])).sum(axis=1)
    assert np.allclose(sorted(out[out.qid == 5].dist), np.sort(want)[:2])


def test_own_distance_meets_a_full_query_block_in_few_chunks():
    """Chunks of 256 rows, calls of a bounded number of elements (once chunks of 4 rows, each with its own masks and cuts)."""
    import pandas as pd
    calls = []

    def pairs(q, x):
        calls.append(q.size)
        return np.abs(q - x).sum(axis=1)

    chunks, real = [], blockscan.approx_block
    X, Q, batch = _block_batches(pd, 512, 1024, 64)
    try:
        blockscan.approx_block = lambda q, x, *a: chunks.append(len(x)) or real(q, x, *a)
        out = pd.concat(blockscan._make_scan(pairs, "topk", 3, {"vec": "v", "id": "id"}, None, False, False)([batch]))
    finally:
        blockscan.approx_block = real
    assert chunks == [256, 256] and max(calls) <= blockscan.PAIR_BUDGET
    want = np.sort(np.abs(Q[:, None, :] - X[None, :, :]).sum(axis=2), axis=1)[:, :3]
    assert np.allclose(np.sort(out.dist.to_numpy().reshape(1024, 3), axis=1), want)


def _block_batches(pd, n_base: int, n_query: int, d: int, seed: int = 3):
    rng = np.random.default_rng(seed)
    X, Q = rng.normal(size=(n_base, d)), rng.normal(size=(n_query, d))
    import pickle
    part = pd.DataFrame({"id": np.arange(n_base), "v": list(X), "doc": np.arange(n_base) % 7})
    block = blockscan.QueryBlock(qid=np.arange(n_query), Q=Q, radius=np.full(n_query, np.inf))
    return X, Q, pd.DataFrame({"rows": [pickle.dumps(part)], "block": [0], "queries": [pickle.dumps(block)]})


@pytest.mark.parametrize("mode,k", [("topk", 100), ("topk_groups", 3), ("radius", 1)])
def test_scan_memory_does_not_grow_with_the_blocks(mode, k):
    """4096 queries by 4096 rows used to gather gigabytes of row pairs at once."""
    import tracemalloc

    import pandas as pd
    n = 1024 if mode == "radius" else 4096
    X, Q, batch = _block_batches(pd, 4096, n, 64)
    cols = {"vec": "v", "id": "id"} | ({"group": "doc"} if mode == "topk_groups" else {})
    run = blockscan._make_scan("l2", mode, k, cols, None, False, False)
    tracemalloc.start()
    seen, want = 0, ((Q[5] - X) ** 2).sum(axis=1)
    mine = []
    for out in run([batch]):
        seen += len(out)
        mine.append(out[out.qid == 5])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20
    got = pd.concat(mine).sort_values(["dist", "id"])
    if mode == "radius":
        assert seen == n * 4096 and np.allclose(got.dist, np.sort(want))
    elif mode == "topk":
        assert seen == n * k and np.allclose(got.dist, np.sort(want)[:k])
    else:
        best = np.sort([want[np.arange(4096) % 7 == g].min() for g in range(7)])[:k]
        assert seen == n * k and np.allclose(got.dist, best)


def test_many_cells_leave_a_task_before_its_end():
    import pickle

    import pandas as pd
    X, Q, batch = _block_batches(pd, 200, 1024, 4)
    run = blockscan._make_scan("l2", "topk", 100, {"vec": "v", "id": "id"}, None, False, False)
    many = pd.concat([batch.assign(block=n) for n in range(40)])
    out = list(run([many]))
    assert len(out) == 40 and pickle.loads(batch["queries"][0]).Q.shape == (1024, 4)
    first = [next(iter(run(iter([many, _Stop()]))))]         # the first results come before the last batch is read
    assert len(first[0]) == 1024 * 100


class _Stop:
    def __getitem__(self, name):
        raise AssertionError("read to the end before any result left")
