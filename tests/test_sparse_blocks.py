"""Sparse search by blocks: the scores, and what a task is sent and holds."""

import pickle
import random

import pandas as pd

from vecspark.operators import sparse as S


def _table(n, seed, words=40, size=6):
    rnd = random.Random(seed)
    return {i: {f"w{d}": float(rnd.randint(1, 5)) for d in rnd.sample(range(words), size)} for i in range(n)}


def test_scores_by_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "QUERY_ROWS", 4)
    monkeypatch.setattr(S, "BASE_ROWS", 5)
    docs, queries = _table(60, 1), _table(11, 2)
    entry = [(i, [d for d, _ in e], [w for _, w in e]) for i, t in docs.items() for e in [sorted(t.items(), key=lambda x: (-x[1], x[0]))]]
    rows = spark.createDataFrame(entry + [(None, ["w1"], [9.0])], "id long, dims array<string>, ws array<double>")
    q = spark.createDataFrame([(i, d, w) for i, t in queries.items() for d, w in t.items()], "qid long, dim string, w double")
    got = {(r.qid, r.rk): (r.id, r.score) for r in S.mips(rows, q, 3).collect() if r.id is not None}
    for i, t in queries.items():
        score = sorted(((-sum(w * d.get(x, 0.0) for x, w in t.items()), n) for n, d in [*docs.items(), (None, {"w1": 9.0})] if any(x in d for x in t)),
                       key=lambda x: (x[0], x[1] is not None, x[1] or 0))[:3]
        for rk, (v, n) in enumerate(score, 1):
            if n is not None and sum(v == s for s, _ in score) == 1 and rk < 3:
                assert got[i, rk] == (n, -v)


def test_query_blocks_travel_as_entries():
    """A block of 512 queries with 20 000 dims was sent as two matrices of 80 MB with every block of vectors."""
    part = pd.DataFrame({"qid": range(512), "dims": [[f"w{i}_{j}" for j in range(40)] for i in range(512)], "ws": [[1.0] * 40] * 512})

    class Context:
        partitionId = staticmethod(lambda: 0)
    import pyspark
    real, pyspark.TaskContext = pyspark.TaskContext, type("T", (), {"get": staticmethod(Context)})
    try:
        sent = list(S._pack_queries([part]))
    finally:
        pyspark.TaskContext = real
    assert len(sent) == 1 and len(sent[0]["queries"][0]) < 4 << 20
    qid, at, m, short = S._matrices(sent[0]["queries"][0], 8)
    assert m.sum() == 512 * 40 and short.sum() == 512 * 8 and len(at) == 512 * 40 and len(qid) == 512
    assert pickle.loads(sent[0]["queries"][0])[0][3] == 3
