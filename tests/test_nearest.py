"""A stop rule of one's own in the nearest-first search."""

import numpy as np

from vecspark.operators import nearest as N


def spread_rule(gap):
    class SpreadRule(N.StopRule):
        """Keeps every second neighbour and stops at the first gap wider than ``gap``."""

        columns = ("label",)

        def __init__(self, gap: float):
            self.gap = gap

        def start(self):
            return (0, None)

        def step(self, state, dist, id_, row):
            n, last = state
            if last is not None and dist - last > self.gap:
                return state, N.KEEP_AND_STOP
            return (n + 1, dist), N.KEEP if n % 2 == 0 and row["label"] != 3 else N.SKIP

    return SpreadRule(gap)


def test_a_rule_with_state_and_base_columns(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 3))
    base = spark.createDataFrame([(i, x[i].tolist(), i % 5) for i in range(150)], "id long, v array<double>, label int")
    q = spark.createDataFrame([(1000 + j, rng.normal(size=3).tolist()) for j in range(4)], "qid long, qv array<double>")
    got = {}
    for r in N.nearest_first(base, q, spread_rule(0.9), first=4).orderBy("qid", "rk").collect():
        got.setdefault(r.qid, []).append((r.rk, r.id, r.label))
    for row in q.collect():
        d = ((x - np.array(row.qv)) ** 2).sum(axis=1)
        order, kept, last, n = np.lexsort((np.arange(150), d)), [], None, 0
        for i in order.tolist():
            if last is not None and d[i] - last > 0.9:
                kept.append(i)
                break
            if n % 2 == 0 and i % 5 != 3:
                kept.append(i)
            n, last = n + 1, d[i]
        assert got[row.qid] == [(k + 1, i, i % 5) for k, i in enumerate(kept)]
