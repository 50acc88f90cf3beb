"""Greedy subset selection checked against an independent pandas re-computation; compaction recurrence."""

import math

import pandas as pd

from vecspark.plans import workload as W
from vecspark.sources import fixtures as fx
from vecspark.streaming import replay

from conftest import SF_SMALL


def _brute_greedy(c: pd.DataFrame, edges: list[tuple[str, str]], p: W.Params):
    def mprime(card):
        return max(4, int(round(math.log10(card) / math.log10(p.n) * p.M / 4.0)) * 4)

    def size(card):
        return card * (mprime(card) + 50) // 82

    def ef(card):
        return max(p.k, int(math.log10(card) / math.log10(p.n) * p.ef))

    def up(pc, qc):
        return math.log(pc) * math.floor(pc / qc) ** p.gamma * ((p.k + (ef(pc) - p.k) / p.s) / p.k)

    card = dict(zip(c.pid, c.card))
    cnt = dict(zip(c.pid, c.cnt))
    best = {x: min(card[x] * math.log(p.cutoff) / p.cutoff,
                   math.log(p.n) * math.floor(p.n / card[x]) ** p.gamma * ((p.k + (p.ef - p.k) / p.s) / p.k)) for x in card}
    children = {x: [ch for ch, par in edges if par == x] for x in card}
    budget, used, chosen = W.total_budget(p), 0, []
    while used < budget and len(chosen) < len(card):
        scores = {}
        for x in card:
            if x in chosen:
                continue
            g = sum(max(0.0, best[ch] - up(card[x], card[ch])) * cnt[ch] for ch in children[x])
            scores[x] = g / size(card[x]) if size(card[x]) > 0 else 0.0
        x = sorted(scores.items(), key=lambda kv: (-kv[1], kv[0]))[0][0]
        chosen.append(x)
        used += size(card[x])
        for ch in children[x]:
            best[ch] = min(best[ch], up(card[x], card[ch]))
    return chosen


def test_greedy_matches_bruteforce(spark):
    q, b = fx.split(fx.vectors(spark, SF_SMALL))
    bt = fx.with_tag_array(b)
    p = W.Params(n=bt.count(), cutoff=5)
    c = W.candidates(bt, fx.workload(spark, SF_SMALL), p)
    edges = [(r.child, r.parent) for r in W.lattice(c).collect()]
    got = [r.pid for r in W.select(c, p).orderBy("round").collect()]
    assert got == _brute_greedy(c.toPandas(), edges, p)


def test_compaction_recurrence(spark):
    rb = spark.createDataFrame([(1, "insert", 0, 60), (2, "delete", 0, 30), (3, "insert", 60, 80),
                                (4, "delete", 30, 50), (5, "insert", 80, 100)],
                               "step int, op string, start long, end long")
    got = [(r.step, r.compacted) for r in replay.compaction_points(rb, 80).orderBy("step").collect()]
    # step 3: active 50 + pending 30 >= 80 → compact; step 5: active 50 + pending 20 < 80
    assert got == [(1, False), (2, False), (3, True), (4, False), (5, False)]
