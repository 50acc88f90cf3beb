"""Slot reuse against a plain replay of the log with a queue of free slots."""

import random
from collections import deque

from vecspark.streaming import replay


def brute(log):
    live, free, take, new, out = set(), deque(), 0, 0, []
    for seq, i, op in log:
        if op == "insert" and i not in live:
            live.add(i)
            take += 1
            if free:
                s, j = free.popleft()
                out.append((seq, i, take, s, j, None))
            else:
                out.append((seq, i, take, None, None, new))
                new += 1
        elif op == "delete" and i in live:
            live.remove(i)
            free.append((seq, i))
    return out


def test_slots_are_free_when_they_are_taken(spark):
    rng = random.Random(1)
    for width, n in ((7, 400), (1 << 20, 300)):
        log = [(s, rng.randrange(25), rng.choice(["insert", "insert", "delete", "search"])) for s in range(n)]
        df = spark.createDataFrame(log, "seq long, id long, op string").repartition(3)
        got = sorted(tuple(r) for r in replay.replace_deleted(df, width).collect())
        assert got == brute(log)
        assert all(r[3] is None or r[3] < r[0] for r in got)
