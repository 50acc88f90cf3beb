"""Nearest-first search that a rule of the user's ends: continue, keep or stop at every neighbour.

A rule sees a query's neighbours in order of (distance, id) and answers for each of them (see ``StopRule``).  The search
fetches neighbours in growing batches: round r asks the exact block scan for the ``first * GROWTH^r`` nearest of the queries
that are still open, and feeds the new ones to the rule, whose state per query is kept between the rounds.  A query is closed
when its rule says so or the base has no more rows.  Rules of many queries run in parallel, a query's neighbours in order;
a round holds for each open query the neighbours of one batch.
"""

from __future__ import annotations

import pickle
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.operators import blockscan

GROWTH = 4

KEEP, SKIP, STOP, KEEP_AND_STOP = "keep", "skip", "stop", "keep and stop"


class StopRule:
    """A pluggable rule; ``columns`` of the base row are handed to ``step`` beside its distance and id."""

    columns: tuple[str, ...] = ()

    def start(self) -> Any:
        """State of a query before its first neighbour."""
        return None

    def step(self, state: Any, dist: float, id_: int, row: dict) -> tuple[Any, str]:
        """New state, and KEEP, SKIP (go on without it), STOP (without it) or KEEP_AND_STOP."""
        raise NotImplementedError


class EpsilonRule(StopRule):
    """Rows with ``dist <= eps``, at least ``least`` and at most ``most`` of them."""

    def __init__(self, eps: float, least: int = 0, most: int | None = None):
        self.eps, self.least, self.most = eps, least, most

    def start(self) -> int:
        return 0

    def step(self, state, dist, id_, row):
        if (dist > self.eps and state >= self.least) or state == self.most:
            return state, STOP
        return state + 1, KEEP


class DocsRule(StopRule):
    """Every neighbour before the first one of the (n+1)-th document."""

    def __init__(self, num_docs: int, doc_col: str = "doc_id"):
        self.n, self.columns = num_docs, (doc_col,)

    def start(self) -> frozenset:
        return frozenset()

    def step(self, state, dist, id_, row):
        state = state | {row[self.columns[0]]}
        return state, STOP if len(state) > self.n else KEEP


def nearest_first(base: DataFrame, queries: DataFrame, rule: StopRule, metric: str = "l2", first: int = 64) -> DataFrame:
    """``(qid, rk, id, dist, *rule.columns)``: what the rule keeps, ranked from 1 per query."""
    columns = list(rule.columns)
    kinds = {f.name: f.dataType.simpleString() for f in base.schema.fields}
    extra = "".join(f", {c} {kinds[c]}" for c in columns)
    found_shape = f"qid long, pos int, id long, dist double{extra}, state binary, done boolean"

    def feed(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["dist", "id"])
        raw = part["state"].iloc[0]
        state = rule.start() if raw is None else pickle.loads(raw)
        out, done = [], False
        for r in part[part["pos"] > part["seen"]].to_dict("records"):
            state, say = rule.step(state, r["dist"], r["id"], r)
            if say in (KEEP, KEEP_AND_STOP):
                out.append((r["qid"], r["pos"], r["id"], r["dist"], *[r[c] for c in columns]))
            if say in (STOP, KEEP_AND_STOP):
                done = True
                break
        names = ["qid", "pos", "id", "dist", *columns]
        # the last line carries the query's state to the next round
        out.append((part["qid"].iloc[0], -1, None, None, *[None] * len(columns)))
        got = pd.DataFrame(out, columns=names)
        got["id"] = got["id"].astype("Int64")
        for c in columns:
            got[c] = got[c].astype("Int64") if kinds[c] in ("int", "bigint") else got[c]
        got["state"] = [None] * (len(out) - 1) + [pickle.dumps(state)]
        got["done"] = done
        return got

    rows, k, seen, results = base.count(), first, 0, None
    open_ = queries.select(F.col("qid").alias("__q"), F.lit(None).cast("binary").alias("state")).checkpoint()
    while True:
        near = blockscan.knn(base.select("id", "v"), queries.join(open_.select(F.col("__q").alias("qid")), "qid", "left_semi"), k, metric)
        near = near.join(base.select("id", *columns), "id") if columns else near
        fed = near.withColumnRenamed("rk", "pos").join(open_.withColumnRenamed("__q", "qid"), "qid").withColumn("seen", F.lit(seen))
        got = fed.groupBy("qid").applyInPandas(feed, found_shape).checkpoint()
        kept = got.where("pos > 0").select("qid", "pos", "id", "dist", *columns)
        results = kept if results is None else results.unionByName(kept)
        open_ = got.where("pos < 0 and not done").select(F.col("qid").alias("__q"), "state").checkpoint()
        if k >= rows or not open_.head(1):
            break
        seen, k = k, k * GROWTH
    return blockscan.rank_topk(results.drop("pos"), 1 << 30).select("qid", "rk", "id", "dist", *columns)
