"""User-facing searcher objects and the metric registry.

A searcher is fitted on a base table and answers query tables; every method
returns a DataFrame in the long result form ``(qid, rk, id, dist)`` (range:
``(qid, id, dist)``).  Nothing is computed until an action runs.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.operators import knn as K
from vecspark.operators import quality as Q
from vecspark.plans import cover, routing
from vecspark.plans import workload as W
from vecspark.plans.store import SubsetStore


class Searcher:
    """Exact searcher over ``base(id, v[, tags][, a0, a1])``."""

    def __init__(self, metric: str = "l2"):
        self.metric = metric
        self.base: DataFrame | None = None

    def fit(self, base: DataFrame) -> "Searcher":
        self.base = base
        return self

    def query(self, queries: DataFrame, k: int) -> DataFrame:
        return K.knn(self.base, queries, k, self.metric)

    def range_query(self, queries: DataFrame, radius: float) -> DataFrame:
        return K.range_search(self.base, queries, radius, self.metric)

    def filtered_query(self, queries: DataFrame, k: int, strategy: str = "auto", cutoff: int = 30) -> DataFrame:
        """Tag filters in ``queries(ftags, is_and)``."""
        return K.knn_filtered(self.base, queries, k, self.metric, strategy=strategy, cutoff=cutoff)

    def where(self, predicate: Column) -> "Searcher":
        """Restrict the searchable rows with any boolean Column (pushed into the scan)."""
        s = Searcher(self.metric)
        s.base = self.base.where(predicate)
        return s


class WorkloadSearcher(Searcher):
    """Searcher that materialises workload-chosen predicate subsets and routes each query."""

    def __init__(self, params: W.Params | None = None, metric: str = "l2", name: str = "subsets"):
        super().__init__(metric)
        self.params = params
        self.name = name
        self.store: SubsetStore | None = None
        self.selected = None

    def fit(self, base: DataFrame, workload: DataFrame | None = None) -> "WorkloadSearcher":
        self.base = base
        p = self.params or W.Params(n=base.count())
        self.params = p
        if workload is not None:
            self.store = self.store or SubsetStore(base.sparkSession)
            self.refit(workload)
        return self

    def refit(self, workload: DataFrame) -> DataFrame:
        """Select anew for a changed log; only new subsets are written.  Returns (pid, action)."""
        cands = W.candidates(self.base, workload, self.params)
        chosen = W.select(cands, self.params).select("pid")
        self.selected = cands.join(chosen, "pid").select("pid", "ftags", "is_and", "card").checkpoint()
        return self.store.refit(self.base, self.selected)

    def insert(self, rows: DataFrame) -> "WorkloadSearcher":
        """Add base rows: they go to the base and to every held subset that they match."""
        self.base = self.base.unionByName(rows.select(*self.base.columns))
        self.params = replace(self.params, n=self.base.count())
        if self.store is not None:
            self.store.append(rows)
            self.selected = self.store.subsets().checkpoint()
        return self

    def filtered_query(self, queries: DataFrame, k: int, strategy: str = "auto", cutoff: int | None = None) -> DataFrame:
        if self.selected is None:
            return super().filtered_query(queries, k, strategy, cutoff or self.params.cutoff)
        from vecspark.operators import predicates as P
        card = P.filter_cardinality(self.base, queries.select("ftags", "is_and"))
        qcard = queries.join(card, ["ftags", "is_and"]).select("qid", "card")
        rt = W.route(queries, self.selected, self.params.n)
        plan = cover.cover_plan(queries, self.selected, self.base, self.params).checkpoint()
        st = cover.strategy_with_cover(rt, qcard, plan, self.params).checkpoint()
        routes = routing.single_routes(st).unionByName(cover.cover_routes(st, plan))
        return routing.search(self.base, queries, st, routes, self.store, k, self.metric)


@dataclass(frozen=True)
class Metric:
    name: str
    direction: str          # "max" or "min": which way is better
    fn: object = field(compare=False)


def _recall(truth, run, count):
    return Q.recall(truth, run, count, ties=True)


METRICS: dict[str, Metric] = {
    "k-nn": Metric("k-nn", "max", _recall),
    "ap": Metric("ap", "max", lambda gt, res: Q.range_ap(gt, res)),
    "qps": Metric("qps", "max", lambda runs: runs.select("run_id", "qps")),
    "build": Metric("build", "min", lambda runs: runs.select("run_id", "build")),
    "indexsize": Metric("indexsize", "min", lambda runs: runs.select("run_id", "indexsize")),
    "queriessize": Metric("queriessize", "min", lambda runs: runs.select("run_id", (F.col("indexsize") / F.col("qps")).alias("queriessize"))),
    "wspq": Metric("wspq", "min", lambda runs: runs.select("run_id", (F.col("watt_seconds") / F.col("count")).alias("wspq"))),
    "mean_latency": Metric("mean_latency", "min", lambda runs: runs.select("run_id", "mean_latency")),
}


def register_metric(name: str, direction: str, fn) -> None:
    METRICS[name] = Metric(name, direction, fn)
