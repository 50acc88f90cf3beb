"""The versioned subset store: create / keep / drop, deltas, failed refits, vacuum; choice against the one-by-one greedy."""

import pytest
from pyspark.sql import functions as F

from vecspark.plans.store import SubsetStore

SUBSETS = "pid string, ftags array<int>, is_and boolean"
A, B, C, E = ("and|1", [1], True), ("and|1,2", [1, 2], True), ("or|2,3", [2, 3], False), ("and|9", [9], True)


def base(spark, ids):
    return spark.createDataFrame([(i, [float(i)], [t for t in (1, 2, 3) if i % (t + 1) == 0]) for i in ids], "id long, v array<float>, tags array<int>")


def held(store, version=None):
    out = {}
    for r in store.rows(version=version).collect():
        out.setdefault(r.pid, set()).add(r.id)
    return out


def want(ids, pid):
    return {i for i in ids if {"and|1": i % 2 == 0, "and|1,2": i % 6 == 0, "or|2,3": i % 3 == 0 or i % 4 == 0}[pid]}


def test_refit_append_and_vacuum(spark):
    store, ids = SubsetStore(spark), range(60)
    plan = lambda df: {r.pid: r.action for r in df.collect()}
    assert store.version() == -1 and store.rows().count() == 0
    assert plan(store.refit(base(spark, ids), spark.createDataFrame([A, B, E], SUBSETS))) == {A[0]: "create", B[0]: "create", E[0]: "create"}
    assert held(store) == {p: want(ids, p) for p in (A[0], B[0])}
    first = {r.pid: r.part for r in store.manifest().collect()}
    assert first[E[0]] is None                                              # held without rows
    assert plan(store.refit(base(spark, ids), spark.createDataFrame([B, C], SUBSETS))) == {A[0]: "drop", B[0]: "keep", C[0]: "create", E[0]: "drop"}
    second = {r.pid: r.part for r in store.manifest().collect()}
    assert second[B[0]] == first[B[0]] and second[C[0]] != first[A[0]]      # kept rows are not written again
    assert held(store) == {p: want(ids, p) for p in (B[0], C[0])} and held(store, 0) == {p: want(ids, p) for p in (A[0], B[0])}
    more = range(60, 90)
    store.append(base(spark, more))
    both = range(90)
    assert held(store) == {p: want(both, p) for p in (B[0], C[0])}
    assert {r.pid: r.card for r in store.subsets().collect()} == {p: len(want(both, p)) for p in (B[0], C[0])}
    only = store.rows(spark.createDataFrame([(C[0],)], "pid string"))
    assert {r.pid for r in only.select("pid").distinct().collect()} == {C[0]}
    store.refit(base(spark, both), spark.createDataFrame([C], SUBSETS))
    store.refit(base(spark, both), spark.createDataFrame([A], SUBSETS))
    gone = store.vacuum(keep=1)
    assert len(gone) == 3 and held(store) == {A[0]: want(both, A[0])}


def test_a_failed_refit_leaves_the_old_version(spark):
    store = SubsetStore(spark)
    store.refit(base(spark, range(30)), spark.createDataFrame([A], SUBSETS))
    broken = base(spark, range(30)).withColumn("v", F.when(F.col("id") < 0, F.col("v")).otherwise(F.raise_error(F.lit("lost")).cast("array<float>")))
    with pytest.raises(Exception, match="lost"):
        store.refit(broken, spark.createDataFrame([B, C], SUBSETS))
    assert store.version() == 0 and held(store) == {A[0]: want(range(30), A[0])}


def test_searcher_refits_and_inserts(spark):
    from vecspark.api import Searcher, WorkloadSearcher
    from vecspark.plans.workload import Params
    rows = base(spark, range(200))
    log = spark.createDataFrame([(i, [1] if i % 3 else [2, 3], bool(i % 3)) for i in range(50)], "seq long, ftags array<int>, is_and boolean")
    q = spark.createDataFrame([(0, [31.0], [1], True), (1, [77.0], [1, 2], True), (2, [140.0], [2, 3], False), (3, [5.0], [], True)],
                              "qid long, qv array<float>, ftags array<int>, is_and boolean")
    ws = WorkloadSearcher(Params(n=200, cutoff=5)).fit(rows, log)
    answer = lambda s: [tuple(r) for r in s.filtered_query(q, 5).orderBy("qid", "rk").collect()]
    assert answer(ws) == answer(Searcher().fit(rows))
    ws.insert(base(spark, range(200, 260)))
    assert answer(ws) == answer(Searcher().fit(base(spark, range(260))))
    ws.refit(log.where("is_and"))
    assert answer(ws) == answer(Searcher().fit(base(spark, range(260))))
