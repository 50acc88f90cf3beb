"""Filters against rows by blocks: the pairs, and that no join, shuffle or grouping sees them."""

import random

import pytest

from vecspark.catalog.q_predicates import _range_rows
from vecspark.operators import cells, knn
from vecspark.operators import predicates as P


def _rows(spark, n, seed=1):
    rnd = random.Random(seed)
    rows = [(i, sorted(rnd.sample(range(9), rnd.randint(0, 4))), i % 3, [rnd.random(), rnd.random()]) for i in range(n)]
    rows[3] = (3, None, 0, [0.1, 0.2])
    return rows, spark.createDataFrame(rows, "id long, tags array<int>, cell long, v array<double>")


def _filters(spark, n, seed=2):
    rnd = random.Random(seed)
    f = [(1000 + i, rnd.sample(range(11), rnd.choice([0, 1, 2, 2])), rnd.random() < 0.5, [rnd.random(), rnd.random()]) for i in range(n)]
    return f, spark.createDataFrame(f, "qid long, ftags array<int>, is_and boolean, qv array<double>")


def _match(tags, ftags, is_and):
    have = set(tags or [])
    return not ftags or (set(ftags) <= have if is_and else bool(have & set(ftags)))


@pytest.fixture
def small_blocks(monkeypatch):
    for name, n in (("ROWS", 7), ("FILTERS", 3), ("FILTER_BLOCKS", 2), ("CELLS", 11)):
        monkeypatch.setattr(P, name, n)


def _nodes(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tag_filters_by_blocks(spark, small_blocks):
    rows, base = _rows(spark, 60)
    f, filters = _filters(spark, 25)
    found = P.pred_rows(base, filters, key="qid")
    assert sorted(map(tuple, found.collect())) == sorted((q, i) for q, ft, a, _ in f for i, t, _, _ in rows if _match(t, ft, a))
    plan = _nodes(found)
    assert "Join Inner" not in plan and "Join Cross" in plan          # rows and filters met in a join on the tag before


def test_range_filters_by_blocks(spark, small_blocks):
    rows = [(i, (i * 7919 % 1000) / 1000, (i * 104729 % 1000) / 1000) for i in range(50)]
    f = [(q, q % 7 / 10, q % 7 / 10 + 0.4, q % 5 / 10, q % 5 / 10 + 0.5) for q in range(17)]
    base = spark.createDataFrame(rows + rows[:5], "id long, a0 double, a1 double")
    fr = spark.createDataFrame(f, "qid long, lo0 double, hi0 double, lo1 double, hi1 double")
    for is_and in (True, False):
        found = _range_rows(base, fr, is_and)
        want = sorted((q, i) for q, a, b, c, d in f for i, x, y in (rows + rows[:5] if is_and else rows)
                      if ((a <= x < b) and (c <= y < d) if is_and else (a <= x < b) or (c <= y < d)))
        assert sorted(map(tuple, found.collect())) == want
        plan = _nodes(found)
        assert "Join Inner" not in plan and "Union" not in plan       # the pairs themselves were joined, united and made distinct


def test_grouped_by_filter_meets_in_blocks(spark):
    rows, base = _rows(spark, 80)
    f, filters = _filters(spark, 20)
    got = {}
    for r in knn.knn_grouped_by_filter(base.where("id <> 3"), filters, 4).collect():
        got.setdefault(r.qid, []).append((r.rk, r.id))
    for q, ft, a, qv in f:
        near = sorted((sum((x - y) ** 2 for x, y in zip(qv, v)), i) for i, t, _, v in rows if i != 3 and _match(t, ft, a))[:4]
        assert [i for _, i in sorted(got.get(q, []))] == [i for _, i in near]


def test_matches_per_cell_are_counted_once_a_distinct_filter(spark):
    rows, base = _rows(spark, 60)
    f, filters = _filters(spark, 40)
    got = {(r.qid, r.cell): r.n for r in cells._matches_per_cell(base, filters.drop("qv")).collect()}
    want = {}
    for q, ft, a, _ in f:
        for _, t, c, _ in rows:
            if _match(t, ft, a):
                want[q, c] = want.get((q, c), 0) + 1
    assert got == want
    met = []
    real, P.tag_pairs = P.tag_pairs, lambda ids, tagged, key: (met.append(tagged.count()), real(ids, tagged, key))[1]
    try:
        cells._matches_per_cell(base, filters.drop("qv")).count()
    finally:
        P.tag_pairs = real
    assert met == [len({(a, tuple(sorted(ft))) for _, ft, a, _ in f if ft})]


def test_grouped_by_filter_ranks_vectors_that_no_block_can_hold(spark):
    nan = float("nan")
    base = spark.createDataFrame([(1, [1], [0.0, 0.0]), (2, [1], None), (3, [1], [nan, 0.0]), (4, [1], [None, 1.0]), (6, [1], [2.0, 0.0])],
                                 "id long, tags array<int>, v array<double>")
    f = spark.createDataFrame([(10, [1], True, [0.0, 1.0]), (11, [1], True, None)], "qid long, ftags array<int>, is_and boolean, qv array<double>")
    got = [(r.qid, r.rk, r.id) for r in knn.knn_grouped_by_filter(base, f, 5).orderBy("qid", "rk").collect()]
    assert got == [(10, 1, 2), (10, 2, 4), (10, 3, 1), (10, 4, 6), (10, 5, 3), *((11, n + 1, i) for n, i in enumerate([1, 2, 3, 4, 6]))]
