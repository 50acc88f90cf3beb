"""Properties of the non-SQL operators: generated runbooks, sub-cells, designed signatures, searchers."""

from pyspark.sql import functions as F

from vecspark import catalog
from vecspark.api import Searcher, WorkloadSearcher
from vecspark.operators import predicates as P
from vecspark.plans import workload as W
from vecspark.sources import fixtures as fx
from vecspark.streaming import replay

from conftest import SF_SMALL


def test_generated_runbook_is_valid(spark):
    rb = catalog.queries()["runbook_generate"](spark, SF_SMALL)
    steps = sorted(r.step for r in rb.select("step").collect())
    assert steps == list(range(1, len(steps) + 1))
    n = fx.vectors(spark, SF_SMALL).count()
    assert replay.runbook_validate(rb, n).count() == 0
    act = replay.runbook_active(rb).collect()
    assert all(r.active >= 0 for r in act)


def test_two_level_subcells(spark):
    got = catalog.queries()["two_level_cells"](spark, SF_SMALL).toPandas()
    assert len(got) == fx.vectors(spark, SF_SMALL).count()
    assert got.subcell.between(0, 3).all()


def test_designed_bits_stay_under_half(spark):
    q, b = fx.split(fx.vectors(spark, SF_SMALL))
    bt = fx.with_tag_array(b)
    n = bt.count()
    design = P.design_signatures(bt, 8)
    cover = (P.postings(bt).join(design, "tag").select("bit", "id").distinct()
             .groupBy("bit").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("id")))
    words = design.groupBy("bit").agg(F.count(F.lit(1)).alias("w"))
    for r in cover.join(words, "bit").collect():
        assert r.rows * 2 < n or r.w == 1      # a single hot word may exceed half on its own


def test_covering_equals_filtered_or(spark):
    qs = catalog.queries()
    a = sorted(map(tuple, qs["knn_covering"](spark, SF_SMALL).collect()))
    b = sorted(map(tuple, qs["knn_filtered_or"](spark, SF_SMALL).collect()))
    assert a == b


def test_searchers(spark):
    q, b = fx.split(fx.vectors(spark, SF_SMALL))
    bt = fx.with_tag_array(b)
    qf = fx.filters_tag(q, True)
    exact = Searcher().fit(bt).filtered_query(qf, 10)
    ws = WorkloadSearcher(W.Params(n=bt.count(), cutoff=5)).fit(bt, fx.workload(spark, SF_SMALL))
    routed = ws.filtered_query(qf, 10)
    key = ["qid", "rk", "id"]
    assert sorted(map(tuple, exact.select(key).collect())) == sorted(map(tuple, routed.select(key).collect()))
    assert Searcher().fit(bt).where(F.col("id") % 2 == 0).query(q, 5).where(F.col("id") % 2 == 1).count() == 0
