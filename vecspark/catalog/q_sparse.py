"""Catalog: sparse vectors (A6, B14-B16, D7, D8) over documents (base) and benchmark passages (queries)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecspark.catalog.oracle_fixtures import cte
from vecspark.catalog.registry import register
from vecspark.operators import sparse as S
from vecspark.sources import fixtures as fx

# Fixed query parameters.
TOPK = 10
MASS_ALPHA = 0.5
TOPT, TOPT_SCALE = 8, 0.5
DOC_T, QUERY_T, CAND_R = 16, 8, 50
K1 = 1.2


def _rank_sql(score_sql: str, k: int = TOPK) -> str:
    return (f"SELECT qid, rk, id, round(score, 6) AS score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid "
            f"ORDER BY score DESC, id) AS INTEGER) AS rk FROM ({score_sql}) WHERE score > 0) WHERE rk <= {k}")


def _sp(spark, sf):
    """(documents in row form, queries in long form)."""
    return fx.sparse_rows(spark, sf), fx.sparse_queries(spark, sf)


def _round(df):
    return df.withColumn("score", F.round("score", 6))


@register("sparse_mips", cte("sparse_docs", "sparse_queries") + _rank_sql(
    "SELECT q.qid, d.id, sum(q.w * d.w) AS score FROM sparse_queries q JOIN sparse_docs d ON d.dim = q.dim GROUP BY q.qid, d.id"))
def sparse_mips(spark, sf):
    d, q = _sp(spark, sf)
    return _round(S.mips(d, q, TOPK))


@register("sparse_saturated", cte("sparse_docs", "sparse_queries") + _rank_sql(
    f"SELECT q.qid, d.id, round(sum(q.w * (d.w / (d.w + {K1}))), 9) AS score FROM sparse_queries q JOIN sparse_docs d ON d.dim = q.dim GROUP BY q.qid, d.id"))
def sparse_saturated(spark, sf):
    d, q = _sp(spark, sf)
    # fractional sums depend on summation order: rank on the score rounded to 1e-9
    return _round(S.mips(d, q, TOPK, weight=S.saturated(K1), digits=9))


@register("sparse_prune_mass", cte("sparse_docs") + f"""
SELECT id, dim, w FROM (SELECT *, coalesce(sum(w) OVER (PARTITION BY id ORDER BY w DESC, dim ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(w) OVER (PARTITION BY id) AS total FROM sparse_docs) WHERE before < {MASS_ALPHA} * total""")
def sparse_prune_mass(spark, sf):
    return S.prune_mass(fx.sparse_docs(spark, sf), MASS_ALPHA)


@register("sparse_prune_topt", cte("sparse_docs") + f"""
SELECT id, dim, CAST(floor(w * {TOPT_SCALE}) AS DOUBLE) AS w FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY w DESC, dim) AS r
FROM sparse_docs) WHERE r <= {TOPT} AND floor(w * {TOPT_SCALE}) > 0""")
def sparse_prune_topt(spark, sf):
    return S.prune_topt(fx.sparse_docs(spark, sf), TOPT, TOPT_SCALE)


@register("sparse_two_stage", cte("sparse_docs", "sparse_queries") + f"""
, pd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY w DESC, dim) AS r FROM sparse_docs) WHERE r <= {DOC_T}),
pq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY w DESC, dim) AS r FROM sparse_queries) WHERE r <= {QUERY_T}),
cand AS (SELECT qid, id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM (
  SELECT pq.qid, pd.id, sum(pq.w * pd.w) AS score FROM pq JOIN pd ON pd.dim = pq.dim GROUP BY pq.qid, pd.id) WHERE score > 0) WHERE r <= {CAND_R})
""" + _rank_sql("SELECT c.qid, c.id, sum(q.w * d.w) AS score FROM cand c JOIN sparse_docs d ON d.id = c.id "
                "JOIN sparse_queries q ON q.qid = c.qid AND q.dim = d.dim GROUP BY c.qid, c.id"))
def sparse_two_stage(spark, sf):
    d, q = _sp(spark, sf)
    return _round(S.two_stage(d, q, TOPK, DOC_T, QUERY_T, CAND_R))


@register("sparse_validate", cte("sparse_docs") + """
, n AS (SELECT count(*) AS n FROM documents)
SELECT 'nonpositive_weight' AS "check", CAST(count(*) FILTER (WHERE w <= 0) AS BIGINT) AS violations FROM sparse_docs
UNION ALL SELECT 'id_out_of_range', CAST(count(*) FILTER (WHERE id < 0 OR id >= n.n) AS BIGINT) FROM sparse_docs, n
UNION ALL SELECT 'empty_dim', CAST(count(*) FILTER (WHERE dim = '') AS BIGINT) FROM sparse_docs""")
def sparse_validate(spark, sf):
    n = fx.read(spark, sf, "documents").count()
    return S.validate(fx.sparse_docs(spark, sf), n)
