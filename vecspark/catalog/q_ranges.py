"""Catalog: range-filter workloads — templates, cardinalities, lattice, routing and routed k-NN."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecspark.catalog.oracle_fixtures import cte, l2
from vecspark.catalog.q_knn import TOPK, _fin, topk_sql
from vecspark.catalog.registry import register
from vecspark.plans import ranges as R, workload as W
from vecspark.sources import fixtures as fx

CUTOFF = 10

_LOG = ("SELECT event_id AS seq, CAST(t % 7 AS DOUBLE) / 10.0 AS lo0, CAST(t % 7 + 3 + t % 4 AS DOUBLE) / 10.0 AS hi0, "
        "CASE WHEN t % 6 = 5 THEN NULL ELSE CAST(t % 3 AS DOUBLE) / 10.0 END AS lo1, "
        "CASE WHEN t % 6 = 5 THEN NULL ELSE CAST(t % 3 + 5 + t % 3 AS DOUBLE) / 10.0 END AS hi1, t % 5 <> 4 AS is_and "
        "FROM (SELECT event_id, (1000 // (event_id % 1000 + 1) + 7 * (event_id // 5000)) % 61 AS t FROM events)")


def _key(x: str) -> str:
    parts = " || '|' || ".join(f"coalesce(CAST({x}.{c} AS VARCHAR), '*')" for c in R.BOUNDS)
    return f"CASE WHEN {x}.is_and THEN 'and' ELSE 'or' END || '|' || {parts}"


def _inside(a: str, lo: str, hi: str) -> str:
    return f"(({lo} IS NULL OR {a} >= {lo}) AND ({hi} IS NULL OR {a} < {hi}))"


def _match(b: str, f: str) -> str:
    m0, m1 = (_inside(f"{b}.a{a}", f"{f}.lo{a}", f"{f}.hi{a}") for a in (0, 1))
    return f"CASE WHEN {f}.is_and THEN {m0} AND {m1} ELSE {m0} OR {m1} END"


def _contains(c: str, p: str) -> str:
    lo = " AND ".join(f"({p}.lo{a} IS NULL OR ({c}.lo{a} IS NOT NULL AND {c}.lo{a} >= {p}.lo{a}))" for a in (0, 1))
    hi = " AND ".join(f"({p}.hi{a} IS NULL OR ({c}.hi{a} IS NOT NULL AND {c}.hi{a} <= {p}.hi{a}))" for a in (0, 1))
    return f"({c}.is_and = {p}.is_and AND {lo} AND {hi})"


_PARTS = [f"wr AS ({_LOG})",
          "ba AS (SELECT b.id, a.a0, a.a1 FROM base b JOIN attrs a ON a.id = b.id)",
          f"tl AS (SELECT {_key('wr')} AS pid, lo0, hi0, lo1, hi1, is_and, count(*) AS cnt FROM wr GROUP BY ALL)",
          f"cr AS (SELECT tl.pid, tl.lo0, tl.hi0, tl.lo1, tl.hi1, tl.is_and, tl.cnt, count(ba.id) AS card FROM tl LEFT JOIN ba ON {_match('ba', 'tl')} GROUP BY ALL "
          f"HAVING count(ba.id) >= {CUTOFF})"]
_ROUTE = [f"qr AS (SELECT f.*, f.qid % 2 = 0 AS is_and FROM filters_range f)",
          f"rt AS (SELECT q.qid, {_key('q')} AS qkey, c.pid, c.card, row_number() OVER (PARTITION BY q.qid ORDER BY c.pid <> {_key('q')}, c.card, c.pid) AS r "
          f"FROM qr q LEFT JOIN cr c ON {_contains('q', 'c')})"]


def _cte(*extra: str) -> str:
    return cte("queries", "base", "attrs", "filters_range", extra=",\n".join([*_PARTS, *extra]))


def _setup(spark, sf):
    q, b = fx.split(fx.vectors(spark, sf))
    ba = fx.with_attrs(b)
    p = W.Params(n=ba.count(), cutoff=CUTOFF)
    return q, ba, p, R.candidates(ba, fx.workload_ranges(spark, sf), p)


@register("gen_range_workload", cte("queries", extra=f"wr AS ({_LOG})") + "SELECT * FROM wr")
def gen_range_workload(spark, sf):
    """One range template an event: a Zipf-shaped mix of AND and OR templates, some open on the second attribute."""
    return fx.workload_ranges(spark, sf)


@register("range_candidates", _cte() + "SELECT pid, cnt, card FROM cr")
def range_candidates(spark, sf):
    """Distinct range predicates of the log with their counts and exact cardinalities."""
    return _setup(spark, sf)[3].select("pid", "cnt", "card")


@register("range_lattice_edges", _cte() + f"SELECT c.pid AS child, p.pid AS parent FROM cr c, cr p WHERE {_contains('c', 'p')}")
def range_lattice_edges(spark, sf):
    """Containment edges among the range candidates, by the interval-containment join."""
    return R.containment_edges(_setup(spark, sf)[3])


@register("range_hasse_edges", _cte(f"e AS (SELECT c.pid AS child, p.pid AS parent FROM cr c, cr p WHERE c.pid <> p.pid AND {_contains('c', 'p')})") + """
SELECT child, parent FROM e WHERE NOT EXISTS (SELECT 1 FROM e a JOIN e b ON a.parent = b.child WHERE a.child = e.child AND b.parent = e.parent)
UNION ALL SELECT pid AS child, 'root' AS parent FROM cr WHERE pid NOT IN (SELECT child FROM e)""")
def range_hasse_edges(spark, sf):
    """Transitive reduction of the range lattice, with root links."""
    return W.hasse(R.containment_edges(_setup(spark, sf)[3]))


def _queries(q):
    return fx.filters_range(q).withColumn("is_and", F.col("qid") % 2 == 0)


@register("range_route", _cte(*_ROUTE) + "SELECT qid, qkey, coalesce(pid, 'root') AS route, coalesce(card, (SELECT count(*) FROM base)) AS route_card, "
          "CASE WHEN pid IS NULL THEN 'root' WHEN pid = qkey THEN 'exact' ELSE 'superset' END AS kind FROM rt WHERE r = 1")
def range_route(spark, sf):
    """Each range query's smallest containing subset, else the root."""
    q, ba, p, c = _setup(spark, sf)
    return R.route(_queries(q), c, p.n)


@register("knn_range_routed", _cte(*_ROUTE) + topk_sql(
    f"SELECT q.qid, b.id, {l2('q.qv', 'b.v')} AS dist FROM queries q JOIN qr f ON f.qid = q.qid, base b JOIN ba ON ba.id = b.id WHERE {_match('ba', 'f')}"))
def knn_range_routed(spark, sf):
    """Range-filtered k-NN routed through stored range subsets; the answer is the exact one."""
    q, ba, p, c = _setup(spark, sf)
    qr = _queries(q)
    return _fin(R.search(ba, qr, R.route(qr, c, p.n), R.materialise(ba, c), TOPK))
