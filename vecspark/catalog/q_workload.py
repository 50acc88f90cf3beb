"""Catalog: workload-driven subset selection and routing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.catalog.oracle_fixtures import cte, l2
from vecspark.catalog.q_knn import TOPK, _fin, topk_sql
from vecspark.catalog.registry import register
from vecspark.operators import predicates as P
from vecspark.plans import routing, workload as W
from vecspark.plans.store import SubsetStore
from vecspark.session import cut_lineage
from vecspark.sources import fixtures as fx

WINDOW_N = 5000
CUTOFF = 30
M, EF, GAMMA, S = 16, 50, 0.5, 3.0


def _setup(spark, sf):
    q, b = fx.split(fx.vectors(spark, sf))
    bt = fx.with_tag_array(b)
    return q, bt, W.Params(n=bt.count(), cutoff=CUTOFF, M=M, k=TOPK, ef=EF, gamma=GAMMA, s=S)


def _cands(spark, sf, wl: DataFrame | None = None):
    q, bt, p = _setup(spark, sf)
    wl = fx.workload(spark, sf) if wl is None else wl
    return q, bt, p, W.candidates(bt, wl, p)


# ------------------------------------------------------------------ SQL building blocks

_BT = "bt AS (SELECT b.id, t.tags FROM base b JOIN tag_arr t ON t.id = b.id)"
_N = "n AS (SELECT count(*) AS n FROM base)"


def _cand_sql(wl_where: str = "") -> str:
    return (f"wl AS (SELECT seq, list_sort(list_distinct(ftags)) AS ftags, true AS is_and FROM workload {wl_where}),\n"
            "tal AS (SELECT 'and|' || array_to_string(ftags, ',') AS pid, ftags, is_and, count(*) AS cnt FROM wl GROUP BY ftags, is_and),\n"
            "tcard AS (SELECT t.pid, count(bt.id) AS card FROM tal t LEFT JOIN bt ON list_has_all(bt.tags, t.ftags) GROUP BY t.pid),\n"
            f"cand AS (SELECT t.*, c.card FROM tal t JOIN tcard c ON c.pid = t.pid WHERE c.card >= {CUTOFF})")


def _wcte(*extra: str, names=("queries", "base", "tag_arr", "workload")) -> str:
    return cte(*names, extra=",\n".join([_BT, _N, *extra]))


def _mprime(c: str) -> str:
    return f"greatest(4, CAST(round(log10({c}) / log10(n.n) * {M} / 4.0) * 4 AS BIGINT))"


def _efprime(c: str) -> str:
    return f"greatest({TOPK}, CAST(floor(log10({c}) / log10(n.n) * {EF}) AS BIGINT))"


def _upward(pc: str, qc: str) -> str:
    return (f"(ln({pc}) * pow(floor(CAST({pc} AS DOUBLE) / {qc}), {GAMMA}) * "
            f"(({TOPK} + ({_efprime(pc)} - {TOPK}) / {S}) / {TOPK}))")


def _root(qc: str) -> str:
    ratio = (TOPK + (EF - TOPK) / S) / TOPK
    return f"(ln(n.n) * pow(floor(CAST(n.n AS DOUBLE) / {qc}), {GAMMA}) * {ratio!r})"


def _bf(qc: str) -> str:
    return f"(CAST({qc} AS DOUBLE) * {math.log(CUTOFF) / CUTOFF!r})"


def _subsume_sql(c: str, p: str) -> str:
    return (f"(len({p}.ftags) = 0 OR (len({c}.ftags) > 0 AND {c}.is_and = {p}.is_and AND CASE WHEN {p}.is_and "
            f"THEN list_has_all({c}.ftags, {p}.ftags) ELSE list_has_all({p}.ftags, {c}.ftags) END))")


# ------------------------------------------------------------------ F6, E2, I1, G1, E12

@register("workload_window", cte("workload") + f"SELECT seq, ftags FROM workload ORDER BY seq DESC LIMIT {WINDOW_N}")
def workload_window(spark, sf):
    return W.workload_window(fx.workload(spark, sf), WINDOW_N).select("seq", "ftags")


@register("workload_tally", _wcte(
    "wl AS (SELECT list_sort(list_distinct(ftags)) AS ftags FROM workload)",
    "tal AS (SELECT 'and|' || array_to_string(ftags, ',') AS pid, ftags, count(*) AS cnt FROM wl GROUP BY ftags)") + f"""
SELECT t.pid, t.cnt, count(bt.id) AS card, count(bt.id) >= {CUTOFF} AS kept
FROM tal t LEFT JOIN bt ON list_has_all(bt.tags, t.ftags) GROUP BY t.pid, t.cnt""")
def workload_tally(spark, sf):
    _, bt, p = _setup(spark, sf)
    t = W.tally(fx.workload(spark, sf))
    card = P.filter_cardinality(bt, t.select("ftags", "is_and"))
    return t.join(card, ["ftags", "is_and"]).select(
        "pid", "cnt", "card", (F.col("card") >= p.cutoff).alias("kept"))


@register("candidate_subsets", _wcte(_cand_sql()) +
          "SELECT pid, cnt, card, CAST(row_number() OVER (ORDER BY card, pid) AS INTEGER) AS ord FROM cand")
def candidate_subsets(spark, sf):
    _, _, _, c = _cands(spark, sf)
    return W.in_order(c).select("pid", "cnt", "card", "ord")


@register("selectivity_profile", _wcte(
    "wl AS (SELECT list_sort(list_distinct(ftags)) AS ftags FROM workload)",
    "sel AS (SELECT w.ftags, (SELECT count(*) FROM bt WHERE list_has_all(bt.tags, w.ftags)) AS card FROM wl w)",
    "srt AS (SELECT card, row_number() OVER (ORDER BY card) - 1 AS i, count(*) OVER () AS total FROM sel)") + """
SELECT avg(card) AS avg_card,
  min(card) FILTER (WHERE i = 0) AS min_card, min(card) FILTER (WHERE i = floor(total * 0.2)) AS p20,
  min(card) FILTER (WHERE i = floor(total * 0.4)) AS p40, min(card) FILTER (WHERE i = floor(total * 0.6)) AS p60,
  min(card) FILTER (WHERE i = floor(total * 0.8)) AS p80, min(card) FILTER (WHERE i = total - 1) AS max_card FROM srt""")
def selectivity_profile(spark, sf):
    _, bt, _ = _setup(spark, sf)
    return W.selectivity_profile(bt, fx.workload(spark, sf))


# ------------------------------------------------------------------ I2, I3: cost and size models

@register("size_model", _wcte(_cand_sql()) + f"""
SELECT c.pid, c.card, {_mprime('c.card')} AS m_prime, CAST((c.card * ({_mprime('c.card')} + 50)) // 82 AS BIGINT) AS size,
       {_efprime('c.card')} AS ef_prime FROM cand c, n""")
def size_model(spark, sf):
    _, _, p, c = _cands(spark, sf)
    return W.with_models(c, p).select("pid", "card", "m_prime", "size", "ef_prime")


@register("cost_model", _wcte(_cand_sql()) + f"""
SELECT c.pid, c.card, round({_bf('c.card')}, 6) AS bf_cost, round({_root('c.card')}, 6) AS root_cost,
       round(least({_bf('c.card')}, {_root('c.card')}), 6) AS best_cost FROM cand c, n""")
def cost_model(spark, sf):
    _, _, p, c = _cands(spark, sf)
    m = W.with_models(c, p)
    return m.select("pid", "card", F.round("bf_cost", 6).alias("bf_cost"), F.round("root_cost", 6).alias("root_cost"),
                    F.round(F.least("bf_cost", "root_cost"), 6).alias("best_cost"))


# ------------------------------------------------------------------ D16, I6: lattice and Hasse diagram

@register("lattice_edges", _wcte(_cand_sql()) +
          f"SELECT c.pid AS child, p.pid AS parent, round({_upward('p.card', 'c.card')}, 6) AS upward_cost "
          f"FROM cand c, cand p, n WHERE {_subsume_sql('c', 'p')}")
def lattice_edges(spark, sf):
    _, _, p, c = _cands(spark, sf)
    e = W.lattice(c)
    cc = c.select(F.col("pid").alias("child"), F.col("card").alias("c_card"))
    pc = c.select(F.col("pid").alias("parent"), F.col("card").alias("p_card"))
    return e.join(cc, "child").join(pc, "parent").select(
        "child", "parent", F.round(W.upward_cost(F.col("p_card"), F.col("c_card"), p), 6).alias("upward_cost"))


@register("hasse_edges", _wcte(_cand_sql(),
                               f"e AS (SELECT c.pid AS child, p.pid AS parent FROM cand c, cand p WHERE c.pid <> p.pid AND {_subsume_sql('c', 'p')})") + """
SELECT child, parent FROM e WHERE NOT EXISTS (SELECT 1 FROM e a JOIN e b ON a.parent = b.child WHERE a.child = e.child AND b.parent = e.parent)
UNION ALL SELECT pid AS child, 'root' AS parent FROM cand WHERE pid NOT IN (SELECT child FROM e)""")
def hasse_edges(spark, sf):
    _, _, _, c = _cands(spark, sf)
    return W.hasse(W.lattice(c))


# ------------------------------------------------------------------ I13, I5, I12: subset lists

@register("oracle_subsets", _wcte(_cand_sql()) + f"""
SELECT c.pid, c.card, CAST((c.card * ({_mprime('c.card')} + 50)) // 82 AS BIGINT) AS size FROM cand c, n""")
def oracle_subsets(spark, sf):
    _, _, p, c = _cands(spark, sf)
    return W.with_models(c, p).select("pid", "card", "size")


def _named_cands(suffix: str, where: str) -> str:
    """The candidate CTEs of a part of the log under their own names."""
    sql = _cand_sql(where)
    for t in ("wl", "tal", "tcard", "cand"):
        sql = sql.replace(f"{t} AS (", f"{t}{suffix} AS (").replace(f"FROM {t} ", f"FROM {t}{suffix} ").replace(f"JOIN {t} ", f"JOIN {t}{suffix} ")
    return sql


@register("subset_plan", _wcte(
    _named_cands("_new", "WHERE seq >= (SELECT count(*) FROM workload) // 2"),
    _named_cands("_old", "WHERE seq < (SELECT count(*) FROM workload) // 2")) + """
SELECT coalesce(n.pid, o.pid) AS pid, CASE WHEN o.pid IS NULL THEN 'create' WHEN n.pid IS NULL THEN 'drop' ELSE 'keep' END AS action
FROM cand_new n FULL OUTER JOIN cand_old o ON o.pid = n.pid""")
def subset_plan(spark, sf):
    """Refit after a workload change: create / keep / drop, old = first half of the log, new = second half."""
    q, bt, p = _setup(spark, sf)
    wl = fx.workload(spark, sf)
    half = wl.count() // 2
    new = W.candidates(bt, wl.where(F.col("seq") >= half), p).select("pid")
    old = W.candidates(bt, wl.where(F.col("seq") < half), p).select("pid")
    return routing.subset_plan(old, new)


@register("subset_append", _wcte(_cand_sql(), names=("queries", "base", "tag_arr", "workload")) + """
SELECT c.pid, t.id FROM cand c, tag_arr t WHERE t.id % 25 = 0 AND list_has_all(t.tags, c.ftags)""")
def subset_append(spark, sf):
    """New rows (the held-out query vectors, inserted) appended to every matching subset."""
    q, bt, p, c = _cands(spark, sf)
    delta = fx.with_tag_array(fx.vectors(spark, sf).where(fx.is_query(F.col("id"))))
    return routing.subset_append(c.select("pid", "ftags", "is_and"), delta)


# ------------------------------------------------------------------ I7, I8, E16, I10: routing and routed execution

_ROUTE_SQL = [
    _cand_sql(),
    "qf AS (SELECT qid, list_sort(list_distinct(ftags)) AS ftags, true AS is_and, 'and|' || array_to_string(list_sort(list_distinct(ftags)), ',') AS qkey FROM filters_tag)",
    f"opts AS (SELECT q.qid, c.pid, c.card, CASE WHEN c.pid = q.qkey THEN 0 ELSE 1 END AS ex FROM qf q, cand c WHERE {_subsume_sql('q', 'c')})",
    "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY ex, card, pid) AS r FROM opts) WHERE r = 1)",
    "rt AS (SELECT q.qid, q.qkey, coalesce(b.pid, 'root') AS route, coalesce(b.card, n.n) AS route_card, "
    "CASE WHEN b.pid IS NULL THEN 'root' WHEN b.ex = 0 THEN 'exact' ELSE 'superset' END AS kind FROM qf q CROSS JOIN n LEFT JOIN best b ON b.qid = q.qid)",
    "qc AS (SELECT q.qid, count(bt.id) AS card FROM qf q LEFT JOIN bt ON len(q.ftags) = 0 OR list_has_all(bt.tags, q.ftags) GROUP BY q.qid)",
]
_INDEX = f"CASE WHEN rt.route <> 'root' THEN {_upward('rt.route_card', 'qc.card')} ELSE {_root('qc.card')} END"
_BRUTE = f"(qc.card <= {CUTOFF} OR {_bf('qc.card')} <= {_INDEX})"
_STRAT = f"CASE WHEN {_BRUTE} THEN 'brute' WHEN rt.route <> 'root' THEN 'subset' ELSE 'root' END"
_COST = f"CASE WHEN {_BRUTE} THEN {_bf('qc.card')} ELSE {_INDEX} END"
_ROUTE_CTE = _wcte(*_ROUTE_SQL, names=("queries", "base", "tag_arr", "workload", "filters_tag"))


def _routed(spark, sf):
    """Query filters routed over the workload candidates; the tag bitmap index is built once and shared."""
    q, bt, p = _setup(spark, sf)
    bms = cut_lineage(P.tag_bitmaps(P.postings(bt)))
    c = W.candidates(bt, fx.workload(spark, sf), p, bitmaps=bms)
    qf = fx.filters_tag(q, True)
    rt = W.route(qf, c.select("pid", "ftags", "is_and", "card"), p.n)
    card = P.filter_cardinality(bt, qf.select("ftags", "is_and"), bitmaps=bms, total=p.n)
    qcard = qf.join(card, ["ftags", "is_and"]).select("qid", "card")
    return q, bt, p, c, qf, rt, qcard


@register("route_query", _ROUTE_CTE + "SELECT qid, qkey, route, route_card, kind FROM rt")
def route_query(spark, sf):
    return _routed(spark, sf)[5]


@register("route_strategy", _ROUTE_CTE + f"SELECT rt.qid, qc.card, rt.route, {_STRAT} AS strategy, round({_COST}, 6) AS cost "
          "FROM rt JOIN qc ON qc.qid = rt.qid, n")
def route_strategy(spark, sf):
    q, bt, p, c, qf, rt, qcard = _routed(spark, sf)
    return W.strategy(rt, qcard, p).withColumn("cost", F.round("cost", 6))


@register("route_tally", _ROUTE_CTE + f"""
, st AS (SELECT rt.qid, qc.card, {_STRAT} AS strategy, {_COST} AS cost FROM rt JOIN qc ON qc.qid = rt.qid, n)
SELECT strategy, count(*) AS searches, round(avg(CAST(card AS DOUBLE) / n.n), 6) AS avg_selectivity, round(sum(cost), 6) AS est_cost
FROM st, n GROUP BY strategy, n.n""")
def route_tally(spark, sf):
    q, bt, p, c, qf, rt, qcard = _routed(spark, sf)
    st = W.strategy(rt, qcard, p)
    return st.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("searches"),
        F.round(F.avg(F.col("card") / F.lit(float(p.n))), 6).alias("avg_selectivity"),
        F.round(F.sum("cost"), 6).alias("est_cost"))


@register("knn_routed", cte("queries", "base", "tag_arr", "filters_tag") + topk_sql(
    f"SELECT q.qid, b.id, {l2('q.qv', 'b.v')} AS dist FROM queries q JOIN filters_tag f ON f.qid = q.qid, "
    "base b JOIN tag_arr t ON t.id = b.id WHERE len(f.ftags) = 0 OR list_has_all(t.tags, f.ftags)"))
def knn_routed(spark, sf):
    """Budgeted choice, stored subsets, routing and search: brute (candidate join), subset (its stored rows only), root."""
    q, bt, p = _setup(spark, sf)
    bms = cut_lineage(P.tag_bitmaps(P.postings(bt)))
    c = W.candidates(bt, fx.workload(spark, sf), p, bitmaps=bms)
    chosen = c.join(W.select(c, p).select("pid"), "pid", "left_semi").checkpoint()
    store = SubsetStore(spark)
    store.refit(bt, chosen)
    qf = fx.filters_tag(q, True)
    rt = W.route(qf, chosen.select("pid", "ftags", "is_and", "card"), p.n)
    card = P.filter_cardinality(bt, qf.select("ftags", "is_and"), bitmaps=bms, total=p.n)
    qcard = qf.join(card, ["ftags", "is_and"]).select("qid", "card")
    st = W.strategy(rt, qcard, p).checkpoint()          # one row per query
    return _fin(routing.knn_routed(bt, qf, st, store, TOPK))
