"""Catalog: budgeted choice, stored subsets, refit and covering (I4, I5, I8-I12, E16), with recursive SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecspark.catalog.oracle_fixtures import cte, l2
from vecspark.catalog.q_knn import TOPK, _fin, topk_sql
from vecspark.catalog.q_workload import (
    CUTOFF, M, WINDOW_N, _BT, _N, _bf, _cand_sql, _mprime, _root, _setup, _subsume_sql, _upward)
from vecspark.catalog.registry import register
from vecspark.operators import predicates as P
from vecspark.plans import cover, routing, workload as W
from vecspark.plans.store import SubsetStore
from vecspark.sources import fixtures as fx

#: the budget of ``W.total_budget`` with the catalog's parameters: twice the size of an index over all rows
_BUDGET = f"(2 * (n.n * ({M} + 50) // 82))"


def _rcte(*parts: str, names=("queries", "base", "tag_arr", "workload")) -> str:
    return cte(*names, extra=",\n".join([_BT, _N, *parts])).replace("WITH ", "WITH RECURSIVE ", 1)


def _named(sql: str, suffix: str) -> str:
    """A block of CTEs under its own names."""
    for t in ("wl", "tal", "tcard", "cand"):
        sql = sql.replace(f"{t} AS (", f"{t}{suffix} AS (").replace(f"FROM {t} ", f"FROM {t}{suffix} ").replace(f"JOIN {t} ", f"JOIN {t}{suffix} ")
    return sql


def _select_sql(suffix: str = "", where: str = "") -> list[str]:
    """Greedy budgeted choice as a recursive CTE ``sel`` over the candidates of a part of the log.

    One row a round: the best costs of all candidates as a list, the chosen ones, the budget used.
    """
    s = suffix
    return [
        _named(_cand_sql(where), s),
        f"ix{s} AS (SELECT c.pid, c.ftags, c.is_and, c.card, c.cnt, CAST((c.card * ({_mprime('c.card')} + 50)) // 82 AS BIGINT) AS size, "
        f"least({_bf('c.card')}, {_root('c.card')}) AS best, row_number() OVER (ORDER BY c.pid) AS i FROM cand{s} c, n)",
        f"par{s} AS (SELECT p.i, p.pid, p.size, list(struct_pack(c := c.i, up := {_upward('p.card', 'c.card')}, cnt := c.cnt) ORDER BY c.i) AS kids "
        f"FROM ix{s} c, ix{s} p, n WHERE {_subsume_sql('c', 'p')} GROUP BY p.i, p.pid, p.size)",
        f"sel{s}(round, pid, benefit, size, used, best, chosen) AS ("
        f"SELECT 0, CAST('' AS VARCHAR), CAST(0 AS DOUBLE), CAST(0 AS BIGINT), CAST(0 AS BIGINT), (SELECT list(best ORDER BY i) FROM ix{s}), CAST([] AS BIGINT[]) "
        f"UNION ALL SELECT round, pid, benefit, size, used, list_transform(best, lambda b, x: least(b, coalesce(list_min(list_transform("
        f"list_filter(kids, lambda k: k.c = x), lambda k: k.up)), b))), list_append(chosen, i) FROM ("
        f"SELECT *, row_number() OVER (ORDER BY round(benefit, {W.TIE_DIGITS}) DESC, pid) AS rn FROM ("
        f"SELECT s.round + 1 AS round, p.i, p.pid, p.size, CAST(s.used + p.size AS BIGINT) AS used, s.best, s.chosen, p.kids, CASE WHEN p.size > 0 THEN "
        f"list_sum(list_transform(p.kids, lambda k: greatest(s.best[k.c] - k.up, 0.0) * k.cnt)) / p.size ELSE 0.0 END AS benefit "
        f"FROM sel{s} s JOIN par{s} p ON NOT list_contains(s.chosen, p.i), n WHERE s.used < {_BUDGET})) WHERE rn = 1)"]


_LAST = f"WHERE seq > (SELECT max(seq) FROM workload) - {WINDOW_N}"
_FIRST = (f"WHERE seq < (SELECT count(*) FROM workload) // 2 AND seq > (SELECT max(seq) FROM workload WHERE seq < "
          f"(SELECT count(*) FROM workload) // 2) - {WINDOW_N}")


# ------------------------------------------------------------------ I4, I11: choice and refit

@register("select_subsets", _rcte(*_select_sql()) + "SELECT round, pid, round(benefit, 6) AS benefit, size, used FROM sel WHERE round > 0")
def select_subsets(spark, sf):
    """Budgeted greedy choice among the workload's predicates."""
    _, bt, p = _setup(spark, sf)
    return W.select(W.candidates(bt, fx.workload(spark, sf), p), p).withColumn("benefit", F.round("benefit", 6))


def _windows(spark, sf):
    """Candidates of the last entries of the whole log and of its first half."""
    _, bt, p = _setup(spark, sf)
    wl = fx.workload(spark, sf)
    half = wl.count() // 2
    old = W.candidates(bt, W.workload_window(wl.where(F.col("seq") < half), WINDOW_N), p)
    new = W.candidates(bt, W.workload_window(wl, WINDOW_N), p)
    return bt, p, old, new


def _chosen(cands, p):
    return cands.join(W.select(cands, p).select("pid"), "pid", "left_semi").select("pid", "ftags", "is_and", "card")


_DIFF = ("SELECT coalesce(n.pid, o.pid) AS pid, CASE WHEN o.pid IS NULL THEN 'create' WHEN n.pid IS NULL THEN 'drop' ELSE 'keep' END AS action "
         "FROM (SELECT pid FROM sel_new WHERE round > 0) n FULL OUTER JOIN (SELECT pid FROM sel_old WHERE round > 0) o ON o.pid = n.pid")


@register("refit_plan", _rcte(*_select_sql("_new", _LAST), *_select_sql("_old", _FIRST)) + _DIFF)
def refit_plan(spark, sf):
    """Choices on the old (first half) and new (whole) log windows, and the create/keep/drop diff."""
    bt, p, old, new = _windows(spark, sf)
    return routing.subset_plan(W.select(old, p).select("pid"), W.select(new, p).select("pid"))


@register("subset_store", _rcte(*_select_sql("_new", _LAST), *_select_sql("_old", _FIRST), f"diff AS ({_DIFF})") + """
SELECT d.pid, d.action, count(t.id) FILTER (WHERE t.id % 25 <> 0) AS base_rows, count(t.id) AS rows
FROM diff d JOIN (SELECT pid, ftags FROM cand_new UNION SELECT pid, ftags FROM cand_old) c ON c.pid = d.pid
LEFT JOIN tag_arr t ON d.action <> 'drop' AND list_has_all(t.tags, c.ftags) GROUP BY d.pid, d.action""")
def subset_store(spark, sf):
    """The store after a fit on the old window, a refit on the new one and the insertion of the held-out vectors.

    Per subset: what the refit did, the rows it held then, and the rows that are read back in the end.
    """
    bt, p, old, new = _windows(spark, sf)
    store = SubsetStore(spark)
    store.refit(bt, _chosen(old, p))
    plan = store.refit(bt, _chosen(new, p))
    fitted = store.version()
    store.append(fx.with_tag_array(fx.vectors(spark, sf).where(fx.is_query(F.col("id")))))
    before = store.subsets(fitted).select("pid", F.col("card").alias("base_rows"))
    after = store.rows().groupBy("pid").agg(F.count(F.lit(1)).alias("rows"))
    return (plan.join(before, "pid", "left").join(after, "pid", "left")
            .select("pid", "action", F.coalesce("base_rows", F.lit(0)).alias("base_rows"), F.coalesce("rows", F.lit(0)).alias("rows")))


# ------------------------------------------------------------------ I9, I8: covers

def _cover_sql(is_and: bool, nodes: str) -> list[str]:
    """Greedy cover as a recursive CTE ``cov``: per distinct filter the rows left as a list, one row a round."""
    flag, match = ("and", "list_has_all(bt.tags, q.ftags)") if is_and else ("or", "list_has_any(bt.tags, q.ftags)")
    logical = f"(q.is_and = c.is_and AND {'list_has_all(q.ftags, c.ftags)' if is_and else 'list_has_all(c.ftags, q.ftags)'})"
    return [
        f"qf AS (SELECT DISTINCT list_sort(list_distinct(ftags)) AS ftags, {str(is_and).lower()} AS is_and, "
        f"'{flag}|' || array_to_string(list_sort(list_distinct(ftags)), ',') AS qkey FROM filters_tag WHERE len(ftags) > 0)",
        f"qrows AS (SELECT q.qkey, list(bt.id) AS ids FROM qf q JOIN bt ON {match} GROUP BY q.qkey)",
        f"nodes AS (SELECT c.pid, c.ftags, c.is_and, c.card, list(bt.id) AS ids FROM {nodes} c JOIN bt ON list_has_all(bt.tags, c.ftags) GROUP BY ALL)",
        "shared AS (SELECT q.qkey, c.pid, c.ids, c.card, len(list_intersect(r.ids, c.ids)) AS n_both FROM qf q JOIN qrows r ON r.qkey = q.qkey, nodes c "
        f"WHERE NOT {logical})",
        f"priced AS (SELECT s.*, {_upward('s.card', 's.n_both')} AS cost FROM shared s, n WHERE n_both > 0)",
        "cov(qkey, round, pid, cost, todo, used) AS (SELECT qkey, 0, CAST('' AS VARCHAR), CAST(0 AS DOUBLE), ids, CAST([] AS VARCHAR[]) FROM qrows "
        "UNION ALL SELECT qkey, round, pid, cost, list_filter(todo, lambda x: NOT list_contains(ids, x)), list_append(used, pid) FROM ("
        f"SELECT *, row_number() OVER (PARTITION BY qkey ORDER BY round(cost / hit, {cover.RATIO_DIGITS}), pid) AS rn FROM ("
        "SELECT v.qkey, v.round + 1 AS round, p.pid, p.cost, v.todo, v.used, p.ids, len(list_intersect(v.todo, p.ids)) AS hit FROM cov v JOIN priced p "
        "ON p.qkey = v.qkey AND NOT list_contains(v.used, p.pid) WHERE len(v.todo) > 0) WHERE hit > 0) WHERE rn = 1)",
        "done AS (SELECT qkey, bool_or(len(todo) = 0) AS covered, sum(cost) AS cost FROM cov GROUP BY qkey)"]


_PLAN = "SELECT v.qkey, v.round, v.pid, round(v.cost, 6) AS cost, d.covered FROM cov v JOIN done d ON d.qkey = v.qkey WHERE v.round > 0"
_QNAMES = ("queries", "base", "tag_arr", "workload", "filters_tag")


def _fitted(spark, sf):
    """(queries, base, parameters, bitmaps of the tags, all candidates)."""
    q, bt, p = _setup(spark, sf)
    return q, bt, p, W.candidates(bt, fx.workload(spark, sf), p)


def _plan(spark, sf, is_and: bool):
    q, bt, p, c = _fitted(spark, sf)
    return cover.cover_plan(fx.filters_tag(q, is_and), c, bt, p).withColumn("cost", F.round("cost", 6))


@register("cover_plan_and", _rcte(_cand_sql(), *_cover_sql(True, "cand"), names=_QNAMES) + _PLAN)
def cover_plan_and(spark, sf):
    """Greedy cover of the AND filters by the workload's predicates."""
    return _plan(spark, sf, True)


@register("cover_plan_or", _rcte(_cand_sql(), *_cover_sql(False, "cand"), names=_QNAMES) + _PLAN)
def cover_plan_or(spark, sf):
    """Greedy cover of the OR filters by the workload's predicates."""
    return _plan(spark, sf, False)


def _strategy_sql(is_and: bool) -> list[str]:
    flag, match = ("and", "list_has_all(bt.tags, q.ftags)") if is_and else ("or", "list_has_any(bt.tags, q.ftags)")
    index = f"CASE WHEN b.pid IS NULL THEN {_root('qc.card')} ELSE {_upward('coalesce(b.card, n.n)', 'qc.card')} END"
    return [
        f"qa AS (SELECT qid, list_sort(list_distinct(ftags)) AS ftags, {str(is_and).lower()} AS is_and, "
        f"'{flag}|' || array_to_string(list_sort(list_distinct(ftags)), ',') AS qkey FROM filters_tag)",
        f"qc AS (SELECT q.qid, count(bt.id) AS card FROM qa q LEFT JOIN bt ON len(q.ftags) = 0 OR {match} GROUP BY q.qid)",
        f"opts AS (SELECT q.qid, c.pid, c.card, CASE WHEN c.pid = q.qkey THEN 0 ELSE 1 END AS ex FROM qa q, chosen c WHERE {_subsume_sql('q', 'c')})",
        "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY ex, card, pid) AS r FROM opts) WHERE r = 1)",
        f"costs AS (SELECT q.qid, q.qkey, qc.card, coalesce(b.pid, 'root') AS route, {_bf('qc.card')} AS brute, {index} AS idx, "
        "CASE WHEN d.covered THEN d.cost ELSE CAST('inf' AS DOUBLE) END AS cov FROM qa q JOIN qc ON qc.qid = q.qid CROSS JOIN n "
        "LEFT JOIN best b ON b.qid = q.qid LEFT JOIN done d ON d.qkey = q.qkey)",
        f"st AS (SELECT *, CASE WHEN card <= {CUTOFF} OR (brute <= coalesce(cov, CAST('inf' AS DOUBLE)) AND brute <= idx) THEN 'brute' "
        "WHEN coalesce(cov, CAST('inf' AS DOUBLE)) <= brute AND coalesce(cov, CAST('inf' AS DOUBLE)) <= idx THEN 'cover' "
        "WHEN route <> 'root' THEN 'subset' ELSE 'root' END AS strategy FROM costs)"]


_CHOSEN = "chosen AS (SELECT c.pid, c.ftags, c.is_and, c.card FROM cand c JOIN sel s ON s.pid = c.pid)"
_ST_COST = "round(CASE strategy WHEN 'brute' THEN brute WHEN 'cover' THEN cov ELSE idx END, 6) AS cost"


def _strategies(spark, sf, is_and: bool):
    """Strategies of the query filters over the budgeted choice, covers included."""
    q, bt, p, c = _fitted(spark, sf)
    chosen = _chosen(c, p).checkpoint()
    qf = fx.filters_tag(q, is_and)
    plan = cover.cover_plan(qf, chosen, bt, p).checkpoint()
    card = P.filter_cardinality(bt, qf.select("ftags", "is_and"), total=p.n)
    qcard = qf.join(card, ["ftags", "is_and"]).select("qid", "card")
    st = cover.strategy_with_cover(W.route(qf, chosen, p.n), qcard, plan, p)
    return q, bt, qf, chosen, plan, st


def _cover_strategy(is_and: bool):
    def run(spark, sf):
        return _strategies(spark, sf, is_and)[5].select("qid", "card", "route", "strategy", F.round("cost", 6).alias("cost"))
    return run


for _flag, _name in ((True, "and"), (False, "or")):
    register(f"cover_strategy_{_name}", _rcte(*_select_sql(), _CHOSEN, *_cover_sql(_flag, "chosen"), *_strategy_sql(_flag), names=_QNAMES)
             + f"SELECT qid, card, route, strategy, {_ST_COST} FROM st")(_cover_strategy(_flag))


@register("cover_tally", _rcte(*_select_sql(), _CHOSEN, *_cover_sql(False, "chosen"), *_strategy_sql(False), names=_QNAMES)
          + "SELECT strategy, count(*) AS searches, count(DISTINCT qkey) AS filters, min(card) AS least_rows, max(card) AS most_rows FROM st GROUP BY strategy")
def cover_tally(spark, sf):
    """Searches of each strategy among the OR filters, where covers are allowed."""
    st = _strategies(spark, sf, False)[5]
    return st.groupBy("strategy").agg(F.count(F.lit(1)).alias("searches"), F.countDistinct("qkey").alias("filters"),
                                      F.min("card").alias("least_rows"), F.max("card").alias("most_rows"))


def _knn_budgeted(is_and: bool):
    def run(spark, sf):
        q, bt, qf, chosen, plan, st = _strategies(spark, sf, is_and)
        st = st.checkpoint()
        store = SubsetStore(spark)
        store.refit(bt, chosen)
        routes = routing.single_routes(st).unionByName(cover.cover_routes(st, plan))
        return _fin(routing.search(bt, qf, st, routes, store, TOPK))
    run.__doc__ = "Filtered k-NN by budgeted choice, stored subsets, covers and routes; the answer is the exact one."
    return run


for _flag, _name, _cond in ((True, "and", "list_has_all"), (False, "or", "list_has_any")):
    register(f"knn_budgeted_{_name}", cte("queries", "base", "tag_arr", "filters_tag") + topk_sql(
        f"SELECT q.qid, b.id, {l2('q.qv', 'b.v')} AS dist FROM queries q JOIN filters_tag f ON f.qid = q.qid, base b JOIN tag_arr t ON t.id = b.id "
        f"WHERE len(f.ftags) = 0 OR {_cond}(t.tags, f.ftags)"))(_knn_budgeted(_flag))


@register("knn_covering_and", cte("queries", "base", "tag_arr", "filters_tag") + topk_sql(
    f"SELECT q.qid, b.id, {l2('q.qv', 'b.v')} AS dist FROM queries q JOIN filters_tag f ON f.qid = q.qid, base b JOIN tag_arr t ON t.id = b.id "
    "WHERE len(f.ftags) = 0 OR list_has_all(t.tags, f.ftags)"))
def knn_covering_and(spark, sf):
    """AND filters answered by the subsets of their greedy covers."""
    q, bt, p, c = _fitted(spark, sf)
    store = SubsetStore(spark)
    store.refit(bt, c)
    return _fin(routing.knn_covering(bt, fx.filters_tag(q, True), c.select("pid", "ftags", "is_and", "card"), store, p, TOPK))
