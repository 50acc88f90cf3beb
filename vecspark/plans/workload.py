"""Workload-driven choice of which predicate subsets to materialise, and per-query routing.

Inputs: the base rows with tag arrays, and a historical workload log of filters
``(seq, ftags, is_and)``.  Outputs are plain tables:

* ``candidates``  — distinct workload predicates with count and exact cardinality
  (cardinality < cutoff are left out, they are always brute-forced);
* ``size_model`` / ``cost_model`` — index size and search cost estimates per candidate;
* ``lattice``      — subsumption edges among candidates (self edges included);
* ``select``       — budgeted greedy choice by marginal benefit per unit of size;
* ``hasse``        — transitive reduction of the lattice plus root links;
* ``route``        — exact subset, else smallest containing subset, else root;
* ``strategy``     — brute force / subset / root by cost.

Everything but the greedy rounds is one declarative plan; the greedy is a loop
of small Spark aggregates whose only driver traffic is the round's winner.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecspark.operators import predicates as P
from vecspark.operators.ranking import global_prefix_sum, global_row_number, ordered_positions
from vecspark.session import cut_lineage


@dataclass(frozen=True)
class Params:
    """Index / cost parameters (always passed by name)."""

    n: int                    # base rows (root cardinality)
    cutoff: int = 30          # brute-force cutoff B
    M: int = 16
    k: int = 10
    ef: int = 50
    gamma: float = 0.5        # query correlation constant
    s: float = 3.0            # ef scaling constant
    budget_factor: float = 2.0  # vector budget = factor * n
    heterogeneous: bool = True


# ------------------------------------------------------------------ workload tables

def workload_window(workload: DataFrame, last_n: int) -> DataFrame:
    """The most recent ``last_n`` entries by ``seq`` (bounded windows, no single-partition sort)."""
    neg = workload.withColumn("_neg", -F.col("seq"))
    return (global_row_number(neg.withColumn("_k", F.lit(0)), ["_k"], "_neg", "_pos")
            .where(F.col("_pos") <= last_n).drop("_k", "_neg", "_pos"))


def tally(workload: DataFrame) -> DataFrame:
    """``(pid, ftags, is_and, cnt)`` — identical filters counted once (normalised key)."""
    w = workload.select(F.array_sort(F.array_distinct("ftags")).alias("ftags"), "is_and")
    return w.groupBy("ftags", "is_and").agg(F.count(F.lit(1)).alias("cnt")) \
            .withColumn("pid", P.filter_key(F.col("ftags"), F.col("is_and")))


def candidates(base_tagged: DataFrame, workload: DataFrame, p: Params, bitmaps: DataFrame | None = None) -> DataFrame:
    """Tally + exact cardinality; predicates with ``card < cutoff`` are skipped.

    ``bitmaps`` (``predicates.tag_bitmaps``) can be passed when the caller reuses the tag index.
    """
    t = tally(workload)
    card = P.filter_cardinality(base_tagged, t.select("ftags", "is_and"), bitmaps=bitmaps, total=p.n)
    c = t.join(card, ["ftags", "is_and"]).where(F.col("card") >= p.cutoff)
    # one row per distinct predicate: written once, reused by lattice, selection and routing
    return cut_lineage(c)


def in_order(cands: DataFrame) -> DataFrame:
    """The candidates with ``ord``, their position by (card, pid): numbered within equal cardinalities on running counts."""
    return ordered_positions(cands, ["card", "pid"], F.col("card"), "ord").withColumn("ord", F.col("ord").cast("int"))


def selectivity_profile(base_tagged: DataFrame, workload: DataFrame) -> DataFrame:
    """Weighted mean cardinality and min/p20/p40/p60/p80/max picked by index in the sorted list.

    Picks are made on the per-template table with cumulative counts, so the
    workload entries themselves are never sorted.
    """
    t = tally(workload)
    card = P.filter_cardinality(base_tagged, t.select("ftags", "is_and"))
    per = t.join(card, ["ftags", "is_and"]).groupBy("card").agg(F.sum("cnt").alias("cnt"))
    cum = cut_lineage(global_prefix_sum(per, "card", "cnt", "lo").withColumn("hi", F.col("lo") + F.col("cnt")))
    cum = cum.crossJoin(cum.agg(F.max("hi").alias("total")))       # one row

    def pick(frac):
        idx = F.floor(F.col("total") * frac) if frac < 1 else F.col("total") - 1
        return F.min(F.when((F.col("lo") <= idx) & (idx < F.col("hi")), F.col("card")))
    return cum.agg(
        (F.sum(F.col("card") * F.col("cnt")) / F.sum("cnt")).alias("avg_card"),
        pick(0.0).alias("min_card"), pick(0.2).alias("p20"), pick(0.4).alias("p40"),
        pick(0.6).alias("p60"), pick(0.8).alias("p80"), pick(1.0).alias("max_card"))


# ------------------------------------------------------------------ size and cost models

def downscaled_m(card: Column, p: Params) -> Column:
    if not p.heterogeneous:
        return F.lit(p.M)
    r = F.log10(card) / F.lit(math.log10(p.n)) * p.M / 4.0
    return F.greatest(F.lit(4), (F.round(r) * 4).cast("long"))


def scaled_size(card: Column, p: Params) -> Column:
    """Index size in vector units: ``floor(card · (M' + 50) / 82)``."""
    return ((card * (downscaled_m(card, p) + 50)) / 82).cast("long")


def downscaled_ef(card: Column, p: Params) -> Column:
    return F.greatest(F.lit(p.k), (F.log10(card) / F.lit(math.log10(p.n)) * p.ef).cast("long"))


def bf_cost(card: Column, p: Params) -> Column:
    return card * F.lit(math.log(p.cutoff) / p.cutoff)


def upward_cost(parent_card: Column, query_card: Column, p: Params) -> Column:
    """Search a subset of ``parent_card`` rows for a query matching ``query_card``: ``ln P · ⌊P/c⌋^γ · ef'``."""
    ef = downscaled_ef(parent_card, p).cast("double") if p.heterogeneous else F.lit(float(p.ef))
    ratio = (F.lit(float(p.k)) + (ef - p.k) / p.s) / p.k
    return F.log(parent_card) * F.pow(F.floor(parent_card / query_card), p.gamma) * ratio


def root_cost(card: Column, p: Params) -> Column:
    ratio = (p.k + (p.ef - p.k) / p.s) / p.k
    return F.lit(math.log(p.n)) * F.pow(F.floor(F.lit(p.n) / card), p.gamma) * F.lit(ratio)


def with_models(cands: DataFrame, p: Params) -> DataFrame:
    c = F.col("card")
    return cands.select(
        "*", downscaled_m(c, p).alias("m_prime"), scaled_size(c, p).alias("size"),
        downscaled_ef(c, p).alias("ef_prime"), bf_cost(c, p).alias("bf_cost"), root_cost(c, p).alias("root_cost"))


def total_budget(p: Params) -> int:
    """``floor(budget / N · size(N))`` in vector units."""
    mp = max(4, int(round(math.log10(p.n) / math.log10(p.n) * p.M / 4.0)) * 4) if p.heterogeneous else p.M
    size_n = p.n * (mp + 50) // 82
    return int(p.budget_factor * p.n / p.n * size_n)


# ------------------------------------------------------------------ lattice and Hasse diagram

def lattice(cands: DataFrame) -> DataFrame:
    """``(child, parent)`` subsumption edges among candidates, self edges included."""
    return P.subsumption_edges(cands.select("pid", "ftags", "is_and"), key="pid")


def hasse(edges: DataFrame, root: str = "root") -> DataFrame:
    """Transitive reduction of the proper edges, plus ``(node, root)`` for nodes without a parent."""
    e = edges.where(F.col("child") != F.col("parent"))
    two = (e.alias("a").join(e.alias("b"), F.col("a.parent") == F.col("b.child"))
            .select(F.col("a.child").alias("child"), F.col("b.parent").alias("parent")).distinct())
    red = e.join(two, ["child", "parent"], "left_anti")
    nodes = edges.select(F.col("child").alias("node")).distinct()
    orphans = nodes.join(e.select(F.col("child").alias("node")).distinct(), "node", "left_anti")
    return red.unionByName(orphans.select(F.col("node").alias("child"), F.lit(root).alias("parent")))


# ------------------------------------------------------------------ greedy budgeted selection

TIE_DIGITS = 9     # benefits equal to so many digits are ties (the smaller pid wins)


def select(cands: DataFrame, p: Params, max_rounds: int | None = None) -> DataFrame:
    """Greedy selection by marginal benefit / size until the vector budget is used.

    benefit(node) = Σ over children c (queries the node can serve, itself included)
    of ``max(0, best_cost(c) − upward(node, c)) · count(c)``, divided by size(node).

    Choosing a node changes only the benefits of nodes that share a child with it, and benefits never grow.  So every node
    that beats all nodes it shares a child with (ties: smaller pid) is what the one-by-one greedy would choose at
    that benefit, and one pass chooses all of them; the choices in falling benefit are the greedy's order.  Passes end when
    the choices above the best open benefit use the budget.  The chosen rows are what comes back to the driver, one job a
    pass.  Returns ``(round, pid, benefit, size, used)``.
    """
    spark = cands.sparkSession
    m = with_models(cands, p)
    parents = m.select(F.col("pid").alias("parent"), F.col("card").alias("p_card"), "size")
    children = m.select(F.col("pid").alias("child"), F.col("card").alias("c_card"), "cnt", F.least("bf_cost", "root_cost").alias("best"))
    edges = (lattice(cands).join(parents, "parent").join(children, "child")
             .select("child", "parent", upward_cost(F.col("p_card"), F.col("c_card"), p).alias("up"), "cnt", "size", "best",
                     F.lit(False).alias("chosen"), F.lit(0.0).alias("benefit")))
    by_parent, by_child = Window.partitionBy("parent"), Window.partitionBy("child")
    budget, edges = total_budget(p), cut_lineage(edges)
    picked: list[tuple] = []                   # (-rounded benefit, pid, benefit, size)
    while True:
        gain = F.sum(F.greatest(F.col("best") - F.col("up"), F.lit(0.0)) * F.col("cnt")).over(by_parent)
        scored = edges.withColumn("benefit", F.when(F.col("chosen"), F.col("benefit")).when(F.col("size") > 0, gain / F.col("size")).otherwise(0.0))
        place = F.when(~F.col("chosen"), F.struct((-F.round("benefit", TIE_DIGITS)).alias("nb"), "parent"))
        topped = scored.withColumn("top", F.min(place).over(by_child)["parent"])
        won = topped.withColumn("now", F.min(~F.col("chosen") & (F.col("top") == F.col("parent"))).over(by_parent))
        now = F.coalesce("now", F.lit(False))
        # one table a pass, a row an edge: each pass starts from a short plan
        edges = cut_lineage(won.select("child", "parent", "up", "cnt", "size",
                                       F.least("best", F.min(F.when(now, F.col("up"))).over(by_child)).alias("best"),
                                       (F.col("chosen") | now).alias("chosen"), "benefit", now.alias("now")))
        rows = edges.where("now and child = parent").select((-F.round("benefit", TIE_DIGITS)).alias("nb"), "parent", "benefit", "size").collect()
        edges = edges.drop("now")
        if not rows:
            break
        best_open = min((r["nb"], r["parent"]) for r in rows)
        if sum(x[3] for x in picked if x[:2] < best_open) >= budget:
            break
        picked += [(r["nb"], r["parent"], float(r["benefit"]), int(r["size"])) for r in rows]
    out, used = [], 0
    for _, pid, benefit, size in sorted(picked):
        if used >= budget or (max_rounds is not None and len(out) >= max_rounds):
            break
        used += size
        out.append((len(out) + 1, pid, benefit, size, used))
    return spark.createDataFrame(out, "round int, pid string, benefit double, size long, used long")


# ------------------------------------------------------------------ routing

def route(filters: DataFrame, subsets: DataFrame, root_card: int) -> DataFrame:
    """Per query: the exact subset, else the smallest containing subset (card, pid), else the root.

    ``filters(qid, ftags, is_and)``, ``subsets(pid, ftags, is_and, card)``.
    Containment candidates come from the tag-sharing equi-join of the
    subsumption edges (no all-pairs theta join).
    """
    f = filters.select("qid", F.array_sort(F.array_distinct("ftags")).alias("ftags"), "is_and") \
               .withColumn("qkey", P.filter_key(F.col("ftags"), F.col("is_and")))
    qn = f.select(F.col("qkey").alias("pid"), "ftags", "is_and").distinct()
    sn = subsets.select("pid", "ftags", "is_and")
    both = cut_lineage(qn.unionByName(sn).distinct())     # distinct predicates of queries and subsets: small
    edges = P.subsumption_edges(both, key="pid")
    sc = subsets.select(F.col("pid").alias("parent"), "card")
    cand = edges.join(sc, "parent").withColumnRenamed("child", "qkey")
    w = Window.partitionBy("qkey").orderBy(F.when(F.col("qkey") == F.col("parent"), 0).otherwise(1), "card", "parent")
    pick = cand.withColumn("r", F.row_number().over(w)).where("r = 1") \
               .select("qkey", F.col("parent").alias("route"), F.col("card").alias("route_card"),
                       F.when(F.col("qkey") == F.col("parent"), "exact").otherwise("superset").alias("kind"))
    out = f.join(pick, "qkey", "left")
    return out.select("qid", "qkey",
                      F.coalesce("route", F.lit("root")).alias("route"),
                      F.coalesce("route_card", F.lit(root_card).cast("long")).alias("route_card"),
                      F.coalesce("kind", F.lit("root")).alias("kind"))


def strategy(routed: DataFrame, qcard: DataFrame, p: Params) -> DataFrame:
    """Brute force when ``card <= cutoff`` or its cost is at most that of the routed index; else that index."""
    x = routed.join(qcard, "qid")
    c = F.col("card").cast("double")
    index = F.when(F.col("route") != "root", upward_cost(F.col("route_card").cast("double"), c, p)).otherwise(root_cost(c, p))
    brute = (F.col("card") <= p.cutoff) | (bf_cost(c, p) <= index)
    strat = F.when(brute, "brute").when(F.col("route") != "root", "subset").otherwise("root")
    cost = F.when(brute, bf_cost(c, p)).otherwise(index)
    return x.select("qid", "card", "route", strat.alias("strategy"), cost.alias("cost"))
