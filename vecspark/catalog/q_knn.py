"""Catalog: dense k-NN, filtered k-NN, range / epsilon, multi-vector, graph, fusion, SQ8 re-rank."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vecspark.catalog.oracle_fixtures import DIST, cte, l2
from vecspark.catalog.registry import ORACLE, register
from vecspark.functions import distance as D
from vecspark.operators import knn as K
from vecspark.operators import nearest as N
from vecspark.sources import fixtures as fx
from vecspark.streaming import replay

# Fixed query parameters (FIXTURES.md suggested constants).
TOPK = 10
TRUTH_K = 100
RADIUS = 1.5            # squared L2 on the unit-norm embeddings
EPS = 1.5
EPS_MIN, EPS_MAX = 5, 40
POST_M = 3
N_SHARDS = 4
NUM_DOCS = 10
FUSION_M = 4            # attribute codes of tags 0..3
FUSION_W = 0.5
SQ8_R = 30
CUTOFF = 30             # brute-force cutoff B


def topk_sql(pairs: str, k: int = TOPK, extra: str = "") -> str:
    """Rank ``(qid, id, dist)`` pairs closest first (ties by id) and keep k."""
    return (f"SELECT qid, rk, id, round(dist, 6) AS dist{extra} FROM (SELECT *, CAST(row_number() OVER "
            f"(PARTITION BY qid ORDER BY dist, id) AS INTEGER) AS rk FROM ({pairs})) WHERE rk <= {k}")


def _scaled(spark, sf):
    q, b = fx.split(fx.vectors_scaled(spark, sf))
    return q, b


def _fin(df):
    return K.round_dist(df).select("qid", "rk", "id", "dist")


# ------------------------------------------------------------------ plain k-NN

def _knn_metric(metric):
    def q(spark: SparkSession, sf: str):
        queries, base = _scaled(spark, sf)
        return _fin(K.knn(base, queries, TOPK, metric))
    return q


for _m in ("l2", "ip", "cosine"):
    register(f"knn_{_m}", cte("squeries", "sbase") + topk_sql(
        f"SELECT q.qid, b.id, {DIST[_m]('q.qv', 'b.v')} AS dist FROM squeries q, sbase b"))(_knn_metric(_m))


@register("knn_l2_u8", cte("vectors") + ", u8 AS (SELECT id, list_transform(v, lambda x: CAST(floor((x + 1.0) * 127.5) AS INTEGER)) AS v FROM vectors)\n"
          + "SELECT qid, rk, id, CAST(dist AS BIGINT) AS dist FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS INTEGER) AS rk FROM ("
          + "SELECT q.id AS qid, b.id, list_sum(list_transform(list_zip(q.v, b.v), lambda z: CAST((z[1] - z[2]) * (z[1] - z[2]) AS BIGINT))) AS dist "
          + "FROM u8 q, u8 b WHERE q.id % 25 = 0 AND b.id % 25 <> 0)) WHERE rk <= 10")
def knn_l2_u8(spark, sf):
    queries, base = fx.split(fx.vectors_u8(spark, sf))
    return K.knn(base, queries, TOPK, "l2").withColumn("dist", F.col("dist").cast("long"))


@register("knn_sharded", cte("squeries", "sbase") + topk_sql(
    f"SELECT q.qid, b.id, {l2('q.qv', 'b.v')} AS dist FROM squeries q, sbase b"))
def knn_sharded(spark, sf):
    queries, base = _scaled(spark, sf)
    return _fin(K.knn_sharded(base, queries, TOPK, N_SHARDS))


# ------------------------------------------------------------------ filtered k-NN

def _tag_setup(spark, sf, is_and=True, single=False):
    queries, base = fx.split(fx.vectors(spark, sf))
    qf = fx.filters_single(queries) if single else fx.filters_tag(queries, is_and)
    return fx.with_tag_array(base), qf


_TAGGED_PAIRS = ("SELECT q.qid, b.id, {d} AS dist FROM queries q JOIN filters_tag f ON f.qid = q.qid, "
                 "base b JOIN tag_arr t ON t.id = b.id WHERE {cond}")


@register("knn_filtered_and", cte("queries", "base", "tag_arr", "filters_tag") + topk_sql(
    _TAGGED_PAIRS.format(d=l2("q.qv", "b.v"), cond="len(f.ftags) = 0 OR list_has_all(t.tags, f.ftags)")))
def knn_filtered_and(spark, sf):
    bt, qf = _tag_setup(spark, sf, True)
    return _fin(K.knn_filtered(bt, qf, TOPK, "l2", strategy="auto", cutoff=CUTOFF))


@register("knn_filtered_or", cte("queries", "base", "tag_arr", "filters_tag") + topk_sql(
    _TAGGED_PAIRS.format(d=l2("q.qv", "b.v"), cond="len(f.ftags) = 0 OR list_has_any(t.tags, f.ftags)")))
def knn_filtered_or(spark, sf):
    bt, qf = _tag_setup(spark, sf, False)
    return _fin(K.knn_filtered(bt, qf, TOPK, "l2", strategy="auto", cutoff=CUTOFF))


@register("knn_filtered_single", cte("queries", "base", "tag_arr") + topk_sql(
    f"SELECT q.qid, b.id, {l2('q.qv', 'b.v')} AS dist FROM queries q, base b JOIN tag_arr t ON t.id = b.id "
    "WHERE list_contains(t.tags, CAST((q.qid // 25) % 5 AS INTEGER))"))
def knn_filtered_single(spark, sf):
    bt, qf = _tag_setup(spark, sf, single=True)
    return _fin(K.knn_filtered(bt, qf, TOPK, "l2", strategy="auto", cutoff=CUTOFF))


_RANGE_PAIRS = ("SELECT q.qid, b.id, {d} AS dist FROM queries q JOIN filters_range f ON f.qid = q.qid, "
                "base b JOIN attrs a ON a.id = b.id WHERE (a.a0 >= f.lo0 AND a.a0 < f.hi0) {op} "
                "(a.a1 >= f.lo1 AND a.a1 < f.hi1)")


def _range_q(is_and):
    def q(spark, sf):
        queries, base = fx.split(fx.vectors(spark, sf))
        return _fin(K.knn_filtered_range(fx.with_attrs(base), fx.filters_range(queries, is_and), TOPK))
    return q


register("knn_filtered_range", cte("queries", "base", "attrs", "filters_range") + topk_sql(
    _RANGE_PAIRS.format(d=l2("q.qv", "b.v"), op="AND")))(_range_q(True))
register("knn_filtered_range_or", cte("queries", "base", "attrs", "filters_range") + topk_sql(
    _RANGE_PAIRS.format(d=l2("q.qv", "b.v"), op="OR")))(_range_q(False))


@register("knn_postfilter", cte("queries", "base", "tag_arr", "filters_tag") + topk_sql(
    "SELECT o.qid, o.id, o.dist FROM (" + topk_sql(
        f"SELECT q.qid, b.id, {l2('q.qv', 'b.v')} AS dist FROM queries q, base b", TOPK * POST_M).replace(
        "round(dist, 6) AS dist", "dist") + ") o JOIN filters_tag f ON f.qid = o.qid JOIN tag_arr t ON t.id = o.id "
    "WHERE len(f.ftags) = 0 OR list_has_all(t.tags, f.ftags)"))
def knn_postfilter(spark, sf):
    bt, qf = _tag_setup(spark, sf, True)
    return _fin(K.knn_postfilter(bt, qf, TOPK, POST_M))


@register("knn_grouped_by_filter", cte("queries", "base", "tag_arr", "filters_tag") + topk_sql(
    _TAGGED_PAIRS.format(d=l2("q.qv", "b.v"), cond="len(f.ftags) = 0 OR list_has_all(t.tags, f.ftags)")))
def knn_grouped_by_filter(spark, sf):
    bt, qf = _tag_setup(spark, sf, True)
    return _fin(K.knn_grouped_by_filter(bt, qf, TOPK))


# ------------------------------------------------------------------ range / epsilon

@register("range_search", cte("queries", "base") + f"SELECT qid, id, round(dist, 6) AS dist FROM ("
          f"SELECT q.qid, b.id, {l2('q.qv', 'b.v')} AS dist FROM queries q, base b) WHERE dist < {RADIUS}")
def range_search(spark, sf):
    queries, base = fx.split(fx.vectors(spark, sf))
    return K.round_dist(K.range_search(base, queries, RADIUS))


@register("epsilon_search", cte("queries", "base") + f"SELECT qid, rk, id, round(dist, 6) AS dist FROM ("
          "SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS INTEGER) AS rk FROM ("
          f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS r0 FROM ("
          f"SELECT q.qid, b.id, {l2('q.qv', 'b.v')} AS dist FROM queries q, base b)) "
          f"WHERE dist <= {EPS} OR r0 <= {EPS_MIN})) WHERE rk <= {EPS_MAX}")
def epsilon_search(spark, sf):
    queries, base = fx.split(fx.vectors(spark, sf))
    return _fin(K.epsilon_search(base, queries, EPS, EPS_MIN, EPS_MAX))


@register("range_from_knn", cte("queries", "base") + "SELECT * FROM (" + topk_sql(
    f"SELECT q.qid, b.id, {l2('q.qv', 'b.v')} AS dist FROM queries q, base b", TRUTH_K)
    + f") WHERE dist < {RADIUS}")
def range_from_knn(spark, sf):
    queries, base = fx.split(fx.vectors(spark, sf))
    return _fin(K.range_from_knn(base, queries, RADIUS, TRUTH_K))


# ------------------------------------------------------------------ multi-vector documents

@register("multivector_docs", cte("queries", "base") + f"""
, d AS (SELECT q.qid, b.id, b.doc_id, {l2('q.qv', 'b.v')} AS dist FROM queries q, base b),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS pos FROM d),
f AS (SELECT qid, doc_id, min(pos) AS first_pos FROM r GROUP BY qid, doc_id),
c AS (SELECT qid, first_pos AS cut FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY first_pos) AS drk FROM f) WHERE drk = {NUM_DOCS + 1})
SELECT r.qid, CAST(r.pos AS INTEGER) AS rk, r.id, r.doc_id, round(r.dist, 6) AS dist
FROM r LEFT JOIN c ON c.qid = r.qid WHERE c.cut IS NULL OR r.pos < c.cut""")
def multivector_docs(spark, sf):
    queries, base = fx.split(fx.vectors(spark, sf))
    return K.round_dist(K.multivector_docs(base, queries, NUM_DOCS))


@register("epsilon_by_rule", ORACLE["epsilon_search"])
def epsilon_by_rule(spark, sf):
    """The epsilon search as a plugged-in stop rule of the nearest-first search."""
    queries, base = fx.split(fx.vectors(spark, sf))
    return _fin(N.nearest_first(base, queries, N.EpsilonRule(EPS, EPS_MIN, EPS_MAX), first=16))


@register("docs_by_rule", ORACLE["multivector_docs"])
def docs_by_rule(spark, sf):
    """Nearest vectors until enough documents are seen, as a plugged-in stop rule."""
    queries, base = fx.split(fx.vectors(spark, sf))
    return K.round_dist(N.nearest_first(base, queries, N.DocsRule(NUM_DOCS), first=16))


# ------------------------------------------------------------------ k-NN graph, fusion

@register("knn_graph", cte("vectors") + "SELECT qid AS src, rk, id AS dst, dist FROM (" + topk_sql(
    f"SELECT a.id AS qid, b.id, {l2('a.v', 'b.v')} AS dist FROM vectors a, vectors b WHERE a.id <> b.id") + ")")
def knn_graph(spark, sf):
    g = K.knn_graph(fx.vectors(spark, sf), TOPK)
    return g.withColumn("dist", F.round("dist", 6))


def _codes_sql(alias: str) -> str:
    return (f"list_transform(range(0, {FUSION_M}), lambda j: CASE WHEN list_contains({alias}.tags, CAST(j AS INTEGER)) "
            "THEN 2 * j + 1 ELSE 2 * j END)")


def _fusion_sql(expr: str) -> str:
    return cte("queries", "base", "tag_arr") + topk_sql(
        f"SELECT q.qid, b.id, {expr} AS dist FROM (SELECT q.*, {_codes_sql('tq')} AS qa FROM queries q "
        f"JOIN tag_arr tq ON tq.id = q.qid) q, (SELECT b.*, {_codes_sql('tb')} AS ba FROM base b "
        "JOIN tag_arr tb ON tb.id = b.id) b")


_CNT = "list_sum(list_transform(list_zip(q.qa, b.ba), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END))"


def _fusion_q(kind, param):
    def q(spark, sf):
        vec = fx.with_tag_array(fx.vectors(spark, sf)).withColumn("attr", D.tag_codes("tags", FUSION_M))
        queries = vec.where(fx.is_query(F.col("id"))).select(
            F.col("id").alias("qid"), F.col("v").alias("qv"), F.col("attr").alias("qattr"))
        base = vec.where(~fx.is_query(F.col("id")))
        return _fin(K.fusion_knn(base, queries, TOPK, kind, param))
    return q


register("fusion_knn_mul", _fusion_sql(f"{l2('q.qv', 'b.v')} * (1.0 + {_CNT} / {float(FUSION_M)})"))(
    _fusion_q("mul", FUSION_M))
register("fusion_knn_add", _fusion_sql(f"{l2('q.qv', 'b.v')} + {_CNT} * {FUSION_W}"))(
    _fusion_q("add", FUSION_W))


# ------------------------------------------------------------------ SQ8 candidates + exact re-rank

@register("knn_sq8_rerank", cte("queries", "base") + f"""
, mm AS (SELECT min(x) AS lo, max(x) AS hi FROM (SELECT unnest(v) AS x FROM base)),
codes AS (SELECT b.id, list_transform(b.v, lambda x: CAST(least(greatest(round(255.0 * (x - mm.lo) / (mm.hi - mm.lo)), 0.0), 255.0) AS INTEGER)) AS c FROM base b, mm),
qcodes AS (SELECT q.qid, list_transform(q.qv, lambda x: CAST(least(greatest(round(255.0 * (x - mm.lo) / (mm.hi - mm.lo)), 0.0), 255.0) AS INTEGER)) AS c FROM queries q, mm),
cand AS (SELECT qid, id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS r FROM (
  SELECT qc.qid, bc.id, list_sum(list_transform(list_zip(qc.c, bc.c), lambda z: CAST((z[1] - z[2]) * (z[1] - z[2]) AS DOUBLE))) AS dist FROM qcodes qc, codes bc)) WHERE r <= {SQ8_R})
""" + topk_sql(f"SELECT c.qid, c.id, {l2('q.qv', 'b.v')} AS dist FROM cand c JOIN queries q ON q.qid = c.qid JOIN base b ON b.id = c.id"))
def knn_sq8_rerank(spark, sf):
    queries, base = fx.split(fx.vectors(spark, sf))
    mm = base.select(F.explode("v").alias("x")).agg(F.min("x").cast("double").alias("lo"),
                                                    F.max("x").cast("double").alias("hi")).first()
    lo, hi = F.lit(mm["lo"]), F.lit(mm["hi"])
    bc = base.select("id", D.sq8_encode("v", lo, hi).alias("c"))
    qc = queries.select("qid", D.sq8_encode("qv", lo, hi).alias("c"))
    cand = K.rank_topk(K.blockscan.scan(bc, qc, k=SQ8_R, vec="c", qvec="c"), SQ8_R).select("qid", "id")
    return _fin(K.knn_prefilter(base, queries, cand, TOPK, "l2"))


# ------------------------------------------------------------------ live-set search, id fetch, anti-join

_TOMB_SQL = ("tomb AS (SELECT id FROM (SELECT id, op, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS r "
             "FROM op_log WHERE op IN ('insert', 'delete')) WHERE r = 1 AND op = 'delete')")


@register("knn_live", cte("queries", "base", "op_log", extra=_TOMB_SQL) + topk_sql(
    f"SELECT q.qid, b.id, {l2('q.qv', 'b.v')} AS dist FROM queries q, base b WHERE b.id NOT IN (SELECT id FROM tomb)"))
def knn_live(spark, sf):
    queries, base = fx.split(fx.vectors(spark, sf))
    tomb = replay.tombstones(fx.op_log(spark, sf))
    return _fin(K.knn(base.join(tomb, "id", "left_anti"), queries, TOPK))


@register("get_items", cte("vectors", "op_log", extra=_TOMB_SQL) + """
SELECT r.id, CASE WHEN v.id IS NULL THEN 'missing' WHEN t.id IS NOT NULL THEN 'deleted' ELSE 'ok' END AS status,
       CAST(len(v.v) AS INTEGER) AS dim
FROM (SELECT DISTINCT id FROM op_log) r LEFT JOIN vectors v ON v.id = r.id LEFT JOIN tomb t ON t.id = r.id""")
def get_items(spark, sf):
    vec = fx.vectors(spark, sf)
    log = fx.op_log(spark, sf)
    return replay.get_items(vec, log.select("id").distinct(), replay.tombstones(log))


@register("base_without_queries", cte("vectors") +
          "SELECT id, label FROM vectors WHERE id NOT IN (SELECT id FROM vectors WHERE id % 25 = 0)")
def base_without_queries(spark, sf):
    vec = fx.vectors(spark, sf)
    queries = vec.where(fx.is_query(F.col("id"))).select("id")
    return vec.join(queries, "id", "left_anti").select("id", "label")


# ------------------------------------------------------------------ I9 covering, L5 halves, B12/B13 transforms

@register("knn_covering", cte("queries", "base", "tag_arr", "filters_tag") + topk_sql(
    _TAGGED_PAIRS.format(d=l2("q.qv", "b.v"), cond="len(f.ftags) = 0 OR list_has_any(t.tags, f.ftags)")))
def knn_covering(spark, sf):
    """OR filters answered by searching several materialised subsets that together cover them."""
    from vecspark.plans import routing, workload as W
    from vecspark.plans.store import SubsetStore
    queries, base = fx.split(fx.vectors(spark, sf))
    bt = fx.with_tag_array(base)
    qf = fx.filters_tag(queries, False)
    p = W.Params(n=bt.count(), cutoff=CUTOFF)
    cands = W.candidates(bt, fx.workload(spark, sf), p).select("pid", "ftags", "is_and", "card").checkpoint()
    store = SubsetStore(spark)
    store.refit(bt, cands)
    return _fin(routing.knn_covering(bt, qf, cands, store, p, TOPK))


_HALF_SQL = ("nb AS (SELECT max(id) + 1 AS nb FROM vectors),\n"
             "hb AS (SELECT b.*, CASE WHEN b.id < nb.nb // 2 THEN [1, 2] ELSE [3, 4] END AS tags FROM base b, nb),\n"
             "hq AS (SELECT q.*, CASE WHEN q.qid < nb.nb // 2 THEN [3, 4] ELSE [1, 2] END AS ftags FROM queries q, nb)")


@register("halves_filtered_knn", cte("queries", "base", extra=_HALF_SQL) + topk_sql(
    f"SELECT q.qid, b.id, {l2('q.qv', 'b.v')} AS dist FROM hq q, hb b WHERE list_has_all(b.tags, q.ftags)"))
def halves_filtered_knn(spark, sf):
    """Half/half tags: each query must find its neighbours in the other half of the ids."""
    from vecspark.sources import generators as G
    vec = fx.vectors(spark, sf)
    nb = vec.agg(F.max("id")).first()[0] + 1
    queries, base = fx.split(vec)
    return _fin(K.knn_filtered(G.halves(base, nb), G.halves_queries(queries, nb), TOPK, "l2", cutoff=CUTOFF))


@register("random_rotation", cte("vectors") +
          "SELECT id, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS norm2 FROM vectors")
def random_rotation(spark, sf):
    """Seeded orthogonal rotation; reported through the (preserved) squared norms."""
    from vecspark.operators import transforms as T
    vec = fx.vectors(spark, sf).select("id", "v")
    d = len(vec.first()["v"])
    rot = T.random_rotation(vec, d)
    return rot.select("id", F.round(D.sq_norm("v"), 6).alias("norm2"))


@register("pca_project")
def pca_project(spark, sf):
    """Top-16 principal components of the vectors (Spark ML; no SQL twin)."""
    from vecspark.operators import transforms as T
    return T.pca_project(fx.vectors(spark, sf), 16)


@register("pairwise_transform_knn_ip", cte("queries", "base") + topk_sql(
    f"SELECT q.qid, b.id, {DIST['ip']('q.qv', 'b.v')} AS dist FROM queries q, base b"))
def pairwise_transform_knn_ip(spark, sf):
    """Inner-product k-NN after the x·L / q·L⁻ᵀ transform (Gram Cholesky): same answer as on raw vectors."""
    from vecspark.operators import transforms as T
    queries, base = fx.split(fx.vectors(spark, sf))
    d = len(base.first()["v"])
    tb, tq = T.ip_preserving_pair(base.select("id", "v"), queries.select("qid", "qv"), d)
    out = K.knn(tb, tq, TOPK, "ip")
    # re-score the chosen ids on the raw vectors (exact value), order unchanged
    raw = out.join(base.select("id", "v"), "id").join(queries.select("qid", "qv"), "qid") \
             .select("qid", "rk", "id", D.ip_dist("qv", "v").alias("dist"))
    return _fin(raw)
