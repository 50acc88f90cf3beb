"""Catalog: search quality.

truth = exact top-100 over uint8 codes (integer distances, so distance ties occur);
run   = top-10 over 4-bit codes (``code // 16``), a deterministic approximate search; top-100 for 1-recall@R.
Range: truth = exact ``dist < r`` pairs; run = pairs whose SQ8-decoded distance is ``< r``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vecspark.catalog.oracle_fixtures import cte, l2
from vecspark.catalog.q_knn import _TAGGED_PAIRS, POST_M, RADIUS, TOPK, topk_sql
from vecspark.catalog.registry import register
from vecspark.functions import distance as D
from vecspark.operators import blockscan
from vecspark.operators import knn as K
from vecspark.operators import predicates as P
from vecspark.operators import quality as Q
from vecspark.sources import fixtures as fx

TRUTH_K = 100
ONE_RECALL_R = [1, 10, 100]
STDERR_N = [10, 100, 1000]
DIFF_EPS = 1.0


# ------------------------------------------------------------------ shared truth / run tables

def _codes(spark, sf):
    u8 = fx.vectors_u8(spark, sf)
    c4 = u8.select("id", F.transform("v", lambda x: (x / 16).cast("int")).alias("v"), "label")
    return u8, c4


def _truth_run(spark, sf, run_k=TOPK):
    u8, c4 = _codes(spark, sf)
    qu, bu = fx.split(u8)
    qc, bc = fx.split(c4)
    truth = K.knn(bu, qu, TRUTH_K)
    run = K.knn(bc, qc, run_k)
    return truth, run


def _int_l2(a, b):
    return f"CAST(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS DOUBLE)"


def _tr(run_k=TOPK):
    return ("u8 AS (SELECT id, list_transform(v, lambda x: CAST(floor((x + 1.0) * 127.5) AS INTEGER)) AS v FROM vectors),\n"
            "c4 AS (SELECT id, list_transform(v, lambda x: x // 16) AS v FROM u8),\n"
            "truth AS (SELECT qid, CAST(rk AS INTEGER) AS rk, id, dist FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rk FROM ("
            f"SELECT q.id AS qid, b.id, {_int_l2('q.v', 'b.v')} AS dist FROM u8 q, u8 b WHERE q.id % 25 = 0 AND b.id % 25 <> 0)) WHERE rk <= {TRUTH_K}),\n"
            "run AS (SELECT qid, CAST(rk AS INTEGER) AS rk, id, dist FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rk FROM ("
            f"SELECT q.id AS qid, b.id, {_int_l2('q.v', 'b.v')} AS dist FROM c4 q, c4 b WHERE q.id % 25 = 0 AND b.id % 25 <> 0)) WHERE rk <= {run_k})")


def _qcte(*extra, run_k=TOPK):
    return cte("vectors", extra=",\n".join([_tr(run_k), *extra]))


def _r6(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


# ------------------------------------------------------------------ E3, E4, E5, E6

@register("recall_at_k", _qcte(
    f"per AS (SELECT q.qid, (SELECT count(*) FROM run r JOIN truth t ON t.qid = r.qid AND t.id = r.id WHERE r.qid = q.qid AND t.rk <= {TOPK}) AS hits "
    "FROM (SELECT DISTINCT qid FROM truth) q)") +
    f"SELECT round(avg(hits) / {TOPK}, 6) AS mean, round(stddev_pop(hits) / {TOPK}, 6) AS std, CAST(0 AS BIGINT) AS queries_with_ties FROM per")
def recall_at_k(spark, sf):
    truth, run = _truth_run(spark, sf)
    return _r6(Q.recall(truth, run, TOPK, ties=False), "mean", "std")


@register("recall_with_ties", _qcte(
    "tt AS (SELECT t.*, max(CASE WHEN rk = 10 THEN dist END) OVER (PARTITION BY qid) AS dk FROM truth t)",
    "brk AS (SELECT qid, min(CASE WHEN rk > 10 AND abs(dk - dist) >= 1e-6 THEN rk END) AS b, max(rk) AS sz FROM tt GROUP BY qid)",
    "endq AS (SELECT qid, CASE WHEN sz <= 10 THEN 10 ELSE coalesce(b - 1, sz) END AS e FROM brk)",
    "per AS (SELECT e.qid, e.e > 10 AS tie, (SELECT count(*) FROM run r JOIN truth t ON t.qid = r.qid AND t.id = r.id "
    "WHERE r.qid = e.qid AND t.rk <= e.e) AS hits FROM endq e)") +
    f"SELECT round(avg(hits) / {TOPK}, 6) AS mean, round(stddev_pop(hits) / {TOPK}, 6) AS std, "
    "CAST(count(*) FILTER (WHERE tie) AS BIGINT) AS queries_with_ties FROM per")
def recall_with_ties(spark, sf):
    truth, run = _truth_run(spark, sf)
    return _r6(Q.recall(truth, run, TOPK, ties=True), "mean", "std")


@register("one_recall_at_r", _qcte(run_k=max(ONE_RECALL_R)) +
          "SELECT CAST(rr.r AS INTEGER) AS r, round(avg(CASE WHEN x.rk <= rr.r THEN 1.0 ELSE 0.0 END), 6) AS recall "
          "FROM (VALUES (1), (10), (100)) rr(r), (SELECT t.qid, ru.rk FROM truth t LEFT JOIN run ru ON ru.qid = t.qid "
          "AND ru.id = t.id WHERE t.rk = 1) x GROUP BY rr.r")
def one_recall_at_r(spark, sf):
    truth, run = _truth_run(spark, sf, run_k=max(ONE_RECALL_R))
    return _r6(Q.one_recall_at(truth, run, ONE_RECALL_R), "recall")


@register("inter_at_k", _qcte() +
          f"SELECT CAST({TOPK} AS INTEGER) AS k, round(CAST(count(*) AS DOUBLE) / ((SELECT count(DISTINCT qid) FROM truth) * {TOPK}), 6) AS inter "
          f"FROM truth t JOIN run r ON r.qid = t.qid AND r.id = t.id WHERE t.rk <= {TOPK} AND r.rk <= {TOPK}")
def inter_at_k(spark, sf):
    truth, run = _truth_run(spark, sf)
    return _r6(Q.intersection_at(truth, run, TOPK), "inter")


# ------------------------------------------------------------------ E7, E8: range precision / recall / AP

_RANGE = ("mm AS (SELECT min(x) AS lo, max(x) AS hi FROM (SELECT unnest(v) AS x FROM base)),\n"
          "codes AS (SELECT b.id, list_transform(b.v, lambda x: CAST(least(greatest(round(255.0 * (x - mm.lo) / (mm.hi - mm.lo)), 0.0), 255.0) AS INTEGER)) AS c FROM base b, mm),\n"
          "qcodes AS (SELECT q.qid, list_transform(q.qv, lambda x: CAST(least(greatest(round(255.0 * (x - mm.lo) / (mm.hi - mm.lo)), 0.0), 255.0) AS INTEGER)) AS c FROM queries q, mm),\n"
          f"gt AS (SELECT q.qid, b.id FROM queries q, base b WHERE {l2('q.qv', 'b.v')} < {RADIUS}),\n"
          f"res AS (SELECT * FROM (SELECT qc.qid, bc.id, {_int_l2('qc.c', 'bc.c')} * (((mm.hi - mm.lo) / 255.0) * ((mm.hi - mm.lo) / 255.0)) AS dist "
          f"FROM qcodes qc, codes bc, mm) WHERE dist < {RADIUS}),\n"
          "cnt AS (SELECT q.qid, (SELECT count(*) FROM gt WHERE gt.qid = q.qid) AS ngt, (SELECT count(*) FROM res WHERE res.qid = q.qid) AS nres, "
          "(SELECT count(*) FROM res JOIN gt ON gt.qid = res.qid AND gt.id = res.id WHERE res.qid = q.qid) AS ninter FROM queries q)")


def _range_tables(spark, sf):
    queries, base = fx.split(fx.vectors(spark, sf))
    gt = K.range_search(base, queries, RADIUS).select("qid", "id")
    mm = base.select(F.explode("v").alias("x")).agg(F.min("x").cast("double").alias("lo"),
                                                    F.max("x").cast("double").alias("hi")).first()
    lo, hi = mm["lo"], mm["hi"]
    scale = ((hi - lo) / 255.0) * ((hi - lo) / 255.0)
    bc = base.select("id", D.sq8_encode("v", F.lit(lo), F.lit(hi)).alias("c"))
    qc = queries.select("qid", D.sq8_encode("qv", F.lit(lo), F.lit(hi)).alias("c"))
    # code distance < r / scale  ⇔  decoded distance < r (checked exactly after the scan)
    res = blockscan.scan(bc, qc, vec="c", qvec="c", mode="radius", radius=RADIUS / scale * (1 + 1e-9), inclusive=True)
    res = res.withColumn("dist", F.col("dist") * F.lit(scale)).where(F.col("dist") < RADIUS)
    return queries.select("qid"), gt, res


@register("range_pr_overall", cte("queries", "base", extra=_RANGE) +
          "SELECT round(CASE WHEN sum(nres) > 0 THEN sum(ninter) / sum(nres) ELSE 1.0 END, 6) AS precision, "
          "round(CASE WHEN sum(ngt) > 0 THEN sum(ninter) / sum(ngt) WHEN sum(nres) = 0 THEN 1.0 ELSE 0.0 END, 6) AS recall FROM cnt")
def range_pr_overall(spark, sf):
    qs, gt, res = _range_tables(spark, sf)
    return _r6(Q.range_pr_overall(gt, res, qs), "precision", "recall")


@register("range_pr_average", cte("queries", "base", extra=_RANGE) +
          "SELECT round(avg(CASE WHEN nres = 0 THEN 1.0 ELSE ninter / nres END), 6) AS precision, "
          "round(avg(CASE WHEN ngt = 0 THEN (CASE WHEN nres = 0 THEN 1.0 ELSE 0.0 END) ELSE ninter / ngt END), 6) AS recall FROM cnt")
def range_pr_average(spark, sf):
    qs, gt, res = _range_tables(spark, sf)
    return _r6(Q.range_pr_average(gt, res, qs), "precision", "recall")


@register("range_ap", cte("queries", "base", extra=_RANGE + """,
dm AS (SELECT max(dist) AS dmax FROM res),
th AS (SELECT i, CASE WHEN i = 99 THEN dmax ELSE CAST(i AS DOUBLE) * ((dmax - (-0.001)) / 99) + (-0.001) END AS t FROM range(100) r(i), dm),
tc AS (SELECT th.i, count(r.id) AS nres, count(g.id) AS ninter FROM th LEFT JOIN res r ON r.dist < th.t
       LEFT JOIN gt g ON g.qid = r.qid AND g.id = r.id GROUP BY th.i),
pr AS (SELECT i, CASE WHEN nres > 0 THEN ninter / nres ELSE 1.0 END AS p, ninter / (SELECT count(*) FROM gt) AS r FROM tc)""") +
          "SELECT round(coalesce(sum((r - r0) * (p + p0) / 2), 0.0), 6) AS ap FROM "
          "(SELECT *, lag(p) OVER (ORDER BY i) AS p0, lag(r) OVER (ORDER BY i) AS r0 FROM pr)")
def range_ap(spark, sf):
    _, gt, res = _range_tables(spark, sf)
    return _r6(Q.range_ap(gt, res), "ap")


# ------------------------------------------------------------------ E11, E21: per-query recall reports

def _filtered_per_query(spark, sf):
    queries, base = fx.split(fx.vectors(spark, sf))
    bt = fx.with_tag_array(base)
    qf = fx.filters_tag(queries, True)
    truth = K.knn_filtered(bt, qf, TOPK, "l2")
    run = K.knn_postfilter(bt, qf, TOPK, POST_M)
    hits = Q.per_query_hits(truth, run, TOPK)
    card = P.filter_cardinality(bt, qf.select("ftags", "is_and"))
    per = qf.join(card, ["ftags", "is_and"]).select("qid", "card") \
            .join(hits, "qid", "left").fillna({"hits": 0})
    return per.withColumn("recall", F.col("hits") / TOPK)


_FPQ = ("ftruth AS (" + topk_sql(_TAGGED_PAIRS.format(d=l2("q.qv", "b.v"), cond="len(f.ftags) = 0 OR list_has_all(t.tags, f.ftags)")) + "),\n"
        "frun AS (" + topk_sql(
            "SELECT o.qid, o.id, o.dist FROM (" + topk_sql(f"SELECT q.qid, b.id, {l2('q.qv', 'b.v')} AS dist FROM queries q, base b",
                                                          TOPK * POST_M).replace("round(dist, 6) AS dist", "dist")
            + ") o JOIN filters_tag f ON f.qid = o.qid JOIN tag_arr t ON t.id = o.id WHERE len(f.ftags) = 0 OR list_has_all(t.tags, f.ftags)") + "),\n"
        "fcard AS (SELECT f.qid, (SELECT count(*) FROM base b JOIN tag_arr t ON t.id = b.id WHERE len(f.ftags) = 0 OR list_has_all(t.tags, f.ftags)) AS card FROM filters_tag f),\n"
        f"fper AS (SELECT c.qid, c.card, (SELECT count(*) FROM frun r JOIN ftruth t ON t.qid = r.qid AND t.id = r.id WHERE r.qid = c.qid) / {float(TOPK)} AS recall FROM fcard c)")


@register("recall_by_selectivity", cte("queries", "base", "tag_arr", "filters_tag", extra=_FPQ) + """
SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, round(avg(card), 6) AS avg_card, round(avg(recall), 6) AS mean_recall
FROM (SELECT *, (row_number() OVER (ORDER BY card, qid) - 1) // ((SELECT count(*) FROM fper) // 5) AS bin FROM fper) WHERE bin < 5 GROUP BY bin""")
def recall_by_selectivity(spark, sf):
    """Post-filter search recall against exact filtered truth, by cardinality quintile."""
    return _r6(Q.recall_by_selectivity(_filtered_per_query(spark, sf)), "avg_card", "mean_recall")


@register("recall_stderr", cte("queries", "base", "tag_arr", "filters_tag", extra=_FPQ) +
          "SELECT CAST(n.n AS INTEGER) AS n, round(sqrt(var_pop(recall) / n.n), 6) AS stderr FROM fper, (VALUES (10), (100), (1000)) n(n) GROUP BY n.n")
def recall_stderr(spark, sf):
    return _r6(Q.recall_stderr(_filtered_per_query(spark, sf), STDERR_N), "stderr")


# ------------------------------------------------------------------ H2, H3, H4: truth checks

@register("truth_diff", _qcte(
    f"rs AS (SELECT r.qid, r.id, {_int_l2('q.v', 'b.v')} AS dist FROM run r JOIN u8 q ON q.id = r.qid JOIN u8 b ON b.id = r.id)",
    f"a AS (SELECT qid, id, floor(dist / {DIFF_EPS}) AS bin FROM truth WHERE rk <= {TOPK})",
    f"b AS (SELECT qid, id, floor(dist / {DIFF_EPS}) AS bin FROM rs)") + """
SELECT coalesce(a.qid, b.qid) AS qid, CAST(count(*) FILTER (WHERE b.id IS NULL) AS BIGINT) AS only_a,
       CAST(count(*) FILTER (WHERE a.id IS NULL) AS BIGINT) AS only_b
FROM a FULL OUTER JOIN b ON a.qid = b.qid AND a.bin = b.bin AND a.id = b.id GROUP BY coalesce(a.qid, b.qid)""")
def truth_diff(spark, sf):
    """Exact top-10 vs the 4-bit run re-scored exactly, compared within distance bins (tie-insensitive)."""
    truth, run = _truth_run(spark, sf)
    u8 = fx.vectors_u8(spark, sf)
    rs = (run.select("qid", "id").join(u8.select(F.col("id").alias("qid"), F.col("v").alias("qv")), "qid")
             .join(u8.select("id", "v"), "id")
             .select("qid", "id", D.l2_sq_int("qv", "v").cast("double").alias("dist")))
    return Q.truth_diff(truth.where(F.col("rk") <= TOPK), rs, DIFF_EPS)


@register("truth_subset_check", _qcte(
    "nb AS (SELECT (max(id) + 1) // 2 AS nb FROM vectors)",
    "crop AS (SELECT qid, rk, id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rk FROM ("
    f"SELECT q.id AS qid, b.id, {_int_l2('q.v', 'b.v')} AS dist FROM u8 q, u8 b, nb WHERE q.id % 25 = 0 AND b.id % 25 <> 0 AND b.id < nb.nb)) WHERE rk <= {TRUTH_K})",
    "restr AS (SELECT t.qid, t.id, row_number() OVER (PARTITION BY t.qid ORDER BY t.rk) AS pos FROM truth t, nb WHERE t.id < nb.nb)") + """
SELECT r.qid, count(*) AS m, CAST(count(*) FILTER (WHERE c.id IS NULL OR c.id <> r.id) AS BIGINT) AS mismatches
FROM restr r LEFT JOIN crop c ON c.qid = r.qid AND c.rk = r.pos GROUP BY r.qid""")
def truth_subset_check(spark, sf):
    """Full truth restricted to ``id < nb`` must be a prefix of the cropped set's truth."""
    u8 = fx.vectors_u8(spark, sf)
    qu, bu = fx.split(u8)
    nb = (fx.vectors(spark, sf).agg(F.max("id")).first()[0] + 1) // 2
    truth = K.knn(bu, qu, TRUTH_K)
    crop = K.knn(bu.where(F.col("id") < nb), qu, TRUTH_K)
    from pyspark.sql import Window
    restr = truth.where(F.col("id") < nb).withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("rk")))
    j = restr.join(crop.select("qid", F.col("rk").alias("pos"), F.col("id").alias("cid")), ["qid", "pos"], "left")
    return j.groupBy("qid").agg(F.count(F.lit(1)).alias("m"),
                                F.sum(F.when(F.col("cid").isNull() | (F.col("cid") != F.col("id")), 1).otherwise(0))
                                 .cast("long").alias("mismatches"))


@register("truth_monotone", _qcte() +
          "SELECT CAST(count(*) FILTER (WHERE p > dist) AS BIGINT) AS violations, count(DISTINCT qid) AS queries "
          "FROM (SELECT *, lag(dist) OVER (PARTITION BY qid ORDER BY rk) AS p FROM truth)")
def truth_monotone(spark, sf):
    truth, _ = _truth_run(spark, sf)
    return Q.monotone_violations(truth)


BURST_MAX = 20
IOU_T = [(1200 + 30 * j) / 1000.0 for j in range(21)]


@register("drop_bursty_queries", cte("queries", "base") + f"""
SELECT q.qid, count(b.id) AS matches FROM queries q LEFT JOIN base b ON {l2('q.qv', 'b.v')} < {RADIUS}
GROUP BY q.qid HAVING count(b.id) <= {BURST_MAX}""")
def drop_bursty_queries(spark, sf):
    """Candidate queries with more than 20 range matches are dropped; the rest with their match count."""
    queries, base = fx.split(fx.vectors(spark, sf))
    cnt = K.range_search(base, queries, RADIUS).groupBy("qid").agg(F.count(F.lit(1)).alias("matches"))
    per = queries.select("qid").join(cnt, "qid", "left").fillna({"matches": 0})
    return per.where(F.col("matches") <= BURST_MAX)


@register("best_iou_threshold", cte("queries", "base", extra=_RANGE + """,
th AS (SELECT j, (1200 + 30 * j) / 1000.0 AS t FROM range(21) r(j)),
sq AS (SELECT qc.qid, bc.id, """ + _int_l2('qc.c', 'bc.c') + """ * (((mm.hi - mm.lo) / 255.0) * ((mm.hi - mm.lo) / 255.0)) AS dist FROM qcodes qc, codes bc, mm),
iou AS (SELECT th.t, count(*) FILTER (WHERE sq.dist < th.t AND g.id IS NOT NULL) AS inter,
          count(*) FILTER (WHERE sq.dist < th.t) AS nb FROM th, sq LEFT JOIN gt g ON g.qid = sq.qid AND g.id = sq.id GROUP BY th.t)""") + """
SELECT t, round(inter / ((SELECT count(*) FROM gt) + nb - inter), 6) AS iou FROM iou
ORDER BY inter / ((SELECT count(*) FROM gt) + nb - inter) DESC, t LIMIT 1""")
def best_iou_threshold(spark, sf):
    """Compressed-distance threshold whose matches best agree (IoU) with the exact matches at radius r."""
    qs, gt, _ = _range_tables(spark, sf)
    queries, base = fx.split(fx.vectors(spark, sf))
    mm = base.select(F.explode("v").alias("x")).agg(F.min("x").cast("double").alias("lo"),
                                                    F.max("x").cast("double").alias("hi")).first()
    lo, hi = mm["lo"], mm["hi"]
    scale = ((hi - lo) / 255.0) * ((hi - lo) / 255.0)
    bc = base.select("id", D.sq8_encode("v", F.lit(lo), F.lit(hi)).alias("c"))
    qc = queries.select("qid", D.sq8_encode("qv", F.lit(lo), F.lit(hi)).alias("c"))
    tmax = max(IOU_T)
    sq = blockscan.scan(bc, qc, vec="c", qvec="c", mode="radius", radius=tmax / scale * (1 + 1e-9), inclusive=True)
    sq = sq.withColumn("dist", F.col("dist") * F.lit(scale)).where(F.col("dist") < tmax)
    hit = sq.join(gt.withColumn("_g", F.lit(1)), ["qid", "id"], "left")
    # the first threshold each pair passes: thresholds are few, so test them in one array expression
    ts = F.array(*[F.lit(t) for t in IOU_T])
    first = F.array_position(F.transform(ts, lambda t: F.col("dist") < t), True)
    per = hit.withColumn("j0", first).where(F.col("j0") > 0).groupBy("j0").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("_g", F.lit(0))).alias("ok"))
    ngt = gt.count()
    th = spark.createDataFrame([(j + 1, t) for j, t in enumerate(IOU_T)], "j0 long, t double")
    from pyspark.sql import Window
    w = Window.orderBy("j0").rowsBetween(Window.unboundedPreceding, 0)      # 21 rows
    c = th.join(per, "j0", "left").fillna({"n": 0, "ok": 0}) \
          .withColumn("nb", F.sum("n").over(w)).withColumn("inter", F.sum("ok").over(w))
    c = c.withColumn("iou", F.col("inter") / (F.lit(ngt) + F.col("nb") - F.col("inter")))
    best = c.orderBy(F.col("iou").desc(), "t").limit(1)
    return best.select("t", F.round("iou", 6).alias("iou"))
