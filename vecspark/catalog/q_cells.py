"""Catalog: coarse cells / IVF (D10-D12, D21, E14, E15, G2, L1-L3); first centroids = every floor(sqrt n)-th vector.

Searches use the held-out split (queries / base); jobs without queries use all vectors.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vecspark.catalog.oracle_fixtures import cosine, cte, dot, l2
from vecspark.catalog.q_knn import TOPK, _fin, topk_sql
from vecspark.catalog.registry import register
from vecspark.operators import blockscan
from vecspark.operators import cells as C
from vecspark.sources import fixtures as fx

NPROBE = 2
MAX_CODES, MAX_PROBES = 60, 8
N_PROPS = 4
CAPS_BUDGET = 50
K2 = 4
PROBE_A, PROBE_B = 1.0, 1.0
PROBE_MIN, PROBE_MAX = 4, 256
KMEANS_ROUNDS = 3


def _setup(spark, sf):
    vec = fx.vectors(spark, sf)
    q, b = fx.split(vec)
    return q, b, fx.centroids(vec)


def _all(spark, sf):
    """(all vectors, centroids) for jobs without queries."""
    vec = fx.vectors(spark, sf)
    return vec, fx.centroids(vec)


def _asg(rows: str) -> str:
    return ("asg AS (SELECT id, cell FROM (SELECT b.id, c.cid AS cell, row_number() OVER (PARTITION BY b.id "
            f"ORDER BY {l2('b.v', 'c.c')}, c.cid) AS r FROM {rows} b, cents c) WHERE r = 1)")


_PRB = (f"ord AS (SELECT q.qid, c.cid AS cell, row_number() OVER (PARTITION BY q.qid ORDER BY {l2('q.qv', 'c.c')}, c.cid) AS prk "
        f"FROM queries q, cents c),\nprb AS (SELECT qid, cell FROM ord WHERE prk <= {NPROBE})")


def _ccte(*names, extra=()):
    """Cells of the base, and probes of the queries."""
    return cte("queries", "base", "cents", *names, extra=",\n".join([_asg("base"), _PRB, *extra]))


def _acte(*names, extra=()):
    """Cells of all vectors."""
    return cte("vectors", "cents", *names, extra=",\n".join([_asg("vectors"), *extra]))


@register("assign_cells", _acte() + "SELECT id, cell FROM asg")
def assign_cells(spark, sf):
    b, cents = _all(spark, sf)
    return C.assign(b, cents).select("id", "cell")


@register("ivf_knn", _ccte() + topk_sql(
    f"SELECT p.qid, b.id, {l2('q.qv', 'b.v')} AS dist FROM prb p JOIN asg a ON a.cell = p.cell JOIN base b ON b.id = a.id "
    "JOIN queries q ON q.qid = p.qid"))
def ivf_knn(spark, sf):
    q, b, cents = _setup(spark, sf)
    return _fin(C.ivf_knn(C.assign(b, cents), q, C.probes(q, cents, NPROBE), TOPK))


@register("ivf_knn_filtered", _ccte("tag_arr", "filters_tag") + topk_sql(
    f"SELECT p.qid, b.id, {l2('q.qv', 'b.v')} AS dist FROM prb p JOIN asg a ON a.cell = p.cell JOIN base b ON b.id = a.id "
    "JOIN queries q ON q.qid = p.qid JOIN filters_tag f ON f.qid = p.qid JOIN tag_arr t ON t.id = b.id "
    "WHERE len(f.ftags) = 0 OR list_has_all(t.tags, f.ftags)"))
def ivf_knn_filtered(spark, sf):
    q, b, cents = _setup(spark, sf)
    qf = fx.filters_tag(q, True)
    a = C.assign(fx.with_tag_array(b), cents)
    return _fin(C.ivf_knn(a, qf, C.probes(q, cents, NPROBE), TOPK, tag_filter=True))


@register("cell_balance", _acte(extra=["sz AS (SELECT cell, count(*) AS s FROM asg GROUP BY cell)"]) + """
SELECT CAST(any_value(k) AS INTEGER) AS n_cells, CAST(CASE WHEN count(*) < any_value(k) THEN 0 ELSE min(s) END AS BIGINT) AS min_size,
       max(s) AS max_size, round(CAST(any_value(k) AS DOUBLE) * sum(s * s) / (CAST(sum(s) AS DOUBLE) * sum(s)), 6) AS imbalance
FROM sz, (SELECT count(*) AS k FROM cents)""")
def cell_balance(spark, sf):
    b, cents = _all(spark, sf)
    out = C.balance(C.assign(b, cents), cents.count())
    return out.withColumn("imbalance", F.round("imbalance", 6))


@register("cluster_permute", _acte() + """
SELECT id, cell, CAST(row_number() OVER (ORDER BY cell, id) - 1 AS BIGINT) AS new_id FROM asg""")
def cluster_permute(spark, sf):
    b, cents = _all(spark, sf)
    return C.permute(C.assign(b, cents)).withColumn("new_id", F.col("new_id").cast("long"))


@register("cell_top_property", _acte("tags") + """
SELECT cell, tag, cnt FROM (SELECT a.cell, t.tag, count(*) AS cnt, row_number() OVER (PARTITION BY a.cell ORDER BY count(*) DESC, t.tag) AS r
FROM asg a JOIN tags t ON t.id = a.id GROUP BY a.cell, t.tag) WHERE r = 1""")
def cell_top_property(spark, sf):
    b, cents = _all(spark, sf)
    return C.top_property(C.assign(fx.with_tag_array(b), cents))


@register("tag_cell_index", _acte("tags") + """
SELECT tag, cell, n, CAST(coalesce(sum(n) OVER (ORDER BY tag, cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
FROM (SELECT t.tag, a.cell, count(*) AS n FROM asg a JOIN tags t ON t.id = a.id GROUP BY t.tag, a.cell)""")
def tag_cell_index(spark, sf):
    b, cents = _all(spark, sf)
    return C.tag_cell_index(C.assign(fx.with_tag_array(b), cents))


@register("cell_medoids", _acte() + f"""
SELECT cid, id, round(dist, 6) AS dist FROM (SELECT c.cid, b.id, 1.0 - {dot('c.c', 'b.v')} AS dist,
  row_number() OVER (PARTITION BY c.cid ORDER BY 1.0 - {dot('c.c', 'b.v')}, b.id) AS r FROM cents c, vectors b) WHERE r = 1""")
def cell_medoids(spark, sf):
    """Entry point per cell: the real base vector with the highest inner product to the centroid."""
    b, cents = _all(spark, sf)
    cq = cents.select(F.col("cid").alias("qid"), F.col("c").alias("qv"))
    m = blockscan.knn(b, cq, 1, "ip")
    return m.select(F.col("qid").alias("cid"), "id", F.round("dist", 6).alias("dist"))


_FREQ = f"""df AS (SELECT tag, count(*) AS n FROM tags WHERE id % 25 <> 0 GROUP BY tag), nb AS (SELECT count(*) AS n FROM base),
fq AS (SELECT f.qid, min(CASE WHEN x.tag IS NOT NULL THEN CAST(coalesce(df.n, 0) AS DOUBLE) / nb.n END) AS f FROM filters_tag f CROSS JOIN nb
       LEFT JOIN (SELECT qid, unnest(ftags) AS tag FROM filters_tag) x ON x.qid = f.qid LEFT JOIN df ON df.tag = x.tag GROUP BY f.qid),
np AS (SELECT qid, CAST(least({PROBE_MAX}, greatest({PROBE_MIN}, floor(pow(2.0, -{PROBE_A} * log10(greatest(coalesce(f, 1.0), 1e-300)) + {PROBE_B})))) AS INTEGER) AS nprobe FROM fq)
"""


def _adaptive(q, b):
    """``(qid, nprobe)``: ``2^(-a·log10 f + b)`` clamped to [4, 256] (f = rarest filter tag's share)."""
    from vecspark.operators.knn import query_tag_freq
    bt = fx.with_tag_array(b)
    n = bt.count()
    df = bt.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    qt = fx.filters_tag(q, True).select("qid", F.explode_outer("ftags").alias("tag"))
    fq = qt.join(query_tag_freq(df, qt.where(F.col("tag").isNotNull())), "tag", "left") \
           .groupBy("qid").agg(F.min(F.when(F.col("tag").isNotNull(),
                                            F.coalesce(F.col("n"), F.lit(0)).cast("double") / F.lit(float(n)))).alias("f"))
    share = F.greatest(F.coalesce("f", F.lit(1.0)), F.lit(1e-300))
    npb = F.least(F.lit(PROBE_MAX), F.greatest(F.lit(PROBE_MIN), F.floor(F.pow(F.lit(2.0), -PROBE_A * F.log10(share) + PROBE_B))))
    return fq.select("qid", npb.cast("int").alias("nprobe"))


@register("ivf_adaptive_probe", cte("queries", "base", "tags", "filters_tag", extra=_FREQ) + "SELECT qid, nprobe FROM np")
def ivf_adaptive_probe(spark, sf):
    q, b, _ = _setup(spark, sf)
    return _adaptive(q, b)


@register("ivf_knn_adaptive", _ccte("tags", "tag_arr", "filters_tag", extra=[_FREQ]) + topk_sql(
    f"SELECT p.qid, b.id, {l2('q.qv', 'b.v')} AS dist FROM ord p JOIN np ON np.qid = p.qid AND p.prk <= np.nprobe JOIN asg a ON a.cell = p.cell "
    "JOIN base b ON b.id = a.id JOIN queries q ON q.qid = p.qid JOIN filters_tag f ON f.qid = p.qid JOIN tag_arr t ON t.id = b.id "
    "WHERE len(f.ftags) = 0 OR list_has_all(t.tags, f.ftags)"))
def ivf_knn_adaptive(spark, sf):
    """Filtered k-NN in which every query probes as many cells as its rarest tag asks for."""
    q, b, cents = _setup(spark, sf)
    a = C.assign(fx.with_tag_array(b), cents)
    probe = C.probes(q, cents, PROBE_MAX).join(_adaptive(q, b), "qid").where(F.col("prk") <= F.col("nprobe"))
    return _fin(C.ivf_knn(a, fx.filters_tag(q, True), probe, TOPK, tag_filter=True))


def _lloyd_sql(metric, rounds: int = KMEANS_ROUNDS) -> str:
    """Lloyd's rounds unrolled: assign every vector, average each cell, keep the centroid of an empty cell."""
    parts = ["c0 AS (SELECT cid, c FROM cents)"]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS (SELECT id, v, cid FROM (SELECT b.id, b.v, c.cid, row_number() OVER (PARTITION BY b.id "
                     f"ORDER BY {metric('b.v', 'c.c')}, c.cid) AS r FROM vectors b, c{i} c) WHERE r = 1)")
        parts.append(f"m{i} AS (SELECT cid, list(x ORDER BY p) AS c FROM (SELECT cid, p, avg(x) AS x FROM "
                     f"(SELECT cid, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS p FROM a{i}) GROUP BY cid, p) GROUP BY cid)")
        parts.append(f"c{i + 1} AS (SELECT o.cid, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN m{i} m ON m.cid = o.cid)")
    return cte("vectors", "cents", extra=",\n".join(parts)) + f"SELECT id, cid AS cell FROM a{rounds}"


@register("kmeans_cells", _lloyd_sql(l2))
def kmeans_cells(spark, sf):
    """Lloyd's k-means from the fixed centroids, three rounds over all vectors."""
    b, cents = _all(spark, sf)
    return C.kmeans_cells(b, cents, KMEANS_ROUNDS)


@register("spherical_kmeans_cells", _lloyd_sql(cosine))
def spherical_kmeans_cells(spark, sf):
    b, cents = _all(spark, sf)
    return C.kmeans_cells(b, cents, KMEANS_ROUNDS, metric="cosine")


@register("bucket_layout", _acte("tag_arr", extra=[
    "ky AS (SELECT a.id, a.cell, CAST(list_sum(list_transform(range(0, 4), lambda j: CASE WHEN list_contains(t.tags, CAST(j AS INTEGER)) "
    "THEN CAST(pow(2, 3 - j) AS BIGINT) ELSE 0 END)) AS BIGINT) AS props FROM asg a JOIN tag_arr t ON t.id = a.id)"]) + """
SELECT id, cell, props, row_number() OVER (PARTITION BY cell ORDER BY props, id) AS pos FROM ky""")
def bucket_layout(spark, sf):
    """Rows of each cell laid out sorted by their property code (tags 0..3 as bits), then id."""
    from vecspark.operators.ranking import global_row_number
    b, cents = _all(spark, sf)
    a = C.assign(fx.with_tag_array(b), cents)
    props = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(3)),
                                    lambda j: F.when(F.array_contains("tags", j), F.shiftleft(F.lit(1), 3) / F.pow(F.lit(2), j)).otherwise(0)),
                        F.lit(0.0), lambda acc, x: acc + x).cast("long")
    k = a.select("id", "cell", props.alias("props"))
    pos = global_row_number(k, ["cell", "props"], "id", "gpos")        # in (cell, props, id) order
    first = pos.groupBy("cell").agg(F.min("gpos").alias("_p0"))
    return pos.join(first, "cell").select("id", "cell", "props", (F.col("gpos") - F.col("_p0") + 1).alias("pos"))



def _caps_sql(n: int) -> str:
    """The bucket rounds unrolled: round b takes each cell's most frequent tag among unplaced rows."""
    parts = ["r0 AS (SELECT id, cell FROM asg)"]
    for b in range(n):
        parts.append(f"p{b} AS (SELECT cell, tag FROM (SELECT r.cell, t.tag, row_number() OVER (PARTITION BY r.cell "
                     f"ORDER BY count(*) DESC, t.tag) AS rn FROM r{b} r JOIN tags t ON t.id = r.id GROUP BY r.cell, t.tag) WHERE rn = 1)")
        parts.append(f"b{b} AS (SELECT r.id, r.cell, {b} AS bucket, p.tag AS prop FROM r{b} r JOIN p{b} p ON p.cell = r.cell "
                     f"WHERE EXISTS (SELECT 1 FROM tags t WHERE t.id = r.id AND t.tag = p.tag))")
        parts.append(f"r{b + 1} AS (SELECT * FROM r{b} WHERE id NOT IN (SELECT id FROM b{b}))")
    body = " UNION ALL ".join([f"SELECT * FROM b{b}" for b in range(n)]
                              + [f"SELECT id, cell, {n} AS bucket, CAST(NULL AS INTEGER) AS prop FROM r{n}"])
    return _acte("tags", extra=parts) + body


@register("caps_buckets", _caps_sql(N_PROPS))
def caps_buckets(spark, sf):
    """Per-cell property buckets chosen by repeated most-frequent tag (rounds; SQL twin unrolled)."""
    b, cents = _all(spark, sf)
    return C.property_buckets(C.assign(fx.with_tag_array(b), cents), N_PROPS)


@register("caps_knn", _ccte("tag_arr", "filters_tag", extra=[
    "m AS (SELECT f.qid, a.id, a.cell FROM filters_tag f, asg a JOIN tag_arr t ON t.id = a.id WHERE len(f.ftags) = 0 OR list_has_all(t.tags, f.ftags))",
    "cnt AS (SELECT o.qid, o.cell, o.prk, (SELECT count(*) FROM m WHERE m.qid = o.qid AND m.cell = o.cell) AS n FROM ord o)",
    f"kept AS (SELECT qid, cell FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY qid ORDER BY prk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM cnt) WHERE before < {CAPS_BUDGET})"]) + topk_sql(
    f"SELECT m.qid, b.id, {l2('q.qv', 'b.v')} AS dist FROM m JOIN kept k ON k.qid = m.qid AND k.cell = m.cell "
    "JOIN base b ON b.id = m.id JOIN queries q ON q.qid = m.qid"))
def caps_knn(spark, sf):
    """Filtered k-NN probing cells nearest-first until 50 matching rows are gathered (approximate search)."""
    q, b, cents = _setup(spark, sf)
    qf = fx.filters_tag(q, True)
    a = C.assign(fx.with_tag_array(b), cents)
    return _fin(C.budget_probe_knn(a, qf, cents, TOPK, CAPS_BUDGET))


@register("two_level_cells")
def two_level_cells(spark, sf):
    """Sub-cells of every cell, trained on all its rows (no SQL twin)."""
    b, cents = _all(spark, sf)
    return C.two_level(b, cents, K2)


@register("ivf_knn_max_codes", _ccte(extra=[
    "sz AS (SELECT cell, count(*) AS n FROM asg GROUP BY cell)",
    f"bud AS (SELECT qid, cell FROM (SELECT o.qid, o.cell, coalesce(sum(s.n) OVER (PARTITION BY o.qid ORDER BY o.prk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before "
    f"FROM ord o JOIN sz s ON s.cell = o.cell WHERE o.prk <= {MAX_PROBES}) WHERE before < {MAX_CODES})"]) + topk_sql(
    f"SELECT p.qid, b.id, {l2('q.qv', 'b.v')} AS dist FROM bud p JOIN asg a ON a.cell = p.cell JOIN base b ON b.id = a.id JOIN queries q ON q.qid = p.qid"))
def ivf_knn_max_codes(spark, sf):
    """Cells probed nearest first until they hold 60 rows, at most eight of them."""
    q, b, cents = _setup(spark, sf)
    return _fin(C.ivf_knn(C.assign(b, cents), q, C.probes(q, cents, MAX_PROBES), TOPK, max_codes=MAX_CODES))
