"""Catalog: generators, samples and sweeps (L4, L6, L9, L10, L14), vector maps (B6, B7, B18) and own distances (K1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecspark.catalog.oracle_fixtures import cte, l2
from vecspark.catalog.q_cells import _asg, _setup
from vecspark.catalog.q_knn import TOPK, _fin, topk_sql
from vecspark.catalog.registry import register
from vecspark.functions import distance as D
from vecspark.operators import blockscan
from vecspark.operators import cells as C
from vecspark.operators.ranking import ordered_positions
from vecspark.sources import fixtures as fx

SEED = 11
GEN_TAGS = 20
ZIPF_COEF, ZIPF_DIV, MIN_TAGS, MAX_TAGS = 2500, 9, 2, 5
N_DRAWS = 1 << 14              # template draws; the first 2509 different ones suffice for any total (the last hold a ninth each)
SETTINGS = (1, 2, 4, 8, 16)


def _h(*parts) -> F.Column:
    """md5 of the parts, as in the SQL twins."""
    return F.md5(F.concat_ws("|", *[p.cast("string") if hasattr(p, "cast") else F.lit(str(p)) for p in parts]))


def _u(h):
    """[0, 1) from the first 32 bits of a hash."""
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _h_sql(*parts: str) -> str:
    return "md5(" + " || '|' || ".join(parts) + ")"


def _u_sql(h: str) -> str:
    return f"(CAST(CAST('0x' || substr({h}, 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296.0)"


def _positions(df, key: str):
    """1-based place of each row in the order of ``key`` (a hex hash), then ``id``."""
    return ordered_positions(df, [key, "id"], F.conv(F.substring(key, 1, 4), 16, 10).cast("long"))


# ------------------------------------------------------------------ L4, L10: splits and samples without replacement

@register("split_queries", cte("vectors") + f"""
SELECT id, CASE WHEN row_number() OVER (ORDER BY {_h_sql(f"'{SEED}'", 'id')}, id) <= (SELECT count(*) // 25 FROM vectors) THEN 'query' ELSE 'train' END AS part
FROM vectors""")
def split_queries(spark, sf):
    """A twenty-fifth of the vectors, drawn without replacement by a seeded hash order, become queries."""
    vec = fx.vectors(spark, sf).select("id")
    n = vec.count() // 25
    pos = _positions(vec.withColumn("h", _h(SEED, F.col("id"))), "h")
    return pos.select("id", F.when(F.col("pos") <= n, "query").otherwise("train").alias("part"))


@register("sample_queries", cte("vectors") + f"""
, valid AS (SELECT id FROM vectors WHERE label IS NOT NULL AND len(v) > 0 AND list_sum(list_transform(v, lambda x: x * x)) > 0),
r AS (SELECT id, row_number() OVER (ORDER BY {_h_sql("'sample'", 'id')}, id) AS pos, (SELECT count(*) FROM valid) // 10 AS n FROM valid)
SELECT id, CASE WHEN pos <= n THEN 'public' ELSE 'private' END AS part FROM r WHERE pos <= 2 * n""")
def sample_queries(spark, sf):
    """Public and private query samples of the valid rows: a tenth each, disjoint."""
    vec = fx.vectors(spark, sf)
    valid = vec.where(F.col("label").isNotNull() & (F.size("v") > 0) & (D.sq_norm(F.col("v")) > 0)).select("id")
    n = valid.count() // 10
    pos = _positions(valid.withColumn("h", _h("sample", F.col("id"))), "h").where(F.col("pos") <= 2 * n)
    return pos.select("id", F.when(F.col("pos") <= n, "public").otherwise("private").alias("part"))


# ------------------------------------------------------------------ L6, L9: tags and workloads

@register("gen_tags", cte("vectors") + f"""
SELECT id, CAST(j AS INTEGER) AS tag FROM vectors, range({GEN_TAGS}) r(j) WHERE {_u_sql(_h_sql("'tag'", 'id', 'j'))} < pow(j + 2, -0.5)""")
def gen_tags(spark, sf):
    """Bernoulli tags with Zipf-like rates (j + 2)^-1/2, drawn by hash."""
    j = F.explode(F.sequence(F.lit(0), F.lit(GEN_TAGS - 1))).alias("tag")
    rows = fx.vectors(spark, sf).select("id", j)
    return rows.where(_u(_h("tag", F.col("id"), F.col("tag"))) < F.pow(F.col("tag") + F.lit(2.0), F.lit(-0.5)))


_TEMPLATES_SQL = f"""raw AS (SELECT i, {MIN_TAGS} + CAST(floor({_u_sql(_h_sql("'size'", 'i'))} * {MAX_TAGS - MIN_TAGS + 1}) AS INTEGER) AS k FROM range(1, {N_DRAWS + 1}) r(i)),
draw AS (SELECT i, k, j, row_number() OVER (PARTITION BY i ORDER BY -ln(greatest({_u_sql(_h_sql("'pick'", 'i', 'j'))}, 1e-12)) / pow(1.0 / (j + 3), 0.65), j) AS r FROM raw, range({GEN_TAGS}) t(j)),
tpl AS (SELECT i, list(CAST(j AS INTEGER) ORDER BY j) AS ftags FROM draw WHERE r <= k GROUP BY i),
uniq AS (SELECT ftags, row_number() OVER (ORDER BY min(i)) AS nth FROM tpl GROUP BY ftags),
total AS (SELECT count(*) AS total FROM events),
cnt AS (SELECT ftags, nth, CAST(ceil(total / CAST(greatest(1, {ZIPF_COEF} - nth + 1) AS DOUBLE) / {ZIPF_DIV}.0) AS BIGINT) AS c FROM uniq, total),
cum AS (SELECT ftags, nth, c, coalesce(sum(c) OVER (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM cnt)"""


@register("gen_workload", f"""WITH {_TEMPLATES_SQL},
ev AS (SELECT event_id AS seq, row_number() OVER (ORDER BY {_h_sql("'shuffle'", 'event_id')}, event_id) AS pos FROM events)
SELECT ev.seq, c.nth AS template, c.ftags FROM ev JOIN cum c ON ev.pos > c.before AND ev.pos <= c.before + c.c""")
def gen_workload(spark, sf):
    """A log of as many filters as events: template n repeated ceil(total / (2500 - n + 1) / 9) times, shuffled by hash."""
    from pyspark.sql import Window
    i = spark.range(1, N_DRAWS + 1).withColumnRenamed("id", "i")
    size = F.lit(MIN_TAGS) + F.floor(_u(_h("size", F.col("i"))) * (MAX_TAGS - MIN_TAGS + 1))
    tag = F.explode(F.sequence(F.lit(0), F.lit(GEN_TAGS - 1))).alias("j")
    key = -F.log(F.greatest(_u(_h("pick", F.col("i"), F.col("j"))), F.lit(1e-12))) / F.pow(F.lit(1.0) / (F.col("j") + 3), F.lit(0.65))
    pick = (i.select("i", size.cast("int").alias("k"), tag).groupBy("i", "k")
            .agg(F.sort_array(F.collect_list(F.struct(key.alias("key"), "j"))).alias("o")))      # twenty tags a template
    tpl = pick.select("i", F.array_sort(F.transform(F.expr("slice(o, 1, k)"), lambda e: e["j"])).alias("ftags"))
    first = Window.orderBy("i")                        # a fixed number of templates
    cum = Window.orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    events = fx.read(spark, sf, "events").select(F.col("event_id").alias("id"))
    total = events.count()
    uniq = tpl.groupBy("ftags").agg(F.min("i").alias("i")).select("ftags", F.row_number().over(first).cast("long").alias("nth"))
    c = F.ceil(F.lit(float(total)) / F.greatest(F.lit(1), F.lit(ZIPF_COEF) - F.col("nth") + 1).cast("double") / F.lit(float(ZIPF_DIV)))
    runs = (uniq.withColumn("c", c.cast("long")).withColumn("before", F.coalesce(F.sum("c").over(cum), F.lit(0)))
                .where(F.col("before") < total))
    slots = runs.select("nth", "ftags", F.explode(F.sequence(F.col("before") + 1, F.least(F.col("before") + F.col("c"), F.lit(total)))).alias("pos"))
    pos = _positions(events.withColumn("h", _h("shuffle", F.col("id"))), "h")
    return pos.join(slots, "pos").select(F.col("id").alias("seq"), F.col("nth").alias("template"), "ftags")


# ------------------------------------------------------------------ L14: sweep

_SWEEP = [_asg("base"),
          f"ord AS (SELECT q.qid, c.cid AS cell, row_number() OVER (PARTITION BY q.qid ORDER BY {l2('q.qv', 'c.c')}, c.cid) AS prk FROM queries q, cents c)",
          "grid AS (SELECT * FROM (VALUES " + ", ".join(f"({s})" for s in SETTINGS) + ") g(nprobe))",
          f"pair AS (SELECT q.qid, b.id, a.cell, {l2('q.qv', 'b.v')} AS dist FROM queries q, base b JOIN asg a ON a.id = b.id)",
          f"truth AS (SELECT qid, id FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS r FROM pair) WHERE r <= {TOPK})",
          f"got AS (SELECT nprobe, qid, id FROM (SELECT g.nprobe, p.qid, p.id, row_number() OVER (PARTITION BY g.nprobe, p.qid ORDER BY p.dist, p.id) AS r "
          f"FROM grid g JOIN ord o ON o.prk <= g.nprobe JOIN pair p ON p.qid = o.qid AND p.cell = o.cell) WHERE r <= {TOPK})",
          "rec AS (SELECT nprobe, count(t.id) / CAST((SELECT count(*) FROM truth) AS DOUBLE) AS recall FROM got g LEFT JOIN truth t ON t.qid = g.qid AND t.id = g.id GROUP BY nprobe)",
          "work AS (SELECT g.nprobe, CAST(sum(s.n) AS BIGINT) AS rows_read FROM grid g JOIN ord o ON o.prk <= g.nprobe JOIN (SELECT cell, count(*) AS n FROM asg GROUP BY cell) s ON s.cell = o.cell GROUP BY g.nprobe)",
          "pts AS (SELECT nprobe, recall, rows_read FROM rec JOIN work USING (nprobe))"]


@register("sweep_pareto", cte("queries", "base", "cents", extra=",\n".join(_SWEEP)) + """
SELECT nprobe, round(recall, 6) AS recall, rows_read FROM pts p WHERE NOT EXISTS (
  SELECT 1 FROM pts o WHERE o.recall >= p.recall AND o.rows_read <= p.rows_read
    AND (o.recall > p.recall OR o.rows_read < p.rows_read OR o.nprobe < p.nprobe))""")
def sweep_pareto(spark, sf):
    """Probe counts swept over the cell index; the settings that no other beats in recall and rows read."""
    q, b, cents = _setup(spark, sf)
    a = C.assign(b, cents).select("id", "cell", "v").checkpoint()
    order = C.probes(q, cents, max(SETTINGS)).checkpoint()
    truth = blockscan.knn(b, q, TOPK).select("qid", "id").checkpoint()
    sizes = a.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    n_truth = truth.count()
    points = None
    for s in SETTINGS:                       # a fixed grid of settings
        probe = order.where(F.col("prk") <= s)
        hits = C.ivf_knn(a, q, probe, TOPK).join(truth, ["qid", "id"]).agg(F.count(F.lit(1)).alias("hits"))
        one = hits.crossJoin(probe.join(sizes, "cell").agg(F.sum("n").alias("rows_read"))).select(
            F.lit(s).alias("nprobe"), (F.col("hits") / F.lit(float(n_truth))).alias("recall"), "rows_read")
        points = one if points is None else points.unionByName(one)
    points = points.checkpoint()
    o = points.select(*[F.col(c).alias("o_" + c) for c in points.columns])
    beaten = points.join(o, (F.col("o_recall") >= F.col("recall")) & (F.col("o_rows_read") <= F.col("rows_read")) & (
        (F.col("o_recall") > F.col("recall")) | (F.col("o_rows_read") < F.col("rows_read")) | (F.col("o_nprobe") < F.col("nprobe"))))
    return (points.join(beaten.select("nprobe").distinct(), "nprobe", "left_anti")
            .select("nprobe", F.round("recall", 6).alias("recall"), "rows_read"))


# ------------------------------------------------------------------ B6, B7, B18, K1

_SQ = "list_sum(list_transform({0}, lambda x: x * x))"


@register("vector_maps", cte("vectors_scaled") + f"""
, n AS (SELECT id, v, sqrt({_SQ.format('v')}) AS norm FROM vectors_scaled),
u AS (SELECT id, v, norm, list_transform(v, lambda x: x / CASE WHEN norm = 0 THEN 1.0 ELSE norm END) AS unit FROM n)
SELECT a.id, list_transform(a.unit, lambda x: round(x, 6)) AS unit, round(sqrt({l2('a.v', 'b.v')}), 6) AS to_next,
       round(CASE WHEN {_SQ.format('a.v')} <= 1 THEN sqrt(1.0 - {_SQ.format('a.v')}) END, 6) AS lift
FROM u a LEFT JOIN u b ON b.id = a.id + 1""")
def vector_maps(spark, sf):
    """Per vector: unit form (zero norm counts as 1), metric distance to the next id, inner-product lift (null: norm above 1)."""
    v = fx.vectors_scaled(spark, sf).select("id", "v")
    nxt = v.select((F.col("id") - 1).alias("id"), F.col("v").alias("w"))
    sq = D.sq_norm(F.col("v"))
    return v.join(nxt, "id", "left").select(
        "id", F.transform(D.l2_normalize(F.col("v")), lambda x: F.round(x, 6)).alias("unit"),
        F.round(D.euclidean(F.col("v"), F.col("w")), 6).alias("to_next"),
        F.round(F.when(sq <= 1, F.element_at(D.ip_lift(F.when(sq <= 1, F.col("v"))), -1)), 6).alias("lift"))


def _l1_pairs(q, x):
    """Manhattan distance of row-paired matrices, summed in order."""
    acc = abs(q[:, 0] - x[:, 0])
    for j in range(1, q.shape[1]):
        acc = acc + abs(q[:, j] - x[:, j])
    return acc


@register("knn_own_distance", cte("queries", "base") + topk_sql(
    "SELECT q.qid, b.id, list_sum(list_transform(list_zip(q.qv, b.v), lambda z: abs(z[1] - z[2]))) AS dist FROM queries q, base b"))
def knn_own_distance(spark, sf):
    """Exact k-NN by a distance that the user plugs in (here: Manhattan)."""
    q, b = fx.split(fx.vectors(spark, sf))
    blockscan.register_kernel("l1", _l1_pairs)
    return _fin(blockscan.knn(b, q, TOPK, "l1"))
