"""Catalog: filters and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecspark.catalog.oracle_fixtures import cte, l2
from vecspark.catalog.q_knn import TOPK, _fin, topk_sql
from vecspark.catalog.registry import register
from vecspark.functions import distance as D
from vecspark.operators import knn as K
from vecspark.operators import predicates as P
from vecspark.operators.ranking import global_prefix_sum
from vecspark.sources import fixtures as fx

POPULAR_TAG_SHARE = 10      # tag frequency > N / 10
POPULAR_PAIR_SHARE = 50     # pair frequency > N / 50
FUSION_M = 4


def _base_q(spark, sf):
    q, b = fx.split(fx.vectors(spark, sf))
    return q, fx.with_tag_array(b)


def _base_tags_sql() -> str:
    return "bt AS (SELECT b.id, t.tags FROM base b JOIN tag_arr t ON t.id = b.id)"


# ------------------------------------------------------------------ C1-C4: tag filters → (qid, id)

@register("filter_single", cte("queries", "base", "tags") +
          "SELECT q.qid, t.id FROM queries q JOIN tags t ON t.tag = CAST((q.qid // 25) % 5 AS INTEGER) "
          "WHERE t.id % 25 <> 0")
def filter_single(spark, sf):
    q, bt = _base_q(spark, sf)
    f = fx.filters_single(q).select("qid", F.explode("ftags").alias("tag"))
    return P.postings(bt).join(f, "tag").select("qid", "id")


def _filter_sql(cond: str) -> str:
    return cte("queries", "base", "tag_arr", "filters_tag", extra=_base_tags_sql()) + \
        f"SELECT f.qid, bt.id FROM filters_tag f, bt WHERE {cond}"


def _filter_q(is_and: bool, only_empty: bool = False):
    def q(spark, sf):
        queries, bt = _base_q(spark, sf)
        f = fx.filters_tag(queries, is_and)
        if only_empty:
            f = f.where(F.size("ftags") == 0)
        return P.pred_rows(bt, f, key="qid").select("qid", "id")
    return q


register("filter_and", _filter_sql("len(f.ftags) = 0 OR list_has_all(bt.tags, f.ftags)"))(_filter_q(True))
register("filter_or", _filter_sql("len(f.ftags) = 0 OR list_has_any(bt.tags, f.ftags)"))(_filter_q(False))
register("filter_none", _filter_sql("len(f.ftags) = 0"))(_filter_q(True, only_empty=True))


@register("filter_signature", _filter_sql("len(f.ftags) = 0 OR list_has_all(bt.tags, f.ftags)"))
def filter_signature(spark, sf):
    queries, bt = _base_q(spark, sf)
    return P.signature_filter(bt, fx.filters_tag(queries, True))


@register("tag_intersect", _filter_sql("len(f.ftags) = 2 AND list_has_all(bt.tags, f.ftags)"))
def tag_intersect(spark, sf):
    """Two-word filters: intersection of two posting lists by a self equi-join on id."""
    queries, bt = _base_q(spark, sf)
    f = fx.filters_tag(queries, True).where(F.size("ftags") == 2).select(
        "qid", F.col("ftags")[0].alias("t1"), F.col("ftags")[1].alias("t2"))
    post = P.postings(bt)
    a = post.join(f, post.tag == f.t1).select("qid", "id", "t2")
    return a.join(post, (a.id == post.id) & (a.t2 == post.tag), "left_semi").select("qid", "id")


# ------------------------------------------------------------------ C5: range filters by blocks of rows and filters

def _range_rows(base_attrs: DataFrame, fr: DataFrame, is_and: bool) -> DataFrame:
    """``(qid, id)`` rows inside the half-open ranges; with OR each pair once."""
    rows, f = base_attrs.select("id", "a0", "a1"), fr.select("qid", "lo0", "hi0", "lo1", "hi1")
    if not is_and:
        rows, f = rows.distinct(), f.distinct()          # an id's attributes and a query's ranges are one: the pairs are distinct
    return P.range_pairs(rows, f, is_and)


def _range_sql(op: str) -> str:
    return cte("queries", "base", "attrs", "filters_range") + \
        ("SELECT f.qid, a.id FROM filters_range f, attrs a WHERE a.id % 25 <> 0 AND "
         f"((a.a0 >= f.lo0 AND a.a0 < f.hi0) {op} (a.a1 >= f.lo1 AND a.a1 < f.hi1))")


def _range_q(is_and):
    def q(spark, sf):
        queries, base = fx.split(fx.vectors(spark, sf))
        return _range_rows(fx.with_attrs(base), fx.filters_range(queries, is_and), is_and)
    return q


register("filter_range_and", _range_sql("AND"))(_range_q(True))
register("filter_range_or", _range_sql("OR"))(_range_q(False))


# ------------------------------------------------------------------ C8: required words on documents

_WORDS_CTE = """docw AS (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents)),
dfw AS (SELECT w, count(*) AS n FROM docw GROUP BY w),
qw AS (SELECT DISTINCT item_id AS qid, w FROM (SELECT item_id, unnest(string_split(text, ' ')) AS w FROM benchmark)),
req AS (SELECT qid, w FROM (SELECT qw.qid, qw.w, row_number() OVER (PARTITION BY qw.qid ORDER BY coalesce(dfw.n, 0), qw.w) AS r
        FROM qw LEFT JOIN dfw ON dfw.w = qw.w) WHERE r <= 2),
nreq AS (SELECT qid, count(*) AS k FROM req GROUP BY qid)"""


@register("filter_words", "WITH " + _WORDS_CTE + """
SELECT r.qid, d.doc_id FROM req r JOIN docw d ON d.w = r.w JOIN nreq n ON n.qid = r.qid
GROUP BY r.qid, d.doc_id, n.k HAVING count(*) = n.k""")
def filter_words(spark, sf):
    """Each benchmark passage requires its two rarest words; documents containing all of them."""
    docs = fx.read(spark, sf, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("w")).distinct()
    dfw = docs.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    qw = fx.read(spark, sf, "benchmark").select(F.col("item_id").alias("qid"),
                                                F.explode(F.split("text", " ")).alias("w")).distinct()
    w = Window.partitionBy("qid").orderBy(F.coalesce(F.col("n"), F.lit(0)), "w")
    req = qw.join(dfw, "w", "left").withColumn("r", F.row_number().over(w)).where("r <= 2")
    req = req.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("qid"))).select("qid", "w", "k")
    hits = docs.join(req, "w").groupBy("qid", "doc_id", "k").agg(F.count(F.lit(1)).alias("c"))
    return hits.where(F.col("c") == F.col("k")).select("qid", "doc_id")


# ------------------------------------------------------------------ C6 / K2: arbitrary id predicate pushed into the scan

@register("knn_filter_expr", cte("queries", "base") + topk_sql(
    f"SELECT q.qid, b.id, {l2('q.qv', 'b.v')} AS dist FROM queries q, base b WHERE b.id % 3 = 0 AND b.label <> 7"))
def knn_filter_expr(spark, sf):
    queries, base = fx.split(fx.vectors(spark, sf))
    pred = (F.col("id") % 3 == 0) & (F.col("label") != 7)
    return _fin(K.knn(base.where(pred), queries, TOPK))


@register("knn_filter_nothing", cte("queries", "base") + topk_sql(
    f"SELECT q.qid, b.id, {l2('q.qv', 'b.v')} AS dist FROM queries q, base b WHERE false"))
def knn_filter_nothing(spark, sf):
    queries, base = fx.split(fx.vectors(spark, sf))
    return _fin(K.knn(base.where(F.lit(False)), queries, TOPK))


# ------------------------------------------------------------------ C16 / B17: attribute codes with wildcard

@register("filter_attr_wildcard", cte("queries", "base", "tag_arr", "filters_tag", extra=_base_tags_sql()) + f"""
, qa AS (SELECT qid, list_transform(range(0, {FUSION_M}), lambda j: CASE WHEN list_contains(ftags, CAST(j AS INTEGER)) THEN 2 * j + 1 ELSE NULL END) AS qa FROM filters_tag),
ra AS (SELECT id, list_transform(range(0, {FUSION_M}), lambda j: CASE WHEN list_contains(tags, CAST(j AS INTEGER)) THEN 2 * j + 1 ELSE 2 * j END) AS ra FROM bt)
SELECT qa.qid, ra.id FROM qa, ra WHERE list_sum(list_transform(list_zip(qa.qa, ra.ra), lambda z: CASE WHEN z[1] IS NULL OR z[1] = z[2] THEN 0 ELSE 1 END)) = 0""")
def filter_attr_wildcard(spark, sf):
    """Exact match on attribute codes where the query leaves wildcards (null) — rows whose codes match.

    Candidates come from an equi-join on the query's first fixed code position
    (or all rows when the query is all wildcards), then the full code check.
    """
    queries, bt = _base_q(spark, sf)
    qa = fx.filters_tag(queries, True).select("qid", F.transform(
        F.sequence(F.lit(0), F.lit(FUSION_M - 1)),
        lambda j: F.when(F.array_contains("ftags", j), j * 2 + 1)).alias("qa"))
    ra = bt.select("id", D.tag_codes("tags", FUSION_M).alias("ra"))
    ok = F.aggregate(F.zip_with("qa", "ra", lambda q, r: F.when(q.isNull() | (q == r), 0).otherwise(1)),
                     F.lit(0), lambda a, x: a + x) == 0
    first = F.array_min(F.filter(F.sequence(F.lit(0), F.lit(FUSION_M - 1)), lambda j: F.element_at("qa", j + 1).isNotNull()))
    qa = qa.withColumn("p", first)
    fixed = qa.where(F.col("p").isNotNull())
    ra_ex = ra.select("id", "ra", F.posexplode("ra").alias("p", "code"))
    c1 = ra_ex.join(fixed, (ra_ex.p == fixed.p) & (ra_ex.code == F.element_at(fixed.qa, fixed.p + 1)))
    c1 = c1.where(ok).select("qid", "id")
    c2 = P.match_all(ra.select("id"), qa.where(F.col("p").isNull()).select("qid"))
    return c1.unionByName(c2)


# ------------------------------------------------------------------ C11, C12: cardinality and its estimate

@register("predicate_cardinality", cte("queries", "base", "tag_arr", "filters_tag", extra=_base_tags_sql()) +
          "SELECT f.qid, count(bt.id) AS card FROM filters_tag f LEFT JOIN bt ON len(f.ftags) = 0 OR "
          "list_has_all(bt.tags, f.ftags) GROUP BY f.qid")
def predicate_cardinality(spark, sf):
    queries, bt = _base_q(spark, sf)
    f = fx.filters_tag(queries, True)
    card = P.filter_cardinality(bt, f.select("ftags", "is_and"))
    return f.join(card, ["ftags", "is_and"]).select("qid", "card")


@register("selectivity_estimate", cte("queries", "base", "tags", "tag_arr", "filters_tag", extra=_base_tags_sql()) + """
, n AS (SELECT count(*) AS n FROM base),
df AS (SELECT tag, count(*) AS df FROM tags WHERE id % 25 <> 0 GROUP BY tag),
est AS (SELECT f.qid, CASE WHEN len(f.ftags) = 0 THEN CAST(n.n AS DOUBLE)
          ELSE CAST(n.n AS DOUBLE) * exp(sum(ln(CAST(coalesce(df.df, 0) AS DOUBLE) / n.n))) END AS est
        FROM filters_tag f CROSS JOIN n LEFT JOIN (SELECT qid, unnest(ftags) AS tag FROM filters_tag) x ON x.qid = f.qid
        LEFT JOIN df ON df.tag = x.tag GROUP BY f.qid, f.ftags, n.n),
card AS (SELECT f.qid, count(bt.id) AS card FROM filters_tag f LEFT JOIN bt ON len(f.ftags) = 0 OR list_has_all(bt.tags, f.ftags) GROUP BY f.qid)
SELECT est.qid, round(est.est, 6) AS est, card.card, CASE WHEN est.est <= 30 THEN 'prefilter' ELSE 'scan' END AS route
FROM est JOIN card ON card.qid = est.qid""")
def selectivity_estimate(spark, sf):
    """Independence estimate ``N · Π df(t)/N`` against the exact count, and the route it implies."""
    queries, bt = _base_q(spark, sf)
    f = fx.filters_tag(queries, True)
    n = bt.count()
    df = P.postings(bt).groupBy("tag").agg(F.count(F.lit(1)).alias("df"))
    qt = f.select("qid", F.explode("ftags").alias("tag"))
    ex = qt.join(K.query_tag_freq(df, qt), "tag", "left")
    prod = ex.groupBy("qid").agg(F.sum(F.log(F.coalesce(F.col("df"), F.lit(0)).cast("double") / F.lit(float(n)))).alias("lg"))
    est = f.join(prod, "qid", "left").select(
        "qid", "ftags", "is_and",
        F.when(F.size("ftags") == 0, F.lit(float(n))).otherwise(F.lit(float(n)) * F.exp("lg")).alias("est"))
    card = P.filter_cardinality(bt, f.select("ftags", "is_and"))
    out = est.join(card, ["ftags", "is_and"])
    return out.select("qid", F.round("est", 6).alias("est"), "card",
                      F.when(F.col("est") <= 30, "prefilter").otherwise("scan").alias("route"))


# ------------------------------------------------------------------ C13-C15, H5: relations between predicates

def predicate_set(spark, sf) -> DataFrame:
    """Distinct predicates of the workload log and the query filters (AND and OR forms)."""
    queries, _ = fx.split(fx.vectors(spark, sf))
    w = fx.workload(spark, sf).select("ftags", "is_and")
    fa = fx.filters_tag(queries, True).select("ftags", "is_and")
    fo = fx.filters_tag(queries, False).select("ftags", "is_and")
    u = w.unionByName(fa).unionByName(fo).select(F.array_sort(F.array_distinct("ftags")).alias("ftags"), "is_and")
    return u.distinct().withColumn("pid", P.filter_key(F.col("ftags"), F.col("is_and")))


_PREDS_SQL = ("preds AS (SELECT DISTINCT (CASE WHEN is_and THEN 'and|' ELSE 'or|' END) || "
              "array_to_string(list_sort(list_distinct(ftags)), ',') AS pid, list_sort(list_distinct(ftags)) AS ftags, is_and "
              "FROM (SELECT ftags, true AS is_and FROM workload UNION ALL SELECT ftags, true FROM filters_tag "
              "UNION ALL SELECT ftags, false FROM filters_tag))")
_PROW_SQL = ("prow AS (SELECT p.pid, bt.id FROM preds p, bt WHERE len(p.ftags) = 0 OR (p.is_and AND list_has_all(bt.tags, p.ftags)) "
             "OR (NOT p.is_and AND list_has_any(bt.tags, p.ftags)))")
_PAIRS_SQL = ("pairs AS (SELECT DISTINCT a.pid AS child, b.pid AS parent FROM (SELECT pid, unnest(ftags) AS t FROM preds) a "
              "JOIN (SELECT pid, unnest(ftags) AS t FROM preds) b ON a.t = b.t WHERE a.pid <> b.pid)")


def _pred_cte(*extra: str) -> str:
    return cte("queries", "base", "tag_arr", "filters_tag", "workload",
               extra=",\n".join([_base_tags_sql(), _PREDS_SQL, *extra]))


@register("predicate_subsumes", _pred_cte() +
          "SELECT c.pid AS child, p.pid AS parent FROM preds c, preds p WHERE len(p.ftags) = 0 OR "
          "(len(c.ftags) > 0 AND c.is_and = p.is_and AND CASE WHEN p.is_and THEN list_has_all(c.ftags, p.ftags) "
          "ELSE list_has_all(p.ftags, c.ftags) END)")
def predicate_subsumes(spark, sf):
    return P.subsumption_edges(predicate_set(spark, sf), key="pid")


def _shared_tag_pairs(preds: DataFrame) -> DataFrame:
    ex = preds.select("pid", F.explode("ftags").alias("t"))
    a, b = ex.alias("a"), ex.alias("b")
    return (a.join(b, F.col("a.t") == F.col("b.t"))
             .where(F.col("a.pid") != F.col("b.pid"))
             .select(F.col("a.pid").alias("child"), F.col("b.pid").alias("parent")).distinct())


@register("predicate_contains", _pred_cte(_PROW_SQL, _PAIRS_SQL) + """
SELECT p.child, p.parent, count(r.id) FILTER (WHERE r2.id IS NULL) AS missing,
       count(r.id) FILTER (WHERE r2.id IS NULL) = 0 AS contained
FROM pairs p LEFT JOIN prow r ON r.pid = p.child LEFT JOIN prow r2 ON r2.pid = p.parent AND r2.id = r.id
GROUP BY p.child, p.parent""")
def predicate_contains(spark, sf):
    """Physical containment (row set ⊆) for predicate pairs sharing a tag, by an anti-join count."""
    _, bt = _base_q(spark, sf)
    preds = predicate_set(spark, sf)
    rows = P.pred_rows(bt, preds, key="pid")
    return P.physical_containment(rows, _shared_tag_pairs(preds), key="pid") \
            .select("child", "parent", F.col("missing").cast("long").alias("missing"), "contained")


@register("predicate_overlap", _pred_cte(_PROW_SQL, _PAIRS_SQL) + """
SELECT p.child AS a, p.parent AS b,
       (SELECT count(*) FROM prow x JOIN prow y ON x.id = y.id WHERE x.pid = p.child AND y.pid = p.parent) AS inter,
       (SELECT count(DISTINCT id) FROM prow z WHERE z.pid = p.child OR z.pid = p.parent) AS uni
FROM pairs p WHERE p.child < p.parent""")
def predicate_overlap(spark, sf):
    """``|A ∩ B|``, ``|A ∪ B|`` of predicate pairs sharing a tag, with per-bucket bitmap and/or."""
    _, bt = _base_q(spark, sf)
    preds = predicate_set(spark, sf)
    rows = P.pred_rows(bt, preds, key="pid")
    pairs = _shared_tag_pairs(preds).where(F.col("child") < F.col("parent")) \
        .select(F.col("child").alias("a"), F.col("parent").alias("b"))
    return P.pair_overlap(rows, pairs, key="pid").select("a", "b", "inter", "uni")


@register("predicate_dedupe", _pred_cte(_PROW_SQL) + """
, rs AS (SELECT pid, list(id ORDER BY id) AS ids, count(*) AS card FROM prow GROUP BY pid)
SELECT p.pid, coalesce(rs.card, 0) AS card, min(p.pid) OVER (PARTITION BY rs.ids) AS grp
FROM preds p LEFT JOIN rs ON rs.pid = p.pid""")
def predicate_dedupe(spark, sf):
    """Distinct predicates grouped by identical row sets (order-free 128-bit fingerprint, no id lists)."""
    _, bt = _base_q(spark, sf)
    preds = predicate_set(spark, sf)
    fp = P.row_set_fingerprint(P.pred_rows(bt, preds, key="pid"), key="pid")
    x = preds.select("pid").join(fp, "pid", "left")
    w = Window.partitionBy("card", "fp1", "fp2")
    return x.select("pid", F.coalesce("card", F.lit(0)).alias("card"), F.min("pid").over(w).alias("grp"))


# ------------------------------------------------------------------ E13, A16, D15, F8: tag statistics and layouts

@register("tag_frequency", cte("tags") + "SELECT tag, count(*) AS df FROM tags WHERE id % 25 <> 0 GROUP BY tag")
def tag_frequency(spark, sf):
    _, bt = _base_q(spark, sf)
    return P.postings(bt).groupBy("tag").agg(F.count(F.lit(1)).alias("df"))


@register("tag_list_export", cte("vectors", "tags") +
          "SELECT v.id, coalesce(string_agg(CAST(t.tag AS VARCHAR), ',' ORDER BY t.tag), '-1') AS tag_list "
          "FROM vectors v LEFT JOIN tags t ON t.id = v.id AND t.tag < 100 GROUP BY v.id")
def tag_list_export(spark, sf):
    """Generated tags per row as text, ``-1`` when a row has none."""
    vec = fx.with_tag_array(fx.vectors(spark, sf))
    gen = F.filter("tags", lambda t: t < fx.LABEL_TAG_OFFSET)
    return vec.select("id", F.when(F.size(gen) == 0, "-1")
                      .otherwise(F.array_join(F.array_sort(gen), ",")).alias("tag_list"))


@register("popular_subsets", cte("tags") + f"""
, bt AS (SELECT * FROM tags WHERE id % 25 <> 0), n AS (SELECT count(DISTINCT id) AS n FROM bt),
single AS (SELECT CAST(tag AS VARCHAR) AS subset, 'tag' AS kind, count(*) AS cnt FROM bt GROUP BY tag),
pair AS (SELECT CAST(a.tag AS VARCHAR) || ',' || CAST(b.tag AS VARCHAR) AS subset, 'pair' AS kind, count(*) AS cnt
         FROM bt a JOIN bt b ON a.id = b.id AND a.tag < b.tag GROUP BY a.tag, b.tag)
SELECT subset, kind, cnt FROM single, n WHERE cnt * {POPULAR_TAG_SHARE} > n.n
UNION ALL SELECT subset, kind, cnt FROM pair, n WHERE cnt * {POPULAR_PAIR_SHARE} > n.n""")
def popular_subsets(spark, sf):
    """Tags with frequency > N/10 and tag pairs co-occurring in > N/50 rows (subset build list)."""
    _, bt = _base_q(spark, sf)
    n = bt.count()
    post = P.postings(bt)
    single = post.groupBy("tag").agg(F.count(F.lit(1)).alias("cnt")) \
                 .where(F.col("cnt") * POPULAR_TAG_SHARE > n) \
                 .select(F.col("tag").cast("string").alias("subset"), F.lit("tag").alias("kind"), "cnt")
    # pairs from each row's own tag array (no join across rows)
    pairs = bt.select(F.explode(F.filter(
        F.flatten(F.transform("tags", lambda a: F.transform("tags", lambda b: F.when(a < b, F.concat_ws(",", a.cast("string"), b.cast("string")))))),
        lambda s: s.isNotNull())).alias("subset"))
    pair = pairs.groupBy("subset").agg(F.count(F.lit(1)).alias("cnt")) \
                .where(F.col("cnt") * POPULAR_PAIR_SHARE > n).select("subset", F.lit("pair").alias("kind"), "cnt")
    return single.unionByName(pair)


@register("csr_offsets", cte("tags") + """
SELECT id, nnz, CAST(coalesce(sum(nnz) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
FROM (SELECT id, count(*) AS nnz FROM tags GROUP BY id)""")
def csr_offsets(spark, sf):
    """CSR row pointer of the tag matrix: exclusive prefix sum of per-row tag counts in id order."""
    vec = fx.with_tag_array(fx.vectors(spark, sf))
    nnz = vec.select("id", F.size("tags").cast("long").alias("nnz"))
    return global_prefix_sum(nnz, "id", "nnz", "offset").select("id", "nnz", "offset")


@register("gen_tags_graded", cte("vectors") + """
SELECT id, CAST(j AS INTEGER) AS tag FROM vectors, range(19) r(j)
WHERE ((id * 2654435761 + (j + 1) * 40503) % 1000003) % 100 < 5 * (j + 1)""")
def gen_tags_graded(spark, sf):
    """Graded-selectivity tags: tag j on about 5(j+1) % of the rows (hash-seeded)."""
    from vecspark.sources import generators as G
    return G.graded_tags(fx.vectors(spark, sf).select("id"))


SIG_DESIGN_BITS = 16


@register("signature_design")
def signature_design(spark, sf):
    """Balanced word → bit assignment (greedy per bit; no SQL twin)."""
    _, bt = _base_q(spark, sf)
    return P.design_signatures(bt, SIG_DESIGN_BITS)


@register("filter_signature_designed", _filter_sql("len(f.ftags) = 0 OR list_has_all(bt.tags, f.ftags)"))
def filter_signature_designed(spark, sf):
    """AND filters with the designed signatures as pre-check: equal to the exact filter."""
    queries, bt = _base_q(spark, sf)
    return P.designed_signature_filter(bt, fx.filters_tag(queries, True), P.design_signatures(bt, SIG_DESIGN_BITS))
