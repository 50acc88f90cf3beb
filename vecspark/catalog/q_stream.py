"""Catalog: replayed op logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecspark.catalog.oracle_fixtures import cte, l2
from vecspark.catalog.q_knn import TOPK
from vecspark.catalog.registry import register
from vecspark.operators import quality as Q
from vecspark.sources import fixtures as fx
from vecspark.streaming import incremental, replay

TRUTH_K = 100
CAPACITY_SHARE = 0.7     # compaction capacity = 70 % of the vectors


def _steps_sql(ids_from: str) -> str:
    return (f"ev AS (SELECT v.id, r.step, r.op FROM runbook r JOIN {ids_from} v ON v.id >= r.\"start\" AND v.id < r.\"end\" "
            "WHERE r.op IN ('insert', 'delete')),\n"
            "ss AS (SELECT step AS s FROM runbook WHERE op = 'search'),\n"
            "lastop AS (SELECT ss.s, ev.id, arg_max(ev.op, ev.step) AS op FROM ss JOIN ev ON ev.step < ss.s GROUP BY ss.s, ev.id),\n"
            "live AS (SELECT s AS step, id FROM lastop WHERE op = 'insert')")


@register("live_set_at_step", cte("vectors", "runbook", extra=_steps_sql("vectors")) + "SELECT step, id FROM live")
def live_set_at_step(spark, sf):
    return replay.live_set_at_step(fx.runbook(spark, sf), fx.vectors(spark, sf).select("id"))


def _step_knn_sql(k: int) -> str:
    return (cte("queries", "base", "runbook", extra=_steps_sql("base")) +
            "SELECT step, qid, rk, id, round(dist, 6) AS dist FROM (SELECT *, CAST(row_number() OVER (PARTITION BY step, qid "
            "ORDER BY dist, id) AS INTEGER) AS rk FROM (SELECT l.step, q.qid, b.id, "
            f"{l2('q.qv', 'b.v')} AS dist FROM live l JOIN base b ON b.id = l.id, queries q)) WHERE rk <= {k}")


def _step_knn(k):
    def q(spark, sf):
        queries, base = fx.split(fx.vectors(spark, sf))
        out = replay.stream_knn_steps(fx.runbook(spark, sf), base, queries, k)
        return out.withColumn("dist", F.round("dist", 6))
    return q


register("stream_knn_steps", _step_knn_sql(TOPK))(_step_knn(TOPK))
register("stream_truth", _step_knn_sql(TRUTH_K))(_step_knn(TRUTH_K))


# ------------------------------------------------------------------ E25, E26: recall across search steps

def _step_recall(spark, sf):
    """Per (step, query) recall@10 with ties of a 4-bit-code search against exact uint8 truth."""
    u8 = fx.vectors_u8(spark, sf)
    c4 = u8.select("id", F.transform("v", lambda x: (x / 16).cast("int")).alias("v"), "label")
    rb = fx.runbook(spark, sf)
    qu, bu = fx.split(u8)
    qc, bc = fx.split(c4)
    truth = replay.stream_knn_steps(rb, bu, qu, TRUTH_K)
    run = replay.stream_knn_steps(rb, bc, qc, TOPK)

    def enc(df):
        return df.withColumn("qid", F.struct(F.col("step").cast("int").alias("step"), F.col("qid").alias("q")))
    ext = Q.tie_extended_truth(enc(truth), TOPK).select("qid", "id").withColumn("_t", F.lit(1))
    hits = enc(run).select("qid", "id").join(ext, ["qid", "id"]).groupBy("qid").agg(F.count(F.lit(1)).alias("h"))
    qs = enc(truth).select("qid").distinct()
    per = qs.join(hits, "qid", "left").fillna({"h": 0})
    return per.select(F.col("qid.step").alias("step"), (F.col("h") / TOPK).alias("recall"))


_STEP_RECALL_SQL = (
    "u8 AS (SELECT id, list_transform(v, lambda x: CAST(floor((x + 1.0) * 127.5) AS INTEGER)) AS v FROM vectors),\n"
    "c4 AS (SELECT id, list_transform(v, lambda x: x // 16) AS v FROM u8),\n"
    + _steps_sql("(SELECT id FROM vectors WHERE id % 25 <> 0)") + ",\n"
    "pt AS (SELECT l.step, q.id AS qid, b.id, CAST(list_sum(list_transform(list_zip(q.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS DOUBLE) AS dist "
    "FROM live l JOIN u8 b ON b.id = l.id, u8 q WHERE q.id % 25 = 0),\n"
    f"truth AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY step, qid ORDER BY dist, id) AS rk FROM pt) WHERE rk <= {TRUTH_K}),\n"
    "pr AS (SELECT l.step, q.id AS qid, b.id, CAST(list_sum(list_transform(list_zip(q.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS DOUBLE) AS dist "
    "FROM live l JOIN c4 b ON b.id = l.id, c4 q WHERE q.id % 25 = 0),\n"
    f"run AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY step, qid ORDER BY dist, id) AS rk FROM pr) WHERE rk <= {TOPK}),\n"
    "tt AS (SELECT t.*, max(CASE WHEN rk = 10 THEN dist END) OVER (PARTITION BY step, qid) AS dk FROM truth t),\n"
    "brk AS (SELECT step, qid, min(CASE WHEN rk > 10 AND abs(dk - dist) >= 1e-6 THEN rk END) AS b, max(rk) AS sz FROM tt GROUP BY step, qid),\n"
    "endq AS (SELECT step, qid, CASE WHEN sz <= 10 THEN 10 ELSE coalesce(b - 1, sz) END AS e FROM brk),\n"
    "per AS (SELECT e.step, e.qid, (SELECT count(*) FROM run r JOIN truth t ON t.step = r.step AND t.qid = r.qid AND t.id = r.id "
    "WHERE r.step = e.step AND r.qid = e.qid AND t.rk <= e.e) / 10.0 AS recall FROM endq e),\n"
    "st AS (SELECT step, avg(recall) AS recall FROM per GROUP BY step)")


@register("stream_recall", cte("vectors", "runbook", extra=_STEP_RECALL_SQL) +
          "SELECT round(avg(recall), 6) AS mean_recall, count(*) AS search_steps FROM st")
def stream_recall(spark, sf):
    """Mean over search steps of the step's mean recall@10 (ties counted)."""
    st = _step_recall(spark, sf).groupBy("step").agg(F.avg("recall").alias("recall"))
    return st.agg(F.round(F.avg("recall"), 6).alias("mean_recall"), F.count(F.lit(1)).alias("search_steps"))


@register("recall_over_steps", cte("vectors", "runbook", extra=_STEP_RECALL_SQL) +
          "SELECT step, round(recall, 6) AS recall, round(first_value(recall) OVER (ORDER BY step) - recall, 6) AS drop_from_first, "
          "round(min(recall) OVER (), 6) AS min_recall, round(max(recall) OVER (), 6) AS max_recall FROM st")
def recall_over_steps(spark, sf):
    from pyspark.sql import Window
    st = _step_recall(spark, sf).groupBy("step").agg(F.avg("recall").alias("recall"))   # one row per search step
    w = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return st.select("step", F.round("recall", 6).alias("recall"),
                     F.round(F.first("recall").over(w) - F.col("recall"), 6).alias("drop_from_first"),
                     F.round(F.min("recall").over(w), 6).alias("min_recall"),
                     F.round(F.max("recall").over(w), 6).alias("max_recall"))


# ------------------------------------------------------------------ J4-J7, F7, A13: op-log semantics

@register("tombstone_log", cte("op_log") + """
, x AS (SELECT *, lag(op) OVER (PARTITION BY id ORDER BY seq) AS prev,
          coalesce(sum(CASE WHEN op = 'insert' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ins
        FROM op_log WHERE op IN ('insert', 'delete')),
y AS (SELECT seq, id, op, CASE WHEN prev IS NULL THEN 'absent' WHEN prev = 'insert' THEN 'live' WHEN ins > 0 THEN 'deleted' ELSE 'absent' END AS before FROM x)
SELECT seq, id, op, before, CASE WHEN op = 'insert' THEN (CASE WHEN before = 'absent' THEN 'insert' WHEN before = 'live' THEN 'update' ELSE 'undelete' END)
  ELSE (CASE WHEN before = 'live' THEN 'delete' WHEN before = 'absent' THEN 'error_unknown_label' ELSE 'error_already_deleted' END) END AS outcome FROM y""")
def tombstone_log(spark, sf):
    return replay.tombstone_log(fx.op_log(spark, sf))


@register("upsert_latest", cte("op_log") + """
SELECT o.id, arg_max(e.value, o.seq) AS value, max(o.seq) AS seq FROM op_log o JOIN events e ON e.event_id = o.seq
WHERE o.op = 'insert' GROUP BY o.id""")
def upsert_latest(spark, sf):
    ev = fx.op_log(spark, sf).join(fx.read(spark, sf, "events").select(F.col("event_id").alias("seq"), "value"), "seq")
    return replay.upsert_latest(ev)


@register("replace_deleted", cte("op_log") + """
, ev AS (SELECT seq, id, op, lag(op) OVER (PARTITION BY id ORDER BY seq) AS prev FROM op_log WHERE op IN ('insert', 'delete')),
e AS (SELECT seq, id, CASE WHEN op = 'insert' AND prev IS DISTINCT FROM 'insert' THEN 1 WHEN op = 'delete' AND prev = 'insert' THEN -1 END AS d FROM ev),
r AS (SELECT *, sum(d) OVER w AS run, sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) OVER w AS take, sum(CASE WHEN d < 0 THEN 1 ELSE 0 END) OVER w AS frees
      FROM e WHERE d IS NOT NULL WINDOW w AS (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
t AS (SELECT *, greatest(0, max(run) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS app,
             greatest(0, coalesce(max(run) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS app0 FROM r)
SELECT a.seq, a.id, CAST(a.take AS BIGINT) AS take, f.seq AS freed_seq, f.id AS freed_id,
       CAST(CASE WHEN a.run > a.app0 THEN a.app - 1 END AS BIGINT) AS new_slot
FROM t a LEFT JOIN t f ON f.d = -1 AND f.frees = a.take - a.app AND NOT a.run > a.app0 WHERE a.d = 1""")
def replace_deleted(spark, sf):
    return replay.replace_deleted(fx.op_log(spark, sf))


@register("runbook_active", cte("runbook") + """
SELECT step, op, delta, CAST(sum(delta) OVER w AS BIGINT) AS active, CAST(max(a) OVER w AS BIGINT) AS max_pts FROM (
  SELECT *, sum(delta) OVER w AS a FROM (SELECT step, op, CAST(CASE WHEN op = 'insert' THEN "end" - "start" WHEN op = 'delete' THEN -("end" - "start") ELSE 0 END AS BIGINT) AS delta FROM runbook)
  WINDOW w AS (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
WINDOW w AS (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def runbook_active(spark, sf):
    return replay.runbook_active(fx.runbook(spark, sf))


def _events_runbook(spark, sf):
    """A long runbook from the events table: one step per event (ranges from user id and value)."""
    ev = fx.op_log(spark, sf).join(fx.read(spark, sf, "events").select(F.col("event_id").alias("seq"), "value"), "seq")
    rng = F.col("op").isin("insert", "delete")
    return ev.select((F.col("seq") + 1).cast("int").alias("step"), "op",
                     F.when(rng, F.col("id")).alias("start"),
                     F.when(rng, F.col("id") + 1 + F.col("value").cast("long") % 3).alias("end"))


@register("runbook_validate", cte("op_log") + """
, rb AS (SELECT CAST(o.seq + 1 AS INTEGER) AS step, o.op, CASE WHEN o.op IN ('insert', 'delete') THEN o.id END AS "start",
          CASE WHEN o.op IN ('insert', 'delete') THEN o.id + 1 + CAST(trunc(e.value) AS BIGINT) % 3 END AS "end"
        FROM op_log o JOIN events e ON e.event_id = o.seq),
mp AS (SELECT max(user_id) + 1 AS m FROM events),
x AS (SELECT rb.*, (SELECT count(*) FROM rb r2 WHERE r2.step = rb.step - 1) > 0 AS has_prev,
             (SELECT count(*) FROM rb r3 WHERE r3.step = rb.step) AS n FROM rb)
SELECT step, op, problem FROM (SELECT step, op, CASE
  WHEN op NOT IN ('insert', 'delete', 'search') THEN 'undefined operation'
  WHEN op IN ('insert', 'delete') AND "start" IS NULL THEN 'start not specified'
  WHEN op IN ('insert', 'delete') AND "end" IS NULL THEN 'end not specified'
  WHEN op IN ('insert', 'delete') AND ("start" < 0 OR "start" >= mp.m) THEN 'start out of range'
  WHEN op IN ('insert', 'delete') AND ("end" < 0 OR "end" > mp.m) THEN 'end out of range'
  WHEN step < 1 THEN 'non-contiguous step'
  WHEN step > 1 AND NOT has_prev THEN 'non-contiguous step'
  WHEN n > 1 THEN 'duplicate step' END AS problem FROM x, mp) WHERE problem IS NOT NULL""")
def runbook_validate(spark, sf):
    max_pts = fx.read(spark, sf, "events").agg(F.max("user_id")).first()[0] + 1
    return replay.runbook_validate(_events_runbook(spark, sf), max_pts)


@register("compaction_points", (cte("runbook") + """
, s AS (SELECT step, op, delta, CAST(sum(delta) OVER (ORDER BY step) AS BIGINT) AS active, row_number() OVER (ORDER BY step) AS i
        FROM (SELECT step, op, CAST(CASE WHEN op = 'insert' THEN "end" - "start" WHEN op = 'delete' THEN -("end" - "start") ELSE 0 END AS BIGINT) AS delta FROM runbook)),
cap AS (SELECT (count(*) * 7) // 10 AS cap FROM embeddings),
rec AS (SELECT s.i, s.step, s.op, s.active,
               CAST(CASE WHEN s.op = 'delete' THEN -s.delta ELSE 0 END AS BIGINT) AS pending,
               (s.op = 'insert' AND s.active >= cap.cap) AS compacted FROM s, cap WHERE s.i = 1
        UNION ALL
        SELECT s.i, s.step, s.op, s.active,
               CAST(CASE WHEN s.op = 'insert' AND s.active + r.pending >= cap.cap THEN 0 ELSE r.pending END
                    + CASE WHEN s.op = 'delete' THEN -s.delta ELSE 0 END AS BIGINT),
               (s.op = 'insert' AND s.active + r.pending >= cap.cap)
        FROM rec r JOIN s ON s.i = r.i + 1, cap)
SELECT step, op, active, pending, compacted FROM rec""").replace("WITH ", "WITH RECURSIVE ", 1))
def compaction_points(spark, sf):
    """Consolidation steps of the runbook: before an insert, live + pending deletes >= capacity (70 % of vectors)."""
    cap = fx.read(spark, sf, "embeddings").count() * 7 // 10
    return replay.compaction_points(fx.runbook(spark, sf), cap)


@register("stream_live_set", cte("op_log") + """
SELECT id FROM (SELECT id, arg_max(op, seq) AS op FROM op_log WHERE op IN ('insert', 'delete') GROUP BY id) WHERE op = 'insert'""")
def stream_live_set(spark, sf):
    """Structured Streaming replay of the op log (file source, foreachBatch merge); final live ids."""
    return incremental.stream_live_set(spark, fx.op_log(spark, sf))


SWITCH_SHARE = 0.5    # re-partition once the live set exceeds half the vectors


@register("stream_strategy", cte("vectors", "runbook", extra=_steps_sql("(SELECT id FROM vectors WHERE id % 25 <> 0)")) + f"""
, n AS (SELECT count(*) AS n FROM vectors WHERE id % 25 <> 0)
SELECT s.s AS step, count(l.id) AS live, CASE WHEN count(l.id) > {SWITCH_SHARE} * max(n.n) THEN 'partitioned' ELSE 'brute' END AS strategy
FROM ss s LEFT JOIN live l ON l.step = s.s, n GROUP BY s.s""")
def stream_strategy(spark, sf):
    """Per search step: live-set size and the search strategy it selects (brute force below the limit)."""
    queries, base = fx.split(fx.vectors(spark, sf))
    rb = fx.runbook(spark, sf)
    n = base.count()
    live = replay.live_set_at_step(rb, base.select("id")).groupBy("step").agg(F.count(F.lit(1)).alias("live"))
    steps = rb.where(F.col("op") == "search").select(F.col("step"))
    x = steps.join(live, "step", "left").fillna({"live": 0})
    return x.select("step", "live", F.when(F.col("live") > SWITCH_SHARE * n, "partitioned").otherwise("brute").alias("strategy"))


@register("runbook_generate")
def runbook_generate(spark, sf):
    """Clustered runbook over cluster-contiguous ids (hash-seeded shares; no SQL twin)."""
    from vecspark.operators import cells as C
    from vecspark.sources import generators as G
    from vecspark.operators.ranking import per_group_offsets
    vec = fx.vectors(spark, sf)
    cents = fx.centroids(vec)
    a = C.assign(vec, cents)
    counts = a.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    cells = per_group_offsets(counts, "cell")
    return G.runbook_from_cells(cells)
