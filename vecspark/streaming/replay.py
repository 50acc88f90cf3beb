"""Replayed operation logs: live sets, per-step search, tombstones, upserts, slot reuse.

The reference's streaming track is an ordered op log (insert range / delete range /
search), not event time.  Everything here is batch over the log; the
incremental Structured Streaming version is ``vecspark.streaming.incremental``.

Liveness: a row is live at search step ``s`` iff its last insert/delete before
``s`` is an insert.  Each insert event at step ``a`` whose next event for the
same id is at step ``b`` gives a live interval ``a < s < b``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecspark.operators import blockscan

RANGE_BUCKET = 1 << 16
INF_STEP = 2 ** 31 - 1


# ------------------------------------------------------------------ op-log (event) form

def tombstones(op_log: DataFrame) -> DataFrame:
    """Ids whose latest insert/delete is a delete."""
    return (op_log.where(F.col("op").isin("insert", "delete"))
                  .groupBy("id").agg(F.max_by("op", "seq").alias("last"))
                  .where(F.col("last") == "delete").select("id"))


def get_items(vectors: DataFrame, requested: DataFrame, tomb: DataFrame) -> DataFrame:
    """Fetch by label: ``status`` ok / missing / deleted, and the vector's dimension."""
    t = tomb.withColumn("_dead", F.lit(True))
    return (requested.join(vectors.select("id", "v"), "id", "left")
                     .join(t, "id", "left")
                     .select("id",
                             F.when(F.col("v").isNull(), "missing")
                              .when(F.col("_dead"), "deleted").otherwise("ok").alias("status"),
                             F.size("v").alias("dim"))
                     .withColumn("dim", F.when(F.col("status") == "missing", F.lit(None)).otherwise(F.col("dim"))))


SEQ_BUCKET = 1 << 20      # log positions per sub-bucket (bounds every per-label window)


def tombstone_log(op_log: DataFrame, bucket: int = SEQ_BUCKET) -> DataFrame:
    """Strict delete / un-delete semantics per op: state before, and outcome or error.

    insert: absent → insert, live → update, deleted → undelete;
    delete: live → delete, absent → error_unknown_label, deleted → error_already_deleted.

    The state before an op needs the label's previous op and whether it was ever
    inserted before.  A label may own a third of the log, so windows run inside
    (label, seq-bucket) groups and the carry-in from earlier buckets comes from a
    small per-(label, bucket) summary with its own prefix window.
    """
    ops = op_log.where(F.col("op").isin("insert", "delete")).withColumn("_b", (F.col("seq") / bucket).cast("long"))
    summ = ops.groupBy("id", "_b").agg(F.max_by("op", "seq").alias("_last"),
                                       F.sum(F.when(F.col("op") == "insert", 1).otherwise(0)).alias("_ni"))
    wb = Window.partitionBy("id").orderBy("_b")            # buckets of one label: few rows
    summ = summ.select("id", "_b", F.lag("_last").over(wb).alias("_carry_op"),
                       F.coalesce(F.sum("_ni").over(wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_carry_ni"))
    w = Window.partitionBy("id", "_b").orderBy("seq")      # one bounded bucket
    x = (ops.join(summ, ["id", "_b"])
            .withColumn("_prev", F.coalesce(F.lag("op").over(w), F.col("_carry_op")))
            .withColumn("_ins", F.col("_carry_ni") + F.coalesce(
                F.sum(F.when(F.col("op") == "insert", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0))))
    before = (F.when(F.col("_prev").isNull(), "absent")
               .when(F.col("_prev") == "insert", "live")
               .when(F.col("_ins") > 0, "deleted").otherwise("absent"))
    x = x.withColumn("before", before)
    outcome = F.when(F.col("op") == "insert",
                     F.when(F.col("before") == "absent", "insert")
                      .when(F.col("before") == "live", "update").otherwise("undelete")) \
               .otherwise(F.when(F.col("before") == "live", "delete")
                           .when(F.col("before") == "absent", "error_unknown_label")
                           .otherwise("error_already_deleted"))
    return x.select("seq", "id", "op", "before", outcome.alias("outcome"))


def upsert_latest(events: DataFrame) -> DataFrame:
    """Latest payload per label wins: ``(id, value, seq)`` of the last insert."""
    ins = events.where(F.col("op") == "insert")
    return ins.groupBy("id").agg(F.max("seq").alias("seq"), F.max_by("value", "seq").alias("value")) \
              .select("id", "value", "seq")


def replace_deleted(op_log: DataFrame, width: int = SEQ_BUCKET) -> DataFrame:
    """Slot reuse in log order: an insert of a label that is not live takes the slot that was freed first, if any is
    free at that moment, else a new slot.

    ``(seq, id, take, freed_seq, freed_id, new_slot)``: ``freed_*`` name the delete whose slot is reused (always
    earlier in the log); ``new_slot`` counts appended slots from 0.  Inserts of live labels are updates, deletes of
    labels that are not live do nothing.

    With d = +1 for a take and -1 for a free, a take appends exactly when it raises the running maximum of
    (running sum of d, 0); the other takes match the frees one by one.  Running sums and maxima use windows inside
    buckets of ``width`` log positions plus one row a bucket.
    """
    label = Window.partitionBy("id").orderBy("seq")
    e = (op_log.where(F.col("op").isin("insert", "delete")).withColumn("prev", F.lag("op").over(label))
               .withColumn("d", F.when((F.col("op") == "insert") & ~F.col("prev").eqNullSafe(F.lit("insert")), 1)
                                 .when((F.col("op") == "delete") & (F.col("prev") == "insert"), -1))
               .where(F.col("d").isNotNull()).withColumn("b", (F.col("seq") / width).cast("long")))
    at = Window.partitionBy("b").orderBy("seq")
    upto, before = at.rowsBetween(Window.unboundedPreceding, 0), at.rowsBetween(Window.unboundedPreceding, -1)
    e = (e.withColumn("s", F.sum("d").over(upto)).withColumn("takes", F.sum(F.greatest("d", F.lit(0))).over(upto))
          .withColumn("top", F.max("s").over(upto)).withColumn("top0", F.max("s").over(before)))
    tot = e.groupBy("b").agg(F.sum("d").alias("bs"), F.sum(F.greatest("d", F.lit(0))).alias("bt"), F.max("s").alias("bm"))
    prior = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)          # one row a bucket
    tot = (tot.withColumn("s0", F.coalesce(F.sum("bs").over(prior), F.lit(0))).withColumn("t0", F.coalesce(F.sum("bt").over(prior), F.lit(0)))
              .withColumn("m0", F.greatest(F.coalesce(F.max(F.col("s0") + F.col("bm")).over(prior), F.lit(0)), F.lit(0))))
    e = (e.join(tot.select("b", "s0", "t0", "m0"), "b")
          .withColumn("run", F.col("s0") + F.col("s")).withColumn("take", F.col("t0") + F.col("takes"))
          .withColumn("appended", F.greatest("m0", F.col("s0") + F.col("top")))
          .withColumn("appended0", F.greatest("m0", F.coalesce(F.col("s0") + F.col("top0"), F.col("m0")))))
    take = e.where("d = 1").select("seq", "id", "take", (F.col("take") - F.col("appended")).alias("m"),
                                   F.when(F.col("run") > F.col("appended0"), F.col("appended") - 1).alias("new_slot"))
    free = e.where("d = -1").select((F.col("take") - F.col("run")).alias("m"), F.col("seq").alias("freed_seq"), F.col("id").alias("freed_id"))
    j = take.join(free, (take.m == free.m) & take.new_slot.isNull(), "left")
    return j.select("seq", "id", "take", "freed_seq", "freed_id", "new_slot")


# ------------------------------------------------------------------ runbook form

def runbook_events(runbook: DataFrame, ids: DataFrame, width: int = RANGE_BUCKET) -> DataFrame:
    """``(id, step, op)`` for every id covered by an insert/delete range.

    Range join as an equi-join on id buckets: each op lists the buckets it
    covers, ids join on their bucket, then the exact bounds.
    """
    ops = (runbook.where(F.col("op").isin("insert", "delete") & (F.col("end") > F.col("start")))
                  .withColumn("bucket", F.explode(F.sequence(
                      (F.col("start") / width).cast("long"), ((F.col("end") - 1) / width).cast("long"))))
                  .select("bucket", "step", "op", "start", "end"))
    b = ids.select("id").withColumn("bucket", (F.col("id") / width).cast("long"))
    return (b.join(ops, "bucket")
             .where((F.col("id") >= F.col("start")) & (F.col("id") < F.col("end")))
             .select("id", "step", "op"))


def live_intervals(events: DataFrame) -> DataFrame:
    """``(id, a, b)``: live for search steps ``a < s < b``."""
    w = Window.partitionBy("id").orderBy("step")
    return (events.withColumn("b", F.coalesce(F.lead("step").over(w), F.lit(INF_STEP)))
                  .where(F.col("op") == "insert").select("id", F.col("step").alias("a"), "b"))


def search_steps(runbook: DataFrame) -> list[int]:
    """The runbook's search steps (a small control list)."""
    return [r[0] for r in runbook.where(F.col("op") == "search").select("step").orderBy("step").collect()]


def live_set_at_step(runbook: DataFrame, ids: DataFrame) -> DataFrame:
    """``(step, id)`` for each search step: the live set (union of inserts minus deletes so far)."""
    steps = F.array(*[F.lit(s) for s in search_steps(runbook)])
    iv = live_intervals(runbook_events(runbook, ids))
    return iv.select("id", F.explode(F.filter(steps, lambda s: (F.col("a") < s) & (s < F.col("b")))).alias("step")) \
             .select("step", "id")


def live_base(runbook: DataFrame, base: DataFrame) -> DataFrame:
    """Base rows with their live intervals as arrays (rows never inserted are dropped)."""
    iv = live_intervals(runbook_events(runbook, base.select("id")))
    spans = iv.groupBy("id").agg(F.collect_list("a").alias("live_a"), F.collect_list("b").alias("live_b"))
    return base.join(spans, "id")


def stream_knn_steps(runbook: DataFrame, base: DataFrame, queries: DataFrame, k: int = 10,
                     metric: str = "l2", vec: str = "v", qvec: str = "qv") -> DataFrame:
    """Exact k-NN of every query at every search step over that step's live set.

    One scan of the base serves all (step, query) pairs: the live-interval test
    is a mask inside the task.  Output ``(step, qid, rk, id, dist)``.
    """
    steps = search_steps(runbook)
    lb = live_base(runbook, base)
    # every (step, query) is a query of its own; the key table is written once, so its numbers stay the same
    sq = (queries.select(F.col("qid").alias("query"), qvec).withColumn("step", F.explode(F.array(*[F.lit(s) for s in steps])))
                 .withColumn("qid", F.monotonically_increasing_id()).checkpoint())
    part = blockscan.scan(lb, sq, k=k, metric=metric, vec=vec, qvec=qvec, live_filter=True)
    out = blockscan.rank_topk(part, k).join(sq.select("qid", "query", "step"), "qid")
    return out.select(F.col("step").cast("int").alias("step"), F.col("query").alias("qid"), "rk", "id", "dist")


# ------------------------------------------------------------------ runbook bookkeeping

def runbook_active(runbook: DataFrame) -> DataFrame:
    """Running active count after each step and the running maximum (``max_pts``).

    The runbook is a small control table; the window runs over its steps.
    """
    delta = F.when(F.col("op") == "insert", F.col("end") - F.col("start")) \
             .when(F.col("op") == "delete", -(F.col("end") - F.col("start"))).otherwise(F.lit(0))
    w = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    x = runbook.withColumn("delta", delta.cast("long")).withColumn("active", F.sum("delta").over(w))
    return x.withColumn("max_pts", F.max("active").over(w)).select("step", "op", "delta", "active", "max_pts")


def runbook_validate(runbook: DataFrame, max_pts: int) -> DataFrame:
    """Violations of the runbook rules: unknown op, missing/out-of-range bounds, a gap before a step
    (step > 1 whose predecessor is missing) and duplicated steps.  Equi-joins on ``step`` only — no
    window over the whole runbook, which may have one step per logged event."""
    steps = runbook.select("step")
    present = steps.distinct().select((F.col("step") + 1).alias("step"), F.lit(True).alias("_has_prev"))
    dup = steps.groupBy("step").agg(F.count(F.lit(1)).alias("_n"))
    x = runbook.join(present, "step", "left").join(dup, "step")
    rng = F.col("op").isin("insert", "delete")
    problem = (F.when(~F.col("op").isin("insert", "delete", "search"), "undefined operation")
                .when(rng & F.col("start").isNull(), "start not specified")
                .when(rng & F.col("end").isNull(), "end not specified")
                .when(rng & ((F.col("start") < 0) | (F.col("start") >= max_pts)), "start out of range")
                .when(rng & ((F.col("end") < 0) | (F.col("end") > max_pts)), "end out of range")
                .when(F.col("step") < 1, "non-contiguous step")
                .when((F.col("step") > 1) & F.col("_has_prev").isNull(), "non-contiguous step")
                .when(F.col("_n") > 1, "duplicate step"))
    return x.withColumn("problem", problem).where(F.col("problem").isNotNull()).select("step", "op", "problem")


def compaction_points(runbook: DataFrame, max_pts: int) -> DataFrame:
    """Steps at which deletes are consolidated: before an insert, ``active + pending >= max_pts``.

    ``pending`` resets after each consolidation, a recurrence over the (small)
    runbook summary; it is evaluated in one pandas group of that summary.
    """
    summ = runbook_active(runbook).select("step", "op", "delta", "active")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("step")
        pending, rows = 0, []
        for step, op, delta, active in pdf[["step", "op", "delta", "active"]].itertuples(index=False):
            fired = False
            if op == "insert" and active + pending >= max_pts:
                fired, pending = True, 0
            if op == "delete":
                pending += -delta
            rows.append((int(step), op, int(active), int(pending), fired))
        return pd.DataFrame(rows, columns=["step", "op", "active", "pending", "compacted"])

    return summ.withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(
        lambda pdf: run(pdf.drop(columns=["_g"])),
        "step int, op string, active long, pending long, compacted boolean")


def live_mask(live_a: pd.Series, live_b: pd.Series, steps: np.ndarray, b: int) -> np.ndarray:
    """(nq, b) mask: row live at the query's step (used inside the block scan)."""
    lengths = live_a.map(len).to_numpy()
    A = np.concatenate([np.asarray(x) for x in live_a]) if lengths.sum() else np.zeros(0)
    B = np.concatenate([np.asarray(x) for x in live_b]) if lengths.sum() else np.zeros(0)
    owner = np.repeat(np.arange(b), lengths)
    m = np.zeros((len(steps), b), dtype=bool)
    if len(A) == 0:
        return m
    hits = (A[None, :] < steps[:, None]) & (steps[:, None] < B[None, :])
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    nz = lengths > 0
    m[:, nz] = np.logical_or.reduceat(hits, starts[nz], axis=1)
    return m
