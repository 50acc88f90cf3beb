"""Mixing sources to target weights: temperature, bisected exponent, budgeted block permutations (DataFrame functions only).

Source shares of the tokens, p, become weights w ~ p^alpha (alpha = 1 keeps the shares, alpha = 0 makes them even).
alpha is bisected on a dyadic grid: with ``max_repeats`` to the least alpha (the evenest mix) whose most repeated
source still is repeated at most so often; with ``target_entropy`` to the largest alpha whose weights reach that
share of the greatest possible entropy.  If both are given, both must hold and the repetition limit wins.

A source's quota w * budget is realised as whole epochs over all its documents and a part of one more.  Every epoch
walks the source in another pseudo-random order (md5 of seed, epoch and doc_id).  The running token count places each
draw in one of the blocks, proportionally, so every block holds each source at its weight; inside a block the draws
are permuted again.

How it scales: token counts are combined before the shuffle by source; every bisection pass is one aggregate that
returns a few sums (never the sources) to the driver; running counts use windows over hash-prefix buckets, at most
65536 for each source and epoch, so one source may hold most rows; only (doc_id, source, n_tokens) is shuffled.

Edge cases: a null text has no tokens; a null source counts as the empty string; a null doc_id is an id of its own;
rows with equal doc_id and source are drawn together (ties of the order's md5 go by doc_id); a very long text is one draw, which
may run over its block's and its quota's end; documents without tokens follow their neighbours in the order;
an empty table, or one without tokens, draws nothing; a budget beyond what the limit allows is lowered to it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecspark.llm import common

WORD = r"[^\x20\x09-\x0D]+"
GRID_BITS = 4                  # bits of alpha found by one aggregate
PASSES = 7                     # 28 bits in all


@dataclass(frozen=True)
class Mix:
    """What the weights came out as."""
    alpha: float
    budget: int
    total: int
    scale: float               # sum of p^alpha


def units(docs: DataFrame) -> DataFrame:
    """(source, doc_id, n_tokens): tokens of all rows of an id within a source."""
    return (docs.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
                        F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"))
            .groupBy("source", "doc_id").agg(F.sum("n_tokens").alias("n_tokens")))


def fit(sources: DataFrame, budget_ratio: float = 1.0, max_repeats: float | None = None,
        target_entropy: float | None = None) -> Mix | None:
    """Bisect alpha over ``sources`` (source, tokens); None if there are no tokens."""
    live = sources.filter("tokens > 0")
    total, n, least = live.agg(F.sum("tokens"), F.count(F.lit(1)), F.min("tokens")).first()
    if not total:
        return None
    budget = int(total * budget_ratio)
    if max_repeats is not None:
        budget = min(budget, int(total * max_repeats))
    p = F.col("tokens") / F.lit(float(total))

    def sums(alphas: list[float]) -> list[tuple[float, float]]:
        cols: list[Column] = []
        for a in alphas:
            w = F.pow(p, F.lit(a))
            cols += [F.sum(w), F.sum(w * F.log(p))]
        got = live.agg(*cols).first()
        return [(got[2 * i], got[2 * i + 1]) for i in range(len(alphas))]

    def bisect(high_side) -> tuple[float, float]:
        """Bracket (lo, hi) of the switch of ``high_side(alpha, sums)`` from False to True on [0, 1]."""
        lo, width = 0, 1 << (GRID_BITS * PASSES)
        if high_side(0.0, sums([0.0])[0]):
            return 0.0, 0.0
        for _ in range(PASSES):
            width >>= GRID_BITS
            steps = [lo + i * width for i in range(1, 1 << GRID_BITS)]
            grid = [s / (1 << (GRID_BITS * PASSES)) for s in steps]
            for s, a, x in zip(steps, grid, sums(grid), strict=True):
                if high_side(a, x):
                    break
                lo = s
        return lo / (1 << (GRID_BITS * PASSES)), (lo + 1) / (1 << (GRID_BITS * PASSES))

    import math
    p_min = least / float(total)
    alpha = 1.0
    if target_entropy is not None:
        aim = target_entropy * math.log(n)
        alpha = bisect(lambda a, x: math.log(x[0]) - a * x[1] / x[0] < aim)[0]
    if max_repeats is not None:
        least_alpha = bisect(lambda a, x: p_min ** (a - 1) / x[0] * budget / total <= max_repeats)[1]
        alpha = least_alpha if target_entropy is None else max(alpha, least_alpha)
    return Mix(alpha, budget, int(total), sums([alpha])[0][0])


def draws(docs: DataFrame, budget_ratio: float = 1.0, max_repeats: float | None = None, target_entropy: float | None = None,
          block_tokens: int = 1 << 20, seed: int = 2) -> DataFrame:
    """(doc_id, source, epoch, n_tokens, block, place): the mixed sequence, one row a draw.

    ``block`` runs from 0; ``place`` is the draw's order within its block, from 1.
    """
    u = common.stored(units(docs), "units")
    sources = common.stored(u.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "sources")
    mix = fit(sources, budget_ratio, max_repeats, target_entropy)
    shape = "doc_id long, source string, epoch int, n_tokens long, block long, place int"
    if mix is None:
        return u.sparkSession.createDataFrame([], shape)
    share = F.pow(F.col("tokens") / F.lit(float(mix.total)), F.lit(mix.alpha)) / F.lit(mix.scale)
    quota = (sources.filter("tokens > 0").select("source", "tokens", F.floor(share * F.lit(float(mix.budget))).cast("long").alias("quota"))
             .filter("quota > 0"))
    n_blocks = max(1, -(-mix.budget // block_tokens))
    each = (u.join(quota, "source")
            .withColumn("epoch", F.explode(F.expr("sequence(0, cast((quota - 1) div tokens as int))")))
            .withColumn("key", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epoch").cast("string"), common.id_text("doc_id"))))
            .withColumn("bucket", F.substring("key", 1, 4)))
    within = Window.partitionBy("source", "epoch", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("source", "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = (each.groupBy("source", "epoch", "bucket").agg(F.sum("n_tokens").alias("t"))
            .select("source", "epoch", "bucket", F.coalesce(F.sum("t").over(over), F.lit(0)).alias("base")))
    placed = (each.withColumn("inner", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
              .join(base, ["source", "epoch", "bucket"])
              .withColumn("before", F.col("epoch") * F.col("tokens") + F.col("base") + F.col("inner"))
              .filter("before < quota")
              .withColumn("block", F.floor(F.col("before").cast("double") / F.col("quota") * F.lit(float(n_blocks))).cast("long")))
    order = Window.partitionBy("block").orderBy("key", "source", "doc_id", "epoch")
    return placed.select("doc_id", "source", "epoch", "n_tokens", "block", F.row_number().over(order).alias("place"))


def mixed(docs: DataFrame, **mix) -> DataFrame:
    """The rows of ``docs``, each as often as it is drawn (all its columns, whatever their names)."""
    d = draws(docs, **mix).select("doc_id", "source")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"), F.col("doc_id").cast("long").alias("__id"),
                       F.coalesce(F.col("source").cast("string"), F.lit("")).alias("__source"))
    on = F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__source") == F.col("source"))
    return rows.join(d, on).select("record.*")
