"""Global positions without a single-partition window.

``row_number() over (order by ...)`` with no partition key moves every row to one
task.  Instead: split the ordering into bounded sub-buckets, count each
(small table), take prefix sums of the counts (window over the *counts* only),
and add a row_number inside each bounded sub-bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUB_BUCKET = 1 << 20   # rows of one ordering sub-bucket (bounds the per-task window)


def global_row_number(df: DataFrame, keys: list[str], order: str, out: str = "pos",
                      bucket_width: int | None = None) -> DataFrame:
    """1-based position of each row in the order ``(keys..., order)``.

    ``order`` must be an integral column; rows are sub-bucketed by ``order div width``
    so that no window partition holds more than one sub-bucket.
    """
    width = bucket_width or SUB_BUCKET
    sub = (F.col(order) / F.lit(width)).cast("long")
    b = df.withColumn("_sub", sub)
    counts = b.groupBy(*keys, "_sub").agg(F.count(F.lit(1)).alias("_n"))
    wo = Window.orderBy(*keys, "_sub").rowsBetween(Window.unboundedPreceding, -1)
    # the counts table has at most (#keys * #sub-buckets) rows
    offs = counts.withColumn("_off", F.coalesce(F.sum("_n").over(wo), F.lit(0))).drop("_n")
    w = Window.partitionBy(*keys, "_sub").orderBy(order)
    return (b.join(offs, [*keys, "_sub"])
             .withColumn(out, F.col("_off") + F.row_number().over(w))
             .drop("_sub", "_off"))


def per_group_offsets(counts: DataFrame, key: str, n: str = "n", out: str = "offset") -> DataFrame:
    """Exclusive prefix sums over a small counts table (CSR indptr / cluster offsets)."""
    w = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(out, F.coalesce(F.sum(n).over(w), F.lit(0)).cast("long"))


def first_true_index(cond: Column, order: str, part: str) -> Column:
    """Smallest ``order`` value in the partition where ``cond`` holds (null if none)."""
    return F.min(F.when(cond, F.col(order))).over(Window.partitionBy(part))


def global_prefix_sum(df: DataFrame, order: str, value: str, out: str = "offset",
                      bucket_width: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """Exclusive running sum of ``value`` in the order ``(keys..., order)`` (CSR indptr) with bounded windows.

    Per-sub-bucket totals are prefix-summed on the small totals table; inside a
    sub-bucket a running window adds the local part.
    """
    width = bucket_width or SUB_BUCKET
    b = df.withColumn("_sub", (F.col(order) / F.lit(width)).cast("long"))
    sub = [*(keys or []), "_sub"]
    tot = b.groupBy(*sub).agg(F.sum(value).alias("_t"))
    wo = Window.orderBy(*sub).rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.withColumn("_off", F.coalesce(F.sum("_t").over(wo), F.lit(0))).drop("_t")
    w = Window.partitionBy(*sub).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (b.join(offs, sub)
             .withColumn(out, (F.col("_off") + F.coalesce(F.sum(value).over(w), F.lit(0))).cast("long"))
             .drop("_sub", "_off"))


def ordered_positions(df: DataFrame, order: list[str], bucket: Column, out: str = "pos") -> DataFrame:
    """1-based global position in ``order``; ``bucket`` must be a long that is monotone in that order.

    Counts per bucket are prefix-summed (small table); row_number runs inside a bucket.
    """
    b = df.withColumn("_b", bucket.cast("long"))
    counts = b.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    wo = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.withColumn("_off", F.coalesce(F.sum("_n").over(wo), F.lit(0))).drop("_n")
    w = Window.partitionBy("_b").orderBy(*order)
    return (b.join(offs, "_b").withColumn(out, F.col("_off") + F.row_number().over(w))
             .drop("_b", "_off"))
