"""Incremental live set with Structured Streaming, resumable after a restart.

The op log arrives as files.  Every micro-batch reduces its ops to the latest ``(seq, op)`` per id and writes that
delta under its epoch; the live set is the latest op per id over all deltas.  A batch writes only what it holds,
replaying it overwrites the same folder with the same rows, and "largest seq wins" does not depend on the order of
files or batches.  All progress is in ``root`` (deltas) and the stream's checkpoint below it, none in the driver, so
a restarted or a new driver goes on with the next file.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.session import shared_dir

DELTA = "id long, seq long, op string"
OPS = "seq long, id long, op string"


def latest(ops: DataFrame) -> DataFrame:
    """``(id, seq, op)`` of the last insert or delete of each id."""
    return (ops.where(F.col("op").isin("insert", "delete"))
               .groupBy("id").agg(F.max_by(F.struct("seq", "op"), "seq").alias("s"))
               .select("id", "s.seq", "s.op"))


def live_ids(spark: SparkSession, root: str) -> DataFrame:
    """Ids whose latest op over all deltas under ``root`` is an insert."""
    return latest(spark.read.schema(DELTA).parquet(f"{root}/delta/*")).where(F.col("op") == "insert").select("id")


def run(spark: SparkSession, source: str, root: str, search: Callable[[DataFrame], DataFrame] | None = None,
        files_per_batch: int = 1) -> None:
    """Take in all op files under ``source`` that ``root`` has not seen.

    With ``search``, every batch also writes ``search(live ids)`` under ``root/results`` by its epoch.
    """
    # a first delta without rows, so that the live set exists before any batch
    spark.createDataFrame([], DELTA).write.mode("overwrite").parquet(f"{root}/delta/epoch=none")

    def take(batch: DataFrame, epoch: int) -> None:
        latest(batch).write.mode("overwrite").parquet(f"{root}/delta/epoch={epoch}")
        if search is not None:
            search(live_ids(spark, root)).write.mode("overwrite").parquet(f"{root}/results/epoch={epoch}")

    q = (spark.readStream.schema(OPS).option("maxFilesPerTrigger", files_per_batch).parquet(source)
              .writeStream.foreachBatch(take).option("checkpointLocation", f"{root}/checkpoint")
              .trigger(availableNow=True).start())
    q.awaitTermination()


def stream_live_set(spark: SparkSession, op_log: DataFrame) -> DataFrame:
    """Replay ``op_log(seq, id, op)`` through a file stream; return the final live ids."""
    root = shared_dir(spark, f"stream-{uuid.uuid4().hex[:12]}")
    op_log.select("seq", "id", "op").repartitionByRange("seq").write.parquet(f"{root}/in")
    run(spark, f"{root}/in", root)
    return live_ids(spark, root)
