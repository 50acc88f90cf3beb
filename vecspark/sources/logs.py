"""Benchmark log files: written per run group, parsed back into metric rows.

A log holds header lines (index key, index size, build time), a result header
naming the measure columns, a separator line, then one line per parameter
setting: ``<parameters> <time ms/q> <R@1> <R@10> <R@100>``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed log line formats.
KEY_LINE = "build index, key="
SIZE_LINE = "index size on disk: "
ADD_LINE = "  add in "
RESULT_HEADER = "parameters time(ms/q)   R@1   R@10  R@100"
SEPARATOR = "----"
LOG_BUCKETS = 4


def write_run_logs(runs: DataFrame, folder: str) -> None:
    """One log file per (algorithm, dataset, run bucket); lines kept in order inside each file."""
    g = runs.withColumn("grp", F.concat_ws("_", "algorithm", "dataset", (F.col("run_id") % LOG_BUCKETS).cast("string")))
    head = g.groupBy("grp", "algorithm").agg(F.sum("indexsize").alias("size"), F.sum("build").alias("build"))
    lines = head.select("grp", F.lit(0).alias("o"), F.lit(0).cast("long").alias("r"),
                        F.concat(F.lit(KEY_LINE), "algorithm").alias("value")) \
        .unionByName(head.select("grp", F.lit(1).alias("o"), F.lit(0).cast("long").alias("r"),
                                 F.concat(F.lit(SIZE_LINE), F.col("size").cast("string")).alias("value"))) \
        .unionByName(head.select("grp", F.lit(2).alias("o"), F.lit(0).cast("long").alias("r"),
                                 F.concat(F.lit(ADD_LINE), F.format_string("%.3f", "build"), F.lit(" s")).alias("value"))) \
        .unionByName(head.select("grp", F.lit(3).alias("o"), F.lit(0).cast("long").alias("r"), F.lit(RESULT_HEADER).alias("value"))) \
        .unionByName(head.select("grp", F.lit(4).alias("o"), F.lit(0).cast("long").alias("r"), F.lit(SEPARATOR).alias("value"))) \
        .unionByName(g.select("grp", F.lit(5).alias("o"), F.col("run_id").alias("r"), F.format_string(
            "%s %.4f %.4f %.4f %.4f", F.concat(F.col("parameters"), F.lit("-"), F.col("run_id").cast("string")),
            F.col("mean_latency") * 1000.0, "recall", "recall", "recall").alias("value")))
    (lines.repartition("grp").sortWithinPartitions("grp", "o", "r").select("grp", "value")
          .write.mode("overwrite").partitionBy("grp").text(folder))


def parse_logs(spark: SparkSession, folder: str) -> DataFrame:
    """``(grp, indexkey, index_size, add_time, parameters, time_ms, r1, r10, r100)`` from every log file.

    Each file is one row (``wholetext``); lines are numbered with ``posexplode``, the
    result table starts two lines after the header line.
    """
    files = spark.read.text(folder, wholetext=True)
    lines = files.select("grp", F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    w = Window.partitionBy("grp")      # one log file
    lines = lines.withColumn("hpos", F.min(F.when(F.col("line").contains("time(ms/q)"), F.col("pos"))).over(w))
    stats = lines.groupBy("grp").agg(
        F.max(F.when(F.col("line").startswith(KEY_LINE), F.substring_index("line", "=", -1))).alias("indexkey"),
        F.max(F.when(F.col("line").startswith(SIZE_LINE),
                     F.element_at(F.split("line", " "), -1).cast("long"))).alias("index_size"),
        F.max(F.when(F.col("line").startswith(ADD_LINE),
                     F.element_at(F.split(F.trim("line"), " "), -2).cast("double"))).alias("add_time"))
    res = lines.where((F.col("pos") > F.col("hpos") + 1) & (F.length(F.trim("line")) > 0)) \
               .select("grp", F.split(F.trim("line"), " +").alias("f"))
    res = res.select("grp", F.col("f")[0].alias("parameters"), F.col("f")[1].cast("double").alias("time_ms"),
                     F.col("f")[2].cast("double").alias("r1"), F.col("f")[3].cast("double").alias("r10"),
                     F.col("f")[4].cast("double").alias("r100"))
    return res.join(stats, "grp")
