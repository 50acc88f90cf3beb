"""Catalog: scans and binary sources/sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vecspark.catalog.oracle_fixtures import cte
from vecspark.catalog.registry import register
from vecspark.session import posix_dir, shared_dir
from vecspark.sources import binary as B
from vecspark.sources import fixtures as fx

N_SPLITS, SPLIT_PART = 4, 1


def _summary(df):
    return df.select("id", F.size("v").alias("dim"),
                     F.round(F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm2"))


_SUMMARY_SQL = "SELECT id, CAST(len(v) AS INTEGER) AS dim, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS norm2 FROM vectors"


@register("shard_scan", cte("vectors") + f"""
SELECT id, label FROM vectors, (SELECT count(*) AS nb FROM vectors) n
WHERE id >= n.nb * {SPLIT_PART} // {N_SPLITS} AND id < n.nb * {SPLIT_PART + 1} // {N_SPLITS}""")
def shard_scan(spark, sf):
    """Split (n, p): ids ``[nb·p // n, nb·(p+1) // n)`` — a pushed-down range filter."""
    vec = fx.vectors(spark, sf)
    nb = vec.count()
    lo, hi = nb * SPLIT_PART // N_SPLITS, nb * (SPLIT_PART + 1) // N_SPLITS
    return vec.where((F.col("id") >= lo) & (F.col("id") < hi)).select("id", "label")


@register("crop_scan", cte("vectors") + "SELECT id, label FROM vectors WHERE id < (SELECT count(*) FROM vectors) // 2")
def crop_scan(spark, sf):
    """Crop to the first nb rows (nb = half the set here)."""
    vec = fx.vectors(spark, sf)
    return vec.where(F.col("id") < vec.count() // 2).select("id", "label")


@register("range_scan", cte("vectors") + "SELECT id, label FROM vectors, (SELECT count(*) AS nb FROM vectors) n "
          "WHERE id >= n.nb // 5 AND id < 2 * n.nb // 5")
def range_scan(spark, sf):
    """Positional range read ``[start, end)`` = ``[nb/5, 2nb/5)``."""
    vec = fx.vectors(spark, sf)
    nb = vec.count()
    return vec.where((F.col("id") >= nb // 5) & (F.col("id") < 2 * nb // 5)).select("id", "label")


@register("xbin_roundtrip", cte("vectors") + _SUMMARY_SQL)
def xbin_roundtrip(spark, sf):
    """Vectors written as per-partition fbin files and read back by byte ranges."""
    folder = posix_dir(spark, f"xbin-{uuid.uuid4().hex[:12]}")
    B.write_xbin(fx.vectors(spark, sf), folder)
    return _summary(B.read_xbin_folder(spark, folder))


@register("fvecs_roundtrip", cte("vectors") + _SUMMARY_SQL)
def fvecs_roundtrip(spark, sf):
    """Vectors written as one fvecs file at computed offsets and read back in blocks."""
    import os
    folder = posix_dir(spark, f"fvecs-{uuid.uuid4().hex[:12]}")
    path = os.path.join(folder, "vectors.fvecs")
    B.write_fvecs(fx.vectors(spark, sf), path)
    return _summary(B.read_fvecs(spark, path, block_rows=128))


def _qorder(queries):
    from vecspark.operators.ranking import global_row_number
    q = queries.select("qid").withColumn("_k", F.lit(0))
    return global_row_number(q, ["_k"], "qid", "qpos").select("qid", (F.col("qpos") - 1).alias("qpos"))


@register("knn_truth_roundtrip", cte("queries", "base") +
          "SELECT qid, rk, id FROM (SELECT q.qid, b.id, CAST(row_number() OVER (PARTITION BY q.qid ORDER BY "
          "list_sum(list_transform(list_zip(q.qv, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.id) AS INTEGER) AS rk "
          "FROM queries q, base b) WHERE rk <= 10")
def knn_truth_roundtrip(spark, sf):
    """Exact truth written as an ids-then-distances binary file at computed offsets, read back by query blocks."""
    import os
    from vecspark.operators import knn as K
    queries, base = fx.split(fx.vectors(spark, sf))
    folder = posix_dir(spark, f"truth-{uuid.uuid4().hex[:12]}")
    path = os.path.join(folder, "truth.ibin")
    qo = _qorder(queries).checkpoint()
    B.write_knn_usbin(K.knn(base, queries, 10), qo, path, 10)
    back = B.read_knn_usbin(spark, path, block_queries=8)
    return back.join(qo, "qpos").select("qid", "rk", "id")


@register("range_result_roundtrip", cte("queries", "base") +
          "SELECT q.qid, b.id FROM queries q, base b WHERE "
          "list_sum(list_transform(list_zip(q.qv, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) < 1.5")
def range_result_roundtrip(spark, sf):
    """Ragged range result (counts, ids, distances) written at computed offsets and read back."""
    import os
    from vecspark.operators import knn as K
    queries, base = fx.split(fx.vectors(spark, sf))
    folder = posix_dir(spark, f"range-{uuid.uuid4().hex[:12]}")
    path = os.path.join(folder, "range.rbin")
    qo = _qorder(queries).checkpoint()
    B.write_range(K.range_search(base, queries, 1.5), qo, path)
    back = B.read_range(spark, path, block_queries=8)
    return back.join(qo, "qpos").select("qid", "id")


@register("sorted_normal_attrs", cte("vectors") + """
, z AS (SELECT id,
   sqrt(-2.0 * ln((CAST((id * 2654435761 + 40503 * 1) % 1000003 AS DOUBLE) + 0.5) / 1000003.0)) * cos(2.0 * 3.141592653589793 * ((CAST((id * 2654435761 + 40503 * 2) % 1000003 AS DOUBLE) + 0.5) / 1000003.0)) AS z0,
   sqrt(-2.0 * ln((CAST((id * 2654435761 + 40503 * 3) % 1000003 AS DOUBLE) + 0.5) / 1000003.0)) * cos(2.0 * 3.141592653589793 * ((CAST((id * 2654435761 + 40503 * 4) % 1000003 AS DOUBLE) + 0.5) / 1000003.0)) AS z1
   FROM vectors),
r AS (SELECT id, row_number() OVER (ORDER BY id) AS rid FROM vectors),
v0 AS (SELECT z0 AS a0, row_number() OVER (ORDER BY z0, id) AS rid FROM z),
v1 AS (SELECT z1 AS a1, row_number() OVER (ORDER BY z1, id) AS rid FROM z)
SELECT r.id, round(v0.a0, 6) AS a0, round(v1.a1, 6) AS a1 FROM r JOIN v0 ON v0.rid = r.rid JOIN v1 ON v1.rid = r.rid""")
def sorted_normal_attrs(spark, sf):
    """Two sorted standard-normal attributes (row position = rank), hash-seeded."""
    from vecspark.sources import generators as G
    out = G.sorted_normal_attrs(fx.vectors(spark, sf).select("id"))
    return out.select("id", F.round("a0", 6).alias("a0"), F.round("a1", 6).alias("a1"))


@register("spmat_roundtrip", cte("sparse_docs") +
          "SELECT id, count(*) AS nnz, sum(w) AS total_w FROM sparse_docs GROUP BY id")
def spmat_roundtrip(spark, sf):
    """Document bag-of-words written as a CSR file (term → column by hash order) and read back by row blocks."""
    import os
    from vecspark.operators.ranking import ordered_positions
    from vecspark.session import bound_batches, cut_lineage
    bound_batches(spark)
    sp = cut_lineage(fx.sparse_blocks(spark, sf))
    dims = cut_lineage(sp.select(F.explode("terms").alias("dim")).distinct().withColumn("h", F.xxhash64("dim")))
    dims = ordered_positions(dims, ["h", "dim"], F.floor(F.col("h") / F.lit(float(1 << 44))), "col") \
        .select("dim", "h", (F.col("col") - 1).cast("int").alias("col")).checkpoint()
    n_rows = fx.read(spark, sf, "documents").agg(F.max("doc_id")).first()[0] + 1
    folder = posix_dir(spark, f"spmat-{uuid.uuid4().hex[:12]}")
    path = os.path.join(folder, "docs.csr")
    B.write_spmat(sp, path, n_rows, dims)
    back = B.read_spmat(spark, path, block_rows=256)
    return back.groupBy("id").agg(F.count(F.lit(1)).alias("nnz"), F.sum("w").alias("total_w"))
