"""Catalog: files through the vector-file data source, compared value by value."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from vecspark.catalog.oracle_fixtures import cte
from vecspark.catalog.registry import register
from vecspark.session import posix_dir
from vecspark.sources import binary as B
from vecspark.sources import fixtures as fx
from vecspark.sources import vecfiles as V

_POS = "row_number() OVER (ORDER BY id) - 1"
_CODES = "list_transform(v, lambda x: CAST(floor((x + 1.0) * 127.5) AS INTEGER))"


def _folder(spark, name):
    return posix_dir(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def _ordered(df):
    from vecspark.operators.ranking import global_row_number
    pos = global_row_number(df.withColumn("_k", F.lit(0)), ["_k"], "id", "pos")
    return pos.select((F.col("pos") - 1).alias("id"), "v")


def _values(df):
    """One row an element: (id, p, x)."""
    return df.select("id", F.posexplode("v").alias("p", "x"))


def _values_sql(v: str, source: str = "vectors") -> str:
    return (f"SELECT id, CAST(unnest(range(0, len(v))) AS INTEGER) AS p, unnest(v) AS x FROM (SELECT {_POS} AS id, {v} AS v FROM {source})")


@register("xbin_codes", cte("vectors") + _values_sql(_CODES))
def xbin_codes(spark, sf):
    """uint8 codes written as u8bin files of at most 100 rows and read back, every value."""
    folder = _folder(spark, "u8bin")
    V.write(fx.vectors_u8(spark, sf).select("id", "v"), folder, "u8bin", block_rows=100)
    return _values(V.read_folder(spark, folder, "u8bin", block_rows=64))


@register("xbin_slice", cte("vectors") + f"SELECT * FROM ({_values_sql('v')}) WHERE id >= 37 AND id < 37 + 150")
def xbin_slice(spark, sf):
    """Rows 37 to 186 of a folder of fbin files: only their bytes are read."""
    folder = _folder(spark, "slice")
    V.write(fx.vectors(spark, sf).select("id", "v"), folder, "fbin", block_rows=60)
    return _values(V.read_folder(spark, folder, "fbin", start=37, count=150)).withColumn("x", F.col("x").cast("double"))


@register("fvecs_to_xbin", cte("vectors") + _values_sql("v"))
def fvecs_to_xbin(spark, sf):
    """An fvecs file converted to fbin files by range, every value."""
    path = os.path.join(_folder(spark, "fvecs"), "vectors.fvecs")
    B.write_fvecs(_ordered(fx.vectors(spark, sf)), path)
    folder = _folder(spark, "converted")
    V.write(V.read(spark, path, "fvecs", block_rows=90), folder, "fbin")
    return _values(V.read_folder(spark, folder, "fbin")).withColumn("x", F.col("x").cast("double"))


@register("vecs_of_codes", cte("vectors") + f"SELECT 'bvecs' AS kind, * FROM ({_values_sql(_CODES)}) UNION ALL SELECT 'ivecs' AS kind, * FROM ({_values_sql(_CODES)})")
def vecs_of_codes(spark, sf):
    """Codes as bvecs and as ivecs records, every value read back by ranges."""
    codes, out = _ordered(fx.vectors_u8(spark, sf).select("id", "v")), None
    for kind in ("bvecs", "ivecs"):
        path = os.path.join(_folder(spark, kind), f"codes.{kind}")
        B.write_vecs(codes, path, V.VECS[kind][0])
        got = _values(V.read(spark, path, kind, block_rows=77)).select(F.lit(kind).alias("kind"), "id", "p", "x")
        out = got if out is None else out.unionByName(got)
    return out


@register("csr_tag_scan", cte("tags") + "SELECT id, list_sort(list(tag)) AS tags FROM tags GROUP BY id")
def csr_tag_scan(spark, sf):
    """The tag matrix as a CSR file, scanned back as sorted tag arrays (the block of values is skipped)."""
    tags = fx.tags(fx.vectors(spark, sf)).select("id", F.col("tag").alias("col"), F.lit(1.0).alias("w"))
    n = fx.read(spark, sf, "embeddings").agg(F.max("vec_id")).first()[0] + 1
    path = os.path.join(_folder(spark, "tags"), "tags.csr")
    B.write_spmat(tags, path, n, spark.range(tags.agg(F.max("col")).first()[0] + 1))
    return V.read(spark, path, "csrtags", block_rows=50).where(F.size("tags") > 0)


@register("range_attr_scan", cte("vectors", "attrs") + f"SELECT {_POS} AS id, round(a0, 6) AS a0, round(a1, 6) AS a1 FROM attrs")
def range_attr_scan(spark, sf):
    """The two range attributes as a file of two float32 rows, scanned back by ranges."""
    path = os.path.join(_folder(spark, "attrs"), "attrs.bin")
    rows = fx.with_attrs(fx.vectors(spark, sf)).select("id", F.array("a0", "a1").alias("v"))
    B.write_range_attrs(_ordered(rows), path)
    got = V.read(spark, path, "rangeattrs", block_rows=90)
    return got.select("id", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("a0", "a1")])
