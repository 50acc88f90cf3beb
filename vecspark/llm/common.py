"""Small helpers shared by the operators: table reads, the hold-out rule, shared scratch tables, word splitting."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.session import ensure_checkpoint_dir, ship_package

#: the six ASCII white-space characters that separate words
SPACES = " \t\n\x0b\x0c\r"


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder and worker-side imports, once per query."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the folder that all executors share (``spark.checkpoint.dir``)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind: its rows are read from the written files from then on."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: cut lineage, computed once, shuffle files freed."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with shuffles_freed(spark):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_text(col: str | Column = "doc_id") -> Column:
    return F.coalesce((F.col(col) if isinstance(col, str) else col).cast("string"), F.lit(""))


def remainder(col: str | Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod`` (a null id counts as empty text)."""
    return F.crc32(id_text(col)) % F.lit(mod)


def held_out(col: str | Column, mod: int) -> Column:
    return (remainder(col, mod) == 2)


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 text (``bytes.split`` splits on exactly these)."""
    return text.split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public splitmix64 constants): spreads the bits of every element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def binary(array) -> list:
    """Cells of a string or binary Arrow array as ``bytes`` (or None)."""
    import pyarrow as pa
    if pa.types.is_large_string(array.type):
        array = array.cast(pa.large_binary())
    elif pa.types.is_string(array.type):
        array = array.cast(pa.binary())
    return array.to_pylist()


#: words that a worker's dictionaries hold at most before they start anew (a few dozen MB)
WORDS_HELD = 300_000
