"""Deterministic tables derived from the given test tables.

Every table here is a plain projection / explode / filter of a table in the
test-data folder, so its size grows with the data.  The definitions follow
FIXTURES.md; the DuckDB twins used by the correctness oracle live in
``vecspark.catalog.oracle_fixtures``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the fixture definitions (FIXTURES.md).
QUERY_EVERY = 25          # vec_id % 25 = 0 are queries, the rest is the base
N_GEN_TAGS = 20           # generated tags 0..19
LABEL_TAG_OFFSET = 100    # plus tag 100 + label
DOCS_PER_VECTOR = 50      # doc_id = vec_id % 50
ATTR_MULT = (7919, 104729)
WORKLOAD_PERIOD = 1000    # the Zipf shape repeats every 1000 events
WORKLOAD_PHASE = 5000     # the templates change every 5000 events
WORKLOAD_MOD = 61


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- vectors

def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vectors(id, v ARRAY<FLOAT>, label, doc_id)``."""
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("embedding").alias("v"),
        F.col("label"),
        (F.col("vec_id") % DOCS_PER_VECTOR).alias("doc_id"),
    )


def vectors_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each element times ``1 + id % 5`` (double) — breaks the unit-norm tie of l2/ip/cosine."""
    return vectors(spark, sf_dir).select(
        "id",
        F.transform(F.col("v").cast("array<double>"),
                    lambda x: x * (F.lit(1) + F.col("id") % 5)).alias("v"),
        "label", "doc_id")


def vectors_u8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uint8 codes ``floor((x + 1) * 127.5)`` held as ARRAY<INT>."""
    return vectors(spark, sf_dir).select(
        "id",
        F.transform(F.col("v").cast("array<double>"),
                    lambda x: F.floor((x + 1.0) * 127.5).cast("int")).alias("v"),
        "label", "doc_id")


def centroids(vec: DataFrame) -> DataFrame:
    """``(cid, c)``: every floor(sqrt n)-th vector — about sqrt(n) cells, spread over the whole table."""
    step = max(1, math.isqrt(vec.count()))
    return vec.where(F.col("id") % step == 0).select(F.col("id").alias("cid"), F.col("v").alias("c"))


def is_query(id_col: Column) -> Column:
    return id_col % QUERY_EVERY == 0


def split(vec: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queries(qid, qv, label), base) — the fixed query/base split."""
    queries = vec.where(is_query(F.col("id"))).select(
        F.col("id").alias("qid"), F.col("v").alias("qv"), "label")
    base = vec.where(~is_query(F.col("id")))
    return queries, base


def query_index(qid: Column) -> Column:
    """``i = qid div 25`` — the position of a query in the query set."""
    return (qid / QUERY_EVERY).cast("long")


# ---------------------------------------------------------------- tags

def _gen_tag_array(id_col: str = "id") -> Column:
    """Tags 0..19 present iff ``(id*(2j+5) + 7j) % (j+3) = 0``."""
    return F.filter(
        F.sequence(F.lit(0), F.lit(N_GEN_TAGS - 1)),
        lambda j: (F.col(id_col) * (j * 2 + 5) + j * 7) % (j + 3) == 0)


def with_tag_array(vec: DataFrame) -> DataFrame:
    """Adds ``tags ARRAY<INT>`` (sorted) to a vectors table."""
    return vec.withColumn(
        "tags",
        F.array_sort(F.concat(_gen_tag_array("id"),
                              F.array((F.col("label") + LABEL_TAG_OFFSET).cast("int")))))


def tags(vec: DataFrame) -> DataFrame:
    """Long form ``tags(id, tag)``."""
    return with_tag_array(vec).select("id", F.explode("tags").alias("tag"))


def with_attrs(vec: DataFrame) -> DataFrame:
    """Adds ``a0, a1`` in [0, 1): ``((id * m) % 1000) / 1000.0``."""
    return (vec
            .withColumn("a0", ((F.col("id") * ATTR_MULT[0]) % 1000) / 1000.0)
            .withColumn("a1", ((F.col("id") * ATTR_MULT[1]) % 1000) / 1000.0))


# ---------------------------------------------------------------- query filters

def filter_tags_col(qid: Column) -> Column:
    """``i = qid div 25``; ``i%10=9`` → []; ``i%3=0`` → [i%5]; else [i%5, 5+i%4]."""
    i = query_index(qid)
    one = F.array((i % 5).cast("int"))
    two = F.array((i % 5).cast("int"), (F.lit(5) + i % 4).cast("int"))
    return (F.when(i % 10 == 9, F.array().cast("array<int>"))
            .when(i % 3 == 0, one).otherwise(two))


def filters_tag(queries: DataFrame, is_and: bool = True) -> DataFrame:
    return queries.withColumn("ftags", filter_tags_col(F.col("qid"))) \
                  .withColumn("is_and", F.lit(is_and))


def filters_single(queries: DataFrame) -> DataFrame:
    """One required tag per query: ``[i % 5]``."""
    i = query_index(F.col("qid"))
    return queries.withColumn("ftags", F.array((i % 5).cast("int"))).withColumn("is_and", F.lit(True))


def filters_range(queries: DataFrame, is_and: bool = True) -> DataFrame:
    i = query_index(F.col("qid"))
    return (queries
            .withColumn("lo0", (i % 7) / 10.0)
            .withColumn("hi0", (i % 7) / 10.0 + 0.4)
            .withColumn("lo1", (i % 5) / 10.0)
            .withColumn("hi1", (i % 5) / 10.0 + 0.5)
            .withColumn("is_and", F.lit(is_and)))


# ---------------------------------------------------------------- workload log

def workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``workload(seq, ftags, is_and)`` — one historical filter per event.

    ``t = (1000 div (seq % 1000 + 1) + 7 * (seq div 5000)) % 61``; ``t % 3 = 0`` → [t % 11], else [t % 11, 11 + t % 9].
    A Zipf-shaped template mix whose templates change every 5000 events.
    """
    ev = read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"))
    t = ((F.lit(WORKLOAD_PERIOD) / (F.col("seq") % WORKLOAD_PERIOD + 1)).cast("long")
         + 7 * (F.col("seq") / WORKLOAD_PHASE).cast("long")) % WORKLOAD_MOD
    return ev.select(
        "seq",
        F.when(t % 3 == 0, F.array((t % 11).cast("int")))
         .otherwise(F.array((t % 11).cast("int"), (F.lit(11) + t % 9).cast("int"))).alias("ftags"),
        F.lit(True).alias("is_and"))


def workload_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``workload_ranges(seq, lo0, hi0, lo1, hi1, is_and)`` — one historical range filter per event.

    With t as in ``workload``: first range [t%7, t%7 + 3 + t%4) tenths; second [t%3, t%3 + 5 + t%3) tenths, open where
    ``t % 6 = 5``; OR where ``t % 5 = 4``.
    """
    ev = read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"))
    t = ((F.lit(WORKLOAD_PERIOD) / (F.col("seq") % WORKLOAD_PERIOD + 1)).cast("long")
         + 7 * (F.col("seq") / WORKLOAD_PHASE).cast("long")) % WORKLOAD_MOD

    def tenths(x: Column) -> Column:
        return x.cast("double") / 10.0
    closed = t % 6 != 5
    return ev.select("seq", tenths(t % 7).alias("lo0"), tenths(t % 7 + 3 + t % 4).alias("hi0"), F.when(closed, tenths(t % 3)).alias("lo1"),
                     F.when(closed, tenths(t % 3 + 5 + t % 3)).alias("hi1"), (t % 5 != 4).alias("is_and"))


# ---------------------------------------------------------------- sparse vectors

COUNT_ROWS = 256          # texts counted at a time


def _count_terms(batches):
    """Row-form bag of words of each text: terms split on single space, by count descending, then term (Arrow arrays throughout)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    for b in (whole.slice(lo, COUNT_ROWS) for whole in batches for lo in range(0, whole.num_rows, COUNT_ROWS)):
        lists = pc.split_pattern(b.column(1).cast(pa.large_string()), " ")
        n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        terms = lists.flatten().dictionary_encode()
        names = terms.dictionary
        rank = np.empty(len(names), np.int64)
        by_bytes = pc.sort_indices(names.cast(pa.large_binary())).to_numpy()
        rank[by_bytes] = np.arange(len(names))
        key, count = np.unique((np.repeat(np.arange(len(n)), n) << 32) | rank[terms.indices.to_numpy(zero_copy_only=False)], return_counts=True)
        row = key >> 32
        order = np.lexsort((key, -count, row))
        ends = pa.array(np.searchsorted(row, np.arange(len(n) + 1)).astype(np.int32))
        dims = names.take(pa.array(by_bytes[(key[order] & 0xFFFFFFFF)])).cast(pa.string()) if len(key) else pa.array([], pa.string())
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.ListArray.from_arrays(ends, dims), pa.ListArray.from_arrays(ends, pa.array(count[order].astype(np.float64)))],
            names=["id", "dims", "ws"])


def sparse_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as row-form sparse vectors ``(id, dims, ws)``: whole texts, counted row by row, nothing shuffled."""
    src = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return src.mapInArrow(_count_terms, "id long, dims array<string>, ws array<double>")


BLOCK_ENTRIES = 1 << 20   # entries of a block of sparse vectors, about


def _pack_entries(batches):
    """Blocks of row-form vectors: ids, entries a row, distinct terms, and every entry's place among them and weight (row by row, packed)."""
    import numpy as np
    import pyarrow as pa
    import zstandard
    packed = zstandard.ZstdCompressor(level=1).compress

    def block(rows):
        dims = pa.concat_arrays([b.column(1).flatten() for b in rows]).dictionary_encode()
        ws = np.concatenate([b.column(2).flatten().to_numpy() for b in rows])
        ids = pa.concat_arrays([b.column(0).cast(pa.int64()) for b in rows])
        n = pa.concat_arrays([b.column(1).value_lengths().cast(pa.int64()) for b in rows])
        whole = [pa.array([0, len(x)], pa.int32()) for x in (ids, dims.dictionary)]
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(whole[0], ids), pa.ListArray.from_arrays(whole[0], n), pa.ListArray.from_arrays(whole[1], dims.dictionary),
             pa.array([packed(dims.indices.to_numpy().astype(np.int32).tobytes())], pa.binary()), pa.array([packed(ws.tobytes())], pa.binary())],
            names=["ids", "n", "terms", "code", "w"])

    rows, held = [], 0
    for b in _count_terms(batches):
        rows.append(b)
        held += len(b.column(1).flatten())
        if held >= BLOCK_ENTRIES:
            yield block(rows)
            rows, held = [], 0
    if rows:
        yield block(rows)


def sparse_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of ``sparse_rows`` in blocks ``(ids, n, terms, code, w)``: a term is a string once a block; nothing is shuffled."""
    src = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return src.mapInArrow(_pack_entries, "ids array<long>, n array<long>, terms array<string>, code binary, w binary")


def sparse_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecspark.operators.sparse import long_form
    return long_form(sparse_rows(spark, sf_dir))


def sparse_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.explode(F.split("text", " ")).alias("dim"))
    return src.groupBy("qid", "dim").agg(F.count(F.lit(1)).cast("double").alias("w"))


# ---------------------------------------------------------------- streaming inputs

def runbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``runbook(step, op, start, end)`` scaled to the vector count n.

    insert [0, .6n), search, insert [.6n, n), delete [.2n, .5n), search, insert [.2n, .3n), search.
    At n = 500 this is the literal runbook of FIXTURES.md.
    """
    n = read(spark, sf_dir, "embeddings").count()   # one scalar
    steps = spark.createDataFrame(
        [(1, "insert", 0, 6), (2, "search", None, None), (3, "insert", 6, 10),
         (4, "delete", 2, 5), (5, "search", None, None), (6, "insert", 2, 3),
         (7, "search", None, None)],
        "step INT, op STRING, s10 INT, e10 INT")
    return steps.select(
        "step", "op",
        (F.col("s10") * F.lit(n) / 10).cast("long").alias("start"),
        (F.col("e10") * F.lit(n) / 10).cast("long").alias("end"))


def op_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op_log(seq, id, op)`` from events: signup/purchase → insert, error → delete, else search."""
    ev = read(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("id"),
        F.when(F.col("event_type").isin("signup", "purchase"), "insert")
         .when(F.col("event_type") == "error", "delete").otherwise("search").alias("op"))


# ---------------------------------------------------------------- benchmark run rows

def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows ``runs(run_id, algorithm, parameters, dataset, track, count, qps, recall, ...)``.

    One row per event: algorithm = event type, dataset by user bucket, parameters by id,
    quality and timing columns are fixed arithmetic of the event columns.
    """
    ev = read(spark, sf_dir, "events")
    rid = F.col("event_id")
    return ev.select(
        rid.alias("run_id"),
        F.col("event_type").alias("algorithm"),
        F.concat(F.lit("p"), (rid % 7).cast("string")).alias("parameters"),
        F.concat(F.lit("ds"), (F.col("user_id") % 3).cast("string")).alias("dataset"),
        F.when(F.col("user_id") % 2 == 0, "filter").otherwise("ood").alias("track"),
        F.lit(10).alias("count"),
        (F.col("value") * 100.0).alias("qps"),
        (((rid * 7919) % 1000) / 1000.0).alias("recall"),
        (((rid * 104729) % 500) / 10.0).alias("build"),
        ((rid % 97) * 1024).alias("indexsize"),
        (((rid * 31) % 1000) * 10.0).alias("distcomps"),
        (((rid * 17) % 100) / 1000.0).alias("mean_latency"),
        (F.col("value") * 5.0).alias("watt_seconds"),
        ((rid % 4) + 1).alias("run_count"),
        (F.col("value") / 10.0 + (rid % 5)).alias("t_first"),
        (F.col("value") / 10.0 + (rid % 3)).alias("t_last"),
    )
