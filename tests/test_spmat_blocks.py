"""The bag-of-words CSR file from blocks: rows, columns and places by hand, odd ids, terms of equal hash, and what moves."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from vecspark.catalog import q_io
from vecspark.sources import binary as B
from vecspark.sources import fixtures as fx

DOCS = [(0, "a b a c"), (1, None), (2, ""), (3, "b  b"), (9, "c d e f g a"), (4, "x y"), (4, "y z z"), (None, "a q"), (6, "é a a")]


def _written(spark, folder, docs=DOCS):
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def _entries():
    """(id, term, w) of every row with an id; rows that share an id keep their entries."""
    return [(i, t, w) for i, text in DOCS if text is not None and i is not None for t, w in Counter(text.split(" ")).items()]


def test_roundtrip_counts_every_row(spark, tmp_path):
    want = {}
    for i, _, w in _entries():
        n, total = want.get(i, (0, 0))
        want[i] = (n + 1, total + w)
    got = {r.id: (r.nnz, r.total_w) for r in q_io.spmat_roundtrip(spark, _written(spark, tmp_path)).collect()}
    assert got == want


def test_file_is_ordered_and_hash_twins_keep_their_own_column(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fx, "BLOCK_ENTRIES", 4)
    monkeypatch.setattr(B, "WINDOW", 3)                  # in this process, where the twins are looked up
    blocks = fx.sparse_blocks(spark, _written(spark, tmp_path)).localCheckpoint()
    terms = [r.t for r in blocks.select(F.explode("terms").alias("t")).distinct().withColumn("h", F.xxhash64("t")).orderBy("h", "t").collect()]
    assert set(terms) == {t for _, text in DOCS if text is not None for t in text.split(" ")}
    rows = spark.createDataFrame([(t, k) for k, t in enumerate(terms)], "dim string, col int").select("dim", F.xxhash64("dim").alias("h"), "col")
    path = str(tmp_path / "docs.csr")
    B.write_spmat(blocks, path, 10, rows)
    nrow, ncol, nnz = np.fromfile(path, "<i8", 3)
    ptr = np.fromfile(path, "<i8", 11, offset=24)
    idx = np.fromfile(path, "<i4", nnz, offset=24 + 88)
    w = np.fromfile(path, "<f4", nnz, offset=24 + 88 + 4 * nnz)
    want = sorted((i, terms.index(t), float(x)) for i, t, x in _entries())
    assert (nrow, ncol, nnz) == (10, len(terms), len(want)) and ptr[-1] == nnz
    of = np.repeat(np.arange(10), np.diff(ptr)).tolist()
    assert list(zip(of, idx.tolist())) == [x[:2] for x in want] and sorted(zip(of, idx.tolist(), w.tolist())) == want

    class Same:                                          # every term has one hash: names decide
        @staticmethod
        def xxh64_intdigest(t, seed):
            return 7
    import sys
    twin = rows.select("dim", F.lit(7).cast("long").alias("h"), "col")
    monkeypatch.setitem(sys.modules, "xxhash", Same)
    made = []

    class Blocks:                                        # runs the writing function here, on the rows of one task
        def mapInArrow(self, f, schema):
            import pyarrow as pa
            got = blocks.collect()
            batch = pa.table({c: [r[c] if isinstance(r[c], list) else bytes(r[c]) for r in got] for c in blocks.columns}).combine_chunks().to_batches()
            made.extend(f(iter(batch)))
            return spark.range(1)
    B._place_blocks(Blocks(), path, 10, int(nnz), twin, len(terms))
    assert np.array_equal(np.fromfile(path, "<i4", nnz, offset=24 + 88), idx)
    assert sorted((i, c, x) for b in made for i, c, x in zip(*(k.to_pylist() for k in b.columns))) == [x for x in want if x[0] == 4]


def test_entries_are_not_shuffled(spark, tmp_path):
    """What is written and moved grows with blocks, their terms and rows: no row of an entry, before nor when they are placed."""
    blocks = fx.sparse_blocks(spark, _written(spark, tmp_path))
    assert blocks.count() <= 3 and "Exchange" not in blocks._jdf.queryExecution().executedPlan().toString()


def test_few_reading_tasks_and_bounded_batches(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "m.csr")
    sp = spark.range(4000).select("id", (F.col("id") % 7).cast("int").alias("col"), F.lit(2.0).alias("w"))
    B.write_spmat(sp, path, 4000, spark.range(7))
    monkeypatch.setattr(B, "PIECE", 10)
    back = B.read_spmat(spark, path, block_rows=16)
    assert back.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert {(r.id, r.col, r.w) for r in back.collect()} == {(i, i % 7, 2.0) for i in range(4000)}
