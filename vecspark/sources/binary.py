"""Dense-vector binary formats, read and written by byte ranges in parallel.

* xbin (``fbin`` / ``u8bin`` / ``i8bin``): header ``uint32 n, uint32 d`` then n·d values.
* fvecs / bvecs: every record is ``int32 d`` followed by d values.

Record sizes are fixed, so a file's row ranges are computed from its size and
header alone; each Spark task reads its own block with NumPy (``spark.range``
over blocks → ``mapInPandas``).  The sink writes one file per partition (each a
valid xbin file with its own header) into a folder, with a global id column
kept in a sidecar Parquet so ids survive re-reading.
"""

from __future__ import annotations

import os
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DTYPES = {"fbin": np.float32, "u8bin": np.uint8, "i8bin": np.int8}
BLOCK_ROWS = 65536


def _xbin_header(path: str) -> tuple[int, int]:
    with open(path, "rb") as f:
        n, d = struct.unpack("<II", f.read(8))
    return n, d


def read_xbin(spark: SparkSession, paths: list[str], kind: str = "fbin", block_rows: int = BLOCK_ROWS,
              max_rows: int | None = None) -> DataFrame:
    """``(id, v ARRAY<FLOAT>)``; ids continue across files in the given order; ``max_rows`` crops."""
    dtype = DTYPES[kind]
    blocks, base = [], 0
    for p in paths:
        n, d = _xbin_header(p)
        for s in range(0, n, block_rows):
            blocks.append((p, base + s, s, min(n, s + block_rows) - s, d))
        base += n
    if max_rows is not None:
        blocks = [(p, g, s, max(0, min(c, max_rows - g)), d) for p, g, s, c, d in blocks if g < max_rows]
    spec = spark.createDataFrame(blocks, "path string, gid long, start long, cnt long, d int").repartition(
        max(1, len(blocks)))

    def run(it):
        for pdf in it:
            for p, gid, s, cnt, d in pdf.itertuples(index=False):
                if cnt <= 0:
                    continue
                item = np.dtype(dtype).itemsize
                a = np.fromfile(p, dtype=dtype, count=cnt * d, offset=8 + s * d * item).reshape(cnt, d)
                yield pd.DataFrame({"id": np.arange(gid, gid + cnt, dtype=np.int64),
                                    "v": list(a.astype(np.float32))})
    return spec.mapInPandas(run, "id long, v array<float>")


def write_xbin(df: DataFrame, folder: str, kind: str = "fbin") -> None:
    """One xbin file per partition, rows in id order inside each file; ids in ``ids.parquet``."""
    dtype = DTYPES[kind]
    os.makedirs(folder, exist_ok=True)
    ordered = df.repartitionByRange("id").sortWithinPartitions("id")

    def run(it):
        import uuid
        rows = []
        for pdf in it:
            rows.append(pdf)
        if not rows:
            return
        pdf = pd.concat(rows)
        X = np.vstack(pdf["v"].to_numpy()).astype(dtype)
        first = int(pdf["id"].iloc[0])
        name = os.path.join(folder, f"part-{first:012d}-{uuid.uuid4().hex[:8]}.{kind}")
        with open(name, "wb") as f:
            f.write(struct.pack("<II", X.shape[0], X.shape[1]))
            f.write(X.tobytes())
        yield pd.DataFrame({"file": [name], "first_id": [first], "n": [X.shape[0]]})
    manifest = ordered.select("id", "v").mapInPandas(run, "file string, first_id long, n long")
    manifest.write.mode("overwrite").parquet(os.path.join(folder, "_manifest.parquet"))


def read_xbin_folder(spark: SparkSession, folder: str, kind: str = "fbin") -> DataFrame:
    """Read a folder written by ``write_xbin``: files in first-id order, ids restored from the manifest."""
    man = spark.read.parquet(os.path.join(folder, "_manifest.parquet")).orderBy("first_id").collect()
    parts = []
    for r in man:   # the manifest has one row per file
        df = read_xbin(spark, [r["file"]], kind)
        parts.append(df.withColumn("id", F.col("id") + F.lit(r["first_id"])))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_fvecs(spark: SparkSession, path: str, dtype=np.float32, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(id, v)`` from an fvecs/bvecs file; every record must carry the same ``d``."""
    with open(path, "rb") as f:
        d = struct.unpack("<i", f.read(4))[0]
    item = np.dtype(dtype).itemsize
    rec = 4 + d * item
    size = os.path.getsize(path)
    if size % rec:
        raise ValueError("file size is not a whole number of records: mixed dimensions")
    n = size // rec
    blocks = [(s, min(n, s + block_rows) - s) for s in range(0, n, block_rows)]
    spec = spark.createDataFrame(blocks, "start long, cnt long").repartition(max(1, len(blocks)))

    def run(it):
        for pdf in it:
            for s, cnt in pdf.itertuples(index=False):
                raw = np.fromfile(path, dtype=np.uint8, count=cnt * rec, offset=s * rec).reshape(cnt, rec)
                dims = raw[:, :4].copy().view("<i4").ravel()
                if (dims != d).any():
                    raise ValueError("mixed dimensions in fvecs file")
                vals = raw[:, 4:].copy().view(dtype).reshape(cnt, d)
                yield pd.DataFrame({"id": np.arange(s, s + cnt, dtype=np.int64), "v": list(vals.astype(np.float32))})
    return spec.mapInPandas(run, "id long, v array<float>")


def write_fvecs(df: DataFrame, path: str) -> None:
    """Single fvecs file assembled from per-partition byte blocks at computed offsets (id order)."""
    write_vecs(df, path, "<f4")


def write_vecs(df: DataFrame, path: str, dtype: str) -> None:
    """Single file of int32 d and d values of ``dtype`` a record, in order of id; contiguous records are written at once."""
    from vecspark.operators.ranking import global_row_number
    rows = df.select("id", "v")
    d = len(rows.first()["v"])
    rec = 4 + d * np.dtype(dtype).itemsize
    n = rows.count()
    with open(path, "wb") as f:
        f.truncate(n * rec)

    def run(it):
        for pdf in it:
            X = checked_cast(np.vstack(pdf["v"].to_numpy()), dtype)
            buf = np.empty((len(pdf), rec), dtype=np.uint8)
            buf[:, :4] = np.frombuffer(struct.pack("<i", d), dtype=np.uint8)
            buf[:, 4:] = X.view(np.uint8).reshape(len(pdf), rec - 4)
            pos = pdf["pos"].to_numpy()
            order = np.argsort(pos, kind="stable")
            breaks = np.flatnonzero(np.diff(pos[order]) != 1) + 1
            with open(path, "r+b") as f:
                for lo, hi in zip(np.r_[0, breaks], np.r_[breaks, len(pos)], strict=True):
                    f.seek(int(pos[order[lo]]) * rec)
                    f.write(buf[order[lo:hi]].tobytes())
            yield pd.DataFrame({"n": [len(pdf)]})
    pos = global_row_number(rows.withColumn("_k", F.lit(0)), ["_k"], "id", "pos").withColumn("pos", F.col("pos") - 1)
    pos.select("pos", "v").mapInPandas(run, "n long").collect()


def write_range_attrs(rows: DataFrame, path: str) -> None:
    """``(id, v)`` with two values and ids from 0 → uint64 2, uint64 n, then n float32 of each attribute."""
    n = rows.count()
    _preallocate(path, 16 + 8 * n, struct.pack("<QQ", 2, n))
    at = rows.select(F.col("v")[0].alias("a0"), F.col("v")[1].alias("a1"), (16 + 4 * F.col("id")).alias("o0"), (16 + 4 * (F.col("id") + n)).alias("o1"))
    _scatter(at, path, [("a0", "<f4", "o0"), ("a1", "<f4", "o1")])


# ------------------------------------------------------------------ k-NN truth (usbin) and ragged range results

def _preallocate(path: str, nbytes: int, header: bytes) -> None:
    with open(path, "wb") as f:
        f.truncate(nbytes)
        f.seek(0)
        f.write(header)


def checked_cast(values: np.ndarray, dtype) -> np.ndarray:
    """``values`` in a file's number format; whole numbers that it cannot hold are refused, never wrapped."""
    dtype = np.dtype(dtype)
    if dtype.kind in "iu" and len(values):
        lo, hi = values.min(), values.max()
        if lo < np.iinfo(dtype).min or hi > np.iinfo(dtype).max:
            raise OverflowError(f"value {lo if lo < np.iinfo(dtype).min else hi} does not fit {dtype.name}")
    return values.astype(dtype)


def _scatter(df: DataFrame, path: str, cols: list[tuple[str, str, int]]) -> None:
    """Each task writes its rows' values at precomputed byte offsets ``(value col, dtype, offset col)``.

    Offsets are sorted inside the task and contiguous runs are written with one call.
    """
    def run(it):
        with open(path, "r+b") as f:
            for pdf in it:
                for vcol, dt, ocol in cols:
                    offs = pdf[ocol].to_numpy(dtype=np.int64)
                    vals = checked_cast(pdf[vcol].to_numpy(), dt)
                    order = np.argsort(offs, kind="stable")
                    offs, vals = offs[order], vals[order]
                    size = np.dtype(dt).itemsize
                    breaks = np.flatnonzero(np.diff(offs) != size) + 1
                    for lo, hi in zip(np.r_[0, breaks], np.r_[breaks, len(offs)]):
                        f.seek(int(offs[lo]))
                        f.write(vals[lo:hi].tobytes())
        yield pd.DataFrame({"ok": [1]})
    df.mapInPandas(run, "ok int").collect()


def write_knn_usbin(knn: DataFrame, qorder: DataFrame, path: str, k: int) -> None:
    """``(qid, rk, id, dist)`` with exactly k rows per query → header (nq, k), ids block, distances block.

    ``qorder(qid, qpos)`` gives each query's row (0-based); offsets are computed per row.
    """
    nq = qorder.count()
    total = nq * k
    _preallocate(path, 8 + 8 * total, struct.pack("<II", nq, k))
    x = knn.join(qorder, "qid").withColumn("slot", F.col("qpos") * k + F.col("rk") - 1)
    x = x.withColumn("id_off", 8 + 4 * F.col("slot")).withColumn("d_off", 8 + 4 * total + 4 * F.col("slot"))
    _scatter(x.select("id", "dist", "id_off", "d_off"), path, [("id", "<u4", "id_off"), ("dist", "<f4", "d_off")])


def read_knn_usbin(spark: SparkSession, path: str, block_queries: int = 4096) -> DataFrame:
    """``(qpos, rk, id, dist)`` read in blocks of queries."""
    nq, k = _xbin_header(path)
    total = nq * k
    blocks = [(s, min(nq, s + block_queries) - s) for s in range(0, nq, block_queries)]
    spec = spark.createDataFrame(blocks, "start long, cnt long").repartition(max(1, len(blocks)))

    def run(it):
        for pdf in it:
            for s, cnt in pdf.itertuples(index=False):
                ids = np.fromfile(path, dtype="<u4", count=cnt * k, offset=8 + 4 * s * k)
                ds = np.fromfile(path, dtype="<f4", count=cnt * k, offset=8 + 4 * total + 4 * s * k)
                yield pd.DataFrame({"qpos": np.repeat(np.arange(s, s + cnt), k), "rk": np.tile(np.arange(1, k + 1), cnt),
                                    "id": ids.astype(np.int64), "dist": ds.astype(np.float64)})
    return spec.mapInPandas(run, "qpos long, rk int, id long, dist double")


def write_range(res: DataFrame, qorder: DataFrame, path: str) -> None:
    """Ragged range result: header (nq, total), ``nres[nq]``, ids, distances (closest first per query)."""
    from vecspark.operators.ranking import global_prefix_sum
    from pyspark.sql import Window
    nres = qorder.join(res.groupBy("qid").agg(F.count(F.lit(1)).alias("n")), "qid", "left").fillna({"n": 0})
    lims = global_prefix_sum(nres, "qpos", "n", "lim")
    nq = qorder.count()
    total = res.count()
    _preallocate(path, 8 + 4 * nq + 8 * total, struct.pack("<II", nq, total))
    base = 8 + 4 * nq
    _scatter(lims.withColumn("off", 8 + 4 * F.col("qpos")).select("n", "off"), path, [("n", "<u4", "off")])
    w = Window.partitionBy("qid").orderBy("dist", "id")
    x = (res.join(lims.select("qid", "lim"), "qid").withColumn("r", F.row_number().over(w) - 1)
            .withColumn("slot", F.col("lim") + F.col("r")))
    x = x.withColumn("id_off", base + 4 * F.col("slot")).withColumn("d_off", base + 4 * total + 4 * F.col("slot"))
    _scatter(x.select("id", "dist", "id_off", "d_off"), path, [("id", "<u4", "id_off"), ("dist", "<f4", "d_off")])


def read_range(spark: SparkSession, path: str, block_queries: int = 4096) -> DataFrame:
    """``(qpos, id, dist)`` from a ragged range file; limits come from the ``nres`` block."""
    nq, total = _xbin_header(path)
    nres = np.fromfile(path, dtype="<u4", count=nq, offset=8).astype(np.int64)
    lims = np.r_[0, np.cumsum(nres)]
    blocks = [(s, min(nq, s + block_queries), int(lims[s]), int(lims[min(nq, s + block_queries)]))
              for s in range(0, nq, block_queries)]
    spec = spark.createDataFrame(blocks, "q0 long, q1 long, r0 long, r1 long").repartition(max(1, len(blocks)))
    base = 8 + 4 * nq
    nres_bc = spark.sparkContext.broadcast(nres)

    def run(it):
        nr = nres_bc.value
        for pdf in it:
            for q0, q1, r0, r1 in pdf.itertuples(index=False):
                cnt = r1 - r0
                ids = np.fromfile(path, dtype="<u4", count=cnt, offset=base + 4 * r0)
                ds = np.fromfile(path, dtype="<f4", count=cnt, offset=base + 4 * total + 4 * r0)
                yield pd.DataFrame({"qpos": np.repeat(np.arange(q0, q1), nr[q0:q1]), "id": ids.astype(np.int64),
                                    "dist": ds.astype(np.float64)})
    return spec.mapInPandas(run, "qpos long, id long, dist double")


# ------------------------------------------------------------------ CSR sparse matrices

PIECE = 1 << 18           # entries that leave a reading task at a time
TASK_BYTES = 8 << 20      # bytes of entries that one reading task has, about
WINDOW = 1 << 21          # hashes of a file of columns that a task maps at a time


def write_spmat(sp: DataFrame, path: str, n_rows: int, dims: DataFrame) -> None:
    """Long-form ``(id, col, w)`` (``col`` an int column index) → CSR file at computed offsets.

    Layout: int64 (nrow, ncol, nnz); int64 indptr[nrow+1]; int32 indices[nnz]; float32 data[nnz].
    ``indptr`` is a prefix sum of per-row counts; entries are ordered by (row, col).

    Blocks ``(ids, n, terms, code, w)`` of ``fixtures.sparse_blocks`` are not shuffled: with ``dims(dim, h, col)``, columns by
    ascending xxhash64 ``h``, a task finds the columns in a file of all ``h`` and its rows' places in the written pointers.  Only
    rows whose id other rows share go on in long form.
    """
    from pyspark.sql import Window
    from vecspark.operators.ranking import global_prefix_sum
    spark = sp.sparkSession
    blocks = sp if "terms" in sp.columns else None
    ncol = dims.count()
    if blocks is None:
        nnz = sp.count()
        n = sp.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    else:
        n = blocks.select(F.explode(F.arrays_zip("ids", "n")).alias("e")).filter("e.n > 0").select(F.col("e.ids").alias("id"), "e.n")
        n = n.filter((F.col("id") >= 0) & (F.col("id") < n_rows)).groupBy("id").agg(F.sum("n").alias("n")).checkpoint()
        nnz = n.agg(F.sum("n")).first()[0] or 0
    rows = spark.range(n_rows).select(F.col("id"))
    per = rows.join(n, "id", "left").fillna({"n": 0})
    ptr = global_prefix_sum(per, "id", "n", "ptr").checkpoint()
    hdr = np.array([n_rows, ncol, nnz], dtype="<i8").tobytes()
    base_i = 24 + 8 * (n_rows + 1)
    base_d = base_i + 4 * nnz
    _preallocate(path, base_d + 4 * nnz, hdr)
    with open(path, "r+b") as f:     # the closing pointer
        f.seek(24 + 8 * n_rows)
        f.write(np.array([nnz], dtype="<i8").tobytes())
    _scatter(ptr.withColumn("off", 24 + 8 * F.col("id")).select("ptr", "off"), path, [("ptr", "<i8", "off")])
    if blocks is not None:
        sp = _place_blocks(blocks, path, n_rows, nnz, dims, ncol)
        if sp.isEmpty():
            return
    w = Window.partitionBy("id").orderBy("col")
    x = (sp.join(ptr.select("id", "ptr"), "id").withColumn("slot", F.col("ptr") + F.row_number().over(w) - 1)
           .withColumn("i_off", base_i + 4 * F.col("slot")).withColumn("d_off", base_d + 4 * F.col("slot")))
    _scatter(x.select("col", "w", "i_off", "d_off"), path, [("col", "<i4", "i_off"), ("w", "<f4", "d_off")])


def _place_blocks(blocks: DataFrame, path: str, n_rows: int, nnz: int, dims: DataFrame, ncol: int) -> DataFrame:
    """Writes the entries of the rows of ``blocks`` that are alone with their id; ``(id, col, w)`` of the other rows."""
    import pyarrow as pa
    hashes = path + ".columns"
    _preallocate(hashes, 8 * ncol, b"")
    _scatter(dims.select("h", (8 * F.col("col").cast("long")).alias("off")), hashes, [("h", "<i8", "off")])
    # terms with equal hashes lie side by side in the order of ``col``; there are hardly any
    twins = [r.h for r in dims.groupBy("h").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").collect()]
    named = {r.dim: r.col for r in dims.filter(F.col("h").isin(twins)).collect()} if twins else {}
    base_i = 24 + 8 * (n_rows + 1)
    base_d = base_i + 4 * nnz

    def columns(terms: list[str]) -> np.ndarray:
        import xxhash
        h = np.array([xxhash.xxh64_intdigest(t.encode(), 42) for t in terms], np.uint64).view(np.int64)      # Spark's xxhash64
        order = np.argsort(h)
        h, at, a = h[order], np.full(len(h), -1, np.int64), 0
        for lo in range(0, ncol, WINDOW):                # one part of the file at a time: the rest is not in memory
            part = np.memmap(hashes, "<i8", "r", offset=8 * lo, shape=(min(WINDOW, ncol - lo),))
            z = int(np.searchsorted(h, part[-1], "right"))
            got = np.searchsorted(part, h[a:z])
            at[order[a:z]] = np.where(part[got] == h[a:z], lo + got, -1)
            a = z
        if (at < 0).any():
            raise ValueError("term without a column")
        if named:
            at = np.array([named.get(t, a) for t, a in zip(terms, at.tolist(), strict=True)], np.int64)
        return at

    def placed(batches):
        import zstandard
        unpacked = zstandard.ZstdDecompressor().decompress
        if not nnz:
            return
        with open(path, "r+b") as f:
            for batch in batches:
                for i in range(batch.num_rows):
                    ids, n, terms, code, w = (batch.column(k)[i].as_py() for k in range(5))
                    row = np.repeat(np.arange(len(n)), n)
                    if not len(row):
                        continue
                    ptr = np.memmap(path, "<i8", "r", offset=24, shape=(n_rows + 1,))
                    col = columns(terms)[np.frombuffer(unpacked(code), np.int32)]
                    w = checked_cast(np.frombuffer(unpacked(w), np.float64), "<f4")
                    order = np.argsort((row << 32) | col)
                    col, w = checked_cast(col[order], "<i4"), w[order]
                    ends = np.cumsum(n)
                    known = np.array([x is not None and 0 <= x < n_rows and k > 0 for x, k in zip(ids, n, strict=True)])
                    at = np.where(known, np.array([x if ok else 0 for x, ok in zip(ids, known, strict=True)], np.int64), 0)
                    start = ptr[at]
                    alone = known & (ptr[at + 1] - start == n)
                    mine = np.flatnonzero(alone)
                    mine = mine[np.argsort(start[mine], kind="stable")]
                    # rows that follow each other in the block and in the file are written at once
                    breaks = np.flatnonzero((np.diff(mine) != 1) | (np.diff(start[mine]) != np.array(n)[mine[:-1]])) + 1
                    for lo, hi in zip(np.r_[0, breaks], np.r_[breaks, len(mine)], strict=True):
                        if lo == hi:
                            continue
                        a, z, to = int(ends[mine[lo]] - n[mine[lo]]), int(ends[mine[hi - 1]]), int(start[mine[lo]])
                        for base, values in ((base_i, col), (base_d, w)):
                            f.seek(base + 4 * to)
                            f.write(values[a:z].tobytes())
                    rest = (known & ~alone)[row]
                    for lo in range(0, int(rest.sum()), PIECE):
                        e = np.flatnonzero(rest)[lo:lo + PIECE]
                        yield pa.RecordBatch.from_arrays([pa.array(at[row[e]]), pa.array(col[e]), pa.array(w[e].astype(np.float64))], names=["id", "col", "w"])

    return blocks.mapInArrow(placed, "id long, col int, w double").checkpoint()


def read_spmat(spark: SparkSession, path: str, block_rows: int = 65536) -> DataFrame:
    """``(id, col, w)`` by row blocks; each task checks its indices are in ``[0, ncol)`` and its pointers ordered.

    A task has several blocks, about ``TASK_BYTES`` of entries; rows leave it ``PIECE`` entries at a time.
    """
    with open(path, "rb") as f:
        nrow, ncol, nnz = np.frombuffer(f.read(24), dtype="<i8")
    last = np.fromfile(path, dtype="<i8", count=1, offset=24 + 8 * int(nrow))[0]
    if last != nnz:
        raise ValueError("indptr does not end at nnz")
    base_i = 24 + 8 * (int(nrow) + 1)
    base_d = base_i + 4 * int(nnz)
    n_blocks = -(-int(nrow) // block_rows)
    tasks = max(1, min(n_blocks, max(4 * spark.sparkContext.defaultParallelism, 8 * int(nnz) // TASK_BYTES)))
    spec = spark.range(0, int(nrow), block_rows, tasks).select(F.col("id").alias("r0"), F.least(F.col("id") + block_rows, F.lit(int(nrow))).alias("r1"))

    def run(it):
        import pyarrow as pa
        for batch in it:
            for r0, r1 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ptr = np.fromfile(path, dtype="<i8", count=r1 - r0 + 1, offset=24 + 8 * r0)
                if (np.diff(ptr) < 0).any():
                    raise ValueError("indptr not monotone")
                cnt = int(ptr[-1] - ptr[0])
                idx = np.fromfile(path, dtype="<i4", count=cnt, offset=base_i + 4 * int(ptr[0]))
                val = np.fromfile(path, dtype="<f4", count=cnt, offset=base_d + 4 * int(ptr[0]))
                if cnt and ((idx < 0).any() or (idx >= ncol).any()):
                    raise ValueError("column index out of bounds")
                ids = np.repeat(np.arange(r0, r1), np.diff(ptr))
                for lo in range(0, cnt, PIECE):
                    hi = min(cnt, lo + PIECE)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi]), pa.array(idx[lo:hi].astype(np.int32)), pa.array(val[lo:hi].astype(np.float64))],
                                                     names=["id", "col", "w"])
    return spec.mapInArrow(run, "id long, col int, w double")
