"""Binary formats: round trips and rejection of malformed files."""

import struct
import tempfile

import numpy as np
import pytest

from vecspark.sources import binary as B


def _tmp():
    return tempfile.mkdtemp(prefix="vecspark-io-", dir="/tmp")


def test_xbin_roundtrip_exact(spark):
    rng = np.random.default_rng(5)
    X = rng.normal(size=(37, 6)).astype(np.float32)
    df = spark.createDataFrame([(i, X[i].tolist()) for i in range(37)], "id long, v array<float>").repartition(3)
    folder = _tmp() + "/x"
    B.write_xbin(df, folder)
    back = sorted((r.id, tuple(r.v)) for r in B.read_xbin_folder(spark, folder).collect())
    assert back == [(i, tuple(float(x) for x in X[i])) for i in range(37)]


def test_fvecs_mixed_dimensions_rejected(spark):
    path = _tmp() + "/bad.fvecs"
    with open(path, "wb") as f:
        f.write(struct.pack("<i", 3) + np.arange(3, dtype=np.float32).tobytes())
        f.write(struct.pack("<i", 2) + np.arange(2, dtype=np.float32).tobytes())
    with pytest.raises(Exception):
        B.read_fvecs(spark, path).collect()


def test_spmat_out_of_range_column_rejected(spark):
    path = _tmp() + "/bad.csr"
    nrow, ncol, nnz = 2, 3, 2
    with open(path, "wb") as f:
        f.write(np.array([nrow, ncol, nnz], dtype="<i8").tobytes())
        f.write(np.array([0, 1, 2], dtype="<i8").tobytes())
        f.write(np.array([1, 7], dtype="<i4").tobytes())          # 7 >= ncol
        f.write(np.array([1.0, 2.0], dtype="<f4").tobytes())
    with pytest.raises(Exception):
        B.read_spmat(spark, path).collect()


def test_knn_usbin_roundtrip(spark):
    knn = spark.createDataFrame([(q, r, q * 10 + r, float(r) / 4) for q in (5, 9) for r in (1, 2, 3)],
                                "qid long, rk int, id long, dist double")
    qorder = spark.createDataFrame([(5, 0), (9, 1)], "qid long, qpos long")
    path = _tmp() + "/t.ibin"
    B.write_knn_usbin(knn, qorder, path, 3)
    back = sorted(tuple(r) for r in B.read_knn_usbin(spark, path).collect())
    assert back == sorted((qp, r, q * 10 + r, float(r) / 4) for q, qp in ((5, 0), (9, 1)) for r in (1, 2, 3))


def _bytes(name, *parts):
    path = _tmp() + "/" + name
    with open(path, "wb") as f:
        for p in parts:
            f.write(p)
    return path


def test_files_that_do_not_fit_their_header_are_refused(spark):
    from vecspark.sources import vecfiles as V
    x = np.arange(12, dtype="<f4")
    bad = [("fbin", _bytes("a", struct.pack("<II", 4, 3), x.tobytes()[:-4])), ("fbin", _bytes("b", struct.pack("<II", 4, 3), x.tobytes(), b"1234")),
           ("fvecs", _bytes("c", struct.pack("<i", 3), x.tobytes())),
           ("fvecs", _bytes("d", struct.pack("<i", 3), x[:3].tobytes(), struct.pack("<i", 2), x[:3].tobytes())),
           ("csrtags", _bytes("e", np.array([2, 3, 2, 0, 1, 2], "<i8").tobytes(), np.array([1, 7], "<i4").tobytes())),
           ("csrtags", _bytes("f", np.array([2, 9, 2, 0, 3, 2], "<i8").tobytes(), np.array([1, 7], "<i4").tobytes())),
           ("rangeattrs", _bytes("g", struct.pack("<QQ", 2, 5), x.tobytes()[:36]))]
    for kind, path in bad:
        with pytest.raises(Exception):
            V.read(spark, path, kind).collect()
    good = _bytes("h", struct.pack("<II", 4, 3), x.tobytes())
    got = V.read(spark, f"file://{good},{good}", "fbin", start=3, count=3, block_rows=2).orderBy("id").collect()
    assert [(r.id, list(r.v)) for r in got] == [(i, x.reshape(4, 3)[i % 4].tolist()) for i in (3, 4, 5)]
    tags = _bytes("i", np.array([3, 9, 4, 0, 2, 2, 4], "<i8").tobytes(), np.array([7, 1, 8, 0], "<i4").tobytes())
    assert [list(r.tags) for r in V.read(spark, tags, "csrtags").orderBy("id").collect()] == [[1, 7], [], [0, 8]]


def test_failed_write_leaves_no_file(spark):
    import os

    from vecspark.sources import vecfiles as V
    folder = _tmp() + "/out"
    rows = spark.createDataFrame([(i, [300 if i == 99 else i, 1]) for i in range(100)], "id long, v array<int>").repartition(2)
    with pytest.raises(Exception):
        V.write(rows, folder, "u8bin")
    assert not [n for n in os.listdir(folder) if n.startswith("_manifest")]
