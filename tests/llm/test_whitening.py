import math

import numpy as np
import pytest

from vecspark.llm import bidiagonal, whitening

RNG = np.random.default_rng(5)
SHAPE = "vec_id long, embedding array<float>, label int, x string, n int, component int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, 3) for i, v in rows], SHAPE)


def brute(rows, k=4):
    """Covariance of the distinct x vectors and its eigenvectors by numpy; deviations in whole numbers."""
    usable = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in rows
              if v and all(c is not None and math.isfinite(c) for c in v)]
    lengths = [len(x) for _, x in usable]
    d = max(set(lengths), key=lambda n: (lengths.count(n), n))
    usable = [(i, x) for i, x in usable if len(x) == d]
    fit = np.array(sorted({x for _, x in usable}), dtype=np.int64)
    n, sums = len(fit), fit.sum(axis=0)
    c = (n * fit - sums) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, x in usable:
        diff = n * np.array(x) - sums
        for j in range(min(k, d)):
            if values[j] > 1e-9 * values[0]:
                out.setdefault((i, j + 1), []).append((n, int((diff.astype(object) ** 2).sum()), diff / n @ vectors[:, j] / math.sqrt(values[j]), values[j] / values.sum()))
    return out


def check(rows, found):
    want = brute(rows)
    assert len(found) == sum(map(len, want.values()))
    flip = {}
    for r in found:
        n, dev, w, share = min(want[r.vec_id, r.component], key=lambda t: (t[1] != r.deviation, abs(abs(t[2]) - abs(r.whitened))))
        assert (r.n, r.deviation) == (n, dev) and r.explained == pytest.approx(share, rel=1e-9)
        assert abs(r.whitened) == pytest.approx(abs(w), abs=1e-9)
        if abs(w) > 1e-3:
            assert flip.setdefault(r.component, r.whitened * w > 0) == (r.whitened * w > 0)      # one sign for all rows
        assert r.identity_error <= 1e-9


def vectors(n, d):
    return [(i, [float(x) for x in v]) for i, v in enumerate(RNG.normal(size=(n, d)) * np.linspace(3, 0.5, d))]


def test_equals_brute_force_with_unusable_rows(spark):
    rows = vectors(400, 12)
    rows += [(1000, None), (1001, [1.0] * 11 + [None]), (1002, [float("nan")] * 12), (1003, [float("inf")] * 12), (1004, []),
             (1005, [1.0, 2.0]), (1006, [0.5] * 13), (None, [0.25] * 12)] + rows[:30] * 5 + [(9, [1.0] * 12)] * 300
    found = whitening.whiten(table(spark, rows)).collect()
    check([r for r in rows if r[0] != 1003], found)
    assert {r.vec_id for r in found}.isdisjoint({1000, 1001, 1002, 1003, 1004, 1005, 1006})


def test_few_dimensions_and_missing_rank(spark):
    two = vectors(60, 2)
    found = whitening.whiten(table(spark, two)).collect()
    assert {r.component for r in found} == {1, 2}
    check(two, found)
    flat = [(i, [v[0], 2 * v[0], 3.0]) for i, v in enumerate([[0.25 * j] for j in range(40)])]      # one direction only
    found = whitening.whiten(table(spark, flat)).collect()
    assert {r.component for r in found} == {1}
    check(flat, found)


def test_tables_without_variance(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5, [(1, None), (2, [])]):
        assert whitening.whiten(table(spark, rows)).count() == 0


def test_tied_eigenvalues_and_large_entries(spark):
    eye = [(2 * i + s, [float((1 - 2 * s) * (i == j)) for j in range(6)]) for i in range(6) for s in (0, 1)]
    found = whitening.whiten(table(spark, eye)).collect()
    assert {r.component for r in found} == {1, 2, 3, 4} and all(r.identity_error <= 1e-9 and r.explained == pytest.approx(1 / 6) for r in found)
    huge = whitening.whiten(table(spark, [(1, [3e30, 0.0]), (2, [1.0, 2.0]), (3, [-3e30, 1.0])])).collect()
    assert {r.vec_id for r in huge} == {1, 2, 3} and all(r.deviation is None for r in huge if r.vec_id != 2)


def test_whole_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    check([(r.vec_id, r.embedding) for r in d.collect()], whitening.whiten(d).collect())


@pytest.mark.parametrize("name", ["random", "rank", "graded", "ties", "near", "zero", "constant", "one"])
def test_solver_against_numpy(name):
    q = np.linalg.qr(RNG.normal(size=(32, 32)))[0]
    m = {"random": RNG.normal(size=(90, 32)), "rank": RNG.normal(size=(90, 5)) @ RNG.normal(size=(5, 32)),
         "graded": RNG.normal(size=(90, 16)) * 10.0 ** -np.arange(16), "ties": np.diag([5.0] * 3 + [2.0] * 3 + [1.0] * 26) @ q,
         "near": np.diag([1, 1 + 1e-9, 1 + 2e-9, 0.5] + [0.1] * 28) @ q, "zero": np.zeros((9, 9)), "constant": np.ones((9, 4)),
         "one": np.array([[-3.0]])}[name]
    r = np.linalg.qr(m, mode="r")
    values, z = bidiagonal.solve(r, min(4, len(r)))
    truth = np.linalg.svd(r, compute_uv=False) ** 2
    top = max(truth[0], 1e-300)
    assert np.abs(values - truth).max() <= 1e-13 * top
    assert np.abs(r.T @ (r @ z) - z * values[:z.shape[1]]).max() <= 1e-13 * top
    assert np.abs(z.T @ z - np.eye(z.shape[1])).max() <= 1e-12
    assert name != "graded" or np.allclose(values[:8], truth[:8], rtol=1e-9)
