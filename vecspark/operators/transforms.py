"""Linear transforms of vector tables: random rotation, PCA, and the inner-product-preserving pair.

The d×d matrices are built from distributed partial sums (one d×d block per
partition, summed by a small aggregate) and broadcast; rows are transformed
inside their partitions with one matrix product per batch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecspark.operators.blockscan import as_matrix


def _apply(df: DataFrame, M: np.ndarray, vec: str = "v", out: str = "v") -> DataFrame:
    bc = df.sparkSession.sparkContext.broadcast(M)
    others = [c for c in df.columns if c != vec]
    schema = df.select(*others).schema.add(out, T.ArrayType(T.DoubleType()))

    def run(batches):
        A = bc.value
        for pdf in batches:
            if len(pdf) == 0:
                continue
            Y = as_matrix(pdf[vec]) @ A
            res = pdf[others].copy()
            res[out] = list(Y)
            yield res
    return df.mapInPandas(run, schema)


def random_rotation(df: DataFrame, d: int, seed: int = 123, vec: str = "v") -> DataFrame:
    """Rows times a seeded random orthogonal matrix (norms and distances preserved)."""
    rng = np.random.default_rng(seed)
    q, r = np.linalg.qr(rng.normal(size=(d, d)))
    q = q * np.sign(np.diag(r))[None, :]
    return _apply(df, q, vec)


def gram(df: DataFrame, d: int, vec: str = "v") -> np.ndarray:
    """``XᵀX`` from per-partition blocks summed by an aggregate over (i, j) cells."""
    def run(batches):
        G = np.zeros((d, d))
        for pdf in batches:
            if len(pdf):
                X = as_matrix(pdf[vec])
                G += X.T @ X
        i, j = np.indices((d, d))
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "g": G.ravel()})
    cells = df.select(vec).mapInPandas(run, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g"))
    G = np.zeros((d, d))
    for r in cells.collect():          # d² cells
        G[r["i"], r["j"]] = r["g"]
    return G


def ip_preserving_pair(base: DataFrame, queries: DataFrame, d: int, vec: str = "v", qvec: str = "qv"):
    """Base ``x·L`` and queries ``q·L⁻ᵀ`` with ``XᵀX = L Lᵀ``: inner products are unchanged."""
    G = gram(base, d, vec)
    L = np.linalg.cholesky(G + 1e-12 * np.trace(G) * np.eye(d))
    return _apply(base, L, vec), _apply(queries, np.linalg.inv(L).T, qvec, qvec)


def pca_project(df: DataFrame, k: int, vec: str = "v") -> DataFrame:
    """Project rows on the top-k principal components (Spark ML)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array
    feats = df.select("id", array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    model = PCA(k=k, inputCol="features", outputCol="pca").fit(feats)
    return model.transform(feats).select("id", vector_to_array("pca").alias("pca"))
