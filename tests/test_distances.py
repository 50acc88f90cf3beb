"""Golden distance values on a fixed 5×3 integer set (plus zero-padding invariance)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspark.functions import distance as D
from vecspark.operators import blockscan

DATA = [[1, 0, 0], [0, 1, 0], [0, 0, 1], [1, 1, 0], [1, 1, 1]]
QUERY = [1, 0, 0]


def _rows(spark, pad=0):
    return spark.createDataFrame([(i, [float(x) for x in v] + [0.0] * pad) for i, v in enumerate(DATA)],
                                 "id long, v array<double>")


@pytest.mark.parametrize("pad", [0, 4])
def test_golden(spark, pad):
    df = _rows(spark, pad).withColumn("q", F.array(*[F.lit(float(x)) for x in QUERY + [0] * pad]))
    got = df.select("id", D.l2_sq("q", "v").alias("l2"), D.ip_dist("q", "v").alias("ip"),
                    D.cosine_dist("q", "v").alias("cos")).orderBy("id").toPandas()
    assert got.l2.tolist() == [0.0, 2.0, 2.0, 1.0, 2.0]
    assert got.ip.tolist() == [0.0, 1.0, 1.0, 0.0, 0.0]
    np.testing.assert_allclose(got.cos, [0.0, 1.0, 1.0, 1 - 1 / np.sqrt(2), 1 - 1 / np.sqrt(3)], atol=1e-12)


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
def test_kernel_matches_column_expression(spark, metric):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(40, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, X[i].tolist()) for i in range(40)], "id long, v array<float>")
    q = spark.createDataFrame([(100 + j, X[j].tolist()) for j in range(3)], "qid long, qv array<float>")
    got = blockscan.knn(df, q, 5, metric).toPandas()
    exp = (df.crossJoin(q).select("qid", "id", D.distance(metric, "qv", "v").alias("dist")).toPandas()
             .sort_values(["qid", "dist", "id"]).groupby("qid").head(5))
    assert got.sort_values(["qid", "rk"])[["qid", "id", "dist"]].values.tolist() == exp[["qid", "id", "dist"]].values.tolist()


def test_self_query_finds_itself(spark):
    rng = np.random.default_rng(7)
    X = rng.normal(size=(200, 8))
    df = spark.createDataFrame([(i, X[i].tolist()) for i in range(200)], "id long, v array<double>")
    q = df.select(F.col("id").alias("qid"), F.col("v").alias("qv"))
    got = blockscan.knn(df, q, 1).toPandas()
    assert (got.qid == got.id).all() and (got.dist == 0).all()
