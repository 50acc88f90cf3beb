"""1-recall@R with the true nearest deep in the run: every R looks at the first R of the run."""

from vecspark.catalog import q_quality as QQ


def test_true_nearest_beyond_the_tenth_is_seen_at_100(spark, tmp_path):
    # all base vectors share their 4-bit codes with the query (the run orders them by id), only the last is near it
    rows = [(0, [0.01, 0.01], 0)] + [(i, [0.1, 0.1] if i < 40 else [0.02, 0.02], 0) for i in range(1, 41) if i % 25]
    rows += [(50, [-0.9, -0.9], 0), (51, [-0.9, -0.9], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.r: r.recall for r in QQ.one_recall_at_r(spark, str(tmp_path)).collect()}
    assert got == {1: 0.5, 10: 0.5, 100: 1.0}                        # rank 39 of the run for query 0, rank 1 for query 50
    assert QQ.recall_at_k(spark, str(tmp_path)).first()["mean"] > 0     # the other measures keep their ten
    _, run = QQ._truth_run(spark, str(tmp_path))
    assert run.groupBy("qid").count().filter("count > 10").count() == 0
