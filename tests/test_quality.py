"""Recall with and without distance ties on hand-made cases (the reference's metric rules)."""

import pytest

from vecspark.operators import quality as Q

# (truth ids, truth dists, run ids, count, expected recall without ties, expected with ties)
CASES = [
    ([1, 2, 3, 4], [0.1, 0.2, 0.3, 0.4], [1, 2], 2, 2, 2),
    ([1, 2, 3, 4], [0.1, 0.2, 0.2, 0.2], [1, 4], 2, 1, 2),          # tie extends through 4
    ([1, 2, 3, 4], [0.1, 0.2, 0.2, 0.3], [1, 4], 2, 1, 1),          # tie stops at 3
    ([1, 2, 3], [0.5, 0.5, 0.5], [3], 1, 0, 1),                     # all-close tail to the end
    ([1, 2], [0.1, 0.2], [2, 1], 2, 2, 2),                          # truth as deep as count
    ([5, 6, 7, 8], [1.0, 2.0, 2.0000005, 3.0], [7, 9], 2, 0, 1),     # |d - d_k| < 1e-6
    ([5, 6, 7, 8], [1.0, 2.0, 2.000002, 3.0], [7, 9], 2, 0, 0),      # not close
]


@pytest.mark.parametrize("tids,tds,rids,count,no_ties,ties", CASES)
def test_recall_cases(spark, tids, tds, rids, count, no_ties, ties):
    truth = spark.createDataFrame([(0, i + 1, t, d) for i, (t, d) in enumerate(zip(tids, tds))],
                                  "qid long, rk int, id long, dist double")
    run = spark.createDataFrame([(0, i + 1, r) for i, r in enumerate(rids)], "qid long, rk int, id long")
    a = Q.recall(truth, run, count, ties=False).first()
    b = Q.recall(truth, run, count, ties=True).first()
    assert a["mean"] == pytest.approx(no_ties / count)
    assert b["mean"] == pytest.approx(ties / count)


def test_truth_as_answer_gives_one(spark):
    truth = spark.createDataFrame([(q, r, q * 10 + r, float(r)) for q in range(3) for r in range(1, 6)],
                                  "qid long, rk int, id long, dist double")
    got = Q.recall(truth, truth.where("rk <= 3"), 3, ties=True).first()
    assert got["mean"] == 1.0 and got["std"] == 0.0
