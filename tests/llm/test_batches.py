"""Wide rows come to Python workers in bounded batches, whatever operator ran first."""

import pyarrow as pa
import pytest

from vecspark.llm import neardup, substrings
from vecspark.operators import blockscan
from vecspark.session import BATCH_BYTES, bound_batches

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def _few(spark):
    return spark.createDataFrame([(i, f"text {i} " * 30) for i in range(4)], "doc_id long, text string")


def _scan(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], "id long, v array<double>")
    blockscan.knn(v, v.selectExpr("id as qid", "v as qv"), 2).count()


@pytest.fixture
def default(spark):
    spark.conf.unset(LIMIT)
    yield spark
    spark.conf.unset(LIMIT)


@pytest.mark.parametrize("run", [lambda s: substrings.remove_repeats(_few(s)).count(),
                                 lambda s: neardup.keep_one(_few(s)).count(), _scan], ids=["op7", "op9", "scan"])
def test_batches_of_long_texts_are_bounded(default, run):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"bytes": [b.nbytes], "rows": [b.num_rows]})

    run(default)
    texts = default.range(0, 3000, 1, 1).selectExpr("id", "repeat('abcdefgh ', 1100) as text")
    got = texts.mapInArrow(sizes, "bytes long, rows long").collect()
    assert sum(r["rows"] for r in got) == 3000
    assert max(r["bytes"] for r in got) <= BATCH_BYTES + 40_000


@pytest.mark.parametrize("given, kept", [("4m", "4m"), ("128k", "128k"), ("64MB", str(BATCH_BYTES)), ("1g", str(BATCH_BYTES))])
def test_a_smaller_limit_of_the_session_stays(default, given, kept):
    default.conf.set(LIMIT, given)
    bound_batches(default)
    assert default.conf.get(LIMIT) == kept
