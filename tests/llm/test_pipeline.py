"""The pipeline's stages, each judged on its own input, against plain re-computations."""

import zlib

import numpy as np

import corpus_pipeline
from vecspark.llm import common, mixing, neardup, quality, queries

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    common.prepare(spark)
    docs = common.table(spark, SF, "documents")
    columns = docs.columns
    held = [docs]
    for name, stage in corpus_pipeline.STAGES:
        held.append(common.stored(stage(spark, held[-1], SF), "test"))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert held[-1].columns == columns
    source, good, single, clean, mixed, tokens = ({} if False else [tuple(r) for r in h.collect()] for h in held)
    text = {r[0]: r[1] for r in source}
    want = {r.doc_id for r in quality.quality_scores(docs).filter("kept").collect()}
    assert {r[0] for r in good} == want and len(good) == len(want)
    classes = {r.doc_id: r.class_id for r in neardup.classes(held[1]).collect()}
    assert sorted(r[0] for r in single) == sorted(set(classes.values()))
    from tests.llm.test_decontam import brute
    items = [(r.item_id, r.text) for r in common.table(spark, SF, "benchmark").collect()]
    hit = {r[0] for r in brute([(r[0], r[1]) for r in single], items, 10) if r[2]}
    assert sorted(r[0] for r in clean) == sorted(r[0] for r in single if r[0] not in hit)
    times = sorted(r.doc_id for r in mixing.draws(held[3], **queries.MIX).collect())
    assert sorted(r[0] for r in mixed) == times and all(r[1] == text[r[0]] for r in mixed)
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(queries.tokenizer_path())
    want, start = [], 0
    for i in times:
        ids = np.array([*tok.encode(text[i], add_special_tokens=False).ids, 2], dtype="<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tokens, key=lambda r: r[1]) == want


def test_run_is_registered_and_whole(spark):
    import __spark_entry__ as e
    assert e.queries()["pipeline"] is corpus_pipeline.run and "pipeline" not in e.oracle_sql()
    r = corpus_pipeline.run(spark, SF)
    assert r.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and r.count() > 50


def test_nulls_repeated_ids_clashing_columns_and_no_rows(spark):
    """Every stage, one after the other, on rows that are not as usual; then on an empty table."""
    common.prepare(spark)
    plain = common.table(spark, SF, "documents")
    rows = [tuple(r) for r in plain.limit(60).collect()]
    long = " ".join(r[1] or "" for r in rows) * 3
    odd = [(None, rows[0][1]), (rows[1][0], rows[2][1]), (rows[3][0], rows[3][1]), (rows[3][0], rows[3][1]), (900_001, None), (900_002, ""), (900_003, long)]
    shape = plain.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")
    docs = spark.createDataFrame(rows + [(i, t, *rows[0][2:4], len(t or "")) for i, t in odd], shape)
    for name in ("record", "__id", "block", "n_words", "items"):
        docs = docs.withColumn(name, docs["doc_id"] * 2)
    folder = common.scratch(spark, "odd")
    docs.write.parquet(f"{folder}/documents.parquet")
    common.table(spark, SF, "benchmark").write.parquet(f"{folder}/benchmark.parquet")
    for held in (common.table(spark, folder, "documents"), common.table(spark, folder, "documents").limit(0)):
        empty = held.isEmpty()
        for name, stage in corpus_pipeline.STAGES:
            before, held = held, common.stored(stage(spark, held, folder), "odd")
            if name != corpus_pipeline.STAGES[-1][0]:
                assert held.columns == docs.columns
                assert held.exceptAll(before).isEmpty() or name == "source mix"
        assert held.isEmpty() == empty
