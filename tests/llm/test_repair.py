import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vecspark.llm import queries, repair


def brute(spark, rows):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(queries.tokenizer_path())
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


HARD = ["", "  ", "á ́x", "Foo's bar'll. <|endoftext|> x<|startoftext|>y.", "ÀÉİ İ. x\x1cy",
        "<|ENDOFTEXT|>", "x\n\n\ty.", "12.5, a.b,c..", "\U0001F600 ok!?", "<|endoftext|>.", "a<|endoftext|>b."]


@pytest.mark.parametrize("text", HARD)
def test_encoder_equals_library(text):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(queries.tokenizer_path())
    ids, n = repair.Encoder(queries.tokenizer_path()).encode(pa.array([text, None, text]))
    want = tok.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want * 2 and n.tolist() == [len(want), 0, len(want)]


def test_documents_equal_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(3, "again again"), (None, "null id"), (50, None), (51, "to be " * 30_000)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, start string, part int")
    got = [tuple(r) for r in repair.read_documents(repair.write_shards(docs.repartition(3), queries.tokenizer_path()))
           .select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    want = brute(spark, [r for r in rows if r[0] != 3])
    assert [r[2:] for r in want if r[0] == 51] == [r[2:] for r in got if r[0] == 51]
    assert sum(r[2] for r in got) == sum(r[2] for r in brute(spark, rows))
    by = sorted(got, key=lambda r: r[1])
    assert [r[1] for r in by] == np.concatenate(([0], np.cumsum([r[2] for r in by])[:-1])).tolist()
    assert [r[0] for r in by] == sorted([r[0] for r in rows], key=lambda i: (i is not None, i or 0))


def test_whole_table_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in queries.queries()["op6_repair_shards"](spark, sf).collect()), key=lambda r: r[1])
    assert got == brute(spark, rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert repair.read_documents(repair.write_shards(docs, queries.tokenizer_path())).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), max_size=60), min_size=1, max_size=8), st.integers(2, 6))
def test_grammar_round_trip(texts, min_count):
    lens = np.array([len(t) for t in texts])
    ids = np.array([x for t in texts for x in t], dtype=np.uint16)
    sym, per_doc, rules, lengths = repair.compress(ids, lens, min_count=min_count)
    assert repair.expand(sym, rules, lengths).tolist() == ids.tolist()
    # documents keep their own symbols
    a = 0
    for k, n in zip(per_doc, np.split(ids, np.cumsum(lens)[:-1])):
        assert repair.expand(sym[a:a + k], rules, lengths).tolist() == n.tolist()
        a += k
    shard = {"rules": rules.tobytes(), "lengths": lengths.astype(np.int32).tobytes(), "symbols": sym.tobytes(),
             "n_base": repair.N_BASE}
    for lo in range(0, len(ids) + 1, 7):
        for hi in (lo, lo + 1, lo + 9, len(ids)):
            assert repair.decode_range(shard, lo, min(hi, len(ids))).tolist() == ids[lo:min(hi, len(ids))].tolist()


def test_grammar_shortens_repeated_text():
    ids = np.tile(np.arange(16, dtype=np.uint16), 500)
    sym, _, rules, lengths = repair.compress(ids, np.array([len(ids)]))
    assert len(sym) < len(ids) / 10 and len(rules) and lengths.max() >= 16
