import random

import pytest
import regex

from vecspark.llm import decontam


def words(t):
    return regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, width, slop=0):
    out = []
    for i, t in docs:
        w = words(t)
        hit, found = set(), set()
        for item, q in items:
            v = words(q)
            for s in range(max(1, len(v) - width + 1) if v else 0):
                win = v[s:s + width]
                for p in range(len(w) - len(win) + 1):
                    if w[p:p + len(win)] == win:
                        hit.update(range(p, p + len(win)))
                        found.add("" if item is None else str(item))
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk", [16 << 20, 200])
def test_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(decontam, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 300)
    rng = random.Random(5)
    vocab = ["the", "of", "Ünï", "a1", "zeta", "the"]
    docs = [(i % 25, " ".join(rng.choices(vocab, k=rng.randint(0, 60)))) for i in range(30)]
    docs += [(None, "the of a1"), (40, None), (41, ""), (42, "...!"), (43, "the " * 400), (43, "the " * 400)]
    items = [(1, "The, of; A1"), (2, " ".join(rng.choices(vocab, k=14))), (3, None), (4, "!!"), (None, "zeta zeta"), (2, "of of"),
             (5, docs[3][1]), (5, docs[3][1]), (6, "never seen word")]
    d = spark.createDataFrame([(i, t, "x", 7) for i, t in docs], "doc_id long, text string, items string, block int").repartition(3)
    b = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    got = decontam.find(d, b, width=5).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got], key=repr) == brute(docs, items, 5)
    clean = decontam.remove_contaminated(d, b, width=5)
    assert clean.columns == d.columns
    bad = {r[0] for r in brute(docs, items, 5) if r[2]}
    assert sorted([r.doc_id for r in clean.collect()], key=repr) == sorted([i for i, _ in docs if i not in bad], key=repr)


def test_proximity_is_wider_than_exact(spark):
    d = spark.createDataFrame([(1, "alpha x beta gamma"), (2, "alpha beta gamma"), (3, "alpha y y y beta gamma"), (4, "gamma beta alpha")],
                              "doc_id long, text string")
    b = spark.createDataFrame([(9, "alpha beta gamma")], "item_id long, text string")
    got = {r.doc_id: (list(r["items"]), list(r.near)) for r in decontam.find(d, b, width=3, slop=1).collect()}
    assert got == {1: ([], ["9"]), 2: (["9"], ["9"]), 3: ([], []), 4: ([], [])}


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontam.find(d.limit(0), b).count() == 0
    r = decontam.find(d, b.limit(0)).collect()
    assert [(x.doc_id, x.n_words, x.n_hit) for x in r] == [(1, 2, 0)]


def test_long_items_in_pieces_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(decontam, "PIECE_WORDS", 3)
    monkeypatch.setattr(decontam, "CHUNK_BYTES", 64)
    rng = random.Random(6)
    long = [f"w{rng.randrange(40)}" for _ in range(60)]
    docs = [(1, " ".join(long)), (2, " ".join(long[7:19])), (3, " ".join(long[20:24])), (4, "one two"), (5, " ".join(long[2:6] + ["x"] + long[6:12]))]
    items = [(1, " ".join(long)), (2, "one two"), (3, " ".join(long[5:11]))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted([(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in decontam.find(d, b, width=5).collect()], key=repr)
    assert got == brute(docs, items, 5)
    monkeypatch.undo()
    text = " ".join(f"v{rng.randrange(300_000)}" for _ in range(600_000))          # about 4 MB in one document and one item
    d = spark.createDataFrame([(1, text), (2, "none of it")], "doc_id long, text string")
    r = {x.doc_id: (x.n_words, x.n_hit, list(x["items"])) for x in decontam.find(d, spark.createDataFrame([(7, text)], "item_id long, text string")).collect()}
    assert r == {1: (600_000, 600_000, ["7"]), 2: (3, 0, [])}


def test_a_full_chunk_of_windows_takes_bounded_memory():
    import pickle
    import tracemalloc
    rng = random.Random(7)
    words, rows, held = [f"word{k}" for k in range(200_000)], [], 0
    while held < decontam.CHUNK_BYTES:
        rows.append((str(len(rows)), " ".join(rng.choices(words, k=1000)).encode()))
        held += len(rows[-1][1])
    tracemalloc.start()
    w = decontam.Windows(rows, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20 and len(pickle.dumps(w)) < 100 << 20
