import math
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vecspark.llm import lattice, queries

SF = "/root/testdata/sf0.001"
TEXTS = ["", "a", "b", "ab", "▁", "▁a", "▁ab", "ba", "é", "abab", "▁abé"]


def small():
    texts = [""] * 256 + TEXTS[1:]
    p = np.linspace(1, 3, len(texts))
    return lattice.Pieces(texts, list(range(256))), np.log(p / p.sum())


def brute(pieces, log_p, word):
    """Sum over all segmentations, one by one; a character may be its byte pieces."""
    def total(i):
        if i == len(word):
            return 1.0
        s = math.exp(sum(log_p[b] for b in word[i].encode())) * total(i + 1)
        for j in range(i + 1, len(word) + 1):
            n = pieces.number.get(word[i:j])
            if n is not None:
                s += math.exp(log_p[n]) * total(j)
        return s
    return total(0)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("abéx▁", min_size=0, max_size=7), min_size=1, max_size=6))
def test_marginal_equals_sum_over_segmentations(words):
    pieces, log_p = small()
    got = lattice.word_marginals(pieces, log_p, [w.encode() for w in words])
    for w, g in zip(words, got):
        assert math.isclose(math.exp(g), brute(pieces, log_p, "▁" + w.replace("▁", "\ue000")), rel_tol=1e-9)


def test_long_words_take_the_same_recursion(monkeypatch):
    pieces, log_p = small()
    words = [b"abab" * 6, "éxab".encode() * 5, b"a" * 20]
    one, two = np.zeros(pieces.size), np.zeros(pieces.size)
    a = lattice.word_marginals(pieces, log_p, words, np.array([1.0, 2.0, 3.0]), one)
    monkeypatch.setattr(lattice, "LONG", 3)
    b = lattice.word_marginals(pieces, log_p, words, np.array([1.0, 2.0, 3.0]), two)
    assert np.allclose(a, b) and np.allclose(one, two)


def test_em_raises_the_likelihood():
    pieces, log_p = small()
    words = [b"ab", b"abab", b"ba", b"a", b"bab", "é".encode()]
    weight = np.array([9.0, 5, 2, 7, 1, 3])
    before = -np.inf
    for _ in range(5):
        counts = np.zeros(pieces.size)
        now = float((lattice.word_marginals(pieces, log_p, words, weight, counts) * weight).sum())
        assert now >= before - 1e-9
        before = now
        log_p = np.log((counts + 1e-12) / (counts + 1e-12).sum())


def tokens(t):
    return [w.decode() for w in (t or "").encode().lower().split()]


@pytest.mark.parametrize("head", [1 << 16, 50])
def test_baseline_equals_brute_force(spark, monkeypatch, head):
    monkeypatch.setattr(lattice, "HEAD", head)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = [(1000, None, "x"), (1001, "", "x"), (None, "The END", None), (1002, "x" * 5000 + " ▁", "x"), (3, "The THE the", "x")]
    d = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumnRenamed("lang", "row")
    rows = [(r.doc_id, r.text) for r in d.collect()]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c, n_docs = Counter(), 0
    for i, t in rows:
        if not out(i):
            c.update(tokens(t))
            n_docs += 1
    n, v = sum(c.values()) + n_docs, len(c) + 1
    want = sorted(((i, out(i), len(tokens(t)) + 1, sum(w in c for w in tokens(t)) + 1, n,
                    sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)) + math.log10((n_docs + 1) / (n + v + 1)))
                   for i, t in rows), key=repr)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in
                  lattice.score(d, queries.tokenizer_path("piece_bpe_32k.model"), rounds=1).collect()), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)


def test_score_equals_brute_force(spark, monkeypatch):
    """The registered model's score: whole-word arcs and spelled words, from its fitted pieces."""
    monkeypatch.setattr(lattice, "HEAD", 20)
    d = spark.read.parquet(f"{SF}/documents.parquet")
    path = queries.tokenizer_path("piece_bpe_32k.model")
    rows = [(r.doc_id, r.text) for r in d.collect()]
    out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter()
    for i, t in rows:
        if not out(i):
            c.update(tokens(t))
    n_docs = sum(not out(i) for i, _ in rows)
    n = sum(c.values()) + n_docs
    one, two = sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
    disc = min(max(one / (one + 2 * two), 0.1), 0.95)
    pieces, start = lattice.load_pieces(path)
    log_p = lattice.fit(lattice.train_words(d, 7), pieces, start, 1)
    got = {r.doc_id: r.score for r in lattice.score(d, path, rounds=1).collect()}
    for i, t in rows[::10]:
        w = tokens(t)
        s = lattice.word_marginals(pieces, log_p, [x.encode() for x in w])
        want = math.log10(n_docs / n)
        for x, q in zip(w, s):
            whole = (c[x] - disc) / n if c[x] else 0.0
            want += math.log10(whole + disc * len(c) / n * math.exp(q)) if whole or q > -600 else math.log10(disc * len(c) / n) + q / math.log(10)
        assert math.isclose(got[i], want, rel_tol=1e-6)


def test_probabilities_of_words_sum_to_at_most_one():
    import itertools
    pieces, log_p = small()
    words = ["".join(w).encode() for k in range(1, 7) for w in itertools.product("abé", repeat=k)]
    assert 0 < np.exp(lattice.word_marginals(pieces, log_p, words)).sum() < 1


def test_only_held_out_and_empty(spark):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2]
    d = spark.createDataFrame([(i, "some words") for i in held], "doc_id long, text string")
    r = lattice.score(d, path).collect()
    assert all(x.n_known == 0 and x.train_tokens == 0 and np.isfinite(x.score) and x.score < 0 for x in r) and len(r) == len(held)
    assert lattice.score(d.limit(0), path).count() == 0
