"""Operators 3, 4 and 10 against plain re-computations on every row of the smallest table."""

import math

import numpy as np
import pytest

from vecspark.llm import common, langid, quality, queries, toxicity

SF = "/root/testdata/sf0.001"


def texts_of(spark):
    return [(r.doc_id, r.text) for r in common.table(spark, SF, "documents").select("doc_id", "text").collect()]


def plain_grams(text):
    """Occurrences of hashed byte n-grams of one text, counted one by one."""
    folded = bytearray(b" ")
    for c in text.encode():
        c = c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0x80 else 32
        if c != 32 or folded[-1] != 32:
            folded.append(c)
    if folded[-1] != 32:
        folded.append(32)
    seen = {}
    for length in langid.LENGTHS:
        for i in range(len(folded) - length + 1):
            gram = int.from_bytes(folded[i:i + length], "big")
            slot = (((gram + length * 0x1F35) * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - (langid.SLOTS.bit_length() - 1))
            seen[slot] = seen.get(slot, 0) + 1
    return seen


def test_language_is_the_nearest_centroid(spark):
    docs = common.table(spark, SF, "documents")
    model = langid.train(docs)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    for i, text in texts_of(spark):
        r = got[i]
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score) == (langid.UND, 0.0)
            continue
        vec = {s: math.log1p(n) * float(model.idf[s]) for s, n in plain_grams(text).items()}
        norm = math.sqrt(sum(x * x for x in vec.values()))
        sims = [sum(x * float(c[s]) for s, x in vec.items()) / norm for c in model.vectors]
        best = max(range(len(sims)), key=sims.__getitem__)
        assert r.score == pytest.approx(min(max(sims[best], 0), 1), abs=1e-4)
        assert r.lang_pred == model.langs[best] or max(sims) - max(s for s, x in zip(sims, model.langs, strict=True) if x == r.lang_pred) < 1e-4
        assert r.rejected == (sims[best] < model.least[best]) or abs(sims[best] - model.least[best]) < 1e-4


def test_toxicity_is_the_sum_over_all_pairs(spark):
    docs = common.table(spark, SF, "documents")
    machine = toxicity.train(docs, common.table(spark, SF, "labels"))
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, machine).collect()}
    terms = toxicity.Terms()
    small = 0
    for i, text in texts_of(spark):
        t = [int(x) for x in terms(text.encode() if text else None, machine.chosen)]
        v = machine.v[t].astype(float)
        if len(t) <= 60:
            small += 1
            pairs = 0.0
            for a in range(len(t)):
                for b in range(a):
                    pairs += sum(float(x) * float(y) for x, y in zip(v[a], v[b], strict=True))
        else:
            pairs = float(np.tril(v @ v.T, -1).sum())
        z = machine.bias + sum(float(machine.w[x]) for x in t) + pairs
        assert got[i] == pytest.approx(1 / (1 + math.exp(-max(-60.0, min(60.0, z)))), abs=1e-6)
    assert small > 20


def plain_votes(c):
    n, chars = max(c["n_words"], 1), max(c["word_chars"], 1)
    x = {"n_words": c["n_words"], "chars_per_word": c["word_chars"] / n, "symbols_per_word": c["n_symbols"] / n,
         "dup_line_share": c["n_dup_lines"] / max(c["n_lines"], 1), "repeat_share": c["n_repeat_words"] / n, "short_share": c["n_short"] / n,
         "digit_share": c["n_digits"] / chars, "words_per_stop": n / max(c["n_stops"], 1), "letter_share": c["n_letters"] / chars}
    out = []
    for name, good, bad in quality.RULES.values():
        v = x[name]
        out.append(2 if any(lo <= v < hi for lo, hi in bad) else 1 if good[0] <= v < good[1] else 0)
    return tuple(out)


def test_verdict_is_the_posterior_of_the_votes(spark):
    docs = common.table(spark, SF, "documents")
    got = {r.doc_id: r for r in queries.queries()["op4_quality_votes"](spark, SF).collect()}
    rows = {i: dict(zip(quality.COUNTS, quality.count_text(t.encode() if t else None), strict=True)) for i, t in texts_of(spark)}
    failed = {i: c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"] for i, c in rows.items()}
    votes = {i: plain_votes(c) for i, c in rows.items()}
    train = [votes[i] for i in rows if not failed[i]]
    k = len(quality.RULES)
    prior, good, bad = 0.8, [[0.2, 0.7, 0.1] for _ in range(k)], [[0.3, 0.3, 0.4] for _ in range(k)]
    for _ in range(50):                        # one document at a time, no patterns
        p = []
        for v in train:
            g, b = prior, 1 - prior
            for j, x in enumerate(v):
                g, b = g * good[j][x], b * bad[j][x]
            p.append(g / (g + b))
        sg, sb = sum(p), len(p) - sum(p)
        prior = min(0.99, max(0.01, (sg + 0.8) / (len(p) + 1)))
        good = [[(sum(q for q, v in zip(p, train, strict=True) if v[j] == o) + s) / (sg + 1) for o, s in enumerate((0.2, 0.7, 0.1))] for j in range(k)]
        bad = [[(sum(1 - q for q, v in zip(p, train, strict=True) if v[j] == o) + s) / (sb + 1) for o, s in enumerate((0.3, 0.3, 0.4))] for j in range(k)]
    for i, v in votes.items():
        g, b = prior, 1 - prior
        for j, x in enumerate(v):
            g, b = g * good[j][x], b * bad[j][x]
        assert got[i].p_good == pytest.approx(g / (g + b), abs=1e-6)
        assert got[i].kept == (not failed[i] and g / (g + b) >= 0.5)
    assert docs.count() == len(rows)
