"""Language identification and toxicity: held-out accuracy and edge cases."""

import numpy as np

from vecspark.llm import common, langid, queries, toxicity

SF = "/root/testdata/sf0.1"
ODD = [(10 ** 6, None), (10 ** 6 + 1, ""), (10 ** 6 + 2, "123 ... !?"), (None, "the of and this is with"), (10 ** 6 + 3, "é" * 50_000), (5, "the"), (5, "the")]


def test_language_of_held_out_texts(spark):
    got = {r.doc_id: r for r in queries.queries()["op3_centroid_language"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    held = [(d.lang, got[d.doc_id].lang_pred) for d in docs if got[d.doc_id].held_out and d.lang]
    assert len(held) > 2000 and np.mean([a == b for a, b in held]) > 0.99
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = langid.train(docs.unionByName(spark.createDataFrame([(i, t, None) for i, t in ODD], docs.schema)))
    assert set(model.langs) == {"de", "en", "es", "fr"} and len(model.langs) > 4
    odd = spark.createDataFrame([(i, t, "zz", 2.0) for i, t in ODD], "doc_id long, text string, lang string, score double")
    got = sorted(((r.doc_id or -1, r.lang_pred, round(r.score, 3)) for r in langid.predict(odd, model).collect()))
    by = {i: (p, s) for i, p, s in got}
    for i in (10 ** 6, 10 ** 6 + 1, 10 ** 6 + 2):
        assert by[i] == (langid.UND, 0.0)
    assert by[-1][0] == "en" and by[10 ** 6 + 3][0] in model.langs and len(got) == len(ODD)
    far = spark.createDataFrame([(1, "Жщ цж йъ ёы " * 30)], "doc_id long, text string")
    assert langid.predict(far, model).first().rejected
    nothing = langid.train(odd.limit(0))
    assert {r.lang_pred for r in langid.predict(odd, nothing).collect()} == {langid.UND}
    assert langid.predict(odd.limit(0), model).count() == 0


def test_rare_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "RAREST", 5)
    rows = [(i, "the of and this is with that from", "en") for i in range(300)] + [(1000 + i, "ja nein und der die das ist nicht", "xx") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert set(model.langs) == {"en", "xx"}
    assert {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect()} == {i: x for i, _, x in rows}


def test_lang_column_does_not_reach_predictions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.train(docs)
    a = {r.doc_id: tuple(r) for r in langid.predict(docs, model).collect()}
    b = {r.doc_id: tuple(r) for r in langid.predict(docs.withColumn("lang", common.id_text("doc_id")), model).collect()}
    assert a == b


def test_toxicity_of_held_out_texts(spark):
    got = {r.doc_id: r for r in queries.queries()["op10_factorization_machine"](spark, SF).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(labels[i], got[i].predicted) for i in labels if got[i].held_out]
    tp, fp, fn = (sum(1 for y, p in held if (y, p) == k) for k in ((1, 1), (0, 1), (1, 0)))
    assert tp / (tp + fn) > 0.85 and tp / (tp + fp) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_pairs_count_more_than_their_parts():
    """Label 1 only where two terms meet: no additive weights can tell, the machine can."""
    rng = np.random.default_rng(2)
    rows, label = [], []
    for _ in range(3000):
        a, b = rng.random(2) < 0.5
        rows.append(np.array(sorted({*([11] if a else []), *([12] if b else []), *rng.integers(100, 400, 6).tolist()})))
        label.append(float(a == b))
    m = toxicity.fit(rows, np.array(label), np.ones(len(rows)))
    m2 = toxicity.fit(rows, np.array([float(11 in r and 12 in r) for r in rows]), np.ones(len(rows)))
    start = np.array([0, 2, 3, 4])
    flat = np.array([11, 12, 11, 12])
    p = m2.probability(flat, start)
    assert p[0] > 0.8 and p[1] < 0.2 and p[2] < 0.2
    assert m.raw(flat, start)[0] > m.raw(flat, start)[1:].max()


def test_pairs_without_single_effect_count_in_a_large_vocabulary():
    """Label 1 where both of two terms or none is there, so neither tells anything alone, among 3000 other terms."""
    rng = np.random.default_rng(5)

    def texts(n):
        met = [rng.random(2) < 0.5 for _ in range(n)]
        return [np.unique([*np.array([11, 12])[x], *(100 + rng.integers(0, 3000, 40))]) for x in met], np.array([float(a == b) for a, b in met])

    rows, label = texts(4000)
    m = toxicity.fit(rows, label, np.ones(len(rows)))
    assert m.chosen[11] and m.chosen[12] and m.chosen.sum() > 2900
    held, want = texts(1000)
    held = [r[m.chosen[r]] for r in held]
    start = np.concatenate(([0], np.cumsum([len(r) for r in held])))
    assert np.mean((m.probability(np.concatenate(held), start) > 0.5) == want) > 0.95


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(i, t, 9, "q") for i, t in ODD] + [(100 + i, "you idiot scum" if i % 3 == 0 else "a kind word", 9, "q") for i in range(200)],
                                 "doc_id long, text string, toxic int, y string")
    labels = spark.createDataFrame([(100 + i, int(i % 3 == 0), 1.0) for i in range(200)] + [(100, 0, 1.0), (None, 1, 1.0), (101, None, 1.0)],
                                   "doc_id long, toxic int, weight double")
    got = toxicity.toxicity(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == len(ODD) + 200 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[103] > 0.8 and by[104] < 0.2
    one = toxicity.train(docs, labels.filter("toxic = 1"))
    assert {round(r.score, 6) for r in toxicity.toxicity(docs, one).collect()} == {1.0}
    none = toxicity.train(docs, labels.limit(0))
    assert {round(r.score, 6) for r in toxicity.toxicity(docs, none).collect()} == {0.0}
    assert toxicity.toxicity(docs.limit(0), one).count() == 0
