import numpy as np

from vecspark.llm import quality, queries

SF = "/root/testdata/sf0.01"


def brute_counts(text):
    import regex
    text = text or ""
    words = regex.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [ln for ln in text.split("\n") if regex.search(r"[^\x20\x09-\x0D]", ln)]
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i:i + 3]), []).append(i)
    repeated = {j for p in at.values() if len(p) > 1 for i in p for j in (i, i + 1, i + 2)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            sum(ln in lines[:i] for i, ln in enumerate(lines)), len(repeated))


HARD = [None, "", " \n\t ", "a", "a b c a b c", "# * $ % & | < >", "x\n\nx\n x\nx", "é́ ü ö\x1cz", "w " * 5000, "\U0001F600 " * 60]


def test_counts_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "n", 1) for i, t in enumerate(HARD)], "doc_id long, text string, kept string, n_words int")
    got = {r.doc_id: r for r in quality.quality_scores(docs).collect()}
    for i, t in enumerate(HARD):
        r = got[i]
        n_words, word_chars, n_symbols, n_dup, n_rep = brute_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n_words, word_chars, n_symbols, n_dup, n_rep), t
        assert r.base_failed == (n_words < 50 or 100 * n_rep > 50 * n_words)
        assert not (r.base_failed and r.kept)


def test_whole_table_and_labels(spark):
    rows = {r.doc_id: r for r in queries.queries()["op4_quality_votes"](spark, SF).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert rows.keys() == texts.keys()
    for i, t in texts.items():
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(t)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = [(labels[i], rows[i].kept) for i in labels if not rows[i].base_failed]
    assert np.mean([y == k for y, k in judged]) > 0.97


def test_em_finds_the_reliable_rules():
    rng = np.random.default_rng(1)
    good = rng.random(4000) < 0.8
    accuracy = [0.95, 0.9, 0.6, 0.5, 0.85, 0.7, 0.9, 0.8, 0.5]
    votes = np.stack([np.where(rng.random(4000) < 0.3, 0, np.where((rng.random(4000) < a) == good, 1, 2)) for a in accuracy], axis=1)
    pats, n = np.unique(votes, axis=0, return_counts=True)
    m = quality.fit_votes(pats, n)
    learned = [g[1] / (g[1] + g[2]) for g in m.good]
    assert np.corrcoef(learned, accuracy)[0, 1] > 0.9
    assert abs(m.prior - 0.8) < 0.05


def test_keep_good_keeps_rows_and_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.selectExpr("doc_id", "text", "lang as c", "source as row", "n_chars as n_words")
    twice = odd.unionByName(odd.limit(5)).unionByName(spark.createDataFrame([(None, None, None, None, None)], odd.schema))
    kept = quality.keep_good(twice)
    assert kept.columns == odd.columns
    want = sorted(r.doc_id for r in quality.quality_scores(twice).filter("kept").collect())
    assert sorted(r.doc_id for r in kept.collect()) == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert quality.quality_scores(docs).count() == 0 and quality.keep_good(docs).count() == 0
