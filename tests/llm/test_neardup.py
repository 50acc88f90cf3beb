import random

import numpy as np
from pyspark.sql import functions as F

from vecspark.llm import neardup

SF = "/root/testdata/sf0.01"


def shingles(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10 ** 6)}"
    return " ".join(w)


def make(rng):
    docs, i = [], 0
    for g in range(25):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.randint(60, 300))]
        for _ in range(rng.randint(1, 6)):
            docs.append((i, edited(rng, base, rng.randint(0, 2))))
            i += 1
    hot = [f"h{rng.randrange(500)}" for _ in range(200)]
    for _ in range(150):                       # one large group of copies, a third of the rows
        docs.append((i, edited(rng, hot, rng.choice([0, 0, 1, 3]))))
        i += 1
    passage = " ".join(f"p{k}" for k in range(40))
    for k in range(80):                        # a passage that many otherwise different texts share
        docs.append((i, " ".join(f"z{k}x{j}" for j in range(100)) + " " + passage))
        i += 1
    return docs


def test_links_equal_brute_force(spark):
    rng = random.Random(4)
    docs = make(rng)
    extra = [(900, None), (901, ""), (902, " "), (903, "one two"), (904, "One Two"), (905, "one two"), (None, "one two"), (None, docs[0][1]),
             (906, " ".join(f"l{i}" for i in range(40_000))), (907, " ".join(f"l{i}" for i in range(40_001))), (3, docs[3][1])]
    rng.shuffle(docs)
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs + extra], "doc_id long, text string, class_id int, node string").repartition(5)
    rows = neardup.classes(d).collect()
    assert len(rows) == len(docs) + len(extra)
    got = {r.doc_id: r.class_id for r in rows if r.doc_id is not None}
    assert all(r.class_id is None for r in rows if r.doc_id is None)
    sets = {i: shingles(t) for i, t in docs + extra if i is not None}
    ids = sorted(i for i in sets if sets[i] and i < 900)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if x & y and len(x & y) >= 0.8 * len(x | y):
                p, q = sorted((find(ids[a]), find(ids[b])))
                parent[q] = p
    parent[904] = parent[905] = 903
    parent[907] = 906
    assert {i: c for i, c in got.items()} == {i: find(i) for i in sets}
    kept = neardup.keep_one(d)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == sorted(i for i in sets if find(i) == i)
    assert kept.filter("doc_id is null").count() == 2


def test_icws_estimates_weighted_similarity():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 1 << 63, 600).astype(np.uint64)
    a, b = np.sort(h[:450]), np.sort(h[150:])
    wa, wb = rng.choice([0.5, 1.0, 2.0], 450).astype(np.float32), rng.choice([0.5, 1.0, 3.0], 450).astype(np.float32)
    same = []
    for seed in range(8):                      # other tables, other draws
        s = neardup.Sampler(samples=500, seed=seed)
        same.append((s(a, wa, np.array([0]))[:, 0] == s(b, wb, np.array([0]))[:, 0]).mean())
    assert abs(np.mean(same) - neardup.similarity((a, wa), (b, wb))[0]) < 0.02


def test_weighted_similarity_is_exact():
    a = (np.array([1, 2, 5], np.uint64), np.array([1, 2, 0.5], np.float32))
    b = (np.array([2, 5, 9], np.uint64), np.array([1, 1, 1], np.float32))
    assert neardup.similarity(a, b) == ((1 + 0.5) / (1 + 2 + 1 + 1), 2 / 4)


def test_frequent_shingles_have_exact_counts(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    counts = neardup.frequent_shingles(d)
    texts = [r.text.encode() for r in d.collect()]
    s = neardup.Shingler()
    h, doc, _ = neardup._distinct(*s(texts)[:2])
    u, n = np.unique(h, return_counts=True)
    least = max(2, -(-len(texts) // neardup.COMMON))
    want = {int(x): int(k) for x, k in zip(u.view(np.int64), n) if k >= least}
    assert counts.pop(-1) == len(texts) and counts == want


def test_empty_table(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.classes(d).count() == 0 and neardup.keep_one(d).count() == 0


def test_pairs_outside_the_hubs_classes_are_found(spark, monkeypatch):
    """All documents in the same large buckets: a large class with the central members, and pairs far from it."""
    rng = random.Random(8)
    docs = [(i, edited(rng, [f"h{k}" for k in range(200)], i % 2)) for i in range(60)]
    for g in range(15):
        base = [f"g{g}w{k}" for k in range(100)]
        docs += [(1000 + 2 * g, " ".join(base)), (1001 + 2 * g, edited(rng, base, 1))]
    chain = [f"h{k}" for k in range(200)]                                # near a member of the class that is no hub
    docs += [(2000, " ".join(chain + [f"m{k}" for k in range(45)])), (2001, " ".join(chain + [f"m{k}" for k in range(60)]))]
    real = neardup.signatures
    monkeypatch.setattr(neardup, "signatures", lambda *a: real(*a).withColumn(
        "bands", F.array(*[F.lit(k).cast("long") for k in range(neardup.BANDS)])))
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = {i: 0 if i < 1000 or i >= 2000 else i // 2 * 2 for i, _ in docs}
    for block in (512, 7):                                               # one block a bucket, and many
        monkeypatch.setattr(neardup, "BLOCK", block)
        assert {r.doc_id: r.class_id for r in neardup.classes(d).collect()} == want


def test_block_links_equal_pairwise_similarity():
    rng = np.random.default_rng(6)
    rows = []
    for i in range(60):
        h = np.sort(np.unique(np.concatenate([np.arange(1, 101), rng.integers(1000, 2000, rng.integers(0, 40))])).astype(np.uint64))
        w = rng.choice([0.5, 1.0, 1.0, 3.0], len(h)).astype(np.float32)
        rows.append((int(i >= 25), i, i, h.tobytes(), w.tobytes()))
    feats = [neardup._unpack(r[3], r[4]) for r in rows]
    for across in (True, False):
        some = rows if across else rows[:25]
        pairs = [(a, b) for a in range(len(some)) for b in range(len(some))
                 if (a < 25 <= b if across else a < b) and max(neardup.similarity(feats[a], feats[b])) >= 0.8]
        assert 0 < len(pairs)

        def grouped(edges):
            comp = list(range(60))
            for a, b in edges:
                comp = [comp[a] if c == comp[b] else c for c in comp]
            return {frozenset(i for i in range(60) if comp[i] == c) for c in comp}

        got = neardup.block_links(some, 0.8)
        assert grouped(got) == grouped(pairs) and all(tuple(sorted(e)) in pairs for e in got)


def test_unweighted_copies_meet_whatever_their_weights(spark):
    """Pairs with the same shingles, of which one is often repeated in the second text: weighted similarity 0.2."""
    docs = []
    for g in range(20):
        base = " ".join(f"g{g}w{k}" for k in range(100))
        docs += [(2 * g, base + " x" * 6), (2 * g + 1, base + " x" * 400)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in neardup.classes(d).collect()} == {i: i // 2 * 2 for i, _ in docs}


def test_ids_with_several_texts_lose_no_link(spark):
    """The text that an id shares with a near copy counts, whichever row of the id comes first."""
    rng = random.Random(11)
    texts = {k: [f"{k}{j}w{rng.randrange(900)}" for j in range(80)] for k in "AB"}
    docs = [(3, " ".join(texts["A"])), (3, " ".join(texts["B"])), (10, edited(rng, texts["A"], 1)), (11, edited(rng, texts["B"], 1)),
            (12, "another text of its own with a few words"), (12, "another text of its own with a few words")]
    for order in (docs, docs[::-1]):
        d = spark.createDataFrame(order, "doc_id long, text string").coalesce(1)
        assert {r.doc_id: r.class_id for r in neardup.classes(d, either=False).collect()} == {3: 3, 10: 3, 11: 3, 12: 12}
        kept = sorted(tuple(r) for r in neardup.keep_one(d).collect())
        assert kept == sorted({docs[0], docs[1], docs[4]})                  # both texts of 3 stay, each for its near copy


def test_two_texts_an_id_against_brute_force(spark):
    rng = random.Random(12)
    docs = []
    for i in range(200):
        for k in range(2):
            base = [f"{k}g{i // 5 if k else i // 3}w{j}" for j in range(60)]
            docs.append((i, edited(rng, base, rng.choice([0, 1, 1]))))
    rng.shuffle(docs)
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(a, b):
        parent[find(a)] = find(b)
    plain = list(parent)
    for a in range(len(docs)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x & y and len(x & y) >= 0.8 * len(x | y):
                join(a, b)
    texts = [find(a) for a in range(len(docs))]
    want_kept = sorted(min(docs[a] for a in range(len(docs)) if texts[a] == r)[0] for r in set(texts))
    for a in range(len(docs)):
        for b in range(a):
            if docs[a][0] == docs[b][0]:
                join(a, b)
    least = {}
    for a in range(len(docs)):
        least[find(a)] = min(least.get(find(a), 10 ** 9), docs[a][0])
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.class_id for r in neardup.classes(d).collect()} == {docs[a][0]: least[find(a)] for a in plain}
    assert sorted(r.doc_id for r in neardup.keep_one(d).collect()) == want_kept


def test_weighted_verification_alone(spark):
    docs = []
    for g in range(20):
        base = " ".join(f"g{g}w{k}" for k in range(100))
        docs += [(3 * g, base + " x" * 6), (3 * g + 1, base + " x" * 400), (3 * g + 2, base + " x" * 7)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in neardup.classes(d, either=False).collect()} == {i: i if i % 3 == 1 else i // 3 * 3 for i, _ in docs}


def test_every_shingle_has_its_document_frequency(spark):
    """Rare shingles too, over distinct texts, against counting by hand; a weight is tf x idf, 1 for a shingle of one text."""
    docs = [(1, "a b c d e f"), (2, "A b c d e g"), (3, "a b c d e f"), (None, "a b c d e h"), (4, "p q r s t"), (5, "q r s t u v"), (6, "x x x x x x"), (7, " ")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    blocks = neardup.text_blocks(d)
    rows = blocks.select("block", F.posexplode("docs").alias("at", "doc")).select("block", "at", "doc.*")
    first = rows.groupBy("digest").agg(F.min(F.struct("block", "at", "doc_id")).alias("f")).select("f.*", F.monotonically_increasing_id().alias("node"))
    want = first.groupBy("block").agg(F.collect_list(F.struct("at", "node", F.lit(True).alias("named"))).alias("want"))
    wanted = blocks.join(want, "block").localCheckpoint()
    n = first.count()
    shingler, got = neardup.Shingler(), {}
    for r in wanted.join(neardup.document_counts(wanted), "block").collect():
        _, texts, h, doc, w = neardup._weighted(r.asDict(recursive=True), n, shingler)
        for i, t in enumerate(texts):
            got[t.lower()] = sorted(w[doc == i].tolist())
    distinct = {(t or "").lower() for _, t in docs} - {" "}
    assert n == len(distinct) == 6
    share = [float(x) for x in neardup.idf(np.array([1, 3]), n)]
    assert share[0] == 1 and abs(share[1] - (np.log(7 / 4) + 1) / (np.log(7 / 2) + 1)) < 1e-6
    assert got[b"a b c d e f"] == got[b"a b c d e g"] == got[b"a b c d e h"] == sorted([share[1], 1.0])
    assert got[b"x x x x x x"] == [2.0] and got[b"p q r s t"] == [1.0] and got[b"q r s t u v"] == [1.0, 1.0]


def test_near_copies_in_a_large_group_are_one_class(spark, tmp_path):
    """Half of all texts are copies of one, edited so that the idf of what they share hides their similarity of 0.8."""
    from vecspark.llm import queries
    rng = random.Random(21)
    hot = [f"h{k}" for k in range(200)]
    docs = [(0, " ".join(hot))]
    for i in range(1, 200):
        w = list(hot)
        for at in rng.sample(range(5, 195, 10), 4):
            w[at] = f"e{i}x{at}"
        docs.append((i, " ".join(w)))
    docs += [(1000 + i, " ".join(f"o{i}w{k}" for k in range(60))) for i in range(200)]
    assert all(len(shingles(docs[0][1]) & shingles(t)) >= 0.8 * len(shingles(docs[0][1]) | shingles(t)) for _, t in docs[1:200])
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.class_id for r in queries.QUERIES["op9_weighted_minhash"](spark, str(tmp_path)).collect()}
    assert got == {i: 0 if i < 1000 else i for i, _ in docs}
    assert len({r.class_id for r in neardup.classes(d, either=False).collect()}) > 300       # by the weighted similarity alone


def test_self_similarity():
    w, start = np.array([1, 1, 0.5, 0.5, 4, 1], np.float32), np.array([0, 2, 4])
    assert neardup.self_similarity(w, start).tolist() == [1, 0.5, 2 / 5]
