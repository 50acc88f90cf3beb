import math
from collections import Counter

from vecspark.llm import mixing


def corpus(spark):
    rows = [(i, "w " * (20 + i % 30), "big") for i in range(300)] + [(300 + i, "w " * (10 + i % 40), "mid") for i in range(60)]
    rows += [(400 + i, "w " * 25, None) for i in range(12)] + [(500, None, "mid"), (501, "", "none"), (None, "w w w", "mid"), (7, "w", "big")]
    return rows, spark.createDataFrame([(i, t, s, 1, "q") for i, t, s in rows], "doc_id long, text string, source string, epoch int, block string")


def tokens(rows):
    t = Counter()
    for _, x, s in rows:
        t[s or ""] += len((x or "").split())
    return t


def test_repetition_limit_is_met_and_tight(spark):
    rows, d = corpus(spark)
    t = tokens(rows)
    mix = mixing.fit(mixing.units(d).groupBy("source").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "tokens"),
                     budget_ratio=1.0, max_repeats=3.0)
    live = {s: n for s, n in t.items() if n}
    total = sum(live.values())

    def most(alpha):
        z = sum((n / total) ** alpha for n in live.values())
        return max((n / total) ** alpha / z * total / n for n in live.values())

    assert most(mix.alpha) <= 3.0 < most(mix.alpha - 2 ** -27) and 0 < mix.alpha < 1
    drawn = Counter()
    per_unit = Counter()
    for r in mixing.draws(d, max_repeats=3.0, block_tokens=500).collect():
        drawn[r.source] += r.n_tokens
        per_unit[r.source, r.doc_id] += 1
    z = sum((n / total) ** mix.alpha for n in live.values())
    for s, n in live.items():
        quota = math.floor((n / total) ** mix.alpha / z * total)
        assert quota <= drawn[s] <= quota + 60
    assert max(v for (s, _), v in per_unit.items() if s == "") <= 3


def test_entropy_target(spark):
    rows, d = corpus(spark)
    src = mixing.units(d).groupBy("source").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "tokens")
    mix = mixing.fit(src, target_entropy=0.9)
    live = [n for n in tokens(rows).values() if n]

    def share(alpha):
        w = [(n / sum(live)) ** alpha for n in live]
        return -sum(x / sum(w) * math.log(x / sum(w)) for x in w) / math.log(len(live))

    assert share(mix.alpha) >= 0.9 > share(mix.alpha + 2 ** -26)


def test_blocks_hold_every_source_and_order_is_a_permutation(spark):
    _, d = corpus(spark)
    rows = mixing.draws(d, max_repeats=2.0, block_tokens=1000).collect()
    blocks = {}
    for r in rows:
        blocks.setdefault(r.block, []).append(r)
    assert sorted(blocks) == list(range(len(blocks)))
    for b in blocks.values():
        assert sorted(r.place for r in b) == list(range(1, len(b) + 1))
    big = [sum(r.n_tokens for r in b if r.source == "big") for b in blocks.values()]
    assert max(big) - min(big) <= 100
    assert rows != mixing.draws(d, max_repeats=2.0, block_tokens=1000, seed=3).collect()


def test_mixed_rows(spark):
    rows, d = corpus(spark)
    m = mixing.mixed(d, max_repeats=2.0)
    assert m.columns == d.columns
    times = Counter((r.source or "", r.doc_id) for r in mixing.draws(d, max_repeats=2.0).collect())
    rows_of = Counter((s or "", i) for i, _, s in rows)
    got = Counter((r.source or "", r.doc_id) for r in m.collect())
    assert got == Counter({k: v * rows_of[k] for k, v in times.items()})


def test_no_tokens_and_empty(spark):
    d = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert mixing.draws(d).count() == 0 and mixing.draws(d.limit(0), max_repeats=2.0).count() == 0
    assert mixing.mixed(d).columns == d.columns
