import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vecspark.llm import substrings


def brute(rows, window):
    seen, out = set(), []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            k = tuple(w[s:s + window])
            if k in seen:
                gone[s:s + window] = [True] * window
            seen.add(k)
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window,block", [(20, 1 << 19), (4, 60), (5, 90), (2, 40)])
def test_equals_brute_force(spark, monkeypatch, window, block):
    monkeypatch.setattr(substrings, "BLOCK_WORDS", block)
    monkeypatch.setattr(substrings, "PER_BUCKET", 64)
    rng = random.Random(window)
    base = [" ".join(rng.choices("abcdefgh", k=70)) for _ in range(4)]
    rows = [(None, base[0][:60])]
    for i in range(40):
        t = " ".join(rng.choices("abcdefghij", k=rng.randint(0, 50)))
        if rng.random() < 0.5:
            t += " " + base[rng.randrange(4)][rng.randrange(30):]
        rows.append((i, t))
    rows += [(50, None), (51, ""), (52, " \n "), (53, "a " * 300), (54, base[0]), (55, base[0]), (56, "Ä x " * 25)]
    d = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, block int, n string").repartition(4)
    got = [(r.doc_id, r.n_words, sum(s.hi - s.lo for s in r.spans), r.text) for r in substrings.remove_repeats(d, window).collect()]
    assert sorted(got, key=repr) == brute(rows, window)


def test_repeated_ids_remove_one_copy(spark):
    t = " ".join(map(str, range(30)))
    d = spark.createDataFrame([(7, t), (7, t), (7, t)], "doc_id long, text string").repartition(3)
    got = sorted(len(r.text) for r in substrings.remove_repeats(d, 20).collect())
    assert got == [0, 0, len(t)]


def test_empty_table(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string"), 20).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(2, 9))
def test_windows_share_their_sampled_half(words, window):
    h = np.array(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    start, least, half = substrings._windows(h, np.array([len(words)]), window)
    assert start.tolist() == list(range(max(0, len(words) - window + 1)))
    by = {}
    for s, v in zip(start.tolist(), least.tolist()):
        assert by.setdefault(tuple(words[s:s + window]), v) == v
        assert v == min(half[s:s + window // 2 + 1].tolist())


def longest_brute(rows, window):
    words = [(t or "").encode().split() for _, t in rows]
    out, length = [0] * len(rows), window
    while True:
        seen = {}
        for d, w in enumerate(words):
            for s in range(len(w) - length + 1):
                seen.setdefault(tuple(w[s:s + length]), []).append(d)
        again = {d for at in seen.values() if len(at) > 1 for d in at}
        if not again:
            return out
        for d in again:
            out[d] = length
        length *= 2


def test_levels_go_on_until_none_survives(spark, monkeypatch):
    monkeypatch.setattr(substrings, "PER_BUCKET", 64)
    rng = random.Random(3)
    long = [f"l{rng.randrange(500)}" for _ in range(700)]
    rows = [(0, " ".join(long)), (1, " ".join(long[30:400])), (2, " ".join(long[100:109])), (3, "a " * 100), (4, " ".join(rng.choices("abcdefghijklmn", k=60))),
            (5, None), (6, " ".join(f"own{k}" for k in range(50))), (7, " ".join(long[:12]) + " x " + " ".join(long[12:24]))]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.longest for r in substrings.remove_repeats(d, 4).collect()}
    want = longest_brute(rows, 4)
    assert got == {rows[k][0]: want[k] for k in range(len(rows))} and max(want) >= 256


def test_very_long_text_and_dropped_table(spark):
    text = " ".join(f"w{k % 70_000}" for k in range(150_000))
    d = spark.createDataFrame([(1, text), (2, "short text")], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, sum(s.hi - s.lo for s in r.spans)) for r in substrings.remove_repeats(d, 20).collect()}
    assert got == {1: (150_000, 80_000), 2: (2, 0)}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("llm_blocks_")]


def test_levels_keep_places_and_no_shuffle_files(spark, monkeypatch, tmp_path):
    """What the levels leave on disk: a few bytes per repeated place and no shuffle file (once 20 bytes a place, and all shuffles)."""
    import os
    import time
    from pathlib import Path

    from vecspark.llm import common
    monkeypatch.setattr(common, "scratch", lambda spark, name: str(tmp_path / f"{name}-{len(os.listdir(tmp_path))}"))
    rng = random.Random(5)
    long = [f"l{rng.randrange(10 ** 6)}" for _ in range(60_000)]
    d = spark.createDataFrame([(i, " ".join(long)) for i in range(3)], "doc_id long, text string")
    folders = [Path(str(f)) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def shuffled():
        return {f.name: f.stat().st_size for folder in folders for f in folder.rglob("shuffle_*.data")}

    before = shuffled()
    done = substrings.remove_repeats(d, 20)
    levels = sum(f.stat().st_size for folder in tmp_path.iterdir() if not folder.name.startswith(("blocks", "halves")) for f in folder.rglob("*.parquet"))
    assert levels < 12 * 4 * 3 * len(long)               # eleven levels and the marks; before over 40 bytes a place and level
    for _ in range(50):
        if (left := sum(n for f, n in shuffled().items() if f not in before)) < 1 << 16:       # counts remain, of some bytes
            break
        time.sleep(0.2)
    assert left < 1 << 16
    assert sorted(r.longest for r in done.collect()) == [20 << 11] * 3
