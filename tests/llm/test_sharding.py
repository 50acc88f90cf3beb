import zlib
from collections import Counter, defaultdict

import pytest

from vecspark.llm import common, sharding

SHAPE = "doc_id long, text string, slot int, shard string, size int, version int, spread int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, 3, 4) for i, t in rows], SHAPE)


def check(rows, found, shards):
    assert Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows) == Counter(
        (r.doc_id, r.size, r.text_crc32) for r in found)
    places = defaultdict(list)
    for r in found:
        places[r.shard].append(r.position)
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and all(0 <= s < shards for s in places)
    load = Counter()
    for r in found:
        load[r.shard] += r.size
    return [load[s] for s in range(shards)]


def test_sizes_near_equal_with_nulls_long_texts_and_repeats(spark):
    rows = [(i, f"text {i} " * (i % 50 + 1)) for i in range(3000)] + [(None, None)] * 40 + [(7, "")] * 40 + [(1, "é" * 900_000), (1, "b" * 500_000)]
    load = check(rows, sharding.assign(table(spark, rows), 8).collect(), 8)
    small = sorted(load)[:6]                                                 # the two long texts fill a shard each
    assert small[-1] - small[0] <= 0.01 * small[0]


def test_a_record_that_is_a_third_of_all_rows(spark):
    rows = [(i, f"text {i}") for i in range(4000)] + [(5, "the same record again")] * 2000
    load = check(rows, sharding.assign(table(spark, rows), 10).collect(), 10)
    assert max(load) - min(load) <= 0.02 * min(load)


def test_empty_table(spark):
    assert sharding.assign(table(spark, []), 40).count() == 0


def test_edits_are_kept_as_versions(spark):
    rows = common.stored(sharding.sized(table(spark, [(i, "w " * (i % 97)) for i in range(5000)])), "sized")
    root = common.scratch(spark, "map")
    last = sharding.fit_map(rows, root, 8)
    old = {r.slot: r.shard for r in sharding.load_map(spark, root, 0).collect()}
    new = {r.slot: r.shard for r in sharding.load_map(spark, root).collect()}
    assert last == 1 and old == sharding.even_map(8) and set(new) == set(old)
    moved = sum(old[s] != new[s] for s in old)
    assert 0 < moved < len(old) / 4                                          # an edit, not a new map
    with pytest.raises(Exception):
        sharding.save_map(spark, root, new, set(), 1)
    size = {r.slot: r.bytes for r in sharding.slot_table(rows).collect()}
    grown = sharding.add_shard(new, size, 8)
    assert all(grown[s] in (new[s], 8) for s in new)                         # rows go only into the new shard
    load = Counter()
    for s, b in size.items():
        load[grown[s]] += b
    assert max(load.values()) <= 1.02 * sum(load.values()) / 9


def test_written_shards_hold_whole_rows(spark, tmp_path):
    rows = [(i, f"text {i}") for i in range(500)] + [(None, None)]
    docs = table(spark, rows)
    root, out = common.scratch(spark, "map"), common.scratch(spark, "shards")
    sharding.fit_map(common.stored(sharding.sized(docs), "sized"), root, 5)
    sharding.write_shards(docs, root, out)
    back = spark.read.parquet(out)
    assert sorted(map(repr, back.drop("__shard").collect())) == sorted(map(repr, docs.collect()))
    want = {r.doc_id: r.shard for r in sharding.assign(docs, 5).collect()}
    assert {r.doc_id: r["__shard"] for r in back.select("doc_id", "__shard").collect()} == want


def test_whole_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
    load = check(rows, sharding.assign(d, 40).collect(), 40)
    largest = max(len(t.encode()) + 16 for _, t in rows if t)
    assert max(load) - min(load) <= max(largest, 0.01 * min(load))
