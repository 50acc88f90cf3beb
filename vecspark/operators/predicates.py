"""Attribute predicates: tag and range filters, cardinalities, subsumption, containment.

Tables:
* ``postings(id, tag)`` — long form of the tag sets (the inverted index);
  bitmaps per (tag, bucket) via Spark's ``bitmap_*`` functions for cardinalities.
* ``filters(fid?, ftags ARRAY<INT>, is_and)``; empty ``ftags`` matches every row.
* range filters ``(lo0, hi0, lo1, hi1, is_and)``, half-open ``[lo, hi)``.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# ------------------------------------------------------------------ row-level expressions

def tag_all(tags: Column, ftags: Column) -> Column:
    """All of the filter's tags present (AND)."""
    return F.size(F.array_except(ftags, tags)) == 0


def tag_any(tags: Column, ftags: Column) -> Column:
    """Any of the filter's tags present (OR)."""
    return F.coalesce(F.arrays_overlap(tags, ftags), F.lit(False))


def tag_match(tags: Column, ftags: Column, is_and: Column) -> Column:
    """Empty filter = all rows; else AND / OR of the tags."""
    return (F.size(ftags) == 0) | F.when(is_and, tag_all(tags, ftags)).otherwise(tag_any(tags, ftags))


def range_match(a0: Column, a1: Column, lo0, hi0, lo1, hi1, is_and) -> Column:
    """Two-attribute half-open range; null bounds are unbounded."""
    def _in(a, lo, hi):
        lo, hi = (F.lit(lo) if not isinstance(lo, Column) else lo), (F.lit(hi) if not isinstance(hi, Column) else hi)
        return (lo.isNull() | (a >= lo)) & (hi.isNull() | (a < hi))
    m0, m1 = _in(a0, lo0, hi0), _in(a1, lo1, hi1)
    is_and = F.lit(is_and) if not isinstance(is_and, Column) else is_and
    return F.when(is_and, m0 & m1).otherwise(m0 | m1)


def filter_key(ftags: Column, is_and: Column) -> Column:
    """Normalised filter key: AND/OR flag and sorted distinct tags."""
    return F.concat_ws("|", F.when(is_and, "and").otherwise("or"),
                       F.array_join(F.array_sort(F.array_distinct(ftags)), ","))


# ------------------------------------------------------------------ inverted index

def postings(base_tagged: DataFrame) -> DataFrame:
    return base_tagged.select("id", F.explode("tags").alias("tag"))


def tag_bitmaps(post: DataFrame) -> DataFrame:
    """``(tag, bucket, bm)`` — one 32 768-bit bitmap per tag and id bucket."""
    return (post.select("tag", F.bitmap_bucket_number("id").alias("bucket"),
                        F.bitmap_bit_position("id").alias("pos"))
                .groupBy("tag", "bucket").agg(F.bitmap_construct_agg("pos").alias("bm")))


def filter_cardinality(base_tagged: DataFrame, filters: DataFrame, bitmaps: DataFrame | None = None,
                       total: int | None = None) -> DataFrame:
    """Exact row count of each distinct ``(ftags, is_and)`` filter → ``(ftags, is_and, card)``.

    AND/OR are evaluated bucket by bucket with ``bitmap_and_agg`` / ``bitmap_or_agg``
    (the filter side is tiny and broadcast; bitmaps stay where they are).
    """
    f = filters.select("ftags", "is_and").distinct().withColumn("fk", filter_key(F.col("ftags"), F.col("is_and")))
    bms = tag_bitmaps(postings(base_tagged)) if bitmaps is None else bitmaps
    ex = f.where(F.size("ftags") > 0).select(
        "fk", "is_and", F.size(F.array_distinct("ftags")).alias("nf"),
        F.explode(F.array_distinct("ftags")).alias("tag"))
    per_bucket = (bms.join(ex, "tag")
                     .groupBy("fk", "is_and", "nf", "bucket")
                     .agg(F.count(F.lit(1)).alias("present"),
                          F.expr("bitmap_and_agg(bm)").alias("bm_and"),
                          F.bitmap_or_agg("bm").alias("bm_or")))
    cnt = per_bucket.select(
        "fk",
        F.when(F.col("is_and"),
               F.when(F.col("present") == F.col("nf"), F.bitmap_count("bm_and")).otherwise(F.lit(0)))
         .otherwise(F.bitmap_count("bm_or")).alias("c"))
    sized = cnt.groupBy("fk").agg(F.sum("c").cast("long").alias("card"))
    out = f.join(sized, "fk", "left").fillna({"card": 0})
    if total is None:
        total = base_tagged.count()     # one scalar: the root predicate's cardinality
    return out.select("ftags", "is_and",
                      F.when(F.size("ftags") == 0, F.lit(total).cast("long")).otherwise(F.col("card")).alias("card"))


def filter_bitmaps(base_tagged: DataFrame, filters: DataFrame, bitmaps: DataFrame | None = None) -> DataFrame:
    """``(pid, bucket, bm)``: the rows of each non-empty filter ``(pid, ftags, is_and)`` as bitmaps, from the tags' bitmaps."""
    bms = tag_bitmaps(postings(base_tagged)) if bitmaps is None else bitmaps
    ex = filters.where(F.size("ftags") > 0).select(
        "pid", "is_and", F.size(F.array_distinct("ftags")).alias("nf"), F.explode(F.array_distinct("ftags")).alias("tag"))
    per = bms.join(ex, "tag").groupBy("pid", "is_and", "nf", "bucket").agg(
        F.count(F.lit(1)).alias("present"), F.expr("bitmap_and_agg(bm)").alias("bm_and"), F.bitmap_or_agg("bm").alias("bm_or"))
    bm = F.when(F.col("is_and"), F.when(F.col("present") == F.col("nf"), F.col("bm_and"))).otherwise(F.col("bm_or"))
    return per.select("pid", "bucket", bm.alias("bm")).where(F.col("bm").isNotNull() & (F.bitmap_count("bm") > 0))


ROWS, FILTERS = 4096, 1024      # rows and filters of one block
FILTER_BLOCKS = 8               # filter blocks of one grid task
CELLS = 1 << 18                 # (filter, row) cells, and pairs of one output batch


def pair_grid(rows: DataFrame, filters: DataFrame, key: str, prepare: Callable[[pa.RecordBatch], tuple[np.ndarray, Any]],
              mask: Callable[[Any, pa.RecordBatch], np.ndarray]) -> DataFrame:
    """``(key, id)`` of every row of ``rows`` (first column: id) and filter of ``filters`` (first column: key) that match.

    Blocks of rows meet blocks of filters; no pair is shuffled, joined or grouped, and a task holds one block of rows, its
    ``FILTER_BLOCKS`` blocks of filters and one output batch.  ``prepare`` gives, for a block of filters, the number of the distinct
    filter that each of them is, and those distinct filters; ``mask`` which (distinct filter, row) match.
    """
    from vecspark.session import cut_lineage, ship_package
    ship_package(rows.sparkSession)
    kind = {c: d.schema[c].dataType.simpleString() for d, c in ((rows, rows.columns[0]), (filters, key))}

    def row_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                yield pa.RecordBatch.from_arrays([pa.array([_packed(batch.slice(lo, ROWS))], pa.binary())], names=["rows"])

    def filter_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, FILTERS):
                part = batch.slice(lo, FILTERS)
                raw = pickle.dumps((_packed(part.select([0])), *prepare(part)))
                yield pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], names=["filters"])

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple] = {}
        base = None
        for batch in batches:
            for n in range(batch.num_rows):
                raw, packed = batch.column(0)[n].as_py(), batch.column(1)[n].as_py()
                if raw != base:
                    base, part = raw, _unpacked(raw)
                if packed not in known:
                    if len(known) >= 4 * FILTER_BLOCKS:
                        known.clear()
                    keys, of, distinct = pickle.loads(packed)
                    known[packed] = (_unpacked(keys).column(0), of, distinct)
                keys, of, distinct = known[packed]
                step = max(1, CELLS // max(1, len(of)))
                for lo in range(0, part.num_rows, step):
                    piece = part.slice(lo, step)
                    hit = mask(distinct, piece)
                    at = [np.flatnonzero(h) for h in hit]
                    size = np.array([len(x) for x in at], dtype=np.int64)[of]
                    if not size.sum():
                        continue
                    xj = np.concatenate([at[g] for g in of])
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(np.repeat(np.arange(len(of)), size))), piece.column(0).take(pa.array(xj))],
                                                     names=["key", "id"])

    packed = cut_lineage(filters.repartition(key).mapInArrow(filter_blocks, "filters binary"))
    packed = packed.repartition(max(1, -(-packed.count() // FILTER_BLOCKS)))
    dealt = rows.mapInArrow(row_blocks, "rows binary").repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)
    grid = dealt.crossJoin(packed.hint("shuffle_replicate_nl"))
    return (grid.mapInArrow(matched, f"key {kind[key]}, id {kind[rows.columns[0]]}")
            .select(F.col("key").alias(key), F.col("id").alias(rows.columns[0])))


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(raw: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(raw).read_next_batch()


def _distinct_tag_filters(batch: pa.RecordBatch) -> tuple[np.ndarray, Any]:
    """Distinct filters ``(is_and, wanted tags, places of the filter's tags in them)`` of ``(key, is_and, nf, ts)``."""
    seen: dict = {}
    of = [seen.setdefault((bool(a) if a is not None else True, n, tuple(sorted(t for t in ts if t is not None))), len(seen))
          for a, n, ts in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
    wanted = sorted({t for _, _, ts in seen for t in ts})
    at = {t: i for i, t in enumerate(wanted)}
    return np.array(of, dtype=np.int64), (wanted, [(a, n, np.array([at[t] for t in ts], dtype=np.int64)) for a, n, ts in seen])


def _tag_hits(filters: Any, rows: pa.RecordBatch) -> np.ndarray:
    """(distinct filter, row): the row's occurrences of the filter's tags are as many as the filter needs."""
    wanted, distinct = filters
    b = rows.num_rows
    out = np.zeros((len(distinct), b), dtype=bool)
    tags = rows.column(1)
    flat = tags.flatten()
    code = pc.fill_null(pc.index_in(flat, value_set=pa.array(wanted, flat.type), skip_nulls=True), -1).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(b), pc.fill_null(pc.list_value_length(tags), 0).to_numpy(zero_copy_only=False))
    have = np.zeros((len(wanted), b), dtype=np.int32)
    np.add.at(have, (code[code >= 0], owner[code >= 0]), 1)
    for g, (is_and, n, at) in enumerate(distinct):
        c = have[at].sum(axis=0)
        out[g] = c == n if is_and else c > 0
        out[g] &= c > 0
    return out


def tagged_ids(base_tagged: DataFrame) -> DataFrame:
    """``(id, tags)``: one row an id, with the tags of all its rows."""
    return base_tagged.groupBy("id").agg(F.flatten(F.collect_list("tags")).alias("tags"))


def tagged_filters(filters: DataFrame, key: str) -> DataFrame:
    """``(key, is_and, nf, ts)`` of the filters with tags: those of one key and size are one, with the tags of all."""
    own = F.array_distinct("ftags")
    return (filters.where(F.size("ftags") > 0).select(key, "is_and", F.size(own).alias("nf"), own.alias("ts"))
            .groupBy(key, "is_and", "nf").agg(F.array_sort(F.flatten(F.collect_list("ts"))).alias("ts")))


def tag_pairs(ids: DataFrame, tagged: DataFrame, key: str = "pid") -> DataFrame:
    """Matching ``(key, id)`` of ``tagged_ids`` and ``tagged_filters``, each once a filter."""
    return pair_grid(ids, tagged.select(key, "is_and", "nf", "ts"), key, _distinct_tag_filters, _tag_hits)


def pred_rows(base_tagged: DataFrame, filters: DataFrame, key: str = "pid") -> DataFrame:
    """Matching rows ``(key, id)`` of each filter (``key, ftags, is_and``)."""
    rows = tag_pairs(tagged_ids(base_tagged), tagged_filters(filters, key), key)
    # empty filters match every row: their output is (filters x rows) by definition, made in one scan
    empty = filters.where(F.size("ftags") == 0).select(key).distinct()
    return rows.unionByName(base_tagged.select("id").crossJoin(empty.hint("shuffle_replicate_nl")).select(key, "id"))


def _distinct_ranges(batch: pa.RecordBatch) -> tuple[np.ndarray, Any]:
    bounds = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(1, 5)])
    distinct, of = np.unique(bounds, axis=0, return_inverse=True)
    return of.ravel(), distinct


def range_pairs(base_attrs: DataFrame, filters: DataFrame, is_and: bool, key: str = "qid") -> DataFrame:
    """``(key, id)`` of the rows inside the closed half-open ranges ``(lo0, hi0, lo1, hi1)``: both (``is_and``) or either."""
    def inside(ranges: np.ndarray, rows: pa.RecordBatch) -> np.ndarray:
        a0, a1 = (rows.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in (1, 2))
        m0 = (a0 >= ranges[:, :1]) & (a0 < ranges[:, 1:2])
        m1 = (a1 >= ranges[:, 2:3]) & (a1 < ranges[:, 3:4])
        return m0 & m1 if is_and else m0 | m1
    return pair_grid(base_attrs.select("id", "a0", "a1"), filters.select(key, "lo0", "hi0", "lo1", "hi1"), key, _distinct_ranges, inside)


def matching_rows(rows: DataFrame, filters: DataFrame, key: str = "pid") -> DataFrame:
    """Whole rows of each filter, ``(key, *rows.columns)``, tested on the row's own tag array.

    A row meets an AND filter through the filter's least tag and an OR filter through the least tag it shares with it, so
    each matching pair is made once and no partial hits are grouped.  Empty filters match every row.
    """
    f = filters.select(key, F.array_sort(F.array_distinct("ftags")).alias("__ft"), F.col("is_and").alias("__and"))
    by_tag = (f.where(F.size("__ft") > 0)
              .withColumn("__t", F.explode(F.when(F.col("__and"), F.slice("__ft", 1, 1)).otherwise(F.col("__ft")))))
    hit = rows.withColumn("__t", F.explode(F.array_distinct("tags"))).join(by_tag, "__t")
    first = F.array_min(F.array_intersect("tags", "__ft")) == F.col("__t")
    ok = F.when(F.col("__and"), tag_all(F.col("tags"), F.col("__ft"))).otherwise(first)
    found = hit.where(ok).select(key, *rows.columns)
    every = f.where(F.size("__ft") == 0).select(key).distinct()
    return found.unionByName(rows.crossJoin(every).select(key, *rows.columns))


def apply_tag_filter(base_tagged: DataFrame, ftags: list[int], is_and: bool = True) -> DataFrame:
    """Rows of the base matching one literal filter (pushed as an array expression)."""
    lit = F.array(*[F.lit(int(t)) for t in ftags]).cast("array<int>") if ftags else F.array().cast("array<int>")
    return base_tagged.where(tag_match(F.col("tags"), lit, F.lit(is_and)))


# ------------------------------------------------------------------ logical relations between filters

def subsumes(child: str, parent: str) -> Column:
    """Logical subset test ``child ⊆ parent`` for tag filters (columns prefixed ``child``/``parent``).

    empty parent ⇒ yes; differing AND/OR ⇒ no; AND ⇒ child has every parent tag;
    OR ⇒ every child tag is in the parent.
    """
    ct, pt = F.col(f"{child}.ftags"), F.col(f"{parent}.ftags")
    ca, pa = F.col(f"{child}.is_and"), F.col(f"{parent}.is_and")
    return (F.size(pt) == 0) | ((ca == pa) & F.when(
        pa, F.size(F.array_except(pt, ct)) == 0).otherwise(F.size(F.array_except(ct, pt)) == 0))


def subsumption_edges(preds: DataFrame, key: str = "pid") -> DataFrame:
    """All ``(child, parent)`` pairs with ``child ⊆ parent`` (self pairs included).

    Not an all-pairs theta join: an AND parent's smallest tag must be a child tag,
    an OR child's smallest tag must be a parent tag, so candidate pairs come from
    an equi-join on that tag; the root (empty filter) joins every predicate on a
    constant key (at most two roots).
    """
    p = preds.select(key, "ftags", "is_and")
    c = p.alias("c")
    par = p.alias("p")
    # AND parents: join on parent's min tag ∈ child tags
    c_ex = c.select(F.col(key).alias("c_key"), "ftags", "is_and", F.explode("ftags").alias("t"))
    and_par = par.where(F.col("is_and") & (F.size("ftags") > 0)).select(
        F.col(key).alias("p_key"), F.col("ftags").alias("p_ftags"), F.col("is_and").alias("p_is_and"),
        F.array_min("ftags").alias("t"))
    e_and = c_ex.join(and_par, "t")
    # OR parents: child's min tag ∈ parent tags
    or_par = par.where(~F.col("is_and") & (F.size("ftags") > 0)).select(
        F.col(key).alias("p_key"), F.col("ftags").alias("p_ftags"), F.col("is_and").alias("p_is_and"),
        F.explode("ftags").alias("t"))
    c_min = c.where(F.size("ftags") > 0).select(F.col(key).alias("c_key"), "ftags", "is_and",
                                                F.array_min("ftags").alias("t"))
    e_or = c_min.join(or_par, "t")
    cand = e_and.unionByName(e_or).select(
        "c_key", "p_key",
        F.struct("ftags", "is_and").alias("child"),
        F.struct(F.col("p_ftags").alias("ftags"), F.col("p_is_and").alias("is_and")).alias("parent"))
    cand = cand.where(subsumes("child", "parent")).select(
        F.col("c_key").alias("child"), F.col("p_key").alias("parent")).distinct()
    # root parents (empty filters, at most two keys): every predicate is their child
    roots = par.where(F.size("ftags") == 0).select(F.col(key).alias("parent")).distinct()
    return cand.unionByName(c.select(F.col(key).alias("child")).crossJoin(roots)).distinct()


def range_subsumes(child: str, parent: str) -> Column:
    """Range containment of both ranges with equal AND/OR flag (null = unbounded)."""
    def lo_ok(c, p):
        return F.col(p).isNull() | (F.col(c).isNotNull() & (F.col(c) >= F.col(p)))

    def hi_ok(c, p):
        return F.col(p).isNull() | (F.col(c).isNotNull() & (F.col(c) <= F.col(p)))
    return ((F.col(f"{child}.is_and") == F.col(f"{parent}.is_and"))
            & lo_ok(f"{child}.lo0", f"{parent}.lo0") & hi_ok(f"{child}.hi0", f"{parent}.hi0")
            & lo_ok(f"{child}.lo1", f"{parent}.lo1") & hi_ok(f"{child}.hi1", f"{parent}.hi1"))


def physical_containment(rows: DataFrame, pairs: DataFrame, key: str = "pid") -> DataFrame:
    """For candidate ``(child, parent)`` pairs: is child's row set ⊆ parent's?  (anti-join count = 0)."""
    cr = rows.select(F.col(key).alias("child"), "id")
    pr = rows.select(F.col(key).alias("parent"), "id").withColumn("hit", F.lit(1))
    x = pairs.join(cr, "child").join(pr, ["parent", "id"], "left")
    miss = x.groupBy("child", "parent").agg(F.sum(F.when(F.col("hit").isNull(), 1).otherwise(0)).alias("missing"))
    return pairs.join(miss, ["child", "parent"], "left").fillna({"missing": 0}) \
                .withColumn("contained", F.col("missing") == 0)


# ------------------------------------------------------------------ signatures, fingerprints, overlaps

SIG_BITS = 63


def tag_signature_bit(tag: Column) -> Column:
    """Hash-seeded one-bit signature of a tag/word."""
    return F.pow(F.lit(2.0), F.pmod(F.xxhash64(tag), F.lit(SIG_BITS))).cast("long")   # exact: 2^b, b < 63


def signature_filter(base_tagged: DataFrame, filters: DataFrame) -> DataFrame:
    """AND filter through a binary signature pre-check, then the exact check → ``(qid, id)``.

    Row signature = OR of its tags' bits; a row can only match when
    ``qsig & ~rowsig = 0``.  Candidates come from the postings of the query's
    smallest tag (equi-join); the one-word signature test prunes them before the
    exact array test.  Empty filters match every row.
    """
    def sig(col):
        return F.aggregate(F.transform(col, tag_signature_bit), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))
    rows = base_tagged.select("id", "tags", sig("tags").alias("sig"))
    q = filters.select("qid", "ftags", "is_and", sig("ftags").alias("qsig"))
    post = rows.select("id", "tags", "sig", F.explode("tags").alias("t"))
    drive = q.where(F.size("ftags") > 0).withColumn("t", F.array_min("ftags"))
    cand = post.join(drive, "t").where(F.col("qsig").bitwiseAND(F.bitwise_not("sig")) == 0)
    hit = cand.where(tag_match(F.col("tags"), F.col("ftags"), F.col("is_and"))).select("qid", "id")
    return hit.unionByName(match_all(rows, q.where(F.size("ftags") == 0)))


def match_all(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """``(qid, id)`` for queries whose filter matches every row (the output is queries x rows by definition)."""
    return rows.select("id").crossJoin(queries.select("qid").distinct()).select("qid", "id")


def row_set_fingerprint(rows: DataFrame, key: str = "pid") -> DataFrame:
    """Order-free 128-bit fingerprint and count of each predicate's row set."""
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("card"),
        F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("fp1"),
        F.sum(F.xxhash64(F.col("id"), F.lit(7919)).cast("decimal(38,0)")).alias("fp2"))


def pred_bitmaps(rows: DataFrame, key: str = "pid") -> DataFrame:
    return (rows.select(key, F.bitmap_bucket_number("id").alias("bucket"), F.bitmap_bit_position("id").alias("pos"))
                .groupBy(key, "bucket").agg(F.bitmap_construct_agg("pos").alias("bm")))


def pair_overlap(rows: DataFrame, pairs: DataFrame, key: str = "pid") -> DataFrame:
    """``|A ∩ B|`` and ``|A ∪ B|`` of predicate pairs ``(a, b)`` bucket by bucket with bitmap aggregates."""
    bms = pred_bitmaps(rows, key)
    side_a = pairs.select("a", "b", F.col("a").alias(key))
    side_b = pairs.select("a", "b", F.col("b").alias(key))
    both = side_a.unionByName(side_b).join(bms, key)
    per = both.groupBy("a", "b", "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.expr("bitmap_and_agg(bm)").alias("band"), F.bitmap_or_agg("bm").alias("bor"))
    agg = per.groupBy("a", "b").agg(
        F.sum(F.when(F.col("n") == 2, F.bitmap_count("band")).otherwise(F.lit(0))).cast("long").alias("inter"),
        F.sum(F.bitmap_count("bor")).cast("long").alias("uni"))
    return pairs.join(agg, ["a", "b"], "left").fillna({"inter": 0, "uni": 0})


# ------------------------------------------------------------------ designed (balanced) signatures

WORD_BUCKET = 1 << 16     # word positions per bucket when locating a bit's cut

def design_signatures(base_tagged: DataFrame, n_bits: int) -> DataFrame:
    """Word → bit table with every bit set on fewer than half of the rows (when a word allows).

    Words are taken in a hash order; bit b receives the longest run of the next
    words whose rows (rows containing any of them) stay under N/2.  For each bit
    one aggregation finds, per row, its first word at or after the current
    position, and the cut is read off the cumulative counts.  Returns ``(tag, bit)``.
    """
    from vecspark.operators.ranking import ordered_positions
    from vecspark.session import cut_lineage
    spark = base_tagged.sparkSession
    post = postings(base_tagged)
    vocab = post.select("tag").distinct().withColumn("h", F.xxhash64("tag"))
    vocab = ordered_positions(vocab, ["h", "tag"], F.floor(F.col("h") / F.lit(float(1 << 44))), "wr") \
        .withColumn("wr", F.col("wr") - 1).select("tag", "wr")
    vocab = cut_lineage(vocab)
    n_words = vocab.count()
    n = base_tagged.count()
    need = -(-n // 2)                   # rows covered must stay <= ceil(n/2) - 1
    pr = cut_lineage(post.join(vocab, "tag").select("id", "wr"))      # vocabulary-sized: AQE picks the join
    cuts, offset = [], 0
    for b in range(n_bits):
        if offset >= n_words:
            break
        first = pr.where(F.col("wr") >= offset).groupBy("id").agg(F.min("wr").alias("f"))
        hist = first.groupBy("f").agg(F.count(F.lit(1)).alias("c")).withColumn("fb", (F.col("f") / WORD_BUCKET).cast("long"))
        # the cut: smallest f whose cumulative row count reaches ceil(N/2) — found from the
        # per-bucket totals (few rows), then inside that one bucket
        tots = hist.groupBy("fb").agg(F.sum("c").alias("t")).orderBy("fb").collect()
        acc, hit = 0, None
        for r in tots:
            if acc + r["t"] >= need:
                w = Window.partitionBy("fb").orderBy("f").rowsBetween(Window.unboundedPreceding, 0)
                hit = (hist.where(F.col("fb") == r["fb"]).withColumn("cum", F.lit(acc) + F.sum("c").over(w))
                           .where(F.col("cum") >= need).agg(F.min("f")).first()[0])
                break
            acc += r["t"]
        hi = n_words - 1 if hit is None else max(offset, hit - 1)
        cuts.append((b, offset, hi))
        offset = hi + 1
    table = spark.createDataFrame(cuts, "bit int, lo long, hi long")
    return vocab.join(table, (F.col("wr") >= F.col("lo")) & (F.col("wr") <= F.col("hi"))) \
                .select("tag", "bit")


def designed_signature_filter(base_tagged: DataFrame, filters: DataFrame, design: DataFrame) -> DataFrame:
    """AND filter with the designed signatures as pre-check (same answer as the exact filter)."""
    bits = design.withColumn("m", F.pow(F.lit(2.0), F.col("bit")).cast("long"))
    rs = (postings(base_tagged).join(bits, "tag", "left")
          .groupBy("id").agg(F.bit_or(F.coalesce("m", F.lit(0).cast("long"))).alias("sig")))
    rows = base_tagged.select("id", "tags").join(rs, "id")
    qt = filters.select("qid", F.explode("ftags").alias("tag"))
    qbits = bits.join(qt.select("tag").distinct(), "tag")
    qs = (qt.join(qbits, "tag", "left")
          .groupBy("qid").agg(F.bit_or(F.coalesce("m", F.lit(0).cast("long"))).alias("qsig")))
    q = filters.select("qid", "ftags", "is_and").join(qs, "qid", "left").fillna({"qsig": 0})
    post = rows.select("id", "tags", "sig", F.explode("tags").alias("t"))
    drive = q.where(F.size("ftags") > 0).withColumn("t", F.array_min("ftags"))
    cand = post.join(drive, "t").where(F.col("qsig").bitwiseAND(F.bitwise_not("sig")) == 0)
    hit = cand.where(tag_match(F.col("tags"), F.col("ftags"), F.col("is_and"))).select("qid", "id")
    return hit.unionByName(match_all(rows.select("id"), q.where(F.size("ftags") == 0)))
