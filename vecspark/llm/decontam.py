"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` stores the training postings: one row per *block* of whole documents (about half a million words,
a longer document makes a larger block), holding the block's terms in order and, per term, the ascending word
positions.  A document-partitioned index keeps every posting list bounded by its block, however frequent the term.
``match`` reads the index once per chunk of test items.  In each block a test window starts from its rarest term:
that term's positions, less the term's offset in the window, are the candidate starts, and the lists of the other
terms are intersected in order of rarity, each shifted by its own offset.  A start that survives with all
differences 0 is an exact phrase; differences up to ``slop`` words are a proximity match.

Nothing but per-document results is shuffled.  Test items are cut into overlapping pieces of at most ``PIECE_WORDS``
windows where they are read, and broadcast in chunks of about ``CHUNK_BYTES`` of text as flat arrays of term numbers,
so the bound holds for any number and length of items (a chunk takes less than 300 MB of the driver while it is built).

Very long texts are indexed whole (a block of their own) and very long items window by window; of equal rarity the term
that comes first in the window leads.

Edge cases: null or empty texts have no words and are returned with zero counts; null ids stay null; repeated rows
are answered row by row; items without words are ignored, a null item_id counts as the empty string; an empty
table on either side gives no hits.  Only doc_id, text and item_id, text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm import common

BLOCK_WORDS = 1 << 19
CHUNK_BYTES = 4 << 20
PIECE_WORDS = 1 << 14         # windows of an item that stay together
SLICE = 1 << 16               # windows looked up at once in a block
CANDIDATES = 1 << 21          # candidate starts held at once while intersecting
NULL_ID = -(1 << 63)
INDEX = "block long, doc_id binary, starts binary, words binary, terms binary, post binary, positions binary"
FOUND = ("block long, ord int, doc_id long, n_words long, spans array<struct<lo:int,hi:int>>, "
         "items array<string>, near array<string>")

#: A-Z lowered; every byte that belongs to no word becomes a space; bytes from 0x80 on are word bytes
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 0x80 else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def _block(number: int, ids: list[int], lens: list[int], terms: dict[bytes, int], numbers: list[np.ndarray]) -> dict:
    starts = np.zeros(len(ids), np.int64)
    np.cumsum(np.array(lens[:-1], dtype=np.int64) + 1, out=starts[1:])     # one free position between documents
    at = np.concatenate([np.arange(n, dtype=np.int64) + s for n, s in zip(lens, starts, strict=True)])
    term = np.concatenate(numbers)
    names = list(terms)
    rank = np.empty(len(names), np.int64)
    order = sorted(range(len(names)), key=names.__getitem__)
    rank[order] = np.arange(len(names))
    key = np.sort((rank[term] << 32) | at)
    post = np.searchsorted(key, np.arange(len(names) + 1, dtype=np.int64) << 32)
    return {"block": number, "doc_id": np.array(ids, np.int64).tobytes(), "starts": starts.tobytes(),
            "words": np.array(lens, np.int64).tobytes(), "terms": b" ".join(names[i] for i in order),
            "post": post.astype(np.int64).tobytes(),
            "positions": np.diff(key & 0xFFFFFFFF, prepend=0).astype(np.int32).tobytes()}


def _as_batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = [("block", pa.int64())] + [(k, pa.binary()) for k in ("doc_id", "starts", "words", "terms", "post", "positions")]
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))


def _index_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext
    number = TaskContext.get().partitionId() << 32
    ids, lens, terms, numbers, held = [], [], {}, [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), common.binary(b.column(1)), strict=True):
            w = terms_of(t)
            ids.append(NULL_ID if i is None else i)
            lens.append(len(w))
            numbers.append(np.array([terms.setdefault(x, len(terms)) for x in w], dtype=np.int64))
            held += len(w) + 1
            if held >= BLOCK_WORDS:
                yield _as_batch([_block(number, ids, lens, terms, numbers)])
                number += 1
                ids, lens, terms, numbers, held = [], [], {}, [], 0
    if ids:
        yield _as_batch([_block(number, ids, lens, terms, numbers)])


def build_index(docs: DataFrame) -> DataFrame:
    """The positional index of ``docs``, written once to the shared folder."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = src.mapInArrow(_index_batches, INDEX)
    return common.stored(blocks, "postings", compression="zstd", **{"parquet.block.size": str(16 << 20)})


def pieces(benchmark: DataFrame, width: int) -> DataFrame:
    """(item, piece, text): every item's words in pieces that overlap by width - 1, so each window is in one piece."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), common.binary(batch.column(1)), strict=True):
                w = terms_of(text)
                starts = range(0, max(1, len(w) - width + 1), PIECE_WORDS) if w else ()
                rows = [(item, k, b" ".join(w[s:s + PIECE_WORDS + width - 1])) for k, s in enumerate(starts)]
                if rows:
                    yield pa.RecordBatch.from_pydict({"item": pa.array([r[0] for r in rows], pa.string()), "piece": pa.array([r[1] for r in rows], pa.int32()),
                                                      "text": pa.array([r[2] for r in rows], pa.binary())})

    b = benchmark.select(common.id_text("item_id").alias("item"), F.col("text").cast("string").alias("text"))
    return b.mapInArrow(cut, "item string, piece int, text binary")


class Windows:
    """Test windows of one chunk of pieces, as flat arrays: term numbers by window length, and the items of each window.

    ``groups`` has (windows, offsets, owners) for every window length: window k belongs to items
    ``owners[offsets[k]:offsets[k + 1]]``.
    """

    def __init__(self, rows: list[tuple[str, bytes | None]], width: int):
        self.vocabulary: dict[bytes, int] = {}
        self.items = sorted({i for i, _ in rows})
        number = {i: k for k, i in enumerate(self.items)}
        held: dict[int, tuple[list, list]] = {}
        for item, text in rows:
            w = np.array([self.vocabulary.setdefault(x, len(self.vocabulary)) for x in terms_of(text)], dtype=np.int32)
            if len(w):
                length = min(width, len(w))
                windows = np.lib.stride_tricks.sliding_window_view(w, length)
                parts, owners = held.setdefault(length, ([], []))
                parts.append(windows)
                owners.append(np.full(len(windows), number[item], np.int32))
        self.groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for length in sorted(held):
            parts, owners = held.pop(length)
            win = np.concatenate(parts)
            _, first, which = np.unique(win.view(np.dtype((np.void, 4 * length))).ravel(), return_index=True, return_inverse=True)
            key = np.unique((which.astype(np.int64) << 32) | np.concatenate(owners))
            offsets = np.searchsorted(key, np.arange(len(first) + 1, dtype=np.int64) << 32)
            self.groups.append((win[first], offsets, (key & 0xFFFFFFFF).astype(np.int32)))


def _survivors(win: np.ndarray, lo: np.ndarray, hi: np.ndarray, key: np.ndarray, at: np.ndarray, doc_of: np.ndarray,
               slop: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(window, start, exact) of every match in one block; windows without one of their terms drop out first."""
    size = hi[win] - lo[win]
    alive = np.flatnonzero((size > 0).all(axis=1))
    rarity = np.argsort(size[alive], axis=1, kind="stable")
    first = size[alive, rarity[:, 0]] if len(alive) else np.zeros(0, np.int64)
    ends = np.cumsum(first)
    done = 0
    while done < len(alive):
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + CANDIDATES)))
        part, rare, n = alive[done:upto], rarity[done:upto], first[done:upto]
        done = upto
        w = np.repeat(np.arange(len(part)), n)
        anchor = at[np.repeat(lo[win[part, rare[:, 0]]] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(len(w))]
        start = anchor - rare[w, 0]
        exact = np.ones(len(w), bool)
        home = doc_of[anchor]
        for j in range(1, win.shape[1]):
            if not len(w):
                break
            off = rare[w, j]
            term = win[part[w], off].astype(np.int64)
            want = start + off
            k = np.searchsorted(key, (term << 32) | np.maximum(want, 0))
            right = np.minimum(k, len(key) - 1)
            left = np.maximum(k - 1, 0)
            dr = np.where((key[right] >> 32) == term, np.abs(at[right] - want), slop + 1)
            if slop:
                dl = np.where((key[left] >> 32) == term, np.abs(at[left] - want), slop + 1)
                pick = np.where(dl < dr, left, right)
                d = np.minimum(dl, dr)
            else:
                pick, d = right, dr
            ok = (d <= slop) & (doc_of[at[pick]] == home)
            w, start, exact, home = w[ok], start[ok], (exact & (d == 0))[ok], home[ok]
        yield part[w], start, exact, home


def _match_block(row: dict, windows: Windows, slop: int) -> pa.RecordBatch:
    ids = np.frombuffer(row["doc_id"], np.int64)
    starts = np.frombuffer(row["starts"], np.int64)
    words = np.frombuffer(row["words"], np.int64)
    post = np.frombuffer(row["post"], np.int64)
    gaps = np.frombuffer(row["positions"], np.int32)
    at_all = np.cumsum(gaps, dtype=np.int64)
    vocabulary = windows.vocabulary
    mine = [(vocabulary[t], j) for j, t in enumerate(row["terms"].split(b" ")) if t in vocabulary]
    lo = np.zeros(len(vocabulary), np.int64)
    hi = np.zeros(len(vocabulary), np.int64)
    spans: dict[int, list[tuple[int, int]]] = {}
    items: dict[int, set[int]] = {}
    near: dict[int, set[int]] = {}
    if mine:
        mine.sort()
        size = np.array([post[j + 1] - post[j] for _, j in mine])
        ends = np.cumsum(size)
        q = np.array([t for t, _ in mine])
        lo[q], hi[q] = ends - size, ends
        at = np.concatenate([at_all[post[j]:post[j + 1]] for _, j in mine])
        key = (np.repeat(q, size) << 32) | at
        doc_of = np.repeat(np.arange(len(ids)), words + 1)
        sliced = ((win, offsets, owners, base) for win, offsets, owners in windows.groups for base in range(0, len(win), SLICE))
        for win, offsets, owners, base in sliced:
            for w, start, exact, home in _survivors(win[base:base + SLICE], lo, hi, key, at, doc_of, slop):
                for k, s, e, d in zip((w + base).tolist(), start.tolist(), exact.tolist(), home.tolist(), strict=True):
                    mine_ = owners[offsets[k]:offsets[k + 1]].tolist()
                    if e:
                        s -= int(starts[d])
                        spans.setdefault(d, []).append((s, s + win.shape[1]))
                        items.setdefault(d, set()).update(mine_)
                    near.setdefault(d, set()).update(mine_)
    out = []
    for d in range(len(ids)):
        merged: list[dict] = []
        for a, b in sorted(spans.get(d, ())):
            if merged and a <= merged[-1]["hi"]:
                merged[-1]["hi"] = max(merged[-1]["hi"], b)
            else:
                merged.append({"lo": a, "hi": b})
        out.append({"block": row["block"], "ord": d, "doc_id": None if ids[d] == NULL_ID else int(ids[d]),
                    "n_words": int(words[d]), "spans": merged,
                    "items": [windows.items[i] for i in sorted(items.get(d, ()))],
                    "near": [windows.items[i] for i in sorted(near.get(d, ()))]})
    span = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
    return pa.RecordBatch.from_pylist(out, schema=pa.schema([
        ("block", pa.int64()), ("ord", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", span),
        ("items", pa.list_(pa.string())), ("near", pa.list_(pa.string()))]))


def match(index: DataFrame, benchmark: DataFrame, width: int = 10, slop: int = 0) -> DataFrame:
    """Per indexed document: word count, merged exact spans, items found exactly, items found within ``slop``.

    One row per document and chunk of items; ``per_document`` joins the chunks.
    """
    spark = index.sparkSession
    b = common.stored(pieces(benchmark, width), "pieces")
    total = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_chunks = 1 + total // CHUNK_BYTES
    out = None
    for c in range(n_chunks):
        rows = b.filter(F.pmod(F.xxhash64("item", "piece", "text"), F.lit(n_chunks)) == c).select("item", "text").collect()
        sent = spark.sparkContext.broadcast(Windows([(r.item, bytes(r.text)) for r in rows], width))

        def matched(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield _match_block(batch.slice(i, 1).to_pylist()[0], sent.value, slop)

        part = index.mapInArrow(matched, FOUND)
        out = part if out is None else out.unionByName(part)
    return out


def per_document(found: DataFrame) -> DataFrame:
    """One row per indexed document: spans of all chunks united, counts and items."""
    g = found.groupBy("block", "ord").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near"))
    hit = F.expr("aggregate(spans, struct(0 as hi, 0L as n), (a, s) -> struct(greatest(a.hi, s.hi) as hi, "
                 "a.n + greatest(0, s.hi - greatest(s.lo, a.hi)) as n), a -> a.n)")
    return g.select("doc_id", "n_words", hit.alias("n_hit"), "spans", "items", "near")


def find(docs: DataFrame, benchmark: DataFrame, width: int = 10, slop: int = 0) -> DataFrame:
    """Index ``docs`` and match ``benchmark`` against it: (doc_id, n_words, n_hit, spans, items, near)."""
    return per_document(match(build_index(docs), benchmark, width, slop))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The rows of ``docs`` whose doc_id has no exact window of an item (rows sharing an id go together)."""
    bad = (find(docs, benchmark, width).filter(F.col("n_hit") > 0)
           .select(F.col("doc_id").alias("__hit_id")).distinct())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"), F.col("doc_id").cast("long").alias("__id"))
    return rows.join(bad, F.col("__id").eqNullSafe(F.col("__hit_id")), "left_anti").select("record.*")
