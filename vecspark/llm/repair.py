"""Token-id output as Re-Pair grammar shards.

``write_shards`` orders documents by doc_id (range partitions, so no task sees more than its range), encodes every
whole text with a public tokenizer, appends an end id, and packs about ``SHARD_IDS`` ids into one shard.  Within a
shard, frequent neighbouring id pairs are replaced by new nonterminals again and again (several pairs a pass, chosen
so that they cannot overlap) until no pair is frequent enough or ``MAX_RULES`` rules exist.  A pair never spans two
documents, so each document keeps its own run of symbols.

File format: Parquet written by Spark (so it commits atomically and works on any file system), one row a shard:

    part, seq        order of the shard: range partition, then number within it
    n_ids, n_base    ids in the shard; ids below n_base are tokenizer ids, n_base + r is rule r
    rules            int32 pairs (left, right); a rule only uses ids and earlier rules
    lengths          int32 expansion length of every rule
    symbols          int32 compressed sequence
    doc_id           int64 ids (ascending; the null id is the least int64)
    doc_ids          int64 ids of all earlier documents of the shard, then the total
    doc_symbols      int64 offset of each document's first symbol, then the total

``read_documents`` expands shards; ``decode_range`` reads a span of ids of one shard through the expansion lengths
without expanding the rest.

Edge cases: a null or empty text is one end id; a null doc_id sorts first; repeated rows and equal ids are kept as
separate documents; a text of any length is one document (its shard grows with it); an empty table writes no
shard.  Only doc_id and text are read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm import common

SHARD_IDS = 1 << 20
N_BASE = 1 << 16
MAX_RULES = 1 << 14
MIN_COUNT = 32                # a pair must occur this often in the shard's current sequence
PASSES = 12
PER_PASS = 2048               # pairs replaced in one pass at most
MIN_GAIN = 0.005              # a pass that shortens the sequence by less is the last
SLOT_BITS = 17                # slots of the hashed pair count
BATCH = 8192                  # texts encoded at once
CACHE_WORDS = 600_000         # words a worker remembers between batches
NULL_ID = -(1 << 63)
BLOBS = ("rules", "lengths", "symbols", "doc_id", "doc_ids", "doc_symbols")
SHARD = "part int, seq int, n_ids long, n_base int, " + ", ".join(f"{b} binary" for b in BLOBS)


# ---- tokenizer ---------------------------------------------------------------------------------

class Numbers(dict):
    """Gives every new key the next number."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class Encoder:
    """Whole texts to ids by the tokenizers library, with each distinct word encoded once.

    The tokenizer's normaliser and pre-tokenizer never join text across ASCII spaces, so a text's ids are its
    space-separated pieces' ids in a row.  A piece of plain Latin letters and at most one of ``. , ; : ! ?`` is the
    lower-case letters' ids and the mark's, because the pre-tokenizer separates letters from other signs; such letters
    pass the normaliser and pre-tokenizer as one word, so the library's model alone encodes them.
    """

    MARKS = [".", ",", ";", ":", "!", "?"]
    PLAIN = "^[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+[.,;:!?]?$"
    LETTERS = frozenset(chr(c) for c in [*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100)])

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self._tok = Tokenizer.from_file(path)
        self._model = Tokenizer(self._tok.model)
        # the byte-level alphabet: bytes that are no printable Latin-1 sign stand as code points from 256 on
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(shown)]
        sign = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self._bytes = {ord(c): "".join(sign[b] for b in c.encode()) for c in self.LETTERS if not c.isascii()}
        self.reset()

    def reset(self) -> None:
        self.words = Numbers()
        self._flat, self._off, self._len = np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._number(["", *self.MARKS])                  # numbers 0 .. 6

    def _number(self, words: list[str]) -> np.ndarray:
        """Numbers of distinct words; those not seen before are encoded."""
        known = len(self.words)
        out = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        fresh = list(itertools.islice(self.words, known, None))
        if not fresh:
            return out
        plain = np.fromiter(map(self.LETTERS.issuperset, fresh), bool, len(fresh))
        lens, off = np.zeros(len(fresh), np.int64), np.zeros(len(fresh), np.int64)
        parts, used = [self._flat], len(self._flat)
        for model, which in ((self._model, True), (self._tok, False)):
            mine = np.flatnonzero(plain == which)
            for a in range(0, len(mine), 20_000):
                some = mine[a:a + 20_000]
                texts = [fresh[i] for i in some.tolist()]
                if which:
                    texts = [w if w.isascii() else w.translate(self._bytes) for w in texts]
                e = model.encode(texts, is_pretokenized=True, add_special_tokens=False)
                n = np.bincount(np.array(e.word_ids, np.int64), minlength=len(some)) if len(e.ids) else np.zeros(len(some), np.int64)
                lens[some], off[some] = n, used + np.cumsum(n) - n
                used += len(e.ids)
                parts.append(np.array(e.ids, dtype=np.uint16))
        self._flat = np.concatenate(parts)
        self._off, self._len = np.concatenate([self._off, off]), np.concatenate([self._len, lens])
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text) of an Arrow string array."""
        import pyarrow.compute as pc
        if len(self.words) > CACHE_WORDS:
            self.reset()
        pieces = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        ends = np.asarray(pieces.offsets).astype(np.int64)
        coded = pc.dictionary_encode(pieces.values)
        distinct = coded.dictionary
        plain = pc.match_substring_regex(distinct, self.PLAIN)
        stems = pc.dictionary_encode(pc.utf8_lower(pc.utf8_rtrim(distinct.filter(plain), characters="".join(self.MARKS))))
        head = np.zeros(len(distinct), np.int64)
        mark = np.zeros(len(distinct), np.int64)
        is_plain = np.asarray(plain)
        head[is_plain] = self._number(stems.dictionary.to_pylist())[np.asarray(stems.indices)]
        last = pc.index_in(pc.utf8_slice_codeunits(distinct.filter(plain), -1), value_set=pa.array(self.MARKS))
        mark[is_plain] = np.asarray(pc.fill_null(last, -1)) + 1
        head[~is_plain] = self._number(distinct.filter(pc.invert(plain)).to_pylist())
        # ids of every distinct word, then of every word of the texts
        both = np.stack([head, mark], axis=1).ravel()
        n = self._len[both]
        flat = self._flat[_spans(self._off[both], n)]
        size = n[0::2] + n[1::2]
        start = np.cumsum(size) - size
        k = np.asarray(coded.indices)[ends[0]:ends[-1]]
        ids = flat[_spans(start[k], size[k])]
        return ids, np.diff(np.concatenate(([0], np.cumsum(size[k])))[ends - ends[0]])


def _spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Indices start[0], start[0]+1, ... (n[0] of them), start[1], ..."""
    total = int(n.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(n)
    return np.arange(total) + np.repeat(start - (ends - n), n)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder (its word cache outlives a task)."""
    if path not in _ENCODERS:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# ---- grammar -----------------------------------------------------------------------------------

def _pair_slot(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (((left * np.uint32(0x9E3779B1)) ^ (right * np.uint32(0x85EBCA77))) >> np.uint32(32 - SLOT_BITS)).astype(np.int64)


def compress(ids: np.ndarray, lens: np.ndarray, max_rules: int = MAX_RULES, min_count: int = MIN_COUNT,
             passes: int = PASSES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair of one shard: (symbols, symbols of each document, rules as pairs, expansion length of each rule).

    Each pass counts all neighbouring pairs, takes the most frequent ones in order of count (ties: smaller pair)
    and replaces their occurrences from left to right.  Where two chosen pairs would share a symbol, the left
    occurrence wins, as in a single sweep; the loser is counted again in the next pass.  It ends when no pair is
    frequent, the rules are used up, or a pass hardly shortens the sequence any more.
    """
    seq = ids.astype(np.uint32)
    last = np.zeros(len(ids), bool)                      # the last symbol of its document pairs with nothing
    ends = np.cumsum(lens)
    last[ends[lens > 0] - 1] = True
    rules: list[np.ndarray] = []
    length = np.ones(N_BASE + max_rules, np.int32)
    n_rules = 0
    for _ in range(passes):
        room = min(PER_PASS, max_rules - n_rules)
        if room <= 0 or len(seq) < 2:
            break
        # few of the possible pairs are frequent: a hashed count finds the places worth an exact count
        slot = _pair_slot(seq[:-1], seq[1:])
        at = np.flatnonzero((np.bincount(slot, minlength=1 << SLOT_BITS) >= min_count)[slot] & ~last[:-1])
        slot = slot[at]
        pair = (seq[at].astype(np.int64) << 20) | seq[at + 1]
        s = np.sort(pair)
        edge = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
        count = np.diff(np.concatenate((edge, [len(s)])))
        often = np.flatnonzero(count >= min_count)
        if not len(often):
            break
        best = often[np.lexsort((s[edge[often]], -count[often]))[:room]]
        chosen = s[edge[best]]
        # each slot serves its most frequent chosen pair; others that share the slot wait for the next pass
        where = _pair_slot((chosen >> 20).astype(np.uint32), (chosen & 0xFFFFF).astype(np.uint32))
        server = np.zeros(1 << SLOT_BITS, np.int64)
        server[where[::-1]] = np.arange(len(chosen))[::-1]
        k = server[slot]
        hit = chosen[k] == pair
        at, k = at[hit], k[hit]
        # of a run of overlapping occurrences, take the 1st, 3rd, 5th ...
        run = np.concatenate(([True], np.diff(at) != 1))
        first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
        take = (np.arange(len(at)) - first) % 2 == 0
        at, k = at[take], k[take]
        uses = np.bincount(k, minlength=len(chosen))
        number = np.cumsum(uses > 0) - 1
        used = np.flatnonzero(uses)
        pairs = np.stack([chosen[used] >> 20, chosen[used] & 0xFFFFF], axis=1)
        length[N_BASE + n_rules:N_BASE + n_rules + len(used)] = length[pairs].sum(axis=1)
        seq[at] = N_BASE + n_rules + number[k]
        last[at] = last[at + 1]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        before = len(seq)
        seq, last = seq[keep], last[keep]
        rules.append(pairs)
        n_rules += len(used)
        if len(at) < MIN_GAIN * before:
            break
    table = np.concatenate(rules).astype(np.int32) if rules else np.zeros((0, 2), np.int32)
    per_doc = np.zeros(len(lens), np.int64)
    per_doc[lens > 0] = np.diff(np.concatenate(([-1], np.flatnonzero(last))))
    return seq.astype(np.int32), per_doc, table, length[N_BASE:N_BASE + n_rules]


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, n_base: int = N_BASE) -> np.ndarray:
    """Ids of a run of symbols: all rules are laid out once, then every symbol's ids are gathered."""
    flat = np.arange(n_base, n_base + len(rules), dtype=np.int64)
    while len(flat) and (top := flat >= n_base).any():
        n = np.where(top, 2, 1)
        out = flat[np.repeat(np.arange(len(flat)), n)]
        at = np.cumsum(n) - n
        r = rules[flat[top] - n_base]
        out[at[top]], out[at[top] + 1] = r[:, 0], r[:, 1]
        flat = out
    flat = np.concatenate((np.arange(n_base, dtype=np.uint32), flat.astype(np.uint32)))
    size = np.concatenate((np.ones(n_base, np.int64), lengths.astype(np.int64)))
    start = np.cumsum(size) - size
    return flat[_spans(start[symbols], size[symbols])]


def decode_range(shard: dict, start: int, stop: int) -> np.ndarray:
    """Ids start..stop-1 of a shard: expansion lengths locate the symbols, only those are expanded."""
    g = {k: np.frombuffer(shard[k], np.int32) for k in ("rules", "lengths", "symbols")}
    base = shard["n_base"]
    size = np.ones(len(g["symbols"]), np.int64)
    big = g["symbols"] >= base
    size[big] = g["lengths"][g["symbols"][big] - base]
    ends = np.cumsum(size)
    a = int(np.searchsorted(ends, start, "right"))
    b = min(int(np.searchsorted(ends, stop, "left")) + 1, len(ends))
    if a >= b:
        return np.zeros(0, np.uint32)
    ids = expand(g["symbols"][a:b], g["rules"].reshape(-1, 2), g["lengths"], base)
    skip = start - int(ends[a] - size[a])
    return ids[skip:skip + max(0, stop - start)]


# ---- Spark -------------------------------------------------------------------------------------

def _shard_batch(part: int, seq: int, ids: list[int], arrays: list[np.ndarray], lens: list[np.ndarray]) -> pa.RecordBatch:
    flat, n = np.concatenate(arrays), np.concatenate(lens)
    symbols, per_doc, rules, lengths = compress(flat, n)
    row = {"part": part, "seq": seq, "n_ids": len(flat), "n_base": N_BASE, "rules": rules.tobytes(),
           "lengths": lengths.astype(np.int32).tobytes(), "symbols": symbols.tobytes(),
           "doc_id": np.array(ids, np.int64).tobytes(),
           "doc_ids": np.concatenate(([0], np.cumsum(n))).astype(np.int64).tobytes(),
           "doc_symbols": np.concatenate(([0], np.cumsum(per_doc))).astype(np.int64).tobytes()}
    kinds = [("part", pa.int32()), ("seq", pa.int32()), ("n_ids", pa.int64()), ("n_base", pa.int32())]
    return pa.RecordBatch.from_pylist([row], schema=pa.schema(kinds + [(b, pa.binary()) for b in BLOBS]))


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Encode, order and compress ``docs``; returns the written shard table."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, seq, held = TaskContext.get().partitionId(), 0, 0
        ids, arrays, lens = [], [], []
        enc = encoder(tokenizer)
        for b in batches:
            for a in range(0, b.num_rows, BATCH):
                some = b.slice(a, BATCH)
                tok, n = enc.encode(some.column(1))
                tok = np.insert(tok, np.cumsum(n), end_id)
                doc_ids = [NULL_ID if i is None else i for i in some.column(0).to_pylist()]
                ends = np.cumsum(n + 1)
                # whole documents go to shards of about SHARD_IDS ids
                cut = np.flatnonzero(np.diff((held + ends) // SHARD_IDS)) + 1
                for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(n)], strict=True):
                    if held >= SHARD_IDS:
                        yield _shard_batch(part, seq, ids, arrays, lens)
                        seq, held, ids, arrays, lens = seq + 1, 0, [], [], []
                    first = int(ends[lo - 1]) if lo else 0
                    arrays.append(tok[first:int(ends[hi - 1])])
                    lens.append(n[lo:hi] + 1)
                    ids += doc_ids[lo:hi]
                    held += len(arrays[-1])
        if ids:
            yield _shard_batch(part, seq, ids, arrays, lens)

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = src.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    return common.stored(ordered.mapInArrow(encoded, SHARD), "token-shards", compression="zstd",
                         **{"parquet.block.size": str(16 << 20)})


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from zlib import crc32
    for batch in batches:
        for i in range(batch.num_rows):
            s = batch.slice(i, 1).to_pylist()[0]
            ids = expand(np.frombuffer(s["symbols"], np.int32), np.frombuffer(s["rules"], np.int32).reshape(-1, 2),
                         np.frombuffer(s["lengths"], np.int32), s["n_base"]).astype("<u4")
            doc = np.frombuffer(s["doc_id"], np.int64)
            at = np.frombuffer(s["doc_ids"], np.int64)
            crc = [crc32(ids[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            n = len(doc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, s["part"], np.int32)), pa.array(np.full(n, s["seq"], np.int32)),
                 pa.array(doc, mask=doc == NULL_ID), pa.array(at[:-1]), pa.array(np.diff(at)),
                 pa.array(np.array(crc, np.int64))],
                names=["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32"])


def read_documents(shards: DataFrame) -> DataFrame:
    """Per document, from the written shards: place among all ids, number of ids, crc32 of the ids."""
    docs = shards.mapInArrow(_documents, "part int, seq int, doc_id long, local long, n_tokens long, ids_crc32 long")
    # shard offsets: running sums inside a range partition, plus the totals of the partitions before it
    from pyspark.sql import Window
    sizes = shards.select("part", "seq", "n_ids")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (sizes.groupBy("part").agg(F.sum("n_ids").alias("t"))
             .select("part", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("part_start")))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = (sizes.withColumn("shard_start", F.coalesce(F.sum("n_ids").over(within), F.lit(0)))
              .join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("shard_start")).alias("base")))
    return (docs.join(starts, ["part", "seq"])
            .select("doc_id", (F.col("base") + F.col("local")).cast("long").alias("start"), "n_tokens", "ids_crc32"))
