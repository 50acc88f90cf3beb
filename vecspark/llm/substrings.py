"""Substring dedup by level-wise doubling: windows repeated at one length alone are extended to twice that length.

The aim is every word covered by a ``window``-word sequence that also starts earlier in the corpus.  Documents are
packed into written blocks of about half a million words.

Level 1 (window/2 words): a block sends the hashes of the least window/2-sequence inside each full window; all
occurrences of a full window share it, so sending these about 1 in 6 sequences loses none.  Buckets of hashes find
the ones in several blocks; a block adds the ones it holds twice itself.
Level 2 (window words): only full windows whose level-1 sequence is repeated are named (by the hashes of their two
halves, 96 bits) and sent, once a block, with their first place.  Buckets find the earliest place of each; every
other place goes back to its block.  Windows that are not repeated never leave their block.
Further levels (2, 4, 8 ... times the window): a sequence is a candidate only if both its halves are repeated.  A level
keeps no more than the places of its repeated sequences; their names come from the block's word hashes again (kept as
numbers into its distinct ones), travel once and are answered by one bit each.  ``repeated_lengths`` goes on until no candidate survives and gives each document the
longest length reached.  The removal needs no longer window: a longer repeat is a run of repeated ones.

How it scales: what is shuffled are packed hashes of candidates, one entry a block however often a sequence occurs
in it, so a passage in a third of all documents costs one entry a block.  Buckets hold about ``PER_BUCKET`` hashes
whatever the corpus.  The block table is bucketed by block number, about ``BUCKET_BYTES`` of text a bucket, so joining
answers back does not shuffle text and a task's share does not grow with the corpus.  Its catalog entry is dropped at once.
A level's shuffle files go when its answers are written, so the disk holds the names of one level, not of all.

Very long texts are taken whole (a block of their own); of equal places (rows that share a doc_id) the one in the lower
block comes first.  Texts and blocks come to a worker in batches of ``session.BATCH_BYTES``, or alone where they are longer.

Edge cases: null and empty texts have no words (nothing removed, digest of the empty text); a document shorter than
the window keeps all; a null doc_id comes before all others; rows with equal doc_id keep the order of their blocks;
an empty table gives an empty result.  Only doc_id and text are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm import common
from vecspark.session import bound_batches

BLOCK_WORDS = 1 << 19
PER_BUCKET = 1 << 20
BUCKET_BYTES = 32 << 20
NULL_ID = -(1 << 63)
BLOCKS = "block long, doc binary, n binary, text binary, vocab binary, ids binary, low binary"


def _join(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """Hash of two sequences in a row from their hashes."""
    return common.mix64(a * np.uint64(0x9E3779B97F4A7C15) + b + np.uint64(salt))


def _sequence_hash(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` words, by doubling (array is length-1 shorter)."""
    have, power, pieces = h, 1, None
    rest, done = length, 0
    while rest:
        if rest & 1:
            if pieces is None:
                pieces, done = have, power
            else:
                n = len(h) - done - power + 1
                pieces = _join(pieces[:n], have[done:done + n], done + power)
                done += power
        rest >>= 1
        if rest:
            have = _join(have[:-power], have[power:], power)
            power *= 2
    return pieces


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours (array is width-1 shorter)."""
    m, have = x, 1
    while 2 * have <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < width:
        n = len(x) - width + 1
        m = np.minimum(m[:n], m[width - have:width - have + n])
    return m


def _windows(h: np.ndarray, n: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of every window inside one document, least half-sequence hash of each, half hashes of the block)."""
    half = (window + 1) // 2
    if len(h) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    halves = _sequence_hash(h, half)
    least = _sliding_min(halves, window - half + 1)
    left = np.repeat(np.cumsum(n), n) - np.arange(len(h))      # words from here to the document's end
    start = np.flatnonzero(left[:len(least)] >= window)
    return start, least[start], halves


class _Hasher:
    """Word hashes of texts, remembered within a task."""

    def __init__(self):
        from xxhash import xxh3_64_intdigest

        class Words(dict):
            def __missing__(self, w):
                self[w] = v = xxh3_64_intdigest(w)
                return v

        self.make, self.words = Words, Words()

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.words) > common.WORDS_HELD:
            self.words = self.make()
        return np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))


def _pack(number: int, ids: list[int], texts: list[list[bytes]], hasher: _Hasher, window: int) -> dict:
    import zstandard
    order = sorted(range(len(ids)), key=ids.__getitem__)
    n = np.array([len(texts[i]) for i in order], np.int64)
    words = [w for i in order for w in texts[i]]
    hashes = hasher(words)
    least = _windows(hashes, n, window)[1]
    vocab, ids_of_words = np.unique(hashes, return_inverse=True)
    change = np.concatenate(([True], least[1:] != least[:-1])) if len(least) else np.zeros(0, bool)
    return {"block": number, "doc": np.array([ids[i] for i in order], np.int64).tobytes(), "n": n.tobytes(),
            "text": zstandard.ZstdCompressor(level=3).compress(b" ".join(words)), "low": np.unique(least[change]).tobytes(), "vocab": vocab.tobytes(),
            "ids": zstandard.ZstdCompressor(level=1).compress(ids_of_words.astype(_id_type(len(vocab))).tobytes())}


def _id_type(size: int) -> type:
    return np.uint16 if size <= 1 << 16 else np.uint32


def _hashes(row: dict) -> np.ndarray:
    """Word hashes of a block, from its distinct ones."""
    import zstandard
    vocab = np.frombuffer(row["vocab"], np.uint64)
    return vocab[np.frombuffer(zstandard.ZstdDecompressor().decompress(row["ids"]), _id_type(len(vocab)))]


def build_blocks(docs: DataFrame, window: int) -> DataFrame:
    """Blocks of whole documents as a table bucketed by block number."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number, hasher = TaskContext.get().partitionId() << 32, _Hasher()
        ids, texts, held = [], [], 0
        schema = pa.schema([("block", pa.int64())] + [(c, pa.binary()) for c in ("doc", "n", "text", "vocab", "ids", "low")])
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), common.binary(b.column(1)), strict=True):
                ids.append(NULL_ID if i is None else i)
                texts.append(common.words_of(t))
                held += len(texts[-1]) + 1
                if held >= BLOCK_WORDS:
                    yield pa.RecordBatch.from_pylist([_pack(number, ids, texts, hasher, window)], schema=schema)
                    number, ids, texts, held = number + 1, [], [], 0
        if ids:
            yield pa.RecordBatch.from_pylist([_pack(number, ids, texts, hasher, window)], schema=schema)

    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    name = f"llm_blocks_{uuid.uuid4().hex}"
    with common.shuffles_freed(spark):
        (src.mapInArrow(packed, BLOCKS).repartition(parts, "block").write.option("path", common.scratch(spark, "blocks"))
         .option("compression", "none").bucketBy(parts, "block").saveAsTable(name))
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")            # the catalog's line only: the files lie in the shared folder
    return table


def _squeezed(places: np.ndarray) -> bytes:
    """Places in ascending order, as compressed steps."""
    import zstandard
    return zstandard.ZstdCompressor(level=1).compress(np.diff(np.sort(places), prepend=0).astype(np.int32).tobytes())


def _places(packed: bytes) -> np.ndarray:
    import zstandard
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.int32), dtype=np.int64)


def _by_bucket(block: int, h: np.ndarray, buckets: int, **columns: np.ndarray) -> Iterator[dict]:
    """Rows (bucket, block, packed columns) of one block, one for each bucket that gets something."""
    to = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    order = np.argsort(to, kind="stable")
    cut = np.searchsorted(to[order], np.arange(buckets + 1, dtype=np.uint64))
    cols = {"h": h[order]} | {k: v[order] for k, v in columns.items()}
    for b in np.flatnonzero(np.diff(cut)).tolist():
        yield {"bucket": b, "block": block} | {k: v[cut[b]:cut[b + 1]].tobytes() for k, v in cols.items()}


def _parts(table: pa.Table, kinds: dict[str, type]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(block of every entry, unpacked columns) of a bucket's rows."""
    cols = {k: [np.frombuffer(x, t) for x in table.column(k).to_pylist()] for k, t in kinds.items()}
    first = next(iter(cols.values()))
    blocks = np.repeat(np.array(table.column("block").to_pylist(), np.int64), [len(x) for x in first])
    return blocks, {k: np.concatenate(v) for k, v in cols.items()}


def _answer(blocks: np.ndarray, values: np.ndarray, name: str) -> pa.Table:
    """One row per block with its packed values, in their order."""
    order = np.argsort(blocks, kind="stable")
    blocks, values = blocks[order], values[order]
    cut = np.flatnonzero(np.concatenate(([True], blocks[1:] != blocks[:-1]))) if len(blocks) else np.zeros(0, np.int64)
    ends = np.concatenate((cut[1:], [len(blocks)])).astype(np.int64)
    return pa.table({"block": pa.array(blocks[cut], pa.int64()),
                     name: pa.array([values[a:b].tobytes() for a, b in zip(cut, ends, strict=False)], pa.binary())})


def repeated_halves(blocks: DataFrame) -> DataFrame:
    """(block, halves): per block its level-1 hashes that another block has too."""
    total = blocks.agg(F.sum(F.octet_length("low"))).first()[0] or 0
    buckets = int(total // 8 // PER_BUCKET) + 1
    schema = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("h", pa.binary())])

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, low in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_pylist(list(_by_bucket(block, np.frombuffer(low, np.uint64), buckets)), schema=schema)

    def shared(table: pa.Table) -> pa.Table:
        block, c = _parts(table, {"h": np.uint64})
        s = np.sort(c["h"])
        twice = s[1:][s[1:] == s[:-1]]
        at = np.minimum(np.searchsorted(twice, c["h"]), max(len(twice) - 1, 0))
        hit = twice[at] == c["h"] if len(twice) else np.zeros(len(block), bool)
        return _answer(block[hit], c["h"][hit], "halves")

    return (blocks.select("block", "low").mapInArrow(sent, "bucket long, block long, h binary")
            .groupBy("bucket").applyInArrow(shared, "block long, halves binary"))


def _with_answers(blocks: DataFrame, answers: DataFrame, name: str) -> DataFrame:
    """Blocks with the list of their answers; only the answers are shuffled."""
    return blocks.join(answers.groupBy("block").agg(F.collect_list(name).alias(name)), "block", "left")


def _first_of_name(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Whether an entry of sorted names is the first of its name."""
    return np.concatenate(([True], (h[1:] != h[:-1]) | (g[1:] != g[:-1]))) if len(h) else np.zeros(0, bool)


def repeated_places(blocks: DataFrame, halves: DataFrame, window: int) -> DataFrame:
    """(block, marks): starts, within the block, of windows whose word sequence is repeated; ``late`` where it also starts earlier."""
    total = blocks.agg(F.sum(F.octet_length("low"))).first()[0] or 0
    buckets = int(total // 8 // (PER_BUCKET // 4)) + 1
    schema = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("late", pa.bool_())] + [(c, pa.binary()) for c in ("h", "g", "doc", "place")])
    found = pa.schema([("block", pa.int64()), ("late", pa.bool_()), ("places", pa.binary())])

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n, hashes = np.frombuffer(row["n"], np.int64), _hashes(row)
                start, least, half = _windows(hashes, n, window)
                if not len(start):
                    continue
                own = np.sort(half)
                repeated = [np.frombuffer(x, np.uint64) for x in row["halves"] or ()]
                known = np.unique(np.concatenate([own[1:][own[1:] == own[:-1]], *repeated]))
                if not len(known):
                    continue
                start = start[known[np.minimum(np.searchsorted(known, least), len(known) - 1)] == least]
                h, g = _names(hashes, window, window, start)
                order = np.lexsort((start, g, h))
                h, g, start = h[order], g[order], start[order]
                first = _first_of_name(h, g)
                doc = np.repeat(np.frombuffer(row["doc"], np.int64), n)
                rows = list(_by_bucket(row["block"], h[first], buckets, g=g[first], doc=doc[start[first]],
                                       place=start[first].astype(np.int32)))
                # places decided in their own block pass through any bucket
                for late, which in ((True, ~first), (False, first & np.concatenate((~first[1:], [False])))):
                    if which.any():
                        rows.append({"bucket": row["block"] % buckets, "block": row["block"], "late": late, "place": _squeezed(start[which])})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def decided(table: pa.Table) -> pa.Table:
        import pyarrow.compute as pc
        own = pc.is_valid(table.column("late"))
        ready = table.filter(own).select(["block", "late", "place"]).cast(found.set(2, pa.field("place", pa.binary()))).rename_columns(found.names)
        table = table.filter(pc.invert(own))
        if not table.num_rows:
            return ready
        block, c = _parts(table, {"h": np.uint64, "g": np.uint32, "doc": np.int64, "place": np.int32})
        order = np.lexsort((block, c["doc"], c["g"], c["h"]))
        first = _first_of_name(c["h"][order], c["g"][order])
        out = [ready]
        for late, which in ((True, ~first), (False, first & np.concatenate((~first[1:], [False])))):
            at = order[which]
            per = _answer(block[at], c["place"][at], "places")
            packed = [_squeezed(np.frombuffer(x, np.int32)) for x in per.column("places").to_pylist()]
            out.append(pa.table([per.column("block"), pa.array([late] * len(packed), pa.bool_()), pa.array(packed, pa.binary())], schema=found))
        return pa.concat_tables(out)

    joined = _with_answers(blocks.drop("low", "text"), halves, "halves")
    return (joined.mapInArrow(sent, "bucket long, block long, late boolean, h binary, g binary, doc binary, place binary")
            .groupBy("bucket").applyInArrow(decided, "block long, late boolean, places binary")
            .groupBy("block").agg(F.collect_list(F.struct("late", "places")).alias("marks")))


def _names(hashes: np.ndarray, window: int, length: int, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """96-bit names (64 and 32 bits) of the sequences of ``length`` = window, 2 window, 4 window ... words at ``start``."""
    x, have, step = _sequence_hash(hashes, (window + 1) // 2), window, window // 2
    while have < length:
        x = _join(x[:-step], x[step:], have)
        have, step = 2 * have, have
    a, b = x[start], x[start + step]
    return _join(a, b, length), (_join(b, a, length + 1) >> np.uint64(32)).astype(np.uint32)


def repeated_lengths(blocks: DataFrame, marks: DataFrame, window: int) -> DataFrame:
    """(block, hit, length): a block's documents (packed places) with a repeated sequence of window, 2 window, 4 window ... words.

    ``marks`` is the table of ``repeated_places``.  A level's table holds, per block, the starts (``live``) of repeated
    sequences of its length; those of twice the length are named where both their halves are live.
    """
    names = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("h", pa.binary()), ("g", pa.binary())])
    level_schema = pa.schema([("block", pa.int64()), ("hit", pa.binary()), ("live", pa.binary()), ("n_live", pa.int64())])

    def level_row(block: int, n: np.ndarray, live: np.ndarray) -> pa.RecordBatch:
        hit = np.unique(np.repeat(np.arange(len(n)), n)[live]).astype(np.int32)
        return pa.RecordBatch.from_pylist([{"block": block, "hit": hit.tobytes(), "live": _squeezed(live), "n_live": len(live)}], schema=level_schema)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                live = np.unique(np.concatenate([_places(m["places"]) for m in row["marks"]]))
                yield level_row(row["block"], np.frombuffer(row["n"], np.int64), live)

    def named(row: dict, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts of a block's candidates of ``length`` words and their names, in the order of names, and which is the first of its name."""
        n, live = np.frombuffer(row["n"], np.int64), _places(row["live"])
        doc = np.repeat(np.arange(len(n)), n)
        alive = np.zeros(len(doc) + 1, bool)
        alive[live] = True
        other = np.minimum(live + length // 2, len(doc))
        start = live[alive[other]]
        start = start[doc[start] == doc[start + length // 2]]
        if not len(start):
            return start, np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, bool)
        h, g = _names(_hashes(row), window, length, start)
        order = np.lexsort((g, h))
        return start[order], h[order], g[order], _first_of_name(h[order], g[order])

    def sent(batches: Iterator[pa.RecordBatch], buckets: int, length: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, h, g, first = named(row, length)
                yield pa.RecordBatch.from_pylist(list(_by_bucket(row["block"], h[first], buckets, g=g[first])), schema=names)

    def shared(table: pa.Table) -> pa.Table:
        """Per row of a bucket one bit an entry, in the order sent: whether another block has its name too."""
        block, c = _parts(table, {"h": np.uint64, "g": np.uint32})
        order = np.lexsort((c["g"], c["h"]))
        first = _first_of_name(c["h"][order], c["g"][order])
        again = np.zeros(len(block), bool)
        again[order] = ~first | np.concatenate((~first[1:], [False]))
        ends = np.cumsum([len(x) // 8 for x in table.column("h").to_pylist()])
        bits = [np.packbits(x).tobytes() for x in np.split(again, ends[:-1])]
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})

    def doubled(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                start, h, _, first = named(row, length)
                # a block's names are sent in ascending order, so its buckets in order make up that order again
                again = ~first[np.minimum(np.flatnonzero(first) + 1, len(first) - 1)] & (np.flatnonzero(first) + 1 < len(first))
                got, at = np.zeros(len(again), bool), 0
                to = ((h[first] >> np.uint64(32)) * np.uint64(row["buckets"])) >> np.uint64(32)
                for answer in sorted(row["answers"] or (), key=lambda x: x["bucket"]):
                    count = int((to == np.uint64(answer["bucket"])).sum())
                    got[at:at + count] = np.unpackbits(np.frombuffer(answer["bits"], np.uint8), count=count)
                    at += count
                live = np.sort(start[(got | again)[np.cumsum(first) - 1]])
                if len(live):
                    yield level_row(row["block"], np.frombuffer(row["n"], np.int64), live)

    shape = "block long, hit binary, live binary, n_live long"
    sizes, words = blocks.select("block", "n"), blocks.select("block", "n", "vocab", "ids")
    level, length = common.stored(sizes.join(marks, "block").mapInArrow(marked, shape), f"level-{window}"), window
    found = level.select("block", "hit", F.lit(length).cast("long").alias("length"))
    while total := level.agg(F.sum("n_live")).first()[0]:
        length, buckets = 2 * length, total // PER_BUCKET + 1
        alive = words.join(level.select("block", "live"), "block")
        answers = (alive.mapInArrow(lambda b, k=buckets, n=length: sent(b, k, n), "bucket long, block long, h binary, g binary")
                   .groupBy("bucket").applyInArrow(shared, "block long, bucket long, bits binary")
                   .groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers")))
        answered = alive.join(answers, "block", "left").withColumn("buckets", F.lit(buckets).cast("long"))
        level = common.stored(answered.mapInArrow(lambda b, n=length: doubled(b, n), shape), f"level-{length}")
        found = found.unionByName(level.select("block", "hit", F.lit(length).cast("long").alias("length")))
    return found


def remove_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """(doc_id, n_words, spans, longest, text): the removed word spans [lo, hi), the longest repeated length, the kept words."""
    bound_batches(docs.sparkSession)
    blocks = build_blocks(docs, window)
    halves = common.stored(repeated_halves(blocks), "halves")
    marks = common.stored(repeated_places(blocks, halves, window), "marks")
    lengths = repeated_lengths(blocks, marks, window)
    span = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", span), ("longest", pa.int64()), ("text", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        for batch in batches:
            for row in batch.to_pylist():
                n = np.frombuffer(row["n"], np.int64)
                words = zstandard.ZstdDecompressor().decompress(row["text"]).split()
                edge = np.zeros(len(words) + 1, np.int64)
                for at in [_places(m["places"]) for m in row["marks"] or () if m["late"]]:
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                step = np.diff(gone.astype(np.int8))
                doc_end = np.cumsum(n)
                longest = np.zeros(len(n), np.int64)
                for at_length in sorted(row["lengths"] or (), key=lambda x: x["length"]):
                    longest[np.frombuffer(at_length["hit"], np.int32)] = at_length["length"]
                out = []
                for i, (d, e) in enumerate(zip(np.frombuffer(row["doc"], np.int64).tolist(), doc_end.tolist(), strict=True)):
                    s = e - int(n[i])
                    if s < e and gone[s:e].any():
                        inner = step[s:e - 1]
                        lo = np.flatnonzero(inner == 1) + 1
                        hi = np.flatnonzero(inner == -1) + 1
                        if gone[s]:
                            lo = np.concatenate(([0], lo))
                        if gone[e - 1]:
                            hi = np.concatenate((hi, [e - s]))
                        spans = [{"lo": a, "hi": b} for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
                        mine = words[s:e]
                        kept = b" ".join([w for a, b in zip([0, *hi.tolist()], [*lo.tolist(), e - s], strict=True) for w in mine[a:b]])
                    else:
                        spans, kept = [], b" ".join(words[s:e])
                    out.append({"doc_id": None if d == NULL_ID else d, "n_words": e - s, "spans": spans,
                                "longest": int(longest[i]), "text": kept.decode()})
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    joined = blocks.select("block", "doc", "n", "text").join(marks, "block", "left")
    joined = joined.join(lengths.groupBy("block").agg(F.collect_list(F.struct("length", "hit")).alias("lengths")), "block", "left")
    return joined.mapInArrow(cut, "doc_id long, n_words long, spans array<struct<lo:int,hi:int>>, longest long, text string")
