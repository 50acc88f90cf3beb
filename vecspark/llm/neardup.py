"""MinHash near-duplicates by improved consistent weighted sampling (ICWS) over TF-IDF shingles.

A document is the weighted set of its five-word shingles: weight = occurrences x idf, with idf = ln((1 + N) / (1 + df)) + 1
of every shingle, N the number of distinct texts with words and df the number of those that hold the shingle (exact copies
are one text).  Weights are divided by the idf of a shingle that is in one text alone, which changes no similarity.  ICWS
draws ``BANDS * ROWS`` samples; two documents share a sample with probability equal to their weighted Jaccard similarity.  Three samples make a band; documents that
agree in a band are candidates; every candidate pair that could join two classes is verified by its exact similarity.

Two documents are linked if their weighted Jaccard similarity is at least ``threshold``.  With ``either`` they also are if
their unweighted one is: a large group of near copies lowers the idf of its own shared shingles.  A text that repeats
a shingle or has a frequent one then also has the bands of its unweighted set, so a pair similar by either measure
meets with the probability that this measure gives.  With ``close`` below 1 only texts whose weighted set is less than
``close`` similar to the unweighted one have them.  Similarity obeys the triangle inequality, so two other texts that are
``threshold`` similar by the unweighted measure are so by the weighted one up to twice 1 - ``close``; where idf alone makes
the weights, up to 0.023 at threshold 0.8 and ``CLOSE``: they are missed by their weighted bands with less than 0.06 %.

How it scales
* texts are packed once into written blocks, bucketed by block number.  A block sends the hashes of its distinct shingles
  with their counts, in buckets of about ``PER_BUCKET`` hashes; a bucket adds the counts and answers every block in the
  order sent, so an answer is a document frequency a hash and only answers are joined back.  Nothing is broadcast.
* exact copies are one node; band buckets become stars around hubs, never all pairs.  The hub of a bucket is its most
  central member: the one whose bands fall into the largest buckets, which in a group of edited copies is the
  document they were made from.  Buckets whose members are not in one class get their next central members as
  hubs, ``TURNS`` in all.  Then every pair of two classes that share a bucket is decided, whatever the bucket's size:
  as rows in buckets of at most ``SMALL`` documents, in larger ones by blocks of about ``BLOCK`` documents that meet
  in a task (members of the bucket's largest class meet only the others), so rows grow by blocks and not by pairs.
* a hub with many partners is spread over salted groups, so no task holds a whole group.
* classes come from alternating large-star/small-star rounds on the edge table, each written to the shared folder.

Edge cases: null and empty texts (and texts without words) are in no group, each its own class; a text of one to
four words is one shingle; very long texts are used whole; a null doc_id gets a null class; rows that share a doc_id are one
document, whose class holds all its texts (``keep_one`` judges every text of its own); of equal texts the least doc_id
stands for all; ties in centrality go to the greater node; an empty table gives an empty result.  Only doc_id and text are
read, other columns may have any names.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm import common
from vecspark.llm.substrings import BUCKET_BYTES, _by_bucket
from vecspark.session import bound_batches

WIDTH = 5
BANDS, ROWS = 12, 3
CLOSE = 0.9                    # a text this similar to its own unweighted set needs the weighted bands alone
COMMON = 64                    # a shingle in 1/COMMON of the documents is frequent
TEXT_BYTES = 3 << 20           # bytes of text of a block of texts, about
PER_BUCKET = 1 << 20           # shingle hashes of blocks that one task adds up, about
PER_SALT = 128                 # partners of a hub in one verification group
TURNS = 4                      # hubs a bucket gets while its members are not in one class
SMALL = 32                     # a bucket of so many documents at most ends with its open pairs as rows, a larger one by blocks
BLOCK = 512                    # documents of a block, and
BLOCK_BYTES = 8 << 20          # bytes of shingle hashes, about
COLUMNS = 4096                 # shingles of one matrix product
TABLE_BITS = 16
HOT = 64                       # a text that is more than 1/HOT of all rows meets its node by broadcast


# ---- shingles ----------------------------------------------------------------------------------

class Shingler:
    """Shingle hashes of texts; word hashes are remembered within a task."""

    def __init__(self):
        from xxhash import xxh3_64_intdigest
        shingler = self

        class Words(dict):
            def __missing__(self, w):
                n = self[w] = len(self)
                shingler.fresh.append(xxh3_64_intdigest(w))
                return n

        self.make = Words
        self.reset()

    def reset(self) -> None:
        self.words, self.fresh = self.make(), []
        self.hash = np.zeros(0, np.uint64)

    def __call__(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(hash of every shingle, document number of each)."""
        if len(self.words) > common.WORDS_HELD:
            self.reset()
        get = self.words.__getitem__
        ids, n = [], []
        for t in texts:
            w = t.lower().split() if t else []       # bytes.lower changes A-Z only
            ids.extend(map(get, w))
            n.append(len(w))
        if self.fresh:
            self.hash = np.concatenate([self.hash, common.mix64(np.array(self.fresh, dtype=np.uint64))])
            self.fresh.clear()
        k = np.array(ids, dtype=np.int64)
        n = np.array(n, dtype=np.int64)
        ends = np.cumsum(n)
        h = self.hash[k]
        doc = np.repeat(np.arange(len(n)), n)
        size = np.minimum(n, WIDTH)[doc]
        at = np.arange(len(k)) - np.repeat(ends - n, n)
        start = np.flatnonzero(at <= n[doc] - size)
        out = np.zeros(len(start), np.uint64)
        for j in range(WIDTH):
            ok = j < size[start]
            out = out * np.uint64(0x9E3779B97F4A7C15) + np.where(ok, h[np.where(ok, start + j, 0)], np.uint64(j + 1))
        return common.mix64(out), doc[start]


def _distinct(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, shingle) in order, with occurrences: (hash, doc, tf)."""
    order = np.argsort((doc.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
    h, doc = h[order], doc[order]
    first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))) if len(h) else np.zeros(0, int)
    return h[first], doc[first], np.diff(np.concatenate((first, [len(h)])))


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def digest(text: F.Column) -> F.Column:
    return F.unhex(F.md5(text))


# ---- blocks of texts ---------------------------------------------------------------------------

TEXTS = "block long, docs array<struct<doc_id:long,digest:binary>>, bytes long, size binary, text binary"


def text_blocks(docs: DataFrame) -> DataFrame:
    """All texts with a word, as written blocks (block, docs, bytes, size, text) bucketed by block number."""

    def row(number: int, ids: list[int | None], texts: list[bytes]) -> pa.RecordBatch:
        from hashlib import md5

        import zstandard
        named = pa.StructArray.from_arrays([pa.array(ids, pa.int64()), pa.array([md5(t).digest() for t in texts], pa.binary())], ["doc_id", "digest"])
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), named),
             pa.array([sum(map(len, texts))], pa.int64()), pa.array([np.array([len(t) for t in texts], np.int64).tobytes()], pa.binary()),
             pa.array([zstandard.ZstdCompressor(level=3).compress(b"".join(texts))], pa.binary())],
            names=["block", "docs", "bytes", "size", "text"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        ids, texts, held = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), common.binary(b.column(1)), strict=True):
                if not t or not t.strip():               # bytes.strip takes off exactly the spaces of bytes.split
                    continue
                ids.append(i)
                texts.append(t)
                held += len(t) + 64
                if held >= TEXT_BYTES:
                    yield row(number, ids, texts)
                    number, ids, texts, held = number + 1, [], [], 0
        if ids:
            yield row(number, ids, texts)

    spark, src = docs.sparkSession, _source(docs)
    total = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    name = f"llm_texts_{uuid.uuid4().hex}"
    with common.shuffles_freed(spark):
        (src.mapInArrow(packed, TEXTS).repartition(parts, "block").write.option("path", common.scratch(spark, "texts"))
         .option("compression", "none").bucketBy(parts, "block").saveAsTable(name))
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")            # the catalog's line only: the files lie in the shared folder
    return table


def _texts(row: dict, wanted: list[int] | None = None) -> list[bytes]:
    """The texts of a block, or those at the places ``wanted``."""
    import zstandard
    whole = zstandard.ZstdDecompressor().decompress(row["text"])
    ends = np.cumsum(np.frombuffer(row["size"], np.int64)).tolist()
    starts = [0, *ends[:-1]]
    return [whole[starts[i]:ends[i]] for i in (range(len(ends)) if wanted is None else wanted)]


def _shingles(texts: list[bytes], shingler: Shingler, size: int = 1 << 19) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) in order, with occurrences: (hash, number of the text, tf); made in runs of about ``size`` bytes."""
    parts, a, held = [], 0, 0
    for z, t in enumerate(texts, 1):
        held += len(t)
        if held >= size or z == len(texts):
            h, doc, tf = _distinct(*shingler(texts[a:z]))
            parts.append((h, doc + a, tf))
            a, held = z, 0
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


# ---- idf ---------------------------------------------------------------------------------------

def _block_counts(blocks: DataFrame) -> DataFrame:
    """(bucket, block, h, n): the distinct shingles of a block and the number of its texts that hold each, dealt by hash.

    Of a block with ``want`` (at, node, named) only the texts at these places count.  A block's hashes ascend over its buckets.
    """
    total = blocks.agg(F.sum("bytes")).first()[0] or 0
    buckets = int(total // 6 // PER_BUCKET) + 1
    schema = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("h", pa.binary()), ("n", pa.binary())])

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for row in batch.to_pylist():
                h = _shingles(_texts(row, _places(row["want"]) if "want" in row else None), shingler)[0]
                u, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_pylist(list(_by_bucket(row["block"], u, buckets, n=n.astype(np.uint32))), schema=schema)

    return blocks.drop("docs").mapInArrow(sent, "bucket long, block long, h binary, n binary")


def _places(want: list[dict]) -> list[int]:
    return sorted(w["at"] for w in want)


def _added(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document frequency) of every entry of a bucket, in the order sent."""
    h, n = (np.concatenate([np.frombuffer(x, t) for x in table.column(k).to_pylist()]) for k, t in (("h", np.uint64), ("n", np.uint32)))
    order = np.argsort(h)
    ascending = h[order]
    first = np.concatenate(([True], ascending[1:] != ascending[:-1]))
    df = np.empty(len(order), np.uint32)
    df[order] = np.add.reduceat(n[order], np.flatnonzero(first))[np.cumsum(first, dtype=np.int32) - 1]
    return h, df


def document_counts(blocks: DataFrame) -> DataFrame:
    """(block, counts): for every block the document frequencies of its distinct shingles, ascending by hash, by bucket."""

    def answered(table: pa.Table) -> pa.Table:
        import zstandard
        df = _added(table)[1]
        ends = np.cumsum([len(x) // 8 for x in table.column("h").to_pylist()])
        packed = [zstandard.ZstdCompressor(level=1).compress(x.tobytes()) for x in np.split(df, ends[:-1])]
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "df": pa.array(packed, pa.binary())})

    return (_block_counts(blocks).groupBy("bucket").applyInArrow(answered, "block long, bucket long, df binary")
            .groupBy("block").agg(F.collect_list(F.struct("bucket", "df")).alias("counts")))


def frequent_shingles(docs: DataFrame) -> dict[int, int]:
    """Document counts of all shingles that occur in at least 1/COMMON of the documents (and of N, under -1), for a report."""
    n_docs = docs.count()
    least = max(2, math.ceil(n_docs / COMMON))

    def often(table: pa.Table) -> pa.Table:
        h, df = _added(table)
        h, at = np.unique(h[df >= least], return_index=True)
        return pa.table({"shingle": pa.array(h.view(np.int64)), "n": pa.array(df[df >= least][at].astype(np.int64))})

    found = _block_counts(text_blocks(docs)).groupBy("bucket").applyInArrow(often, "shingle long, n long").collect()
    return {r.shingle: r.n for r in found} | {-1: n_docs}


def idf(df: np.ndarray, n_docs: int) -> np.ndarray:
    """Smooth inverse document frequency, as a share of that of a shingle in one text."""
    return ((np.log((1 + n_docs) / (1 + df.astype(np.float64))) + 1) / (math.log((1 + n_docs) / 2) + 1)).astype(np.float32)


def _weighted(row: dict, n_docs: int, shingler: Shingler) -> tuple[list[dict], list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """The wanted texts of a block that has its ``counts``: (want, texts, hash, number of the text, weight)."""
    import zstandard
    want = sorted(row["want"], key=lambda x: x["at"])
    texts = _texts(row, [x["at"] for x in want])
    h, doc, tf = _shingles(texts, shingler)
    counts = sorted(row["counts"], key=lambda x: x["bucket"])
    df = np.concatenate([np.frombuffer(zstandard.ZstdDecompressor().decompress(x["df"]), np.uint32) for x in counts])
    own = idf(df, n_docs)[np.unique(h, return_inverse=True)[1]]
    return want, texts, h, doc, tf.astype(np.float32) * own


# ---- sampling ----------------------------------------------------------------------------------

class Sampler:
    """ICWS: per sample and shingle, (r, c, beta) come from a fixed table of 2^16 draws at a hashed place.

    With weight w: t = floor(ln w / r + beta), ln a = ln c - r (t - beta) - r; the shingle with the least a is the
    sample, and (shingle, t) its identity.  ln a depends on the weight through t alone, so (ln a, identity) packed
    into one 64-bit key is equal exactly where the samples are.
    """

    def __init__(self, samples: int = BANDS * ROWS, seed: int = 9):
        rng = np.random.Generator(np.random.PCG64(seed))
        n = 1 << TABLE_BITS
        self.r = rng.gamma(2.0, 1.0, n).astype(np.float32)
        self.log_c = np.log(rng.gamma(2.0, 1.0, n)).astype(np.float32)
        self.beta = rng.random(n, dtype=np.float32)
        zero = np.zeros(n, np.float32)                           # weight 1: t = 0, by the very operations used for other weights
        self.unit = self._order(self.log_c - self.r * (zero - self.beta) - self.r) << np.uint64(32)
        self.odd = rng.integers(0, 1 << 63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    @staticmethod
    def _order(x: np.ndarray) -> np.ndarray:
        """float32 to integers in the same order."""
        b = x.astype(np.float32).view(np.uint32)
        return np.where(b >> 31, ~b, b | np.uint32(0x80000000)).astype(np.uint64)

    def __call__(self, h: np.ndarray, w: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Least keys, one row per sample, one column per document (documents start at ``start``)."""
        return self.both(h, w, start)[0]

    def both(self, h: np.ndarray, w: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least keys by the weights, and as if every weight was 1."""
        odd_ones = np.flatnonzero(w != 1)
        log_w = np.log(w[odd_ones])
        out = np.empty((len(self.odd), len(start)), np.uint64)
        plain = np.empty_like(out) if len(odd_ones) else out
        for s, m in enumerate(self.odd):
            x = h * m
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            at = (x >> np.uint64(64 - TABLE_BITS)).view(np.int64)
            key = self.unit[at]
            x &= np.uint64(0xFFFFFFFF)
            key |= x
            if len(odd_ones):
                plain[s] = np.minimum.reduceat(key, start)
                j = at[odd_ones]
                r, beta = self.r[j], self.beta[j]
                t = np.floor(log_w / r + beta)
                low = (x[odd_ones] ^ (t.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B1))) & np.uint64(0xFFFFFFFF)
                key[odd_ones] = (self._order(self.log_c[j] - r * (t - beta) - r) << np.uint64(32)) | low
            out[s] = np.minimum.reduceat(key, start)
        return out, plain


def self_similarity(w: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Similarity of weighted sets (which start at ``start``) to their unweighted ones."""
    return np.add.reduceat(np.minimum(w, 1), start, dtype=np.float64) / np.add.reduceat(np.maximum(w, 1), start, dtype=np.float64)


def signatures(blocks: DataFrame, n_docs: int, either: bool = True, close: float = 1.0) -> DataFrame:
    """(node, bands) of every wanted and named text of ``blocks``, which have ``want`` and ``counts``.

    With ``either`` the bands of the weighted set are followed by those of the unweighted one where any differs and the
    two sets are less than ``close`` similar.
    """
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sampler = Shingler(), Sampler()
        for b in batches:
            for row in b.to_pylist():
                want, _, h, doc, w = _weighted(row, n_docs, shingler)
                first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))          # a text with a word has a shingle
                ends = np.concatenate((first[1:], [len(h)]))
                a = 0
                while a < len(want):                                                          # about 2^17 shingles at a time
                    z = max(a + 1, int(np.searchsorted(ends, first[a] + (1 << 17))))
                    yield bands_of(want[a:z], h[first[a]:ends[z - 1]], w[first[a]:ends[z - 1]], first[a:z] - first[a], sampler)
                    a = z

    def bands_of(want: list[dict], h: np.ndarray, w: np.ndarray, start: np.ndarray, sampler: Sampler) -> pa.RecordBatch:
        band = np.empty((len(start), 2, BANDS), np.uint64)
        for k, keys in enumerate(sampler.both(h, w, start)):
            for i in range(BANDS):
                v = np.full(len(start), i + 1, np.uint64)
                for row in keys[i * ROWS:(i + 1) * ROWS]:
                    v = common.mix64(v * np.uint64(0x9E3779B97F4A7C15) + row)
                band[:, k, i] = v
        sent_bands = np.ones((len(start), 2), bool)
        sent_bands[:, 1] = (band[:, 0] != band[:, 1]).any(axis=1) & (self_similarity(w, start) < close) & either
        sent_bands[[not x["named"] for x in want]] = False
        ends = np.concatenate(([0], np.cumsum(sent_bands.sum(axis=1) * BANDS))).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array([x["node"] for x in want], pa.int64()),
             pa.ListArray.from_arrays(pa.array(ends), pa.array(band[sent_bands].view(np.int64).ravel()))], names=["node", "bands"])

    return blocks.drop("docs").mapInArrow(signed, "node long, bands array<long>").filter(F.size("bands") > 0)


# ---- classes -----------------------------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the least node of each connected component, for nodes of ``edges`` (u, v).

    Alternating large-star and small-star until the edge table repeats; it then holds one star per component.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        near = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = near.join(least, "u")
        if large:
            out = moved.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return out.filter("u <> v").distinct()

    e = common.stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    seen = None
    while True:
        mark = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            break
        seen = mark
        e = common.stored(star(star(e, True), False), "edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def features(blocks: DataFrame, n_docs: int) -> DataFrame:
    """(node, hashes, weights): distinct shingles, in order, of the texts of ``blocks`` (with ``want`` and ``counts``) named in ``nodes``."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for b in batches:
            for row in b.to_pylist():
                want, _, h, doc, w = _weighted(row, n_docs, shingler)
                cut, mine = np.searchsorted(doc, np.arange(len(want) + 1)).tolist(), set(row["nodes"])
                spans = [(x["node"], i, k) for x, i, k in zip(want, cut[:-1], cut[1:], strict=True) if x["node"] in mine]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x for x, _, _ in spans], pa.int64()), pa.array([h[i:k].tobytes() for _, i, k in spans], pa.binary()),
                     pa.array([b"" if (w[i:k] == 1).all() else w[i:k].tobytes() for _, i, k in spans], pa.binary())],
                    names=["node", "hashes", "weights"])

    return blocks.drop("docs").mapInArrow(made, "node long, hashes binary, weights binary")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """(weighted, unweighted) Jaccard similarity of two sorted shingle sets with weights."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    if not len(a[0]):
        return 0.0, 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    hit = b[0][at] == a[0]
    both = float(np.minimum(a[1][hit], b[1][at[hit]]).sum(dtype=np.float64))
    n = int(hit.sum())
    total = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64))
    return both / (total - both), n / (len(a[0]) + len(b[0]) - n)


def _unpack(hashes: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    h = np.frombuffer(hashes, np.uint64)
    return h, np.frombuffer(weights, np.float32) if weights else np.ones(len(h), np.float32)


def alike(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], threshold: float, either: bool) -> bool:
    """Whether two sets are similar enough by their weighted similarity, or with ``either`` by the unweighted one."""
    weighted, plain = similarity(a, b)
    return weighted >= threshold or (either and plain >= threshold)


def verified(pairs: DataFrame, feats: DataFrame, threshold: float, either: bool = True) -> DataFrame:
    """Pairs (hub, node) that are similar enough, as edges (u, v).

    A hub's row precedes its partners' rows in a sorted partition, so a task holds one hub at a time; a hub with
    many partners is repeated once per salted group.
    """
    wide = (pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / F.lit(PER_SALT)).cast("int").alias("salts")))
    partners = (pairs.join(wide, "hub")
                .select("hub", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), "node")
                .join(feats.hint("merge"), "node").select("hub", "salt", F.lit(1).alias("kind"), "node", "hashes", "weights"))
    hubs = (wide.join(feats, wide["hub"] == feats["node"])
            .select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"),
                    "node", "hashes", "weights"))

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hub = None, None
        for b in batches:
            us, vs = [], []
            cols = [b.column(i).to_pylist() for i in range(b.num_columns)]
            for h, salt, kind, node, hashes, weights in zip(*cols, strict=True):
                if kind == 0:
                    now, hub = (h, salt), _unpack(hashes, weights)
                elif now == (h, salt) and alike(hub, _unpack(hashes, weights), threshold, either):
                    us.append(h)
                    vs.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    rows = partners.unionByName(hubs).repartition("hub", "salt").sortWithinPartitions("hub", "salt", "kind")
    return rows.mapInArrow(checked, "u long, v long")


def _shared(feats: list[tuple[np.ndarray, np.ndarray]], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles of every left and right set: their number, and a bound on the sum of the lesser weights.

    The bound is the sum of sqrt(wa * wb), which is that sum itself where weights are equal.
    """
    h = np.concatenate([f[0] for f in feats])
    root = np.sqrt(np.concatenate([f[1] for f in feats]))
    doc = np.repeat(np.arange(len(feats)), [len(f[0]) for f in feats])
    _, col, n = np.unique(h, return_inverse=True, return_counts=True)
    often = n > 1
    keep = often[col]
    col, doc, root = (np.cumsum(often) - 1)[col[keep]], doc[keep], root[keep]
    order = np.argsort(col, kind="stable")
    col, doc, root = col[order], doc[order], root[order]
    plain = bool((root == 1).all())
    number, bound = np.zeros((len(left), len(right)), np.float32), np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, int(often.sum()), COLUMNS):
        a, z = np.searchsorted(col, [lo, lo + COLUMNS])
        x = np.zeros((len(feats), COLUMNS), np.float32)
        x[doc[a:z], col[a:z] - lo] = 1
        number += x[left] @ x[right].T
        if not plain:
            x[doc[a:z], col[a:z] - lo] = root[a:z]
            bound += x[left] @ x[right].T
    return number, number if plain else bound


def block_links(rows: list[tuple[int, int, int, bytes, bytes]], threshold: float, either: bool = True) -> list[tuple[int, int]]:
    """Links between different classes of ``rows`` (block, node, comp, hashes, weights), one a pair of classes at least.

    With two blocks the pairs across them are decided, with one those within it.  Matrix products leave out only
    pairs that are certainly not similar enough; the others are decided by their exact similarity.
    """
    block = np.array([r[0] for r in rows])
    left = np.flatnonzero(block == block.min())
    right = np.flatnonzero(block == block.max())
    feats = [_unpack(r[3], r[4]) for r in rows]
    comp = np.unique(np.array([r[2] for r in rows], np.int64), return_inverse=True)[1]
    number, bound = _shared(feats, left, right)
    n = np.array([len(f[0]) for f in feats], np.float64)
    w = np.array([f[1].sum(dtype=np.float64) for f in feats])
    most = bound * (1 + 1e-4)                                        # beyond the rounding of float32
    maybe = most >= (threshold - 1e-6) * (w[left][:, None] + w[right] - most)
    if either:
        maybe |= number >= (threshold - 1e-6) * (n[left][:, None] + n[right] - number)
    maybe &= comp[left][:, None] != comp[right]
    parent = list(range(len(rows)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i, j in zip(*(k.tolist() for k in np.nonzero(maybe)), strict=True):
        a, b = int(left[i]), int(right[j])
        x, y = find(int(comp[a])), find(int(comp[b]))
        if x != y and alike(feats[a], feats[b], threshold, either):
            parent[x] = y
            out.append((rows[a][1], rows[b][1]))
    return out


def open_links(members: DataFrame, feats: DataFrame, threshold: float, either: bool = True) -> DataFrame:
    """Edges (u, v) that join all classes linked by a pair in a bucket of ``members`` (band, value, node, comp).

    The members of a bucket's largest class, and the others, are dealt to blocks by hash; every block of others meets
    every block, each two in a group of their own.
    """
    bucket = ["band", "value"]
    sized = members.select(*bucket, "node", "comp").join(feats.select("node", F.length("hashes").alias("bytes")), "node")
    sized = common.stored(sized, "open_sized")
    per = sized.groupBy(*bucket, "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    per = per.groupBy(*bucket).agg(F.max(F.struct("n", "comp", "bytes")).alias("h"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))

    def blocks(n, size):
        return F.greatest(F.lit(1), F.ceil(n / F.lit(BLOCK)), F.ceil(size / F.lit(BLOCK_BYTES))).cast("int")

    one = (F.col("n") <= BLOCK) & (F.col("bytes") <= BLOCK_BYTES)
    per = per.select(*bucket, F.when(~one, F.col("h.comp")).alias("main"),
                     F.when(one, 1).otherwise(blocks(F.col("n") - F.col("h.n"), F.col("bytes") - F.col("h.bytes"))).alias("q"),
                     F.when(one, 0).otherwise(blocks(F.col("h.n"), F.col("h.bytes"))).alias("p"))
    in_main = F.coalesce(F.col("comp") == F.col("main"), F.lit(False))
    place = F.xxhash64("node")
    dealt = (sized.join(per, bucket)
             .withColumn("block", F.when(in_main, F.col("q") + F.pmod(place, F.col("p"))).otherwise(F.pmod(place, F.col("q"))).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.when(in_main, F.col("q")).otherwise(F.col("q") + F.col("p")) - 1)))
             .select(*bucket, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "comp"))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(rows: list) -> pa.RecordBatch:
            got = block_links(rows, threshold, either)
            return pa.RecordBatch.from_arrays([pa.array([u for u, _ in got], pa.int64()), pa.array([v for _, v in got], pa.int64())],
                                              names=["u", "v"])

        now, rows = None, []
        for b in batches:
            for band, value, i, j, *row in zip(*(b.column(k).to_pylist() for k in range(b.num_columns)), strict=True):
                if now != (band, value, i, j):
                    if rows:
                        yield edges(rows)
                    now, rows = (band, value, i, j), []
                rows.append(row)
        if rows:
            yield edges(rows)

    group = [*bucket, "i", "j"]
    rows = (dealt.join(feats.hint("merge"), "node").select(*group, "block", "node", "comp", "hashes", "weights")
            .repartition(*group).sortWithinPartitions(*group))
    return rows.mapInArrow(linked, "u long, v long")


def _hub_pairs(members: DataFrame, served: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Star pairs (hub, node) of each bucket around its most central member that has not served, and those hubs.

    Only members of other classes than the hub's are paired with it.
    """
    ready = members if served is None else members.join(served, ["band", "value", "node"], "left_anti")
    hubs = ready.groupBy("band", "value").agg(F.max(F.struct("central", "node", "comp")).alias("h"))
    hubs = common.stored(hubs.select("band", "value", F.col("h.node").alias("hub"), F.col("h.comp").alias("hub_comp")), "hubs")
    pairs = (members.join(hubs, ["band", "value"]).filter("comp <> hub_comp").select("hub", "node").distinct())
    return pairs, hubs.select("band", "value", F.col("hub").alias("node"))


def _central(members: DataFrame) -> DataFrame:
    """``members`` with the bucket size and, as ``central``, the sum of the sizes of all buckets of a node."""
    n = members.groupBy("band", "value").agg(F.count(F.lit(1)).alias("size"))
    sized = common.stored(members.join(n, ["band", "value"]), "sized")
    return sized.join(sized.groupBy("node").agg(F.sum("size").alias("central")), "node")


def text_classes(docs: DataFrame, threshold: float, either: bool, close: float = 1.0) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Near-duplicate links between distinct texts: (signatures, nodes, ids with several rows, edges).

    ``nodes`` is (node, digest, rep, n, repeated): a number a distinct text, its least doc_id, its rows, whether that id
    has several rows; the edges (u, v) join node numbers.
    """
    bound_batches(docs.sparkSession)
    blocks = text_blocks(docs)
    rows = blocks.select("block", F.posexplode("docs").alias("at", "doc")).select("block", "at", "doc.*")
    sig = rows.filter("doc_id is not null").select("doc_id", "digest")
    # exact copies first; a text's number is its row in the stored table of distinct texts
    distinct = rows.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("doc_id").alias("n"), F.min(F.struct("block", "at")).alias("place"))
    shared_ids = common.stored(sig.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("doc_id"), "shared-ids")
    placed = common.stored(distinct.select("digest", "rep", "n", "place.*").withColumn("node", F.monotonically_increasing_id()), "nodes")
    nodes = (placed.filter("rep is not null").join(shared_ids.select(F.col("doc_id").alias("rep"), F.lit(True).alias("repeated")), "rep", "left")
             .withColumn("repeated", F.coalesce("repeated", F.lit(False))))
    want = placed.groupBy("block").agg(F.collect_list(F.struct("at", "node", F.col("rep").isNotNull().alias("named"))).alias("want"))
    wanted = blocks.join(common.stored(want, "want"), "block")
    counted = wanted.join(common.stored(document_counts(wanted), "counts"), "block")
    n_docs = placed.count()
    bands = common.stored(signatures(counted, n_docs, either, close), "signatures")
    banded = (bands.select("node", "bands", F.posexplode("bands").alias("at", "value"))
              .filter(F.expr(f"at < {BANDS} or value <> bands[at % {BANDS}]"))
              .select("node", F.expr(f"at % {BANDS}").alias("band"), "value"))
    shared = banded.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    members = common.stored(_central(banded.join(shared, ["band", "value"])), "buckets")
    needed = nodes.join(members.select("node").distinct(), "node", "left_semi").groupBy("block").agg(F.collect_list("node").alias("nodes"))
    feats = common.stored(features(counted.join(common.stored(needed, "needed"), "block"), n_docs), "features")

    tried, served = _hub_pairs(members.withColumn("comp", F.col("node")))
    tried = common.stored(tried, "pairs")
    edges = common.stored(verified(tried, feats, threshold, either), "links")
    for turn in range(1, TURNS + 1):
        comp = common.stored(components(edges), "components")
        joined = members.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        mixed = joined.groupBy("band", "value").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a <> b")
        open_ = common.stored(joined.join(mixed.select("band", "value"), ["band", "value"]), "open")
        if turn < TURNS:
            more, hubs = _hub_pairs(open_, served)
            served = served.unionByName(hubs)
        else:
            few = open_.filter(F.col("size") <= SMALL).select("band", "value", "node", "comp")
            x = few.select("band", "value", F.col("node").alias("hub"), F.col("comp").alias("hub_comp"))
            more = few.join(x, ["band", "value"]).filter("comp <> hub_comp and node < hub").select("hub", "node").distinct()
        both = tried.unionByName(tried.select(F.col("node").alias("hub"), F.col("hub").alias("node")))
        more = common.stored(more.join(both, ["hub", "node"], "left_anti"), "pairs")
        tried = tried.unionByName(more)
        edges = edges.unionByName(common.stored(verified(more, feats, threshold, either), "links"))
    edges = edges.unionByName(common.stored(open_links(open_.filter(F.col("size") > SMALL), feats, threshold, either), "links"))
    return sig, nodes, shared_ids, edges


def _placed(sig: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, node, rep) of every signature; a text with many copies meets its node by broadcast (fewer than HOT rows)."""
    total = nodes.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(nodes.filter(F.col("n") * HOT > total).select("digest", "node", "rep"))
    rows = sig.select("doc_id", "digest")
    large = rows.join(hot, "digest")
    small = rows.join(hot.select("digest"), "digest", "left_anti").join(nodes.select("digest", "node", "rep"), "digest")
    return large.unionByName(small).select("doc_id", "node", "rep")


def classes(docs: DataFrame, threshold: float = 0.8, either: bool = True, close: float = 1.0) -> DataFrame:
    """(doc_id, class_id, copy_of): near-duplicate class (its least doc_id) and exact-copy representative of each row."""
    sig, nodes, shared_ids, edges = text_classes(docs, threshold, either, close)
    placed = common.stored(_placed(sig, nodes), "placed")
    # an id that occurs with several texts ties their nodes together
    of_shared = placed.join(shared_ids, "doc_id", "left_semi")
    ties = of_shared.join(of_shared.groupBy("doc_id").agg(F.min("node").alias("v")), "doc_id").filter("node <> v").select(F.col("node").alias("u"), "v")
    comp = common.stored(components(edges.unionByName(ties)), "components")
    rooted = nodes.join(comp, "node", "left").select("node", "rep", F.coalesce("comp", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("class_id"))
    named = rooted.join(least, "root").filter("class_id <> rep").select("rep", "class_id").distinct()
    each = placed.groupBy("doc_id").agg(F.min("rep").alias("copy_of"))
    grouped = each.join(named.withColumnRenamed("rep", "copy_of"), "copy_of", "left").select(
        F.col("doc_id").alias("id"), F.coalesce("class_id", "copy_of").alias("class_id"), "copy_of")
    return (_source(docs).select("doc_id").join(grouped, F.col("doc_id") == F.col("id"), "left")
            .select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copy_of", "doc_id").alias("copy_of")))


def keep_one(docs: DataFrame, threshold: float = 0.8, either: bool = True) -> DataFrame:
    """One row of ``docs`` per class of texts: of the rows with the least doc_id the one with the least digest.

    Different texts of one id are judged each on its own.  Rows with a null id and rows without a word all stay.
    """
    _, nodes, shared_ids, edges = text_classes(docs, threshold, either)
    comp = common.stored(components(edges), "components")
    rooted = nodes.join(comp, "node", "left").withColumn("root", F.coalesce("comp", "node"))
    first = rooted.groupBy("root").agg(F.min(F.struct("rep", "digest", "repeated")).alias("k"))
    keep = common.stored(first.select(F.col("k.rep").alias("__rep"), F.col("k.digest").alias("__digest"), F.col("k.repeated").alias("__repeated")), "kept")
    text = F.col("text").cast("string")
    wordless = F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]")), F.lit(0)) == 0
    all_stay = F.col("doc_id").isNull() | wordless
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"), F.col("doc_id").cast("long").alias("__id"),
                      digest(text).alias("__own"), all_stay.alias("__stay"))
    once = row.filter("not __stay").join(keep.filter("not __repeated"), F.col("__id") == F.col("__rep"), "left_semi")
    many = (row.filter("not __stay").join(keep.filter("__repeated"), (F.col("__id") == F.col("__rep")) & (F.col("__own") == F.col("__digest")), "left_semi")
            .dropDuplicates(["__id", "__own"]))
    return row.filter("__stay").unionByName(once).unionByName(many).select("record.*")
