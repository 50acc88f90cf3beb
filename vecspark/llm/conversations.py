"""Conversation prefix trie as burst tries: trie heads over containers of suffixes, containers sorted and swept.

A turn's id is the 128-bit digest of its role and text.  A conversation is the packed sequence of its turn ids and word
counts; conversations with equal sequences become one row (how many there are, the least id, a hash of all ids).  Heads are
the prefixes whose distinct sequences hold more than a container's turns below them; the root always is one.  An
oversized container bursts by next turn id: round r looks 2^r levels deeper, so heads deep in a shared preamble take
few rounds.  What is left are containers: each sequence goes to the first prefix on its path that is no head, and its
suffix is stored there.  Containers are hash-dealt over shards, sorted by suffix, and one sweep with a stack of open
nodes turns them into trie nodes.  Heads get their sums from the containers below them by pointer doubling.

How it scales: texts are hashed where they are read; 28 bytes a turn are shuffled.  A container holds at most
``max(CONTAINER, turns / 2^14)`` turns unless it is a single sequence, so there are at most 2^14 heads a depth: that
bound allows the heads' keys (16 bytes each) to be sent to all tasks.  Counts are combined before every shuffle.  A sweep
keeps the nodes of one container.  The ids that end at one node are streamed in order through SHA-256, which no two
tasks can share; memory does not grow with them.

Edge cases: a null role or text is the empty string; a null turn comes first; turns with equal numbers follow the digest
of role and text, and repeated rows are turns of their own; rows with a null conv_id belong to no conversation; very
long texts are hashed whole; a conversation's packed ids must fit into one row (2 GB, about 70 million turns); an empty
table gives no nodes; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.llm import common

WORD = r"[^\x20\x09-\x0D]+"
ID = 16                        # bytes of a turn id
CONTAINER = 4096               # turns that a container of several sequences holds at most, or turns / 2^14 if more
HEADS = 1 << 14
LEVELS = 64                    # levels that one burst looks deeper at most
ROOT = hashlib.md5(b"").digest()
EMPTY = hashlib.sha256(b"").hexdigest()


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, tid, words): a row a turn, texts replaced by digest and word count."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    tid = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    return (conversations.filter(F.col("conv_id").isNotNull())
            .select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                    tid.alias("tid"), F.regexp_count(text, F.lit(WORD)).cast("int").alias("words")))


def packed(turns: DataFrame) -> DataFrame:
    """(conv_id, tids, words): each conversation's turn ids and word counts (4 bytes each) in order of turn."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, tids, words = None, bytearray(), bytearray()
        out: list[tuple] = []
        held = 0
        for batch in batches:
            ids = batch.column("conv_id").to_numpy()
            if not len(ids):
                continue
            cuts = np.flatnonzero(np.diff(ids)) + 1
            tid, counts = common.binary(batch.column("tid")), batch.column("words").to_numpy().astype("<i4")
            for lo, hi in zip([0, *cuts], [*cuts, len(ids)], strict=True):
                if conv is not None and ids[lo] != conv:
                    out.append((conv, bytes(tids), bytes(words)))
                    held += len(tids)
                    tids, words = bytearray(), bytearray()
                conv = int(ids[lo])
                tids += b"".join(tid[lo:hi])
                words += counts[lo:hi].tobytes()
                if held > 1 << 22:
                    yield _records(out, ("conv_id", pa.int64()), ("tids", pa.binary()), ("words", pa.binary()))
                    out, held = [], 0
        if conv is not None:
            out.append((conv, bytes(tids), bytes(words)))
        yield _records(out, ("conv_id", pa.int64()), ("tids", pa.binary()), ("words", pa.binary()))

    rows = turns.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "tid")
    return rows.select("conv_id", "tid", "words").mapInArrow(pack, "conv_id long, tids binary, words binary")


def _records(rows: list[tuple], *fields: tuple) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_pydict({name: pa.array(c, kind) for (name, kind), c in zip(fields, columns, strict=True)})


def _cut(column: str, start: Column, width: int, length: Column | None = None) -> Column:
    """Part of a packed column: from item ``start`` (from 0), ``length`` items or all."""
    items = F.lit(1 << 30) if length is None else length * width
    return F.substring(F.col(column), start * width + 1, items)


def rebuilt(own: DataFrame, period: int = 20, heads: int = 4) -> DataFrame:
    """Packed conversations whose first h turns come from conversation c - c % period; h = crc32(c as text) % ``heads``."""
    first = (own.filter(F.col("conv_id") % period == 0)
             .select(F.col("conv_id").alias("base"), F.substring("tids", 1, ID * (heads - 1)).alias("base_tids"),
                     F.substring("words", 1, 4 * (heads - 1)).alias("base_words")))
    h = (F.crc32(F.col("conv_id").cast("string")) % F.lit(heads)).cast("int")
    asked = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % period).withColumn("h", h)
    both = asked.join(first, "base", "left")
    return both.select("conv_id", *[
        F.concat(F.coalesce(_cut("base_" + c, F.lit(0), width, F.col("h")), F.unhex(F.lit(""))), _cut(c, F.col("h"), width)).alias(c)
        for c, width in (("tids", ID), ("words", 4))])


def sequences(conversations: DataFrame) -> DataFrame:
    """(tids, words, n_convs, conv_id, ends): a row a distinct sequence; ``ends`` hashes the ids of its conversations."""
    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = (("seq", pa.binary()), ("n_convs", pa.int64()), ("conv_id", pa.int64()), ("ends", pa.string()))
        seq, n, least, sha = None, 0, 0, hashlib.sha256()
        for batch in batches:
            out = []
            for s, c in zip(common.binary(batch.column("seq")), batch.column("conv_id").to_pylist(), strict=True):
                if s != seq:
                    if seq is not None:
                        out.append((seq, n, least, sha.hexdigest()))
                    seq, n, least, sha = s, 0, c, hashlib.sha256()
                sha.update(f",{c}".encode() if n else str(c).encode())
                n += 1
            yield _records(out, *fields)
        if seq is not None:
            yield _records([(seq, n, least, sha.hexdigest())], *fields)

    keyed = common.stored(conversations.withColumn("seq", F.unhex(F.md5("tids"))), "conversations")
    listed = (keyed.select("seq", "conv_id").repartition("seq").sortWithinPartitions("seq", "conv_id")
              .mapInArrow(ends, "seq binary, n_convs long, conv_id long, ends string"))
    shapes = keyed.groupBy("seq").agg(F.first("tids").alias("tids"), F.first("words").alias("words"))
    return shapes.join(listed, "seq").drop("seq")


def _deeper(key: bytes, tids: bytes, depth: int) -> bytes:
    """Key of the prefix one turn deeper: ``depth`` turns are in ``key``."""
    return hashlib.md5(key + tids[depth * ID:(depth + 1) * ID]).digest()


def _walk(tids: bytes, heads: set[bytes]) -> tuple[int, bytes, bytes]:
    """First prefix of a sequence that is no head, or its end: (depth, key, key of the prefix above)."""
    key = above = ROOT
    depth, length = 0, len(tids) // ID
    while key in heads and depth < length:
        above, key, depth = key, _deeper(key, tids, depth), depth + 1
    return depth, key, above


def burst(seqs: DataFrame, container: int | None = None) -> DataFrame:
    """(key, above, depth, words) of every head: prefixes with more turns of distinct sequences below than a container's."""
    spark = seqs.sparkSession
    total = seqs.agg(F.sum(F.length("tids") / ID)).first()[0] or 0
    limit = max(container or CONTAINER, int(total) // HEADS)
    heads = spark.createDataFrame([(ROOT, None, 0, 0)], "key binary, above binary, depth int, words int")
    known, lo, step = {ROOT}, 0, 1
    while True:
        shared = spark.sparkContext.broadcast(known)

        def look(batches: Iterator[pa.RecordBatch], lo=lo, step=step, shared=shared) -> Iterator[pa.RecordBatch]:
            """Prefixes of the next ``step`` depths of sequences whose prefix of depth ``lo`` is a head, combined by batch."""
            for batch in batches:
                found: dict[bytes, list] = {}
                for tids, words in zip(common.binary(batch.column("tids")), common.binary(batch.column("words")), strict=True):
                    length = len(tids) // ID
                    if length <= lo:
                        continue
                    depth, key, above = _walk(tids, shared.value)
                    if depth <= lo:
                        continue
                    while True:
                        row = found.get(key)
                        if row is None:
                            w = int.from_bytes(words[4 * depth - 4:4 * depth], "little")
                            row = found[key] = [key, above, depth, w, 0, 0]
                        row[4] += length - depth
                        row[5] += 1
                        if depth >= min(lo + step, length):
                            break
                        above, key, depth = key, _deeper(key, tids, depth), depth + 1
                yield _records([tuple(r) for r in found.values()], ("key", pa.binary()), ("above", pa.binary()),
                               ("depth", pa.int32()), ("words", pa.int32()), ("turns", pa.int64()), ("n", pa.int64()))

        shape = "key binary, above binary, depth int, words int, turns long, n long"
        big = (seqs.select("tids", "words").mapInArrow(look, shape).groupBy("key", "above", "depth", "words")
               .agg(F.sum("turns").alias("turns"), F.sum("n").alias("n")).filter(F.col("turns") > limit).filter("n > 1"))
        big = common.stored(big.select("key", "above", "depth", "words"), "heads")
        keys = [bytes(r["key"]) for r in big.select("key").collect()]          # at most HEADS a depth
        heads = heads.unionByName(big)
        known = known | set(keys)
        if not big.filter(F.col("depth") == lo + step).head(1):
            return common.stored(heads, "heads")
        lo, step = lo + step, min(2 * step, LEVELS)


NODE = ("kind int, key binary, above binary, conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, "
        "n_leaves long, saved_tokens long, ends_sha256 string")
NODE_ARROW = (("kind", pa.int32()), ("key", pa.binary()), ("above", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int32()),
              ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
              ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()))
INNER, TOP, END = 0, 1, 2      # a node inside a container, a container's top node, conversations that end at a head


class _Open:
    """A node whose subtree is being swept."""
    __slots__ = ("children", "conv", "ends", "leaves", "n", "nodes", "saved", "words")

    def __init__(self, words: int):
        self.words, self.conv, self.n, self.ends = words, None, 0, EMPTY
        self.children = self.leaves = self.saved = 0
        self.nodes: list[int] = []             # places of its children in the container's output

    def close(self) -> None:
        self.saved += (self.n - 1) * self.words
        self.leaves = self.leaves or 1


def _sweep(rows: list[tuple], depth: int, above: bytes, key: bytes, kind: int) -> list[list]:
    """Nodes of one container: ``rows`` (suffix, words, n, conv, ends) sorted by suffix, the first word count being the top's."""
    out: list[list] = []
    stack: list[_Open] = []

    def shut(size: int) -> None:
        while len(stack) > size:
            node = stack.pop()
            node.close()
            place = len(out)
            out.append([INNER, None, None, node.conv, depth + len(stack), None, node.n, node.children, node.leaves, node.saved, node.ends])
            for child in node.nodes:
                out[child][5] = node.conv
            if stack:
                up = stack[-1]
                up.nodes.append(place)
                up.children += 1
                up.leaves += node.leaves
                up.saved += node.saved
                up.n += node.n
                up.conv = node.conv if up.conv is None else min(up.conv, node.conv)

    before = b""
    for suffix, words, n, conv, ends in rows:
        counts = np.frombuffer(words, dtype="<i4")
        length, common_turns = len(suffix) // ID, 0
        if stack:
            top = min(len(before), len(suffix))
            if before[:top] == suffix[:top]:
                common_turns = top // ID
            else:
                a, b = np.frombuffer(before[:top], "u1"), np.frombuffer(suffix[:top], "u1")
                common_turns = int(np.argmax(a != b)) // ID
        shut(common_turns + 1)
        if not stack:
            stack.append(_Open(int(counts[0])))
        for i in range(len(stack) - 1, length):
            stack.append(_Open(int(counts[i + 1])))
        end = stack[-1]
        end.n, end.ends = end.n + n, ends
        end.conv = conv if end.conv is None else min(end.conv, conv)
        before = suffix
    shut(0)
    out[-1][0], out[-1][1], out[-1][2] = kind, key, above
    return out


def containers(seqs: DataFrame, heads: DataFrame) -> DataFrame:
    """Nodes below the heads, swept container by container, and one row a head at which conversations end."""
    known = {bytes(r["key"]) for r in heads.select("key").collect()}             # at most HEADS a depth
    shared = seqs.sparkSession.sparkContext.broadcast(known)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for tids, words in zip(common.binary(batch.column("tids")), common.binary(batch.column("words")), strict=True):
                depth, key, above = _walk(tids, shared.value)
                out.append((key, above, END if key in shared.value else TOP, depth, tids[depth * ID:],
                            words[4 * depth - 4:] if depth else bytes(4)))
            own = _records(out, ("key", pa.binary()), ("above", pa.binary()), ("kind", pa.int32()), ("depth", pa.int32()),
                           ("suffix", pa.binary()), ("words", pa.binary()))
            rest = [batch.column(c) for c in ("n_convs", "conv_id", "ends")]
            yield pa.RecordBatch.from_arrays([*own.columns, *rest], names=[*own.schema.names, "n_convs", "conv_id", "ends"])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            out: list[list] = []
            columns = [common.binary(batch.column(c)) for c in ("key", "above")]
            columns += [batch.column(c).to_pylist() for c in ("kind", "depth", "suffix", "words", "n_convs", "conv_id", "ends")]
            for key, above, kind, depth, suffix, words, n, conv, ends in zip(*columns, strict=True):
                if now is not None and key != now[2]:
                    out += _sweep(rows, *now)
                    rows = []
                    if len(out) > 20_000:
                        yield _records([tuple(r) for r in out], *NODE_ARROW)
                        out = []
                now = (depth, above, key, kind)
                rows.append((suffix, words, n, conv, ends))
            yield _records([tuple(r) for r in out], *NODE_ARROW)
        if rows:
            yield _records([tuple(r) for r in _sweep(rows, *now)], *NODE_ARROW)

    shape = "key binary, above binary, kind int, depth int, suffix binary, words binary, n_convs long, conv_id long, ends string"
    dealt = seqs.select("tids", "words", "n_convs", "conv_id", "ends").mapInArrow(deal, shape)
    return dealt.repartition("key").sortWithinPartitions("key", "suffix").mapInArrow(sweep, NODE)


def _doubled(heads: DataFrame, sums: list[str], least: str | None = None) -> DataFrame:
    """``heads`` with every column of ``sums`` summed (``least``: minimised) over the head's subtree, by pointer doubling.

    After round r a head holds the sums of the heads less than 2^r levels below it, and ``anc`` is 2^r levels up.
    """
    now = heads.withColumn("anc", F.col("above"))
    reach, deepest = 1, heads.agg(F.max("depth")).first()[0] or 0
    while reach <= deepest:
        below = now.filter(F.col("anc").isNotNull()).groupBy(F.col("anc").alias("up")).agg(
            *[F.sum(c).alias(c + "_b") for c in sums], *([F.min(least).alias(least + "_b")] if least else []))
        higher = now.select(F.col("key").alias("up_key"), F.col("anc").alias("up_anc"))
        joined = (now.join(below, now["key"] == below["up"], "left")
                  .join(higher, now["anc"] == higher["up_key"], "left"))
        kept = [c for c in now.columns if c not in (*sums, least, "anc")]
        now = joined.select(*[now[c] for c in kept],
                            *[(now[c] + F.coalesce(F.col(c + "_b"), F.lit(0))).alias(c) for c in sums],
                            *([F.least(now[least], F.col(least + "_b")).alias(least)] if least else []),
                            F.col("up_anc").alias("anc"))
        now = common.stored(now, "doubled")
        reach *= 2
    return now.drop("anc")


def prefix_trie(seqs: DataFrame, container: int | None = None) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row a trie node."""
    seqs = common.stored(seqs, "sequences")
    heads = burst(seqs, container)
    nodes = common.stored(containers(seqs, heads), "nodes")
    if not nodes.head(1):
        return _shaped(nodes)
    tops, at = nodes.filter(F.col("kind") == TOP), nodes.filter(F.col("kind") == END)
    below = (tops.select(F.col("above").alias("key"), "conv_id", "n_convs", "n_leaves", "saved_tokens", F.lit(1).alias("child"), F.lit(None).cast("string").alias("ends"))
             .unionByName(at.select("key", "conv_id", "n_convs", F.lit(0).alias("n_leaves"), F.lit(0).alias("saved_tokens"), F.lit(0).alias("child"),
                                    F.col("ends_sha256").alias("ends")))
             .groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_leaves").alias("n_leaves"),
                                 F.sum("saved_tokens").alias("saved_tokens"), F.sum("child").alias("n_children"), F.max("ends").alias("ends")))
    inner = heads.filter("above is not null").groupBy(F.col("above").alias("key")).agg(F.count(F.lit(1)).alias("n_heads"))
    zero = ["n_convs", "n_leaves", "saved_tokens", "n_children", "n_heads"]
    all_heads = heads.join(below, "key", "left").join(inner, "key", "left").select(
        "key", "above", "depth", "words", "conv_id", F.coalesce("ends", F.lit(EMPTY)).alias("ends"), *[F.coalesce(c, F.lit(0)).alias(c) for c in zero])
    counted = _doubled(common.stored(all_heads, "heads"), ["n_convs", "n_leaves"], "conv_id")
    own = counted.withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words"))
    full = common.stored(_doubled(common.stored(own, "heads"), ["saved_tokens"]), "heads")
    up = full.select(F.col("key").alias("up"), F.col("conv_id").alias("up_conv"))
    upper = full.join(up, full["above"] == up["up"], "left").select(
        "conv_id", "depth", F.col("up_conv").alias("parent_conv_id"), "n_convs", (F.col("n_children") + F.col("n_heads")).alias("n_children"),
        # a childless head is the root of a table of turnless conversations: a leaf itself
        F.when(F.col("n_children") + F.col("n_heads") == 0, F.lit(1)).otherwise(F.col("n_leaves")).alias("n_leaves"),
        "saved_tokens", F.col("ends").alias("ends_sha256"))
    joined = tops.drop("parent_conv_id").join(up, tops["above"] == up["up"]).withColumnRenamed("up_conv", "parent_conv_id")
    parts = [nodes.filter(F.col("kind") == INNER), joined, upper]
    return _shaped(parts[0]).unionByName(_shaped(parts[1])).unionByName(_shaped(parts[2]))


def _shaped(nodes: DataFrame) -> DataFrame:
    return nodes.select(*[F.col(c).cast("string" if c == "ends_sha256" else "long").alias(c) for c in COLUMNS])


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(conversations: DataFrame, period: int = 20, heads: int = 4, container: int | None = None) -> DataFrame:
    """The prefix trie of the rebuilt conversations (``period`` and ``heads`` as in ``rebuilt``)."""
    own = common.stored(packed(turn_rows(conversations)), "packed")
    return prefix_trie(sequences(rebuilt(own, period, heads)), container)
