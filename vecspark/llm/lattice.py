"""Language-model scoring by subword lattice likelihood.

The subword pieces are an existing public vocabulary (a SentencePiece model with byte pieces); nothing is added to
it.  Spelled out, a word with its word-start mark is the sum over all its segmentations into pieces of the product of
the pieces' probabilities; a character may always be spelled by its UTF-8 byte pieces, so every word has a
probability.  No piece crosses a word, and the sums run forward in log space.  A word that the training documents hold
has one arc more, over the whole word, with its absolutely discounted share of the training tokens; the discounted
mass goes to spelling.  A document's marginal probability is the product over its words and the end token, and the
model is normalised.  ``piece_score`` is the same without whole-word arcs.

Piece probabilities start from the order of the vocabulary and are refitted to the distinct training words (what is
spelled is mostly new) by expectation-maximisation over the lattice, forward and backward: words are counted over all
training documents, expected piece counts (one row a piece and task) are summed by Spark, and the driver sees one row
a piece.

The add-one baseline of every text is returned with it: training words that make up at least 1/HEAD of the training
text are broadcast (there cannot be more than HEAD of them), the rest is joined by word, so no frequent word is a
join key.

Edge cases: a null or empty text is the end piece alone; a null doc_id hashes as the empty string (not held out);
very long texts and words are scored whole, the sum does not depend on where a batch ends; segmentations of equal weight
all count, so there is no tie to break; repeated rows are scored row by row; without training documents all counts are 0 and the probabilities stay at their
start; an empty table gives an empty result.  Only doc_id and text are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm import common

HEAD = 1 << 20                 # words that are at least one in HEAD training words (at most HEAD of them) are broadcast
HEAD_BYTES = 64                # longer words are never broadcast
TOGETHER = 1 << 17             # words taken through the lattice at once
ROUNDS = 3
LONG = 96                      # longer words are taken one by one
START = "▁"


class Pieces:
    """A vocabulary as an array lookup: hash of a character run -> piece number (or -1)."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, texts: list[str], byte_piece: list[int]):
        """``texts`` by piece number ("" for pieces that are no text); ``byte_piece``: piece number of each byte."""
        self.byte_piece = np.array(byte_piece, dtype=np.int64)
        self.number = {t: i for i, t in enumerate(texts) if t}
        self.size = len(texts)
        self.longest = max((len(t) for t in self.number), default=1)
        keys = np.array([self._hash(np.array([[ord(c) for c in t]], dtype=np.uint64))[0] for t in self.number], dtype=np.uint64)
        ids = np.array(list(self.number.values()), dtype=np.int64)
        self.tables = []
        bits = 20
        while len(keys):            # keys that share a slot go to the next, differently hashed table
            slot = self._slot(keys, bits, len(self.tables))
            _, first = np.unique(slot, return_index=True)
            held, value, more = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32), np.zeros(1 << bits, bool)
            held[slot[first]], value[slot[first]] = keys[first], ids[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            more[slot[rest]] = True
            self.tables.append((bits, held, value, more))
            keys, ids, bits = keys[rest], ids[rest], 14

    def _hash(self, chars: np.ndarray) -> np.ndarray:
        h = np.zeros(len(chars), np.uint64)
        for i in range(chars.shape[1]):
            h = h * self.BASE + chars[:, i] + np.uint64(1)
        return h

    @staticmethod
    def _slot(h: np.ndarray, bits: int, turn: int) -> np.ndarray:
        return ((h ^ (h >> np.uint64(31 - turn))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - bits)).view(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the hashes that are pieces, their piece numbers)."""
        where, numbers, left = [], [], None
        for turn, (bits, held, value, more) in enumerate(self.tables):
            mine = h if left is None else h[left]
            s = self._slot(mine, bits, turn)
            hit = np.flatnonzero(held[s] == mine)
            where.append(hit if left is None else left[hit])
            numbers.append(value[s[hit]])
            other = np.flatnonzero(more[s] & (held[s] != mine))
            left = other if left is None else left[other]
            if not len(left):
                break
        at, ids = np.concatenate(where), np.concatenate(numbers).astype(np.int64)
        keep = ids >= 0
        return at[keep], ids[keep]


def load_pieces(path: str) -> tuple[Pieces, np.ndarray]:
    """The vocabulary of a SentencePiece model, and start probabilities (log) from its order."""
    from sentencepiece import SentencePieceProcessor
    m = SentencePieceProcessor(model_file=path)
    texts, byte_piece = [], [0] * 256
    for i in range(m.vocab_size()):
        if m.is_byte(i):
            byte_piece[int(m.id_to_piece(i)[3:5], 16)] = i
        texts.append("" if m.is_byte(i) or m.is_control(i) or m.is_unknown(i) else m.id_to_piece(i))
    rank = np.arange(m.vocab_size(), dtype=float)
    p = 1.0 / (rank + 100.0)
    return Pieces(texts, byte_piece), np.log(p / p.sum())


def _byte_runs(pieces: Pieces, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct code points, inverse, byte piece numbers padded with -1) of an array of characters."""
    points, inverse = np.unique(chars, return_inverse=True)
    rows = np.full((len(points), 4), -1, np.int64)
    for i, c in enumerate(points.tolist()):
        b = chr(c).encode()
        rows[i, :len(b)] = pieces.byte_piece[list(b)]
    return points, inverse.reshape(chars.shape), rows


def _same_length(pieces: Pieces, log_p: np.ndarray, chars: np.ndarray, weight: np.ndarray | None, counts: np.ndarray | None) -> np.ndarray:
    """Log marginal of words of one length (rows of code points); adds expected piece counts to ``counts``."""
    n, length = chars.shape
    _, inverse, runs = _byte_runs(pieces, chars)
    padded = np.append(log_p, 0.0)
    spell = np.ascontiguousarray(padded[runs].sum(axis=1)[inverse].T)     # log probability of each character's bytes
    prefix = np.zeros((length + 1, n), np.uint64)
    for i in range(length):
        prefix[i + 1] = prefix[i] * pieces.BASE + chars[:, i] + np.uint64(1)
    power = [np.uint64(1)]
    for _ in range(min(length, pieces.longest)):
        power.append(power[-1] * pieces.BASE)
    alpha = np.zeros((length + 1, n))
    arcs: list[list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in range(length + 1)]     # by start
    for j in range(1, length + 1):
        now = alpha[j - 1] + spell[j - 1]
        for w in range(1, min(j, pieces.longest) + 1):
            hit, ids = pieces.find(prefix[j] - prefix[j - w] * power[w])
            if len(hit):
                got = log_p[ids]
                now[hit] = np.logaddexp(now[hit], alpha[j - w][hit] + got)
                if counts is not None:
                    arcs[j - w].append((j, hit, ids, got))
        alpha[j] = now
    if counts is not None:
        beta = np.zeros((length + 1, n))
        for i in range(length - 1, -1, -1):
            now = beta[i + 1] + spell[i]
            for j, hit, _, got in arcs[i]:
                now[hit] = np.logaddexp(now[hit], beta[j][hit] + got)
            beta[i] = now
            share = np.exp(alpha[i] + spell[i] + beta[i + 1] - alpha[length]) * weight
            per_point = np.bincount(inverse[:, i], share, minlength=len(runs))
            for k in range(4):
                ok = runs[:, k] >= 0
                np.add.at(counts, runs[ok, k], per_point[ok])
            for j, hit, ids, got in arcs[i]:
                np.add.at(counts, ids, np.exp(alpha[i][hit] + got + beta[j][hit] - alpha[length][hit]) * weight[hit])
    return alpha[length]


def _one_word(pieces: Pieces, log_p: np.ndarray, word: str, weight: float, counts: np.ndarray | None) -> float:
    """The same for one long word, arc by arc."""
    n = len(word)
    padded = [log_p[pieces.byte_piece[list(c.encode())]].sum() for c in word]
    into: list[list[tuple[int, int, float]]] = [[] for _ in range(n + 1)]
    alpha = np.zeros(n + 1)
    for j in range(1, n + 1):
        terms = [alpha[j - 1] + padded[j - 1]]
        for w in range(1, min(j, pieces.longest) + 1):
            i = pieces.number.get(word[j - w:j])
            if i is not None:
                into[j].append((w, i, log_p[i]))
                terms.append(alpha[j - w] + log_p[i])
        alpha[j] = np.logaddexp.reduce(terms)
    if counts is not None:
        beta = np.full(n + 1, -np.inf)
        beta[n] = 0.0
        for j in range(n, 0, -1):
            for w, i, got in into[j]:
                beta[j - w] = np.logaddexp(beta[j - w], beta[j] + got)
                counts[i] += weight * np.exp(alpha[j - w] + got + beta[j] - alpha[n])
            beta[j - 1] = np.logaddexp(beta[j - 1], beta[j] + padded[j - 1])
            share = weight * np.exp(alpha[j - 1] + padded[j - 1] + beta[j] - alpha[n])
            for b in word[j - 1].encode():
                counts[pieces.byte_piece[b]] += share
    return float(alpha[n])


def word_marginals(pieces: Pieces, log_p: np.ndarray, words: list[bytes], weight: np.ndarray | None = None,
                   counts: np.ndarray | None = None) -> np.ndarray:
    """Natural log of every word's marginal probability; with ``counts``, adds expected piece counts to it."""
    # a mark inside a word is no word start: it gets a private sign, which only byte pieces spell
    texts = [START + w.decode().replace(START, "\ue000") for w in words]
    size = np.array([len(t) for t in texts], np.int64)
    out = np.zeros(len(words))
    with np.errstate(over="ignore"):
        for length in np.unique(size).tolist():
            mine = np.flatnonzero(size == length)
            if length > LONG:
                for i in mine.tolist():
                    out[i] = _one_word(pieces, log_p, texts[i], 1.0 if weight is None else float(weight[i]), counts)
                continue
            for a in range(0, len(mine), 1 << 15):
                some = mine[a:a + (1 << 15)]
                flat = np.frombuffer("".join([texts[i] for i in some.tolist()]).encode("utf-32-le"), np.uint32)
                chars = flat.reshape(len(some), length).astype(np.uint64)
                out[some] = _same_length(pieces, log_p, chars, None if weight is None else weight[some], counts)
    return out


# ---- Spark -------------------------------------------------------------------------------------

def _source(docs: DataFrame, mod: int) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       common.held_out("doc_id", mod).alias("held_out"))


def train_words(docs: DataFrame, mod: int) -> DataFrame:
    """(word, n): lower-cased words of all training documents with their counts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(tally), pa.binary()), pa.array(list(tally.values()), pa.int64())],
                                              names=["word", "n"])

        for b in batches:
            for t in common.binary(b.column(0)):
                if t:
                    tally.update(t.lower().split())
            if len(tally) > common.WORDS_HELD:
                yield rows()
                tally.clear()
        if tally:
            yield rows()

    src = _source(docs, mod).filter(~F.col("held_out")).select("text")
    return common.stored(src.mapInArrow(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")


def fit(words: DataFrame, pieces: Pieces, start: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Log probability of every piece after EM over the distinct training words."""
    spark = words.sparkSession
    log_p = start
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((pieces, log_p))

        def expected(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            pieces, log_p = sent.value
            counts = np.zeros(pieces.size)
            words: list[bytes] = []
            for b in batches:
                words += b.column(0).to_pylist()
                if len(words) >= TOGETHER:
                    word_marginals(pieces, log_p, words, np.ones(len(words)), counts)
                    words = []
            word_marginals(pieces, log_p, words, np.ones(len(words)), counts)
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["piece", "n"])

        got = words.select("word").mapInArrow(expected, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        if not got:
            break
        counts = np.full(pieces.size, 0.01)
        for r in got:
            counts[r.piece] += r.n
        log_p = np.log(counts / counts.sum())
    return log_p


def score(docs: DataFrame, vocabulary: str, mod: int = 7, rounds: int = ROUNDS) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, piece_score (log10)."""
    spark = docs.sparkSession
    pieces, start = load_pieces(vocabulary)
    words = train_words(docs, mod)
    n_docs = _source(docs, mod).filter(~F.col("held_out")).count()
    n_words, n_kinds, once, twice = (x or 0 for x in words.agg(
        F.sum("n"), F.count(F.lit(1)), F.sum((F.col("n") == 1).cast("long")), F.sum((F.col("n") == 2).cast("long"))).first())
    log_p = fit(words, pieces, start, rounds)
    head = {bytes(r.word): r.n for r in words.filter((F.octet_length("word") <= HEAD_BYTES) & (F.col("n") * HEAD >= n_words)).collect()}
    tokens = n_words + n_docs
    floor = float(np.log10(tokens + n_kinds + (1 if n_docs else 0) + 1))
    discount = once / (once + 2 * twice) if once + twice else 0.5
    discount = min(max(discount, 0.1), 0.95)
    spell = discount * n_kinds / tokens if n_kinds else 0.5          # probability that a token is spelled
    end = n_docs / tokens if n_docs else 0.5
    tokens = max(tokens, 1)
    end_base = float(np.log10(n_docs + 1)) - floor
    end_score, end_piece = float(np.log10(end)), float(np.log10(end))
    turn_spell, turn_word = float(np.log10(spell)), float(np.log10(1 - end))
    sent = spark.sparkContext.broadcast((pieces, log_p, head))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        pieces, log_p, head = sent.value
        row = TaskContext.get().partitionId() << 32

        class Numbers(dict):
            def __missing__(self, w):
                self[w] = n = len(self)
                return n

        for b in batches:
            texts = common.binary(b.column(1))
            for a in range(0, len(texts), 2048):
                some = texts[a:a + 2048]
                number = Numbers()
                ids, sizes = [], []
                for t in some:
                    w = t.lower().split() if t else []
                    ids.extend(map(number.__getitem__, w))
                    sizes.append(len(w))
                kinds = list(number)
                spelled = word_marginals(pieces, log_p, kinds) / np.log(10)
                c = np.array([head.get(w, 0) for w in kinds], dtype=float)
                k, sizes = np.array(ids, dtype=np.int64), np.array(sizes, dtype=np.int64)
                n = len(some)
                doc = np.repeat(np.arange(n), sizes)
                in_head = c[k] > 0
                whole = np.log10(np.maximum(c - discount, 1e-9) / tokens + spell * 10.0 ** np.maximum(spelled, -300))
                base = np.bincount(doc, np.where(in_head, np.log10(c + 1.0)[k] - floor, 0.0), minlength=n)
                total = np.bincount(doc, np.where(in_head, whole[k], 0.0), minlength=n)
                by_piece = np.bincount(doc, spelled[k] + turn_word, minlength=n)
                met = np.bincount(doc, in_head, minlength=n).astype(np.int64)
                # the other words go to the join, once a document
                pair, times = np.unique((doc[~in_head] << 32) | k[~in_head], return_counts=True)
                cut = pa.array(np.searchsorted(pair >> 32, np.arange(n + 1)).astype(np.int32))
                kind = pair & 0xFFFFFFFF
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + n)), b.column(0).slice(a, n), b.column(2).slice(a, n), pa.array(sizes + 1),
                     pa.array(met + (1 if n_docs else 0)), pa.array(base + end_base), pa.array(total + end_score),
                     pa.array(by_piece + end_piece),
                     pa.ListArray.from_arrays(cut, pa.array([kinds[i] for i in kind.tolist()], pa.binary())),
                     pa.ListArray.from_arrays(cut, pa.array(times.astype(np.int64))),
                     pa.ListArray.from_arrays(cut, pa.array(spelled[kind].astype(np.float64)))],
                    names=["row", "doc_id", "held_out", "n_tokens", "met", "base", "total", "piece_score", "tail", "times", "spelled"])
                row += n

    rows = common.stored(_source(docs, mod).mapInArrow(
        scored, "row long, doc_id long, held_out boolean, n_tokens long, met long, base double, total double, "
                "piece_score double, tail array<binary>, times array<long>, spelled array<double>"), "scores")
    seen = F.greatest(F.col("n") - F.lit(discount), F.lit(1e-9)) / F.lit(float(tokens))
    arc = F.when(F.col("n").isNull(), F.col("spelled") + F.lit(turn_spell)).otherwise(
        F.log10(seen + F.lit(spell) * F.pow(F.lit(10.0), F.greatest(F.col("spelled"), F.lit(-300.0)))))
    tail = (rows.select("row", F.explode(F.arrays_zip("tail", "times", "spelled")).alias("x"))
            .select("row", F.col("x.tail").alias("word"), F.col("x.times").alias("times"), F.col("x.spelled").alias("spelled"))
            .join(words, "word", "left")
            .groupBy("row").agg(
                F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("met2"),
                F.sum(F.col("times") * (F.log10(F.coalesce("n", F.lit(0)) + F.lit(1.0)) - F.lit(floor))).alias("base2"),
                F.sum(F.col("times") * arc).alias("total2")))
    zero = F.lit(0.0)
    return (rows.join(tail, "row", "left")
            .select("doc_id", "held_out", "n_tokens", (F.col("met") + F.coalesce("met2", F.lit(0))).alias("n_known"),
                    F.lit(n_words + n_docs).cast("long").alias("train_tokens"),
                    (F.col("base") + F.coalesce("base2", zero)).alias("base_score"),
                    (F.col("total") + F.coalesce("total2", zero)).alias("score"), "piece_score"))
