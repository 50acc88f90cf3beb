"""Quality rules as weak supervision: rules vote or abstain, EM estimates how reliable each is.

Every document gets a vector of votes (good, bad, abstain) from cheap rules on its whole text.
Expectation-maximisation over the *counts of vote patterns* (at most 3^rules, however many documents)
estimates per rule how often it votes which way on good and on bad documents; the posterior
probability of "good" replaces a filter in which all rules must pass.

Row-local work is one Arrow pass; the only shuffle is the pattern count.

Edge cases: a null or empty text has no words and fails the base rule (it is not kept).  Columns other
than ``doc_id`` and ``text`` are never read by ``quality_scores``; ``keep_good`` returns the input columns.
Very long texts are counted whole; a posterior of exactly 0.5 keeps the document, and there are no other ties.
Repeated rows are judged one by one.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.llm import common

SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
          "n_lines", "n_short", "n_digits", "n_distinct", "n_stops", "n_letters"]
#: rule name -> (measure, good interval, bad interval): a value inside the good interval votes good, inside the
#: bad interval votes bad, anything else abstains (intervals are half-open, [low, high))
RULES: dict[str, tuple[str, tuple[float, float], list[tuple[float, float]]]] = {
    "length": ("n_words", (100, 100_000), [(0, 50)]),
    "word_length": ("chars_per_word", (3.0, 8.0), [(0, 2.2), (10.0, 1e18)]),
    "symbols": ("symbols_per_word", (0.0, 0.02), [(0.1, 1e18)]),
    "dup_lines": ("dup_line_share", (0.0, 0.05), [(0.3, 1.01)]),
    "repeats": ("repeat_share", (0.0, 0.1), [(0.3, 1.01)]),
    "short_words": ("short_share", (0.15, 0.8), [(0.0, 0.08)]),
    "digits": ("digit_share", (0.0, 0.02), [(0.15, 1.01)]),
    "sentences": ("words_per_stop", (3.0, 40.0), [(80.0, 1e18), (0.0, 1.5)]),
    "letters": ("letter_share", (0.85, 1.01), [(0.0, 0.7)]),
}


def _repeat_words(ids: np.ndarray) -> int:
    """Words inside a 3-word window whose sequence occurs at least twice in the text."""
    n = len(ids)
    if n < 4:
        return 0
    v = int(ids.max()) + 1
    if v <= 2_000_000:
        key = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
    else:                                   # v^3 would not fit: number the pairs first
        _, pair = np.unique(ids[:-1] * v + ids[1:], return_inverse=True)
        key = pair[:-1].astype(np.int64) * v + ids[2:]
    s = np.sort(key)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    at = np.searchsorted(twice, key)
    at[at == len(twice)] = 0
    rep = twice[at] == key
    cover = np.zeros(n, bool)
    cover[:-2] |= rep
    cover[1:-1] |= rep
    cover[2:] |= rep
    return int(cover.sum())


def count_text(text: bytes | None) -> list[int]:
    """The counts of one whole text, in the order of ``COUNTS``."""
    if not text:
        return [0] * len(COUNTS)
    words = text.split()
    n = len(words)
    if not n:
        return [0] * len(COUNTS)
    raw = np.frombuffer(text, np.uint8)
    hist = np.bincount(raw, minlength=256)
    points = len(raw) - int(hist[0x80:0xC0].sum())
    spaces = int(hist[[32, 9, 10, 11, 12, 13]].sum())
    lines = [ln for ln in text.split(b"\n") if ln.strip()]
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    digits = int(hist[48:58].sum())
    letters = int(hist[65:91].sum() + hist[97:123].sum() + hist[0xC0:].sum())
    tally = np.bincount(ids)
    short = sum(int(tally[i]) for w, i in number.items() if len(w) <= 3 and w.isalpha())
    stops = int(hist[[33, 46, 63]].sum())
    return [n, points - spaces, int(hist[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), _repeat_words(ids),
            len(lines), short, digits, len(number), stops, letters]


def measures() -> dict[str, Column]:
    """Rule measures as expressions on the count columns."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return {"n_words": F.col("n_words").cast("double"),
            "chars_per_word": F.col("word_chars") / n,
            "symbols_per_word": F.col("n_symbols") / n,
            "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
            "repeat_share": F.col("n_repeat_words") / n,
            "short_share": F.col("n_short") / n,
            "digit_share": F.col("n_digits") / chars,
            "words_per_stop": n / F.greatest(F.col("n_stops"), F.lit(1)),
            "letter_share": F.col("n_letters") / chars}


def vote(rule: str, prefix: str = "") -> Column:
    """1 good, 2 bad, 0 abstain."""
    name, good, bad = RULES[rule]
    x = measures()[name]
    is_bad = F.lit(False)
    for lo, hi in bad:
        is_bad = is_bad | ((x >= lo) & (x < hi))
    return F.when(is_bad, 2).when((x >= good[0]) & (x < good[1]), 1).otherwise(0)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass
class VoteModel:
    """Class prior and, per rule, the probabilities of (abstain, good vote, bad vote) on good and bad documents."""
    prior: float = 0.8
    good: list[list[float]] = field(default_factory=lambda: [[0.2, 0.7, 0.1] for _ in RULES])
    bad: list[list[float]] = field(default_factory=lambda: [[0.3, 0.3, 0.4] for _ in RULES])

    def posterior(self) -> Column:
        """Probability that a document is good, from its votes."""
        z = F.lit(float(np.log(self.prior / (1 - self.prior))))
        for j, rule in enumerate(RULES):
            r = [float(np.log(g / b)) for g, b in zip(self.good[j], self.bad[j], strict=True)]
            v = vote(rule)
            z = z + F.when(v == 1, r[1]).when(v == 2, r[2]).otherwise(r[0])
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> VoteModel:
    """EM on distinct vote patterns (rows of 0/1/2) with their document counts.

    The first E-step trusts every rule alike (start values of ``VoteModel``); counts are smoothed by one vote of
    the start value, so a rule that never votes keeps finite odds.
    """
    start = VoteModel()
    if not len(counts):
        return start
    onehot = np.stack([patterns == k for k in range(3)], axis=2).astype(float)   # patterns x rules x outcomes
    prior, good, bad = start.prior, np.array(start.good), np.array(start.bad)
    g0, b0 = good.copy(), bad.copy()
    c = counts.astype(float)
    for _ in range(rounds):
        lg = np.log(prior) + (onehot * np.log(good)).sum((1, 2))
        lb = np.log1p(-prior) + (onehot * np.log(bad)).sum((1, 2))
        post = 1 / (1 + np.exp(np.clip(lb - lg, -700, 700)))
        wg, wb = c * post, c * (1 - post)
        prior = float(np.clip((wg.sum() + 0.8) / (c.sum() + 1), 0.01, 0.99))
        good = (np.einsum("p,pjk->jk", wg, onehot) + g0) / (wg.sum() + 1)
        bad = (np.einsum("p,pjk->jk", wb, onehot) + b0) / (wb.sum() + 1)
    return VoteModel(prior, good.tolist(), bad.tolist())


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = np.array([count_text(t) for t in common.binary(b.column(1))], dtype=np.int64).reshape(-1, len(COUNTS))
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(rows[:, i]) for i in range(len(COUNTS)))],
                                         names=["doc_id", *COUNTS])


def text_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, counts...) of every row of ``docs``."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(_count_batches, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def learn(counts: DataFrame) -> VoteModel:
    """Fit on the documents that pass the base rule; the driver sees one row per vote pattern (at most 3^rules)."""
    pats = (counts.filter(~base_failed()).select(*[vote(r).alias(r) for r in RULES])
            .groupBy(*RULES).count().collect())
    got = sorted(tuple(r) for r in pats)
    p = np.array([r[:-1] for r in got], dtype=np.int64).reshape(-1, len(RULES))
    return fit_votes(p, np.array([r[-1] for r in got], dtype=np.int64))


def quality_scores(docs: DataFrame) -> DataFrame:
    """Counts, votes' posterior and verdict of every document."""
    counts = common.stored(text_counts(docs), "quality")
    model = learn(counts)
    p = counts.withColumn("p_good", model.posterior()).withColumn("base_failed", base_failed())
    return p.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all their columns) whose verdict is good."""
    model = learn(text_counts(docs))

    @F.pandas_udf(", ".join(f"{c} long" for c in COUNTS))
    def counted(texts):
        import pandas as pd
        return pd.DataFrame([count_text(None if t is None else t.encode()) for t in texts], columns=COUNTS, dtype="int64")

    counted = counted.asNondeterministic()       # evaluated once, not again inside the pushed-down filter
    src = docs.select(F.struct(*docs.columns).alias("row"), counted(F.col("text").cast("string")).alias("c"))
    flat = src.select("row", "c.*")
    return flat.filter(~base_failed() & (model.posterior() >= 0.5)).select("row.*")
