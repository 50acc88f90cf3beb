import hashlib
import zlib

from vecspark.llm import conversations

KEYS = conversations.COLUMNS


def brute(rows):
    """Every prefix of every rebuilt conversation, by dictionaries of whole prefixes."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn, role or "", text or ""))

    def order(t):
        turn, role, text = t
        return (turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest())
    own = {c: [t[1:] for t in sorted(v, key=order)] for c, v in own.items()}
    members, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        seq = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
        ends.setdefault(seq, []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = kids.get(p, [])
        leaves[p] = sum(leaves[k] for k in below) or 1
        words = len(p[-1][1].encode().split()) if p else 0
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in below)
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()) for p, m in members.items())


def table(spark, rows):
    return spark.createDataFrame([(c, t, r, x, c, "x") for c, t, r, x in rows],
                                 "conv_id long, turn long, role string, text string, depth long, key string")


def check(spark, rows, **how):
    got = sorted(tuple(r) for r in conversations.trie(table(spark, rows), **how).select(*KEYS).collect())
    assert got == brute(rows)


def hard_rows():
    rows = [(c, t, "user" if t % 2 else "assistant", f"turn {t} of {c % 3 if t < 5 else c}") for c in range(60) for t in range(c % 9)]
    rows += [(c, t, "user", "same words here") for c in range(100, 180) for t in range(6)]                   # copies
    rows += [(200, None, None, None), (200, 1, "user", ""), (200, 1, "user", "tie"), (200, 1, "user", "tie"), (200, -3, None, "before")]
    rows += [(None, 0, "user", "nobody's"), (-7, 0, "user", "negative"), (-20, 0, "user", "negative base"), (-20, 1, "user", "more")]
    rows += [(2_000_000_000_007, 0, "user", "far"), (301, 0, "user", "long " * 200_000)]
    rows += [(c, t, "user", f"preamble {t}") for c in (400, 401, 402, 403) for t in range(300)] + [(c, 300, "user", f"own {c}") for c in (400, 401, 402)]
    return rows


def test_equals_brute_force_on_hard_rows(spark):
    check(spark, hard_rows())


def test_small_containers_burst_through_deep_heads(spark):
    check(spark, hard_rows(), container=1)


def test_turnless_conversations_and_empty_table(spark):
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in range(20, 60)}
    lone = [c for c, n in h.items() if n and c % 20]
    check(spark, [(c, 0, "user", "gone") for c in lone])               # no base: the first turn goes, nothing is left
    check(spark, [(None, 0, "user", "nobody's")])
    check(spark, [])


def test_equals_brute_force_on_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [tuple(r) for r in d.select("conv_id", "turn", "role", "text").collect()]
    got = sorted(tuple(r) for r in conversations.trie(d, container=64).select(*KEYS).collect())
    assert got == brute(rows)
