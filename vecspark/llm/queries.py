"""Registered queries of this subpackage (production parameters, whole tables) and their DuckDB twins."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm import (
    common,
    conversations,
    decontam,
    langid,
    lattice,
    lines,
    mixing,
    neardup,
    quality,
    repair,
    sharding,
    substrings,
    toxicity,
    whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        common.prepare(spark)
        return fn(spark, sf_dir)
    QUERIES[fn.__name__] = run
    return run


@query
def op3_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text by its nearest centroid, learned from the training documents' languages."""
    docs = common.table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.train(docs, mod=4))
    return found.select("doc_id", common.held_out("doc_id", 4).alias("held_out"), "lang_pred", "score", "rejected")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer's file on this machine (the same on every executor)."""
    import public_tokenizers
    return public_tokenizers.path(name)


@query
def op4_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak-supervision quality verdict of every document."""
    scores = quality.quality_scores(common.table(spark, sf_dir, "documents"))
    return scores.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", "p_good")


@query
def op5_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact ten-word benchmark phrases in every document, from the positional inverted index."""
    found = decontam.find(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"), width=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


ORACLE["op5_positional_index"] = r"""
WITH dw AS (SELECT row_number() OVER () AS rid, doc_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM bw WHERE len(w) > 0),
bwin AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + 9], ' ') AS win FROM bi),
lens AS (SELECT DISTINCT n FROM bwin),
di AS (SELECT rid, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM dw, lens WHERE len(w) >= n),
dwin AS (SELECT rid, n, s, array_to_string(w[s:s + n - 1], ' ') AS win FROM di),
hit AS (SELECT DISTINCT d.rid, d.s, d.n, b.item_id FROM dwin d JOIN bwin b ON d.win = b.win AND d.n = b.n),
cov AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
        FROM (SELECT DISTINCT rid, coalesce(CAST(item_id AS VARCHAR), '') AS id FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov USING (rid) LEFT JOIN its USING (rid)
"""


@query
def op6_repair_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as token ids in Re-Pair shards; per document what the written files hold."""
    shards = repair.write_shards(common.table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)
    return repair.read_documents(shards)


@query
def op9_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document (five-word TF-IDF shingles, weighted or unweighted Jaccard similarity 0.8)."""
    return neardup.classes(common.table(spark, sf_dir, "documents"), threshold=0.8, close=neardup.CLOSE)


#: production parameters of the mix: as many tokens as there are, no source more than 1.25 times
MIX = {"budget_ratio": 1.0, "max_repeats": 1.25}


@query
def op1_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 marginal probability of every text over all segmentations of its words, with the add-one baseline."""
    return lattice.score(common.table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), mod=7)


@query
def op2_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole corpus mixed by source: one row a draw, with its block and place."""
    return mixing.draws(common.table(spark, sf_dir, "documents"), **MIX)


ORACLE["op2_temperature_mix"] = r"""
WITH RECURSIVE u AS (SELECT coalesce(source, '') AS source, doc_id,
        CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS BIGINT) AS n_tokens
    FROM documents GROUP BY 1, 2),
s AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM u GROUP BY 1 HAVING sum(n_tokens) > 0),
t AS (SELECT CAST(sum(tokens) AS BIGINT) AS total, min(tokens) AS least FROM s),
bis(step, lo, hi) AS (
    SELECT 0, CAST(-1 AS BIGINT), CAST(268435456 AS BIGINT)
    UNION ALL
    SELECT step + 1, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END
    FROM (SELECT step, lo, hi, mid,
                 pow(least / CAST(total AS DOUBLE), mid / 268435456.0::DOUBLE - 1)
                 / (SELECT sum(pow(tokens / CAST(total AS DOUBLE), mid / 268435456.0::DOUBLE)) FROM s) <= 1.25 AS ok
          FROM (SELECT step, lo, hi, (lo + hi) // 2 AS mid FROM bis WHERE hi - lo > 1), t)),
a AS (SELECT hi / 268435456.0::DOUBLE AS alpha FROM bis ORDER BY step DESC LIMIT 1),
q AS (SELECT source, tokens, quota FROM (
        SELECT source, tokens, CAST(floor(pow(tokens / CAST(total AS DOUBLE), alpha)
               / (SELECT sum(pow(tokens / CAST(total AS DOUBLE), alpha)) FROM s) * CAST(total AS DOUBLE)) AS BIGINT) AS quota
        FROM s, t, a) WHERE quota > 0),
e AS (SELECT *, md5('2|' || epoch || '|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
      FROM (SELECT u.*, tokens, quota, CAST(unnest(range(0, (quota - 1) // tokens + 1)) AS INTEGER) AS epoch
            FROM u JOIN q USING (source))),
b AS (SELECT *, epoch * tokens + coalesce(sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY key, doc_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e),
c AS (SELECT b.*, CAST(floor(CAST(before AS DOUBLE) / quota * greatest(1, CAST(ceil(total / 1048576.0) AS BIGINT))) AS BIGINT) AS block
      FROM b, t WHERE before < quota)
SELECT doc_id, source, epoch, n_tokens, block,
       CAST(row_number() OVER (PARTITION BY block ORDER BY key, source, doc_id, epoch) AS INTEGER) AS place FROM c
"""


@query
def op7_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of twenty-word sequences that start earlier in the corpus."""
    done = substrings.remove_repeats(common.table(spark, sf_dir, "documents"), window=20)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["hi"] - s["lo"])
    return done.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


ORACLE["op7_doubling"] = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS rid, doc_id,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT rid, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20),
k AS (SELECT rid, s, array_to_string(w[s:s + 19], ' ') AS win FROM s),
late AS (SELECT rid, s FROM (SELECT rid, s, row_number() OVER (PARTITION BY win ORDER BY rid, s) AS nth FROM k) WHERE nth > 1),
gone AS (SELECT DISTINCT rid, unnest(range(s, s + 20)) AS p FROM late),
cut AS (SELECT rid, count(*) AS n, list(p) AS ps FROM gone GROUP BY rid),
words AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d WHERE len(w) > 0),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN cut USING (rid) LEFT JOIN kept USING (rid)
"""


@query
def op8_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page without the lines that its host repeats on more than three tenths of its pages."""
    done = lines.drop_boilerplate(common.table(spark, sf_dir, "pages"), max_ratio=0.3, min_pages=3)
    return done.withColumn("text_sha256", F.sha2("text", 256)).drop("text")


ORACLE["op8_site_lines"] = r"""
WITH l AS (SELECT row_number() OVER () AS rid, page_id,
    lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
    list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(coalesce(html, ''),
        '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', chr(10), 'g'), '<[^>]*>', chr(10), 'g'),
        '[\n\r]'), lambda x : trim(x, ' ' || chr(9) || chr(11) || chr(12))), lambda x : x <> '') AS lines FROM pages),
n AS (SELECT host, count(*) AS pages FROM l GROUP BY host),
h AS (SELECT host, line, count(*) AS k FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM l) GROUP BY 1, 2),
d AS (SELECT host, list(line) AS dropped FROM h JOIN n USING (host) WHERE k >= 3 AND k > 0.3 * pages GROUP BY host)
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped,
       sha256(array_to_string(kept, chr(10))) AS text_sha256
FROM (SELECT page_id, host, lines, CASE WHEN dropped IS NULL THEN lines
             ELSE list_filter(lines, lambda x : NOT list_contains(dropped, x)) END AS kept
      FROM l LEFT JOIN d USING (host))
"""


@query
def op10_factorization_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text by a factorization machine over hashed terms."""
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    found = toxicity.toxicity(docs, toxicity.train(docs, labels, mod=4))
    return found.select("doc_id", common.held_out("doc_id", 4).alias("held_out"), "score",
                        (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op11_burst_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    return conversations.trie(common.table(spark, sf_dir, "conversations"))


@query
def op12_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard by the byte-balanced slot map, with its gapless place in the shard."""
    found = sharding.assign(common.table(spark, sf_dir, "documents"), shards=40)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("position").alias("slot"),
                        F.lit(None).cast("int").alias("grown_shard"), F.col("slot").alias("virtual_slot"), "version")


@query
def op13_qd_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable embedding on the first four whitening directions."""
    return whitening.whiten(common.table(spark, sf_dir, "embeddings"), k=4)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
