"""Corpus pipeline: five stages over ``documents``, each written as Parquet and reread as the next one's docs.

quality rules -> near-duplicates -> benchmark decontamination -> mixing sources -> token shards.  All but the last
return the columns of ``documents``; the last returns what its written shards hold per document: (doc_id, start,
n_tokens, ids_crc32), where documents that mixing drew more than once follow each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vecspark.llm import common, decontam, mixing, neardup, quality, queries, repair
from vecspark.session import bound_batches


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that the rules' posterior rejects go."""
    common.prepare(spark)
    bound_batches(spark)
    return quality.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: one document of each near-duplicate class stays."""
    common.prepare(spark)
    return neardup.keep_one(docs, threshold=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that hold ten consecutive words of a benchmark item go."""
    common.prepare(spark)
    return decontam.remove_contaminated(docs, common.table(spark, sf_dir, "benchmark"), width=10)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: every document as often as the mix draws it."""
    common.prepare(spark)
    return mixing.mixed(docs, **queries.MIX)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: token ids in Re-Pair shards, in ascending doc_id order."""
    common.prepare(spark)
    return repair.read_documents(repair.write_shards(docs, queries.tokenizer_path(), end_id=2))


STAGES = [("quality rules", keep_quality), ("near duplicates", drop_near_duplicates),
          ("decontamination", drop_contaminated), ("source mix", mix_sources), ("token shards", write_tokens)]

#: EM, ICWS and the tokenizer have no SQL form; tests/llm/test_pipeline.py holds every stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    common.prepare(spark)
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
