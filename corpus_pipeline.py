"""A corpus pipeline: quality rules, near duplicates, benchmark leaks, source mixing, shards.

Each stage gets what its predecessor kept, written and read again. It counts as part of editstrata.llm.

Rows of `docs` (doc_id, text, lang, source, n_chars and any others) come out as they went in, with all their columns, whatever
these are called; only the last stage gives columns of its own. Null and empty texts fail the quality rules; where a table is handed to
a later stage they are kept by it: they are near no other, hold no item, and have no tokens to weigh. Rows without an id are judged like
others. Of rows that repeat an id and text the near-duplicate stage leaves one; ties go to the least id. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from editstrata.llm import decontamination, minhash_dedup, quality_rules, sharding, source_mixing
from editstrata.llm._store import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: null and empty texts among them. Repeated rows are judged alike."""
    return quality_rules.passing(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8) stays, that of the least id, null ids last; null and empty texts stay."""
    return minhash_dedup.deduplicated(docs, shingle_words=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents, in the target weights of source, language and topic; nulls are values of their own, rows of one id stay or go together."""
    return source_mixing.sampled(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's shard of 16, of nearly equal bytes, and its place in it."""
    return sharding.shards(docs, 16)


STAGES = [("quality_rules", quality), ("minhash_dedup", near_duplicates), ("decontamination", decontaminate), ("source_mixing", mix), ("sharding", shard)]

#: The boosted trees and the fitted proportions cannot be said in SQL; the stages' operators are compared with plain code, each in its own test.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
