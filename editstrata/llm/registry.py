"""The registered queries of this subpackage: thin forms of the operators, on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import chat_format, decontamination, hard_negatives, lm_scoring, minhash_dedup, pii_surrogates, quality_rules, sharding, source_mixing, template_extraction, toxicity, url_filter, whitening


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    return chat_format.digests(chat_format.formatted_turns(rows.unionByName(extra)))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality_rules.quality_verdicts(documents, labels).drop("score")


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle_words=2, percent=80)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return decontamination.contaminations(documents, benchmark)


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pii_surrogates.with_surrogates(documents, key="a secret of the corpus's owner")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), url_filter.RULES)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), 16)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mixture(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.toxicity_scores(documents, labels)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    good = labels.filter("quality = 1").select("doc_id").distinct()
    few = good.count() <= minhash_dedup.BROADCAST_IDS
    good = good.withColumn("good", F.lit(True))
    marked = documents.select("doc_id", "text").join(F.broadcast(good) if few else good, "doc_id", "left")
    return lm_scoring.cross_entropy_differences(marked, F.col("good"))


def op11_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_extraction.main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", shifted.alias("label"))
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 50 == 0)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (op1_chat_format, op2_quality_rules, op3_minhash_dedup, op4_decontamination, op5_pii_surrogates, op6_url_filter, op7_sharding, op8_source_mixing, op9_toxicity, op10_lm_scoring, op11_template_extraction, op12_hard_negatives, op13_embedding_whitening)}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": chat_format.DIGESTS_SQL, "op12_hard_negatives": hard_negatives.NEGATIVES_SQL}
