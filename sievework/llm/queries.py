"""The registered queries of the operators in this package, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import decontaminate, infill, language, licenses, mixing, negatives, neighbours, oracles, sharding, simhash, substrings, suffixes, tokens, toxicity
from sievework.llm.common import read


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return language.identify(docs, language.learn(docs))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(read(spark, sf_dir, "documents"), merges=True)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(read(spark, sf_dir, "documents"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(read(spark, sf_dir, "embeddings"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, read(spark, sf_dir, "labels")))


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.suffix_dedup(read(spark, sf_dir, "documents")).drop("kept")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_dedup(read(spark, sf_dir, "documents")).drop("text")


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = infill.fill_in_middle(read(spark, sf_dir, "documents"))
    back = infill.restored(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_documents(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine_hard_negatives(read(spark, sf_dir, "embeddings").withColumn("label", moved))


QUERIES = {
    "op1_language": op1_language,
    "op2_decontamination": op2_decontamination,
    "op3_tokens": op3_tokens,
    "op4_simhash": op4_simhash,
    "op5_neighbours": op5_neighbours,
    "op6_mixing": op6_mixing,
    "op7_toxicity": op7_toxicity,
    "op8_suffixes": op8_suffixes,
    "op9_licenses": op9_licenses,
    "op10_substrings": op10_substrings,
    "op11_infill": op11_infill,
    "op12_sharding": op12_sharding,
    "op13_negatives": op13_negatives,
}

#: The others hash, learn, draw or search; SQL has no equal of them, so their tests compare with brute force instead.
ORACLES: dict[str, str] = {"op8_suffixes": oracles.OP8, "op10_substrings": oracles.OP10, "op11_infill": oracles.OP11, "op13_negatives": oracles.OP13}
