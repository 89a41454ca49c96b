"""The numbered queries over the given tables, with production parameters, and their SQL where SQL can say them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from timeweave.llm import collisions, decontaminate, line_dedup, merkle, packing, patterns, quality, repair, set_join, substrings, token_output, toxicity, warc
from timeweave.llm.common import load


def word_vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(load(spark, sf_dir, "documents"), word_vocabulary(), end_id=2)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), size=10)


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_derivatives(load(spark, sf_dir, "pages"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    made = quality.featurise(docs)
    return quality.score(docs, quality.fit(docs, load(spark, sf_dir, "labels"), made=made), threshold=0.7, made=made)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.near_texts(load(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, load(spark, sf_dir, "labels")), threshold=0.5)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.strip_boilerplate(docs, ratio=0.01, min_pages=3)


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions.near_vectors(load(spark, sf_dir, "embeddings"), threshold=0.98)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(load(spark, sf_dir, "documents"), length=200).drop("kept")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), word_vocabulary(), end_id=1)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(load(spark, sf_dir, "conversations"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(load(spark, sf_dir, "documents"))


def op13_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.pack(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, size=1024)


QUERIES = {
    "op1_token_output": op1_token_output,
    "op2_decontaminate": op2_decontaminate,
    "op3_warc_derivatives": op3_warc_derivatives,
    "op4_quality": op4_quality,
    "op5_ngram_join": op5_ngram_join,
    "op6_toxicity": op6_toxicity,
    "op7_line_dedup": op7_line_dedup,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_packing": op10_packing,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_pattern_packing": op13_pattern_packing,
}

ORACLE_SQL = {
    "op2_decontaminate": decontaminate.ORACLE_SQL,
    "op3_warc_derivatives": warc.ORACLE_SQL,
    "op7_line_dedup": line_dedup.ORACLE_SQL,
    "op11_conversation_repair": repair.ORACLE_SQL,
    "op12_merkle_manifest": merkle.ORACLE_SQL,
}
