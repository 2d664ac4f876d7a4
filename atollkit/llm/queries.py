"""Registered queries of the thirteen operators, and their SQL where DuckDB can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atollkit.llm import bpe, hard_negatives, jaccard_join, merkle, oracles, packing, quality, rules, sentence_pieces, substring_dedup, suffix_dedup, token_files, topk, warc

JSON = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(read(spark, sf_dir, "documents"), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op2_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(read(spark, sf_dir, "pages"), least=0)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.score(docs, quality.train(docs, read(spark, sf_dir, "labels")))
    doc_id = F.col("doc.doc_id")
    return out.select(doc_id.alias("doc_id"), quality.held_out(doc_id).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), JSON, end_id=0, size=2048)


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe(read(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN, ids=False, decoded=False)


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.suffix_dedup(read(spark, sf_dir, "documents"), length=50)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_cover_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10, scale=1024)


def op8_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(read(spark, sf_dir, "documents"), JSON, end_id=2, ids=False, literal=False)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.quality_rules(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("doc.doc_id").alias("doc_id"), *(F.col(f"m.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "base_failed", "kept")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read(spark, sf_dir, "documents"), n=5, percent=80)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read(spark, sf_dir, "documents"), tampered=merkle.crc32_of_id(F.col("doc_id")) % 7 == 0, proofs=False)


def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.sentence_pieces(read(spark, sf_dir, "documents"), PIECES, ids=False, decoded=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_substring_dedup, op2_warc_salvage, op3_quality_classifier, op4_best_fit_packing, op5_bpe_round_trip, op6_suffix_array_dedup, op7_cover_tree_top_k, op8_repair_token_files, op9_quality_rules, op10_jaccard_join, op11_hard_negatives, op12_merkle_manifest, op13_sentence_pieces)
}
#: The others need a tokenizer or a model; tests hold them against brute force, round trips or held-out rows.
ORACLES: dict[str, str] = {
    "op1_substring_dedup": oracles.substring_dedup(35),
    "op2_warc_salvage": oracles.warc(),
    "op6_suffix_array_dedup": oracles.suffix_dedup(50),
    "op7_cover_tree_top_k": oracles.top_k(10, 1024, 100),
    "op9_quality_rules": oracles.quality_rules(),
    "op10_jaccard_join": oracles.jaccard(5, 80),
    "op11_hard_negatives": oracles.hard_negatives(),
    "op12_merkle_manifest": oracles.merkle(),
}
