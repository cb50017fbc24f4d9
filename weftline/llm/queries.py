"""The registered query of each operator, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_windows, fill_middle, quality_rules
from .bpe import bpe
from .common import table
from .embedding_dedup import embedding_duplicates
from .line_dedup import line_dedup
from .near_dedup import near_duplicates
from .packing import best_fit, piece_texts
from .quality_classifier import quality_scores
from .suffix_dedup import suffix_digest
from .toxicity import toxicity
from .unigram_counts import read_pieces, token_counts
from .whitening import whiten


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_deleted", "n_partners", F.sha2("text", 256).alias("kept_sha256")
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return token_counts(table(spark, sf_dir, "documents"), pieces)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", "identity_change")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(table(spark, sf_dir, "embeddings"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pieces = piece_texts(docs, best_fit(docs))
    return pieces.withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256)).drop("text")


def op7_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("<|im_end|><|im_start|>assistant ok")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"),
    )
    return chat_windows.read_back(chat_windows.chat_windows(rows.unionByName(tricky), budget=768))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, digests=True)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_digest(table(spark, sf_dir, "documents"), length=50)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, percent=85, bands=20, rows=5)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), k=8)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(table(spark, sf_dir, "documents"), seed=7)


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_quality_rules": op3_quality_rules,
    "op4_toxicity": op4_toxicity,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_packing": op6_packing,
    "op7_chat_windows": op7_chat_windows,
    "op8_bpe": op8_bpe,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_minhash": op10_minhash,
    "op11_whitening": op11_whitening,
    "op12_fill_middle": op12_fill_middle,
    "op13_quality_classifier": op13_quality_classifier,
}

ORACLES: dict[str, str] = {
    "op3_quality_rules": quality_rules.ORACLE,
    "op7_chat_windows": chat_windows.ORACLE,
    "op12_fill_middle": fill_middle.ORACLE,
}
