"""Queries of the training-data operators for the driver, and their SQL where SQL can say it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm._tables import crc_mod, table
from quillon.llm.bt_quality import bt_quality
from quillon.llm.chat_format import chat_format, masked_texts, read_back
from quillon.llm.decontaminate import decontaminate
from quillon.llm.fm_toxicity import fm_toxicity
from quillon.llm.language_id import language_id
from quillon.llm.line_dedup import line_dedup
from quillon.llm.mixing import mix_sources
from quillon.llm.ngram_join import ngram_join
from quillon.llm.quality_rules import quality_rules
from quillon.llm.token_count import token_count

QUALITY_LINE, TOXIC_LINE = 0.3, 0.7


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    folder = os.environ.get("TOKENIZERS_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def _labels(labels: DataFrame, column: str, mod: int, learn) -> DataFrame:
    return labels.where(learn(crc_mod("doc_id", mod))).select(F.col("doc_id").alias("id"), F.col(column).alias("label"))


def op1_bt_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _labels(table(spark, sf_dir, "labels"), "quality", 5, lambda m: m != 0)
    return bt_quality(table(spark, sf_dir, "documents"), labels, threshold=QUALITY_LINE).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    two = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    out = chat_format(turns.unionByName(two))
    turns_text = F.array_join(F.transform(read_back(F.col("formatted")), lambda p: F.concat(p["role"], F.lit("\n"), p["text"], F.lit("\n"))), "")
    loss = F.array_join(masked_texts(F.col("formatted"), F.col("loss_spans")), "")
    return out.select("conv_id", "n_turns", F.sha2(turns_text, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = line_dedup(docs.select("doc_id", "text", "source"), host=F.col("source"))
    return out.select("doc_id", "lines_dropped", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars_left"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_items") >= 2).alias("contaminated"))


def op8_fm_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _labels(table(spark, sf_dir, "labels"), "toxic", 3, lambda m: m != 1)
    return fm_toxicity(table(spark, sf_dir, "documents"), labels, threshold=TOXIC_LINE).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    training = docs.where(crc_mod("doc_id", 3) != 1).select(F.col("doc_id").alias("id"), "text", "lang")
    return language_id(docs, training).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op10_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count(table(spark, sf_dir, "documents"), tokenizer_path())


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_bt_quality": op1_bt_quality,
    "op2_chat_format": op2_chat_format,
    "op3_mix_sources": op3_mix_sources,
    "op4_ngram_join": op4_ngram_join,
    "op5_line_dedup": op5_line_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_decontaminate": op7_decontaminate,
    "op8_fm_toxicity": op8_fm_toxicity,
    "op9_language_id": op9_language_id,
    "op10_token_count": op10_token_count,
    "pipeline": pipeline,
}
