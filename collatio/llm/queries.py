"""The registered queries of this folder: thin callers of the operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classlm, contamination, conversations, crossalign, html, licenses, packing, quality, secrets, simhash, suffix, tokencount, tokenfiles
from .common import scratch, table
from .native import matches
from .oracles import ORACLES


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


#: What op4's edits replace: mail addresses, and numbers as long as those of cards.
PERSONAL = r"(?<![A-Za-z0-9._+-])[A-Za-z0-9._+-]{1,64}@[A-Za-z0-9-]{1,63}\.[A-Za-z]{2,10}|(?<![0-9])[0-9]{13,19}(?![0-9])"


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts tokens, replaces personal data by a mark, and counts again only where texts changed."""
    tokenizer, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    state = tokencount.counted(table(spark, sf_dir, "documents"), tokenizer, pattern)
    edits = F.transform(matches(F.col("text"), PERSONAL), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit("[removed]").alias("value")))
    found = tokencount.edited(state, edits, tokenizer, pattern)
    return found.select("doc_id", "n_before", "n_edits", F.col("n_tokens").alias("n_after"), F.length("text").cast("long").alias("n_chars"), "n_reencoded")


def op5_class_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classlm.scores(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.assess(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents' ids to files, then reads each document back by its key."""
    folder = scratch(spark, "token-files")
    tokenfiles.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return tokenfiles.read(tokenfiles.keys(spark, folder), folder).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damages conversations by a fixed rule, then repairs them; all conversations, also those that lost every turn."""
    rows = table(spark, sf_dir, "conversations")
    found = conversations.repair(conversations.damaged(rows), rows.select(F.col("conv_id").alias("conv")))
    return found.select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossalign.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


__all__ = ["ORACLES", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_suffix_dedup,
        op3_html_extraction,
        op4_token_counts,
        op5_class_lm_scores,
        op6_quality_rules,
        op7_benchmark_decontamination,
        op8_secret_scans,
        op9_license_scans,
        op10_simhash_near_dedup,
        op11_token_files,
        op12_conversation_repair,
        op13_cross_tokenizer_alignment,
    )
}
