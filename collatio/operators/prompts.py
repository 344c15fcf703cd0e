"""Prompts of the benchmark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ref_label
from .scoring import KEY, other_key, same_reference


def prompt(variant: Column, label: Column, source: Column, supplied: Column) -> Column:
    """The prompt of a variant; a copy control without its text is an error. The four templates."""
    only = F.lit("\nOutput only the passage text.")
    cat = F.concat
    copied = cat(F.lit("Copy the supplied text for "), label, F.lit(" from the "), source, F.lit(" exactly."), only, F.lit("\n\n<supplied_text>\n"), supplied, F.lit("\n</supplied_text>"))
    return (
        F.when(variant == "canonical", cat(F.lit("Quote "), label, F.lit(" from the "), source, F.lit(".\nGive the passage exactly as it appears in that translation."), only))
        .when(variant == "concise", cat(F.lit("Quote "), label, F.lit(" in the "), source, F.lit(". Output only the passage text.")))
        .when(variant == "word_for_word", cat(F.lit("Reproduce "), label, F.lit(" word-for-word according to the "), source, F.lit("."), only))
        .when(variant == "copy_control", F.when(supplied.isNull(), F.raise_error(F.lit("copy control requires supplied text")).cast("string")).otherwise(copied))
    )


def prompts(cases: DataFrame, editions: DataFrame, references: DataFrame) -> DataFrame:
    """Each case with its `prompt`."""
    named = cases.join(editions.select(F.col("id").alias("translation"), F.concat("name", F.lit(" ("), "edition", F.lit(")")).alias("source")), "translation")
    texts = references.select(F.col("translation").alias("__edition"), *KEY, "text")
    joined = named.join(other_key(texts), same_reference() & (F.col("translation") == F.col("__edition")), "left")
    label = ref_label(*(F.col(k) for k in KEY))
    return joined.select(*named.columns, "text", label.alias("ref_label"), prompt(F.col("prompt_variant"), label, F.col("source"), F.col("text")).alias("prompt"))
