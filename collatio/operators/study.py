"""Validated analysis: intervals by model, paired differences, examples of failures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.align import word_diff
from ..schemas import CLASSES, camel
from .report import model_key, resemblance
from .statistics import bootstrap, cluster_means


def intervals(scores: DataFrame, resamples: int) -> DataFrame:
    """Bootstrap intervals of exact text and exact words, by model."""
    own = scores.withColumn("model_key", model_key())
    parts = [bootstrap(cluster_means(own, flag, "model_key"), resamples, "model_key").withColumn("metric", F.lit(flag)) for flag in ("exact_text", "exact_words")]
    return reduce(DataFrame.unionByName, parts)


def model_pairs(models: DataFrame) -> DataFrame:
    """Pairs of `model_key` in order of name, with a reason why they cannot be compared, if any.

    `models` has `temperature`, `reasoning_effort`, `max_output_tokens`. There is a row for each model, so the pairs are few.
    """
    left, right = (models.select(*(F.col(c).alias(f"{side}_{c}") for c in ("model_key", "temperature", "reasoning_effort", "max_output_tokens"))) for side in "lr")
    pairs = left.join(right, F.col("l_model_key") < F.col("r_model_key"))
    same = F.col("l_reasoning_effort").eqNullSafe(F.col("r_reasoning_effort")) & (F.col("l_temperature") == F.col("r_temperature")) & F.col("l_max_output_tokens").eqNullSafe(F.col("r_max_output_tokens"))
    reason = F.when(F.col("l_temperature").isNull() | F.col("r_temperature").isNull(), "effective sampling settings are unknown").when(~same, "different requested generation settings")
    return pairs.select(F.col("l_model_key").alias("left"), F.col("r_model_key").alias("right"), reason.alias("reason"))


def paired_intervals(scores: DataFrame, pairs: DataFrame, resamples: int, keyed: bool = False) -> DataFrame:
    """Bootstrap interval of the difference in exact text for each comparable pair (`left`, `right`); with `keyed`, models are by the column `model_key`."""
    means = cluster_means(scores if keyed else scores.withColumn("model_key", model_key()), "exact_text", "model_key")
    left = means.select(F.col("model_key").alias("left"), "stratum", "ref_label", F.col("value").alias("l"))
    right = means.select(F.col("model_key").alias("right"), "stratum", "ref_label", F.col("value").alias("r"))
    usable = pairs.filter("reason is null").select("left", "right")
    both = usable.join(left, "left").join(right, ["right", "stratum", "ref_label"])
    return bootstrap(both.select("left", "right", "stratum", "ref_label", (F.col("l") - F.col("r")).alias("value")), resamples, "left", "right")


def example_kind() -> Column:
    names = F.create_map(*(F.lit(x) for c in CLASSES for x in (c, camel(c))))
    overlap = (F.col("classification") == "partial") & (F.coalesce("alternative_edition_token_overlap", F.lit(0.0)) > 0)
    return F.when(F.col("exact_words"), "formatting_only").when(overlap, "partial_with_alternative_overlap").otherwise(F.element_at(names, F.col("classification")))


def failure_examples(scores: DataFrame, references: DataFrame, most: int = 7, keyed: bool = False) -> DataFrame:
    """For each model (by the column `model_key` with `keyed`) the first failure of each kind, `most` of them, by case and run, with an annotated difference."""
    rows = scores.filter("not exact_text").withColumns({"model_key": F.col("model_key") if keyed else model_key(), "diagnostic": example_kind(), "resembles": resemblance()})
    first = Window.partitionBy("model_key", "diagnostic").orderBy("case_id", "run_id")
    some = Window.partitionBy("model_key").orderBy("case_id", "run_id")
    rows = rows.withColumn("n", F.row_number().over(first)).filter("n = 1").withColumn("n", F.row_number().over(some)).filter(F.col("n") <= most)
    texts = references.select(F.col("translation").alias("requested_translation"), "book", "chapter", "verse_start", F.col("verse_end").alias("__end"), F.col("text").alias("expected"))
    joined = rows.join(texts, ["requested_translation", "book", "chapter", "verse_start"]).filter(F.col("verse_end").eqNullSafe(F.col("__end")))
    return joined.select("model_key", "run_id", "case_id", "ref_label", "requested_translation", "classification", "diagnostic", "resembles", "expected", "output", word_diff("expected", "output").alias("word_diff"), F.array_join("exact_other_translations", ",").alias("exact_other_translations"), F.array_join("closest_translations", ",").alias("closest_translations"), "alternative_edition_token_overlap")
