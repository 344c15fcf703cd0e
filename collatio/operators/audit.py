"""Audit of published trials: what a bundle says is computed again and compared."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digests import sha256
from ..functions.text import normalize_technical, words
from .scoring import KEY

#: How public cases are named, the evidence such bundles may have, and how far figures may be off.
PREFIX, EVIDENCE, TOLERANCE = "BQ-DEV-", "interactive_mcp", 1e-12
_EDITS = ("insertions", "deletions", "substitutions")


def _off(found: Column, saved: Column) -> Column:
    """Further apart than allowed; a missing figure is off. As in the usual test, a billionth of the larger one is allowed too."""
    return ~F.coalesce(F.abs(found - saved) <= F.greatest(F.lit(TOLERANCE), 1e-9 * F.greatest(F.abs(found), F.abs(saved))), F.lit(False))


def bundle_faults(trials: DataFrame, cases: DataFrame, responses: DataFrame, scores: DataFrame, references: DataFrame, editions: DataFrame) -> DataFrame:
    """Every fault of published trials: `trial`, `rule`, `subject` (a case or null).

    `trials` has `trial`, `evidence`, `expected_case_ids`, and of its report `responses`, `mean_word_accuracy` and
    `exact_text_rate`; `cases`, `responses` and `scores` have `trial`, `place` (from 0) and `case_id` besides
    their own columns. Each file's rows are grouped once by trial; figures are computed again from the texts.
    """
    ids = F.col("expected_case_ids")
    own = trials.select("trial", "evidence", "expected_case_ids", "responses", "mean_word_accuracy", "exact_text_rate")
    listed = lambda df, name: df.groupBy("trial").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "case_id"))), lambda x: x["case_id"]).alias(name))
    for df, name in ((cases, "__cases"), (responses, "__responses"), (scores, "__scores")):
        own = own.join(listed(df, name), "trial", "left")
    figures = scores.groupBy("trial").agg(F.count(F.lit(1)).alias("__n"), F.avg("word_accuracy").alias("__mean"), F.avg(F.col("exact_text").cast("double")).alias("__exact"))
    own = own.join(figures, "trial", "left")
    changed = reduce(Column.__or__, (~F.col(n).eqNullSafe(ids) for n in ("__cases", "__responses", "__scores")))
    whole = {
        "case_ids": (F.size(ids) < 1) | (F.size(F.array_distinct(ids)) != F.size(ids)) | F.exists(ids, lambda x: ~x.startswith(PREFIX)),
        "evidence": ~F.col("evidence").eqNullSafe(F.lit(EVIDENCE)),
        "order": changed,
        "responses": ~F.col("responses").eqNullSafe(F.coalesce("__n", F.lit(0))),
        "mean_word_accuracy": _off(F.col("__mean"), F.col("mean_word_accuracy")),
        "exact_text_rate": _off(F.col("__exact"), F.col("exact_text_rate")),
    }
    texts = references.select(F.col("translation").alias("__edition"), *(F.col(k).alias(f"__{k}") for k in KEY), F.col("text").alias("__text"))
    said = scores.select("trial", "place", *(F.col(k).alias(f"s_{k}") for k in KEY), *_EDITS, "word_error_rate", "word_accuracy", "response_sha256")
    given = responses.select("trial", "place", "output")
    rows = cases.select("trial", "place", "case_id", "translation", "prompt_variant", *KEY).join(said, ["trial", "place"]).join(given, ["trial", "place"])
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in KEY))
    rows = rows.join(texts, same & (F.col("translation") == F.col("__edition")), "left")
    length, edits = F.size(words(normalize_technical(F.col("__text")))), reduce(Column.__add__, (F.col(c) for c in _EDITS))
    each = {
        "identity": ~F.col("prompt_variant").eqNullSafe(F.lit("canonical")) | ~reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"s_{k}")) for k in KEY)),
        "commitment": ~sha256(F.encode("output", "UTF-8")).eqNullSafe(F.col("response_sha256")),
        "word_error_rate": _off(F.try_divide(edits, length), F.col("word_error_rate")),
        "word_accuracy": _off(F.greatest(F.lit(0.0), 1 - F.col("word_error_rate")), F.col("word_accuracy")),
    }
    closed = editions.filter(~F.col("redistribute_reference_text") | (F.col("license_kind") != "public_domain")).select(F.col("id").alias("translation"))
    private = cases.join(closed, "translation").select("trial", F.lit("license").alias("rule"), F.col("case_id").alias("subject"))
    return _broken(own, whole, F.lit(None).cast("string")).unionByName(_broken(rows, each, F.col("case_id"))).unionByName(private)


def _broken(rows: DataFrame, rules: dict[str, Column], subject: Column) -> DataFrame:
    found = F.filter(F.array(*(F.when(F.coalesce(when, F.lit(True)), name) for name, when in rules.items())), lambda x: x.isNotNull())
    return rows.select("trial", F.explode(found).alias("rule"), subject.alias("subject"))
