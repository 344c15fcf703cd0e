"""Scores responses against reference texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.align import align
from ..functions.text import contains_contiguous, looks_like_refusal, normalize_technical, rate, ref_label, words

KEY = ("book", "chapter", "verse_start", "verse_end")


def other_key(df: DataFrame) -> DataFrame:
    """`df` with its reference under names of their own, for a join with another reference."""
    return df.withColumnsRenamed({k: f"__{k}" for k in KEY})


def same_reference() -> Column:
    """Equality with the reference of `other_key`; an absent end verse equals an absent one only."""
    out = F.col("verse_end").eqNullSafe(F.col("__verse_end"))
    for name in KEY[:3]:
        out = (F.col(name) == F.col(f"__{name}")) & out
    return out


def prepared(references: DataFrame) -> DataFrame:
    """References with their normalised text, its words, and the other editions of the same reference (`others`).

    Texts are normalised and split once here, not once a response.
    """
    own = references.select("translation", *KEY, "text", normalize_technical(F.col("text")).alias("norm")).withColumn("expected", words(F.col("norm")))
    group = own.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("translation", "norm", "expected"))).alias("every"))
    joined = own.join(other_key(group), same_reference())
    return joined.select("translation", *KEY, "text", "norm", "expected", F.filter("every", lambda x: x["translation"] != F.col("translation")).alias("others"))


def unknown_cases(responses: DataFrame, cases: DataFrame) -> DataFrame:
    return responses.join(cases, "case_id", "left_anti")


def duplicate_responses(responses: DataFrame) -> DataFrame:
    return responses.groupBy("case_id", "run_id", "provider", "model").count().filter("count > 1")


def score(responses: DataFrame, cases: DataFrame, references: DataFrame) -> DataFrame:
    """One row per response of a known case whose edition has a text; flags, edit counts, rates, class.

    `responses` may lack `error`, `truncated`, `typed_refusal`, `resolved_model`; they count as absent. A column
    `line`, a response's place in its file, is carried. Responses of unknown cases have no row here: `runs.score_all`
    rejects them, and responses given twice, before it scores.
    """
    for name, kind in (("error", "string"), ("truncated", "boolean"), ("typed_refusal", "boolean"), ("resolved_model", "string")):
        if name not in responses.columns:
            responses = responses.withColumn(name, F.lit(None).cast(kind))
    texts = prepared(references)
    own = cases.select("case_id", F.col("translation").alias("requested_translation"), *KEY, "stratum")
    joined = own.join(other_key(texts).withColumnRenamed("translation", "__edition"), same_reference() & (F.col("requested_translation") == F.col("__edition")))
    joined = joined.select("case_id", "requested_translation", *KEY, "stratum", "norm", "expected", "others")
    rows = responses.join(joined, "case_id").withColumn("out", normalize_technical(F.col("output"))).withColumn("got", words(F.col("out")))
    off = lambda c: F.coalesce(F.col(c), F.lit(False))
    allowed = ~off("truncated") & ~off("typed_refusal") & F.col("error").isNull()
    differs = F.col("got") != F.col("expected")
    aligned = align(F.when(differs, F.col("expected")), F.when(differs, F.col("got")), F.when(differs, F.transform("others", lambda o: o["expected"])))
    rows = rows.withColumn("a", aligned)
    zero = F.lit(0).cast("long")
    rows = rows.withColumns({n: F.coalesce(F.col(f"a.{n}"), zero) for n in ("insertions", "deletions", "substitutions")})
    errors = F.col("insertions") + F.col("deletions") + F.col("substitutions")
    rows = rows.withColumns(
        {
            "exact_text": allowed & (F.col("out") == F.col("norm")),
            "exact_words": allowed & ~differs,
            "refusal": off("typed_refusal") | looks_like_refusal(F.col("out")),
            "word_error_rate": rate(errors, F.size("expected")),
            "character_error_rate": rate(F.levenshtein("norm", "out"), F.length("norm")),
            "exact_other_translations": F.array_sort(F.array_distinct(F.transform(F.filter("others", lambda o: o["norm"] == F.col("out")), lambda o: o["translation"]))),
            "alternative_edition_token_overlap": F.when((F.col("a.unmatched") > 0) & (F.size("others") > 0), F.col("a.explained") / F.col("a.unmatched")),
            "word_errors": errors,
        }
    )
    nearest = F.array_min("a.distances")
    tied = F.transform(F.filter(F.arrays_zip(F.col("a.distances").alias("d"), F.col("others").alias("o")), lambda x: x["d"] == nearest), lambda x: x["o"]["translation"])
    silent = (F.size("got") == 0) | F.col("refusal") | F.col("error").isNotNull() | off("truncated")
    none = F.array().cast("array<string>")
    rows = rows.withColumns(
        {
            "word_accuracy": F.greatest(F.lit(0.0), 1 - F.col("word_error_rate")),
            "extraneous_text": ~F.col("exact_text") & (((F.col("norm") != "") & F.col("out").contains(F.col("norm"))) | contains_contiguous(F.col("got"), F.col("expected"))),
            "closest_translations": F.when(~silent & F.coalesce(nearest < F.col("word_errors"), F.lit(False)), F.array_sort(F.array_distinct(tied))).otherwise(none),
        }
    )
    kind = (
        F.when(F.col("error").isNotNull(), "provider_error")
        .when(off("truncated"), "truncated")
        .when(F.col("refusal"), "refusal")
        .when(F.col("out") == "", "empty")
        .when(F.col("exact_text"), "exact_requested")
        .when(F.size("exact_other_translations") > 0, "translation_confusion")
        .when(F.col("extraneous_text"), "extraneous_text")
        .otherwise("partial")
    )
    first = lambda c: F.get(F.col(c), F.lit(0))
    return rows.select(
        "case_id", "run_id", "provider", "model", "resolved_model", F.sha2("output", 256).alias("response_sha256"), "requested_translation", *KEY,
        ref_label(*(F.col(k) for k in KEY)).alias("ref_label"), "stratum", "exact_text", "exact_words", "word_error_rate", "character_error_rate", "word_accuracy",
        "insertions", "deletions", "substitutions", "refusal", "extraneous_text", kind.alias("classification"),
        first("exact_other_translations").alias("exact_other_translation"), "exact_other_translations", first("closest_translations").alias("closest_translation"), "closest_translations",
        "alternative_edition_token_overlap", "output", *(["line"] if "line" in responses.columns else []),
    )
