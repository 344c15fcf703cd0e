"""Aggregates over scores: summaries, matrices, stability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scoring import other_key, same_reference

#: Name of each figure of a summary and what it is the mean of.
FIGURES = {
    "exact_text_rate": "cast(exact_text as double)",
    "exact_words_rate": "cast(exact_words as double)",
    "mean_word_accuracy": "word_accuracy",
    "mean_word_error_rate": "word_error_rate",
    "mean_character_error_rate": "character_error_rate",
    "refusal_rate": "cast(refusal as double)",
    "provider_error_rate": "cast(classification = 'provider_error' as double)",
    "extraneous_text_rate": "cast(extraneous_text as double)",
    "translation_confusion_rate": "cast(classification = 'translation_confusion' as double)",
}


def summary_columns() -> list[Column]:
    """Count and figures; without rows, zeros."""
    return [F.count(F.lit(1)).alias("responses"), *(F.coalesce(F.avg(F.expr(e)), F.lit(0.0)).alias(n) for n, e in FIGURES.items())]


def model_key() -> Column:
    return F.concat_ws(" / ", "provider", "model", F.coalesce("resolved_model", F.lit("unresolved")))


def summary(scores: DataFrame, *keys: Column | str) -> DataFrame:
    return scores.groupBy(*keys).agg(*summary_columns())


def summaries(scores: DataFrame) -> DataFrame:
    """Overall, by model, by edition and by stratum, from one pass: `view`, `name` and the figures."""
    rows = scores.withColumn("model_key", model_key())
    grouped = rows.groupingSets([[], ["model_key"], ["requested_translation"], ["stratum"]], "model_key", "requested_translation", "stratum")
    view = F.expr("case grouping_id() when 7 then 'overall' when 3 then 'model' when 5 then 'edition' else 'stratum' end").alias("view")
    out = grouped.agg(view, *summary_columns())
    return out.select("view", F.coalesce("model_key", "requested_translation", "stratum", F.lit("all")).alias("name"), "responses", *FIGURES)


def class_histogram(scores: DataFrame, *keys: Column | str) -> DataFrame:
    return scores.groupBy(*keys, "classification").agg(F.count(F.lit(1)).alias("responses"))


def class_map(scores: DataFrame, *keys: Column | str) -> DataFrame:
    names = [k if isinstance(k, str) else k._jc.toString() for k in keys]
    counted = class_histogram(scores, *keys)
    return counted.groupBy(*names).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("classification", "responses")))).alias("classifications"))


def resemblance() -> Column:
    """Where a response goes in the confusion matrix."""
    kind = F.col("classification")
    return (
        F.when(kind.isin("provider_error", "truncated", "empty", "refusal"), F.concat(F.lit("_"), kind))
        .when(kind == "exact_requested", F.col("requested_translation"))
        .when(F.size("exact_other_translations") > 1, "_ambiguous_exact")
        .when(F.col("exact_other_translation").isNotNull(), F.col("exact_other_translation"))
        .when(F.size("closest_translations") > 1, "_ambiguous_closest")
        .otherwise(F.coalesce("closest_translation", F.lit("_unclassified")))
    )


def confusion_matrix(scores: DataFrame) -> DataFrame:
    return scores.groupBy("requested_translation", resemblance().alias("resembles")).agg(F.count(F.lit(1)).alias("responses"))


def exact_alternatives(scores: DataFrame) -> DataFrame:
    """Of confused responses, how often which other edition was matched; old rows name one edition only."""
    listed = F.when(F.size("exact_other_translations") > 0, F.col("exact_other_translations")).otherwise(F.filter(F.array("exact_other_translation"), lambda x: x.isNotNull()))
    rows = scores.filter("classification = 'translation_confusion'").select("requested_translation", F.explode(listed).alias("matched"))
    return rows.groupBy("requested_translation", "matched").agg(F.count(F.lit(1)).alias("responses"))


def first_runs(scores: DataFrame, order: str | None = None) -> DataFrame:
    """The first row of each model, case and run: by `order`, else by place in the file (`line`), where scores have it, else by output."""
    once = Window.partitionBy("model_key", "case_id", "run_id").orderBy(order or ("line" if "line" in scores.columns else "output"))
    return scores.withColumn("__n", F.row_number().over(once)).filter("__n = 1").drop("__n")


def stability(scores: DataFrame, order: str | None = None) -> DataFrame:
    """By model, over cases with two or more completed runs: share of the most common output, share exact."""
    rows = scores.filter("classification not in ('provider_error', 'truncated')").withColumn("model_key", model_key())
    by_output = first_runs(rows, order).groupBy("model_key", "case_id", "response_sha256").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("exact_text").cast("int")).alias("exact"))
    by_case = by_output.groupBy("model_key", "case_id").agg(F.sum("n").alias("runs"), F.max("n").alias("most"), F.sum("exact").alias("exact")).filter("runs > 1")
    return by_case.groupBy("model_key").agg(F.count(F.lit(1)).alias("repeated_cases"), F.avg(F.expr("most / runs")).alias("mean_output_consistency"), F.avg(F.expr("exact / runs")).alias("mean_exact_recall"))


def conditional_recall(scores: DataFrame) -> DataFrame:
    """Exact share by model among responses that are no provider error; null without any."""
    return scores.groupBy(model_key().alias("model_key")).agg(F.avg(F.when(F.col("classification") != "provider_error", F.col("exact_text").cast("double"))).alias("recall"))


def differing(scores: DataFrame, references: DataFrame) -> DataFrame:
    """Scores whose reference has more than one distinct raw text over all editions."""
    many = references.groupBy("book", "chapter", "verse_start", "verse_end").agg(F.countDistinct("text").alias("texts")).filter("texts > 1")
    return scores.join(other_key(many), same_reference(), "left_semi")


def edition_by_stratum(scores: DataFrame) -> DataFrame:
    return summary(scores, "requested_translation", "stratum")


def execution_summary(responses: DataFrame, *keys: str) -> DataFrame:
    """Token and cost sums of responses with metadata; tokens count only where both counters are known; sums stop at the largest 64-bit value."""
    limit = F.lit(str(2**64 - 1)).cast("decimal(38,0)")
    known = F.col("execution.input_tokens").isNotNull() & F.col("execution.output_tokens").isNotNull()
    total = lambda c, cond: F.least(F.coalesce(F.sum(F.when(cond, F.col(c).cast("decimal(38,0)"))), F.lit(0).cast("decimal(38,0)")), limit).cast("decimal(20,0)")
    charged = F.col("execution.accounted_nanoeur")
    return responses.filter("execution is not null").groupBy(*keys).agg(
        F.count_if(known).alias("known_usage_responses"), total("execution.input_tokens", known).alias("input_tokens"), total("execution.output_tokens", known).alias("output_tokens"),
        F.count_if(charged.isNotNull()).alias("accounted_responses"), total("execution.accounted_nanoeur", charged.isNotNull()).alias("accounted_nanoeur"),
        F.count_if(F.coalesce("execution.reservation_retained", F.lit(False))).alias("uncertain_billing_responses"),
    )


def markdown(scores: DataFrame) -> str:
    """The report as Markdown. Groups and classes are few, so their rows come to the driver."""
    lines = ["# Report", ""]
    for view, rows in _by_view(summaries(scores).orderBy("view", "name").collect()).items():
        lines += [f"## By {view}" if view != "overall" else "## Overall", "", "| Group | Responses | Exact text | Exact words | Word accuracy |", "| --- | ---: | ---: | ---: | ---: |"]
        lines += [f"| {r['name'].replace('|', chr(92) + '|')} | {r['responses']} | {100 * r['exact_text_rate']:.2f}% | {100 * r['exact_words_rate']:.2f}% | {100 * r['mean_word_accuracy']:.2f}% |" for r in rows]
        lines.append("")
    lines += ["## Classes", "", "| Model | Class | Responses |", "| --- | --- | ---: |"]
    classes = class_histogram(scores.withColumn("model_key", model_key()), "model_key").orderBy("model_key", "classification")
    lines += [f"| {r[0].replace('|', chr(92) + '|')} | {r[1]} | {r[2]} |" for r in classes.collect()] + [""]
    for title, frame, names in (("Requested and resembled", confusion_matrix(scores), ("requested_translation", "resembles")), ("Exact alternatives", exact_alternatives(scores), ("requested_translation", "matched"))):
        lines += [f"## {title}", "", "| Requested | Other | Responses |", "| --- | --- | ---: |"]
        lines += [f"| {r[0]} | {r[1]} | {r[2]} |" for r in frame.orderBy(*names).collect()] + [""]
    lines += ["## Stability", "", "| Model | Cases | Consistency | Exact |", "| --- | ---: | ---: | ---: |"]
    lines += [f"| {r[0].replace('|', chr(92) + '|')} | {r[1]} | {100 * r[2]:.2f}% | {100 * r[3]:.2f}% |" for r in stability(scores).orderBy("model_key").collect()]
    return "\n".join(lines) + "\n"


def _by_view(rows: list) -> dict[str, list]:
    out: dict[str, list] = {}
    for r in rows:
        out.setdefault(r["view"], []).append(r)
    return dict(sorted(out.items(), key=lambda x: x[0] != "overall"))
