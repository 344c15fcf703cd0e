"""Runs and their manifests: what binds responses to a dataset, and the validated analysis over runs.

A manifest is a row a run. Runs are few beside their responses: what comes to the driver here is a row a
run, a model or a pair of models.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digests import json_text, ordered_digest, record_json, sha256
from . import report, study, validation
from .prompts import prompts
from .scoring import KEY, score
from .statistics import bootstrap, cluster_means

#: The manifest's version and the kinds of evidence.
SCHEMA_VERSION = 2
EVIDENCE = ("live_provider", "synthetic_fixture")
ENGINE_VERSION = "1"
#: The fields of records in the order in which they are written.
REFERENCE_FIELDS = ("book", "chapter", "verse_start", "verse_end")
SETTINGS = ("temperature", "reasoning_effort", "max_output_tokens")
DIGESTS = ("cases_sha256", "references_sha256", "catalog_sha256", "prompts_sha256")


def reference_struct() -> Column:
    return F.struct(*REFERENCE_FIELDS)


def settled(rows: DataFrame) -> DataFrame:
    """`rows` fetched once and handed back as they are: for a row a run or a dataset, whose plans would stand several times in others."""
    return rows.sparkSession.createDataFrame(rows.collect(), rows.schema)


def dataset_digests(cases: DataFrame, references: DataFrame, editions: DataFrame, case_order: str = "ord", reference_order: tuple[str, ...] = ("translation", *KEY), edition_order: str = "id") -> DataFrame:
    """One row: the digests of cases, references, catalog and prompts, each as JSON in its order.

    The four are one sorted stream by kind. It runs here, once, as its row stands in many plans.
    """
    case = record_json(case_id=F.col("case_id"), translation=F.col("translation"), reference=reference_struct(), stratum=F.col("stratum"), prompt_variant=F.col("prompt_variant"))
    reference = record_json(translation=F.col("translation"), reference=reference_struct(), text=F.col("text"))
    edition = record_json(**{n: F.col(n) for n in ("id", "name", "abbreviation", "edition", "license_kind", "license_url", "source_url", "redistribute_reference_text")})
    asked = prompts(cases.drop("text", "ref_label"), editions, references)
    parts = ((cases, case, (case_order,)), (references, reference, reference_order), (editions, edition, (edition_order,)), (asked, json_text(F.col("prompt")), (case_order,)))
    rows = [_placed(df, order).select(F.lit(n).alias("kind"), "__text", "__number", value.alias("value")) for n, (df, value, order) in zip(DIGESTS, parts, strict=True)]
    around = {"catalog_sha256": ('{"schema_version":1,"translations":', "}")}
    found = ordered_digest(reduce(DataFrame.unionByName, rows), F.col("value"), F.struct("__text", "__number"), "kind", around=around)
    by_kind = {r["kind"]: r["digest"] for r in found.collect()}  # a row a kind
    nothing = {n: hashlib.sha256("[]".join(around.get(n, ("", ""))).encode()).hexdigest() for n in DIGESTS}
    return cases.sparkSession.createDataFrame([tuple(by_kind.get(n, nothing[n]) for n in DIGESTS)], ", ".join(f"{n} string" for n in DIGESTS))


def _placed(rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """`rows` with their order as two lists, of texts and of numbers behind them, so that unlike tables sort in one stream."""
    kinds = dict(rows.dtypes)
    texts, numbers = ([F.col(c) for c in order if (kinds[c] == "string") == text] for text in (True, False))
    if [kinds[c] == "string" for c in order] != sorted((kinds[c] == "string" for c in order), reverse=True):
        raise ValueError("an order has its texts before its numbers")
    return rows.withColumns({"__text": F.array(*texts).cast("array<string>"), "__number": F.array(*(c.cast("long") for c in numbers)).cast("array<bigint>")})


def response_digests(responses: DataFrame, order: str = "ord") -> DataFrame:
    """Of each run, the digest of its responses in order: `provider`, `model`, `run_id`, `responses_sha256`."""
    fields = [n for n in ("case_id", "run_id", "provider", "model", "resolved_model", "output", "error", "temperature", "reasoning_effort", "seed", "provider_request_id", "system_fingerprint", "execution") if n in responses.columns]
    found = ordered_digest(responses, record_json(**{n: F.col(n) for n in fields}), F.col(order), "provider", "model", "run_id")
    return found.withColumnRenamed("digest", "responses_sha256")


def track_of(cases: DataFrame) -> str:
    """The one track of the cases; passages need canonical prompts."""
    found = validation.tracks(cases).collect()  # a row a track
    if len(found) != 1:
        raise ValueError("analyze each prompt, control and passage track separately")
    if found[0]["misfits"]:
        raise ValueError("the passage track requires canonical prompts")
    return found[0]["track"]


def make_manifests(configs: DataFrame, cases: DataFrame, references: DataFrame, editions: DataFrame, responses: DataFrame, evidence: str = "live_provider") -> DataFrame:
    """A manifest for each run of `configs` (`provider`, `model`, `run_id`, settings and `endpoint`).

    Datasets with violations and mixtures of tracks are errors.
    """
    validation.require_valid(validation.dataset_violations(cases, references, editions))
    track = track_of(cases)
    ids = cases.agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "case_id"))), lambda x: x["case_id"]).alias("expected_case_ids"))
    rows = configs.withColumns({"endpoint_sha256": sha256(F.col("endpoint")), "schema_version": F.lit(SCHEMA_VERSION), "engine_version": F.lit(ENGINE_VERSION), "track": F.lit(track), "evidence": F.lit(evidence)})
    rows = rows.join(response_digests(responses), ["provider", "model", "run_id"], "left").crossJoin(dataset_digests(cases, references, editions)).crossJoin(ids)  # single rows
    return settled(rows.select("schema_version", "engine_version", "run_id", "provider", "model", *SETTINGS, "endpoint_sha256", *DIGESTS, "responses_sha256", "expected_case_ids", "track", "evidence"))


def manifest_violations(manifests: DataFrame, responses: DataFrame, cases: DataFrame, references: DataFrame, editions: DataFrame) -> DataFrame:
    """Every rule that a run breaks: `run_id`, `rule`, `reason`. Responses belong to a run by provider, model and run.

    Responses are grouped once, to a row a run with all that the rules ask; the rules are one list of it.
    """
    run = ["provider", "model", "run_id"]
    track, manifests = track_of(cases), settled(manifests)
    now = dataset_digests(cases, references, editions).first()
    expected = cases.select("case_id").distinct()
    asked = expected.count()
    declared = manifests.select(*run, F.explode("expected_case_ids").alias("case_id")).join(expected.withColumn("known", F.lit(True)), "case_id", "left")
    said = declared.groupBy(*run).agg(F.count(F.lit(1)).alias("declared"), F.countDistinct("case_id").alias("distinct_declared"), F.countDistinct(F.when(F.col("known"), F.col("case_id"))).alias("known"))
    given = {n: F.col(n) if n in responses.columns else F.lit(None) for n in (*SETTINGS[:2], "seed")}
    wanted = manifests.select(*run, *(F.col(n).alias(f"m_{n}") for n in SETTINGS[:2]), F.lit(True).alias("in_manifest")).dropDuplicates(run)
    differs = given["seed"].isNotNull() | ~reduce(Column.__and__, (given[n].eqNullSafe(F.col(f"m_{n}")) for n in SETTINGS[:2]))
    rows = responses.join(wanted, run, "left").join(expected.withColumn("met", F.lit(True)), "case_id", "left")
    seen = rows.groupBy(*run).agg(
        F.count(F.lit(1)).alias("observed"), F.countDistinct("case_id").alias("distinct_observed"), F.countDistinct(F.when(F.col("met"), F.col("case_id"))).alias("met"),
        F.bool_or(F.col("in_manifest") & differs).alias("differs"), F.bool_or(F.col("error").isNotNull() & (F.col("output") != "")).alias("both"),
    )
    own = response_digests(responses).withColumnRenamed("responses_sha256", "__responses")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    blank = lambda c: F.trim(c) == ""
    there = F.col("schema_version").isNotNull()
    rules = {
        ("version", "unsupported manifest or engine version"): (F.col("schema_version") != SCHEMA_VERSION) | (F.col("engine_version") != ENGINE_VERSION),
        ("evidence", "unknown evidence kind"): ~F.col("evidence").isin(*EVIDENCE),
        ("digest", "artifacts, prompts or track changed"): reduce(Column.__or__, (F.col(n) != now[n] for n in DIGESTS)) | (there & ~F.col("responses_sha256").eqNullSafe(F.col("__responses"))) | (F.col("track") != track),
        ("coverage", "incomplete, duplicate or unexpected cases"): there & ~reduce(Column.__and__, (zero(c) == asked for c in ("declared", "distinct_declared", "known", "observed", "distinct_observed", "met"))),
        ("configuration", "invalid run configuration"): there & (blank("run_id") | blank("model") | (F.col("max_output_tokens") == 0)),
        ("identity", "responses of no manifest"): ~there,
        ("settings", "response settings disagree with the manifest"): F.col("differs"),
        ("error_with_output", "an error has no output"): F.col("both"),
    }
    counted = seen.join(own, run)
    wide = manifests.drop("expected_case_ids").join(said, run, "left").join(counted, run, "full_outer")
    broken = F.filter(F.array(*(F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(rule).alias("rule"), F.lit(reason).alias("reason"))) for (rule, reason), when in rules.items())), lambda x: x.isNotNull())
    return wide.select(*run, F.explode(broken).alias("v")).select(*run, "v.rule", "v.reason").distinct()


def identities(manifests: DataFrame, responses: DataFrame) -> DataFrame:
    """A row a run: `identity` (provider, model, resolved model, first digits of its configuration's digest) and
    `versions`, how many resolved models and fingerprints its responses without errors name. More than one is a drift."""
    run = ["provider", "model", "run_id"]
    fingerprint = F.col("system_fingerprint") if "system_fingerprint" in responses.columns else F.lit(None).cast("string")
    named = responses.filter("error is null").select(*run, F.struct(F.col("resolved_model").alias("model"), fingerprint.alias("fingerprint")).alias("v"))
    seen = named.groupBy(*run).agg(F.array_sort(F.collect_set("v")).alias("v"))
    version = F.get("v", F.lit(0))
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    parts = [number("temperature"), json_text(F.col("reasoning_effort")), number("max_output_tokens"), json_text(F.col("endpoint_sha256")), F.concat(F.lit("["), json_text(version["model"]), F.lit(","), json_text(version["fingerprint"]), F.lit("]"))]
    configuration = sha256(F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")))
    name = F.concat_ws(" / ", "provider", "model", F.coalesce(version["model"], F.lit("unresolved")), F.substring(configuration, 1, 12))
    return manifests.join(seen, run, "left").select(*run, *SETTINGS, "evidence", F.coalesce(F.size("v"), F.lit(0)).alias("versions"), name.alias("identity"))


def comparability_violations(named: DataFrame) -> DataFrame:
    """Over all runs (of `identities`): `rule` and `subject` for drifts within a run, runs given twice, more than one kind of evidence, and models with fewer runs than others."""
    run = F.concat_ws("/", "provider", "model", "run_id")
    counts = named.groupBy("identity").agg(F.countDistinct("run_id").alias("runs"))
    most = counts.agg(F.max("runs").alias("most"))
    return reduce(
        DataFrame.unionByName,
        (
            named.filter("versions > 1").select(F.lit("model_drift").alias("rule"), run.alias("subject")),
            named.groupBy("provider", "model", "run_id").count().filter("count > 1").select(F.lit("run_twice").alias("rule"), run.alias("subject")),
            named.agg(F.array_sort(F.collect_set("evidence")).alias("e")).filter(F.size("e") > 1).select(F.lit("mixed_evidence").alias("rule"), F.array_join("e", ",").alias("subject")),
            counts.crossJoin(most).filter("runs <> most").select(F.lit("unequal_repetitions").alias("rule"), F.col("identity").alias("subject")),  # one row
        ),
    )


def rejected(responses: DataFrame, cases: DataFrame) -> DataFrame:
    """Responses that scoring stops at: of unknown cases, or given more than once for a case, run, provider and model."""
    key = ["case_id", "run_id", "provider", "model"]
    twice = responses.groupBy(*key).agg(F.count(F.lit(1)).alias("responses")).filter("responses > 1").withColumn("reason", F.lit("duplicate response"))
    unknown = responses.join(cases.select("case_id"), "case_id", "left_anti").groupBy(*key).agg(F.count(F.lit(1)).alias("responses")).withColumn("reason", F.lit("unknown case"))
    return twice.unionByName(unknown)


def score_all(responses: DataFrame, cases: DataFrame, references: DataFrame) -> DataFrame:
    """Scores of all responses; a response of an unknown case or given twice is an error."""
    if first := rejected(responses, cases).orderBy("reason", "case_id", "run_id").first():
        raise ValueError(f"{first['reason']}: case {first['case_id']}, run {first['run_id']}, {first['provider']} / {first['model']}")
    return score(responses, cases, references)


@dataclass(frozen=True)
class Analysis:
    """A validated analysis: `models` a row a model, `groups` its summaries by edition and stratum, `comparisons` a row a pair, `examples` of failures."""

    track: str
    evidence: str
    dataset_sha256: str
    models: DataFrame
    groups: DataFrame
    comparisons: DataFrame
    examples: DataFrame
    scores: DataFrame


def analyze(cases: DataFrame, references: DataFrame, editions: DataFrame, manifests: DataFrame, responses: DataFrame, resamples: int = 2000) -> Analysis:
    """Checks dataset, design and runs, raising an error at the first fault; then compares models.

    Runs of one identity are repetitions of one model. Provider errors count as failures, but not in `recall`.
    """
    if not 100 <= resamples <= 100_000 or manifests.isEmpty():
        raise ValueError("runs and 100 to 100000 resamples are needed")
    validation.require_valid(validation.dataset_violations(cases, references, editions))
    for frame, what in ((validation.unbalanced(cases, editions), "references without every edition or with several strata"), (validation.overlaps(cases), "overlapping references")):
        if frame.limit(1).count():
            raise ValueError(what)
    if first := manifest_violations(manifests, responses, cases, references, editions).orderBy("run_id", "rule").first():
        raise ValueError(f"run {first['run_id']}: {first['reason']}")
    named = settled(identities(manifests, responses))
    if first := comparability_violations(named).orderBy("rule", "subject").first():
        raise ValueError(f"{first['rule']}: {first['subject']}")
    # Kept by the session, as every table below reads the scores; lost blocks are computed again.
    scores = score_all(responses, cases, references).join(named.select("provider", "model", "run_id", "identity"), ["provider", "model", "run_id"]).persist()  # a row a run
    parts = [bootstrap(cluster_means(scores, flag, "identity"), resamples, "identity").withColumn("metric", F.lit(flag)) for flag in ("exact_text", "exact_words")]
    intervals = reduce(DataFrame.unionByName, parts).groupBy("identity").pivot("metric", ["exact_text", "exact_words"]).agg(F.first("estimate").alias("estimate"), F.first("lower").alias("lower"), F.first("upper").alias("upper"), F.first("clusters").alias("clusters"), F.first("resamples").alias("resamples"))
    failed = F.col("classification") == "provider_error"
    figures = scores.groupBy("identity").agg(
        F.countDistinct("run_id").alias("repetitions"), F.countDistinct("case_id").alias("cases_per_run"), F.avg(failed.cast("double")).alias("provider_error_rate"), F.avg(F.when(~failed, F.col("exact_text").cast("double"))).alias("recall")
    )
    apart = report.differing(scores, references).groupBy("identity").agg(F.count(F.lit(1)).alias("differing_responses"), F.avg(F.col("exact_text").cast("double")).alias("differing_exact_text"))
    models = figures.join(intervals, "identity").join(apart, "identity", "left")
    settings = named.select(F.col("identity").alias("model_key"), *SETTINGS).distinct()
    pairs = study.model_pairs(settings)
    keyed = scores.withColumn("model_key", F.col("identity"))
    differences = study.paired_intervals(keyed, pairs, resamples, keyed=True)
    one = manifests.select("evidence", "cases_sha256").first()
    return Analysis(
        track_of(cases), one["evidence"], one["cases_sha256"], models, report.summary(scores, "identity", "requested_translation", "stratum"), pairs.join(differences, ["left", "right"], "left"),
        study.failure_examples(keyed, references, keyed=True), scores,
    )
