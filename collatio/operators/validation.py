"""Integrity checks as frames of violations: `rule`, `subject`, `reason`. An empty frame is a valid dataset."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ref_label, trim_unicode
from .scoring import KEY, other_key, same_reference

#: Fixed value: the catalog's version.
CATALOG_VERSION = 1
#: Attributes that stay behind when markup is not cleaned.
MARKUP = ("strong=", "lemma=", "x-morph=", "x-occurrence=")


#: Of each rule, in the order in which a file's record is looked at: its number, and its file's (the catalog comes first).
RULES = (
    "catalog_version", "catalog_none", "case_none", "reference_none",
    "catalog_empty_id", "catalog_duplicate_id", "catalog_unpinned", "catalog_urls", "catalog_license",
    "reference_invalid", "reference_unknown_edition", "reference_empty", "reference_edges", "reference_markup", "reference_duplicate",
    "case_empty_id", "case_duplicate_id", "case_invalid", "case_unknown_edition", "case_without_text", "case_twice",
)


def _found(rows: DataFrame, rule: str, when: Column, subject: Column, reason: str) -> DataFrame:
    return rows.filter(when).select(F.lit(rule).alias("rule"), subject.cast("string").alias("subject"), F.lit(reason).alias("reason"), _place(rows))


def _listed(rows: DataFrame, subject: Column, rules: dict[str, tuple[Column, str | Column]]) -> DataFrame:
    """A row for each rule that a record breaks, all rules in one pass."""
    reason = lambda r: F.lit(r) if isinstance(r, str) else r
    broken = F.array(*(F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(rule).alias("rule"), reason(told).alias("reason"))) for rule, (when, told) in rules.items()))
    found = rows.select(subject.cast("string").alias("subject"), _place(rows), F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("v"))
    return found.select("v.rule", "subject", "v.reason", "ord")


def _place(rows: DataFrame) -> Column:
    """A record's place in its file, where it has one."""
    return (F.col("ord").cast("long") if "ord" in rows.columns else F.lit(None).cast("long")).alias("ord")


def _twice(rows: DataFrame, rule: str, keys: list[Column], subject: Column, reason: str) -> DataFrame:
    """Keys given more than once, at the place where one comes again. Only such keys' records are joined for it."""
    own = rows.select(*(k.alias(f"__k{n}") for n, k in enumerate(keys)), subject.alias("__s"), _place(rows))
    names = [f"__k{n}" for n in range(len(keys))]
    again = own.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.min("__s").alias("s"), F.min("ord").alias("first")).filter("n > 1")
    same = F.lit(True)
    for n in names:
        same = same & F.col(f"l.{n}").eqNullSafe(F.col(f"r.{n}"))
    later = own.alias("l").join(again.alias("r"), same & (F.col("l.ord") > F.col("r.first"))).groupBy(*(F.col(f"r.{n}") for n in names)).agg(F.min("l.ord").alias("ord"))
    placed = again if "ord" not in rows.columns else again.alias("l").join(later.alias("r"), same, "left").select("l.s", "r.ord")
    return _found(placed, rule, F.lit(True), F.col("s"), reason)


def _none(rows: DataFrame, rule: str, reason: str) -> DataFrame:
    return _found(rows.limit(1).agg(F.count(F.lit(1)).alias("n"), F.lit(0).alias("ord")), rule, F.col("n") == 0, F.lit(""), reason)


def _all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def label() -> Column:
    return ref_label(*(F.col(k) for k in KEY))


def blank(name: str) -> Column:
    return trim_unicode(F.col(name)) == ""


def reference_fault() -> Column:
    """The first structural fault of a reference, or null."""
    return (
        F.when(blank("book"), "book must not be empty")
        .when(F.col("chapter") == 0, "chapter must be greater than zero")
        .when(F.col("verse_start") == 0, "verse_start must be greater than zero")
        .when(F.coalesce("verse_end", "verse_start") < F.col("verse_start"), "verse_end must be greater than or equal to verse_start")
    )


def catalog_violations(editions: DataFrame, schema_version: int | None = None) -> DataFrame:
    """Of `id`, `edition`, `license_kind`, `license_url`, `source_url`, `redistribute_reference_text`."""
    own = F.col("id")
    version = [] if schema_version in (None, CATALOG_VERSION) else [_found(editions.sparkSession.range(1).select(F.lit(0).alias("ord")), "catalog_version", F.lit(True), F.lit(str(schema_version)), "unsupported catalog version")]
    return _all(
        *version,
        _none(editions, "catalog_none", "the catalog needs an edition"),
        _twice(editions, "catalog_duplicate_id", [own], own, "duplicate edition id"),
        _listed(editions, own, {
            "catalog_empty_id": (blank("id"), "edition id must not be empty"),
            "catalog_unpinned": (blank("edition"), "edition is not pinned"),
            "catalog_urls": (blank("license_url") | blank("source_url"), "license_url and source_url are needed"),
            "catalog_license": ((F.col("license_kind") == "licensed_private") & F.col("redistribute_reference_text"), "private licence cannot redistribute"),
        }),
    )


def _known(rows: DataFrame, editions: DataFrame) -> DataFrame:
    """`rows` with `__known` where their edition is in the catalog."""
    return rows.join(editions.select(F.col("id").alias("translation")).distinct().withColumn("__known", F.lit(True)), "translation", "left")


def reference_violations(references: DataFrame, editions: DataFrame) -> DataFrame:
    own = F.concat(F.col("translation"), F.lit(" "), label())
    residue = F.col("text").contains("\\")
    for attribute in MARKUP:
        residue = residue | F.col("text").contains(attribute)
    fault = reference_fault()
    return _all(
        _none(references, "reference_none", "the corpus needs a record"),
        _listed(_known(references, editions), own, {
            "reference_invalid": (fault.isNotNull(), fault),
            "reference_unknown_edition": (F.col("__known").isNull(), "unknown edition"),
            "reference_empty": (F.col("text") == "", "empty text"),
            "reference_edges": (trim_unicode(F.col("text")) != F.col("text"), "white space at an edge"),
            "reference_markup": (residue, "residual markup"),
        }),
        _twice(references, "reference_duplicate", [F.col(c) for c in ("translation", *KEY)], own, "duplicate text"),
    )


def case_violations(cases: DataFrame, references: DataFrame, editions: DataFrame) -> DataFrame:
    own, fault = F.col("case_id"), reference_fault()
    texts = references.select(F.col("translation").alias("__edition"), *KEY)
    missing = cases.join(other_key(texts), same_reference() & (F.col("translation") == F.col("__edition")), "left_anti")
    return _all(
        _none(cases, "case_none", "the dataset needs a case"),
        _listed(_known(cases, editions), own, {
            "case_empty_id": (blank("case_id"), "case id must not be empty"),
            "case_invalid": (fault.isNotNull(), fault),
            "case_unknown_edition": (F.col("__known").isNull(), "unknown edition"),
        }),
        _twice(cases, "case_duplicate_id", [own], own, "duplicate case id"),
        _found(missing, "case_without_text", F.lit(True), own, "no reference text"),
        _twice(cases, "case_twice", [F.col(c) for c in ("translation", *KEY)], own, "more than one case"),
    )


def dataset_violations(cases: DataFrame, references: DataFrame, editions: DataFrame, schema_version: int | None = None) -> DataFrame:
    """All violations: `rule`, `subject`, `reason`, and `ord`, the record's place in its file, where files have `ord`."""
    return _all(catalog_violations(editions, schema_version), reference_violations(references, editions), case_violations(cases, references, editions))


def first_violation(violations: DataFrame) -> DataFrame:
    """The violation that reading the files in order meets first, as one row or none: what concerns a file as a whole, then
    catalog, references and cases, each by record and within it by rule. One pass, without a sort."""
    number = F.array_position(F.array(*map(F.lit, RULES)), F.col("rule"))
    file = F.when(number <= 4, 0).when(F.col("rule").startswith("catalog"), 1).when(F.col("rule").startswith("reference"), 2).otherwise(3)
    place = F.when(number <= 4, number.cast("long")).otherwise(F.coalesce("ord", F.lit(2**62)))
    order = F.struct(file.alias("file"), place.alias("place"), number.alias("rule"), F.col("subject").alias("subject"))
    return violations.agg(F.min_by(F.struct("rule", "subject", "reason", "ord"), order).alias("v")).filter("v is not null").select("v.*")


def require_valid(violations: DataFrame) -> None:
    """Raises on the first violation in the order of files."""
    if first := first_violation(violations).first():
        raise ValueError(f"{first['rule']}: {first['subject']}: {first['reason']}")


def unbalanced(cases: DataFrame, editions: DataFrame) -> DataFrame:
    """References without exactly the catalog's editions, or with more than one stratum."""
    wanted = editions.agg(F.sort_array(F.collect_set("id")).alias("wanted"))  # one row: the catalog is a dimension
    own = cases.groupBy(label().alias("ref_label")).agg(F.sort_array(F.collect_set("translation")).alias("editions"), F.countDistinct("stratum").alias("strata"))
    return own.crossJoin(wanted).filter((F.col("editions") != F.col("wanted")) | (F.col("strata") > 1)).select("ref_label", F.array_join("editions", ",").alias("editions"), "strata")


def overlaps(cases: DataFrame) -> DataFrame:
    """Verses that two different references cover."""
    verses = cases.select(*KEY, label().alias("ref_label"), F.explode(F.sequence("verse_start", F.greatest(F.coalesce("verse_end", "verse_start"), "verse_start"))).alias("verse"))
    return verses.groupBy("book", "chapter", "verse").agg(F.countDistinct("ref_label", F.coalesce(F.col("verse_end"), F.lit(-1))).alias("references")).filter("references > 1")


def tracks(cases: DataFrame) -> DataFrame:
    """Cases by track: passages, else the prompt's variant. More than one row, or passages not canonical, cannot be analysed together."""
    return cases.groupBy(F.when(F.col("verse_end").isNotNull(), "passage").otherwise(F.col("prompt_variant")).alias("track")).agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("verse_end").isNotNull() & (F.col("prompt_variant") != "canonical")).alias("misfits"))


def coverage(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """By run: cases that were expected and not observed, observed and not expected, or observed twice. `expected` has run_id and case_id."""
    seen = observed.groupBy("run_id", "case_id").agg(F.count(F.lit(1)).alias("n"))
    joined = expected.select("run_id", "case_id", F.lit(1).alias("e")).join(seen, ["run_id", "case_id"], "full_outer")
    return joined.groupBy("run_id").agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("e").isNull()).alias("unexpected"), F.count_if(F.col("n") > 1).alias("repeated"))


def run_violations(responses: DataFrame) -> DataFrame:
    """Rows of a run against its rules: no seed, no output beside an error; one resolved model and fingerprint within a run."""
    own = F.concat_ws("/", "run_id", "case_id")
    parts = [_found(responses, "error_with_output", F.col("error").isNotNull() & (F.col("output") != ""), own, "an error has no output")]
    if "seed" in responses.columns:
        parts.append(_found(responses, "seeded", F.col("seed").isNotNull(), own, "seeds are not recorded"))
    told = [F.coalesce(c, F.lit("")) for c in ("resolved_model", "system_fingerprint") if c in responses.columns]
    drift = responses.filter("error is null").groupBy("provider", "model", "run_id").agg(F.size(F.collect_set(F.struct(*told))).alias("n"))
    parts.append(_found(drift, "model_drift", F.col("n") > 1, F.concat_ws("/", "provider", "model", "run_id"), "responses resolve to several models or fingerprints"))
    return _all(*parts)


def repetition_violations(responses: DataFrame) -> DataFrame:
    """Models whose number of runs differs from the others' largest."""
    runs = responses.groupBy("provider", "model").agg(F.countDistinct("run_id").alias("runs"))
    most = runs.agg(F.max("runs").alias("most"))
    return runs.crossJoin(most).filter("runs <> most").select("provider", "model", "runs", "most")
