"""The end of a trial: its answers are scored and its files written, in one call."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.digests import ordered_digest, record_json
from ..sources.records import write_json, write_jsonl, write_text
from . import report
from .audit import EVIDENCE
from .scoring import score
from .trials import INTERACTIVE

#: What such trials cannot tell.
LIMITS = ("self-reported model identity", "shared conversation context", "client-side retrieval restrictions are not enforced", "model sampling settings and usage are unknown")


def finish(identity: dict, answers: DataFrame, cases: DataFrame, references: DataFrame, folder: str) -> dict:
    """Writes `responses.jsonl`, `scores.jsonl`, `report.json`, `report.md` and `trial.json` of a trial; returns its summary.

    `identity` has `run_id` and `model`; `answers` the accepted `output` of each `case_id`; `cases` those selected, with `ord`.
    A case without an answer, or with two, is an error, and nothing is written. Rows are written by Spark in the order of
    cases; the driver gets the report's few rows. The same answers give the same files, byte by byte.
    """
    told = cases.select("case_id", "ord").join(answers.select("case_id", "output"), "case_id", "left")
    open_ = told.groupBy("case_id").agg(F.count("output").alias("n")).filter("n <> 1").limit(1).count() + answers.join(cases, "case_id", "left_anti").limit(1).count()
    if open_:
        raise ValueError("a trial is finished with one answer to every selected case")
    named = {"run_id": identity["run_id"], "provider": INTERACTIVE, "model": identity["model"]}
    responses = told.select("case_id", *(F.lit(v).alias(n) for n, v in named.items()), "output", "ord")
    scores = score(responses, cases, references).join(cases.select("case_id", "ord"), "case_id").persist()  # read by each file; lost blocks are computed again
    at = Path(folder)
    at.mkdir(parents=True, exist_ok=True)
    write_jsonl(responses.select("case_id", *named, "output", "ord").orderBy("ord").drop("ord").coalesce(1), str(at / "responses.jsonl"))
    write_jsonl(scores.orderBy("ord").drop("ord").coalesce(1), str(at / "scores.jsonl"))
    # Means of decimals are the same in whatever order rows are added up; those of doubles differ in their last digits.
    exact = scores.withColumns({n: F.col(n).cast("decimal(30,18)") for n in ("word_accuracy", "word_error_rate", "character_error_rate")})
    views = [r.asDict() for r in report.summaries(exact).orderBy("view", "name").collect()]
    overall = next(v for v in views if v["view"] == "overall")
    classes = {r["classification"]: r["responses"] for r in report.class_histogram(scores).orderBy("classification").collect()}
    write_json({"overall": overall | {"classifications": classes}, "groups": views}, str(at / "report.json"))
    write_text(f"# Interactive trial\n\nEvidence: `{EVIDENCE}`. Limitations: {'; '.join(LIMITS)}. Do not pool with controlled runs.\n\n" + report.markdown(exact), str(at / "report.md"))
    fields = lambda df: record_json(**{c: F.col(c) for c in df.columns if c != "ord"})
    digests = {n: ordered_digest(df, fields(df), F.col("ord")).first()[0] for n, df in (("responses_sha256", responses), ("scores_sha256", scores))}
    ids = [r["case_id"] for r in cases.orderBy("ord").select("case_id").collect()]  # the trial's file lists them
    write_json({"identity": identity | {"evidence": EVIDENCE, "expected_case_ids": ids}, **digests, "provider_api_calls": 0, "paid_api_calls": 0, "limitations": list(LIMITS)}, str(at / "trial.json"))
    scores.unpersist()
    return {"summary": overall | {"classifications": classes}, "output_dir": str(at)}
