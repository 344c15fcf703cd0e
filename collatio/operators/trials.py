"""Trials: checks of their configuration and of saved progress, as frames of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trim_unicode
from .sessions import ANSWER_LIMIT

#: The providers by whether a trial is restricted.
RESTRICTED, INTERACTIVE = "restricted_codex", "interactive_mcp"


def _rules(rows: DataFrame, subject: str, rules: dict) -> DataFrame:
    """A row for each rule that a row breaks, all rules in one pass."""
    broken = F.filter(F.array(*(F.when(F.coalesce(when, F.lit(False)), name) for name, when in rules.items())), lambda x: x.isNotNull())
    return rows.select(F.col(subject).alias("subject"), F.explode(broken).alias("rule"))


def config_violations(configs: DataFrame) -> DataFrame:
    """Of `run_id`, `model` and `case_limit`: `subject` (the run) and `rule`. Missing names break the rules of names."""
    name = F.coalesce("run_id", F.lit(""))
    model = F.coalesce("model", F.lit(""))
    return _rules(
        configs,
        "run_id",
        {
            "run_id": ~name.rlike(r"\A[A-Za-z0-9_-]{1,64}\z"),
            "model": (trim_unicode(model) == "") | (F.octet_length(model) > 256),
            "case_limit": F.col("case_limit") == 0,
        },
    )


def progress_violations(sessions: DataFrame, responses: DataFrame, plan: DataFrame, attempts: DataFrame) -> DataFrame:
    """Saved trials against their plans: `session`, `rule`.

    `sessions` has `session`, `model`, `restricted`, `reasoning_effort`, `pending` and `finished`; `plan` the cases of each (`session`,
    `place` from 0, `case_id`); `responses` and `attempts` their rows with `place`. A session without rows has made no progress.
    """
    count = lambda df, name: df.groupBy("session").agg(F.count(F.lit(1)).alias(name))
    rows = sessions
    for df, name in ((plan, "cases"), (responses, "answers"), (attempts, "tries")):
        rows = rows.join(count(df, name), "session", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    whole = _rules(
        rows,
        "session",
        {
            "progress": (F.col("answers") > F.col("cases")) | (F.col("pending") & (F.col("finished") | (F.col("answers") == F.col("cases")))) | (F.col("finished") & (F.col("answers") != F.col("cases"))),
            "attempts": F.when(F.col("restricted"), (F.col("tries") < F.col("answers")) | (F.col("tries") > F.col("answers") + 1)).otherwise(F.col("tries") > 0),
        },
    )
    planned = plan.select("session", "place", F.col("case_id").alias("planned"))
    given = responses.join(sessions.select("session", F.col("model").alias("own_model"), "restricted", F.col("reasoning_effort").alias("own_effort")), "session").join(planned, ["session", "place"], "left")
    hidden = F.col("restricted")
    wrong = reduce(
        lambda a, b: a | b,
        (
            ~F.col("case_id").eqNullSafe(F.col("planned")), ~F.col("run_id").eqNullSafe(F.col("session")), ~F.col("model").eqNullSafe(F.col("own_model")),
            ~F.col("provider").eqNullSafe(F.when(hidden, RESTRICTED).otherwise(INTERACTIVE)), ~F.col("resolved_model").eqNullSafe(F.when(hidden, F.col("own_model"))),
            F.col("error").isNotNull(), F.col("execution").isNotNull() != hidden, F.col("temperature").isNotNull(), ~F.col("effort").eqNullSafe(F.when(hidden, F.col("own_effort"))),
            F.col("seed").isNotNull(), F.col("provider_request_id").isNotNull(), F.col("system_fingerprint").isNotNull(), F.coalesce(F.char_length("output") > ANSWER_LIMIT, F.lit(False)),
        ),
    )
    answers = _rules(given, "session", {"response": wrong})
    tried = attempts.join(sessions.filter("restricted").select("session", "pending", "finished"), "session").join(count(responses, "answers"), "session", "left").join(planned, ["session", "place"], "left")
    done, digests = F.col("place") < F.coalesce("answers", F.lit(0)), [F.col(c).isNotNull() for c in ("request_sha256", "response_sha256")]
    states = _rules(
        tried,
        "session",
        {
            "attempt_case": ~F.col("case_id").eqNullSafe(F.col("planned")),
            "attempt_accepted": done & ~(F.col("state").eqNullSafe("accepted") & digests[0] & digests[1]),
            "attempt_pending": ~done & ~(F.coalesce(F.col("state").isin("started", "blocked"), F.lit(False)) & F.col("pending") & ~F.col("finished") & ~digests[0] & ~digests[1]),
        },
    )
    return reduce(DataFrame.unionByName, (whole, answers, states)).select(F.col("subject").alias("session"), "rule").distinct()


def trial_totals(responses: DataFrame) -> DataFrame:
    """By session: answers, their characters, tokens in and out, and the accounted cost; absent figures count as nothing."""
    total = lambda c: F.coalesce(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)")
    return responses.groupBy("session").agg(F.count(F.lit(1)).alias("answers"), F.coalesce(F.sum(F.char_length("output")), F.lit(0)).alias("chars"), total("execution.input_tokens").alias("input_tokens"), total("execution.output_tokens").alias("output_tokens"), total("execution.accounted_nanoeur").alias("accounted_nanoeur"))


def edit_totals(scores: DataFrame, *by: str | Column) -> DataFrame:
    """Insertions, deletions and substitutions of scores in all, with the words they are counted against; absent counts as nothing."""
    total = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(c)
    return scores.groupBy(*by).agg(F.count(F.lit(1)).alias("responses"), *(total(c) for c in ("insertions", "deletions", "substitutions")))


def resume_place(ledger: DataFrame, plan: DataFrame) -> DataFrame:
    """Where each session goes on: its ledger (`session`, `place`, `case_id`) has to be a prefix of its plan. `next`, and `broken` if it is not."""
    w = Window.partitionBy("session").orderBy("place")
    rows = ledger.withColumn("nth", F.row_number().over(w) - 1).join(plan.select("session", F.col("place").alias("nth"), F.col("case_id").alias("planned")), ["session", "nth"], "left")
    made = rows.groupBy("session").agg(F.count(F.lit(1)).alias("next"), F.bool_or((F.col("place") != F.col("nth")) | ~F.col("case_id").eqNullSafe(F.col("planned"))).alias("broken"))
    return plan.select("session").distinct().join(made, "session", "left").select("session", F.coalesce("next", F.lit(0)).alias("next"), F.coalesce("broken", F.lit(False)).alias("broken"))
