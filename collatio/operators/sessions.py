"""Sessions as an event log: the first answer to a case counts, others are repeats or conflicts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: characters an answer may have.
ANSWER_LIMIT = 16_384


def answers(log: DataFrame) -> DataFrame:
    """Each submission (`session`, `item`, `seq`, `answer`) with its outcome: accepted, too_long, repeated (the same again) or conflict. A null answer is an empty one."""
    text = F.coalesce("answer", F.lit(""))
    ok = F.char_length(text) <= ANSWER_LIMIT
    w = Window.partitionBy("session", "item", ok).orderBy("seq")
    rows = log.withColumns({"ok": ok, "n": F.row_number().over(w), "first": F.first(text).over(w)})
    outcome = F.when(~F.col("ok"), "too_long").when(F.col("n") == 1, "accepted").when(text == F.col("first"), "repeated").otherwise("conflict")
    return rows.select("session", "item", "seq", "answer", outcome.alias("outcome"))


def progress(log: DataFrame) -> DataFrame:
    """By session: items answered, repeats, conflicts, rejected answers."""
    one = lambda o: F.count_if(F.col("outcome") == o)
    return answers(log).groupBy("session").agg(one("accepted").alias("answered"), one("repeated").alias("repeated"), one("conflict").alias("conflicts"), one("too_long").alias("too_long"))


def pending(log: DataFrame, plan: DataFrame) -> DataFrame:
    """The next item of each session: the plan (`session`, `place`, `item`) at the number of answers so far."""
    answered = answers(log).filter("outcome = 'accepted'").groupBy("session").agg(F.count(F.lit(1)).alias("done"))
    rows = plan.join(answered, "session", "left").withColumn("done", F.coalesce("done", F.lit(0)))
    return rows.filter("place = done").select("session", "item", "done")


def out_of_order(log: DataFrame, plan: DataFrame) -> DataFrame:
    """Accepted answers that are not to the item the session stood at."""
    got = answers(log).filter("outcome = 'accepted'")
    got = got.withColumn("place", (F.row_number().over(Window.partitionBy("session").orderBy("seq")) - 1).cast("long"))
    return got.join(plan.select("session", F.col("place").cast("long").alias("place"), F.col("item").alias("planned")), ["session", "place"], "left").filter(~F.col("item").eqNullSafe(F.col("planned"))).select("session", "place", "item", "planned")


def attempts(log: DataFrame) -> DataFrame:
    """Last state of each attempt (`session`, `item`, `seq`, `state`: started, blocked, accepted); more than one start is a retry."""
    return log.groupBy("session", "item").agg(F.max_by("state", "seq").alias("state"), (F.count_if(F.col("state") == "started") > 1).alias("retried"))


def finished(log: DataFrame, plan: DataFrame) -> DataFrame:
    """Sessions with an accepted answer to every planned item."""
    got = answers(log).filter("outcome = 'accepted'").select("session", "item")
    open_ = plan.join(got, ["session", "item"], "left_anti").select("session").distinct()
    return plan.select("session").distinct().join(open_, "session", "left_anti")


class Desk:
    """One session: it issues the next case of its plan, takes the answer to the case that is out, and finishes when all have one.

    `case` gives the case of a place or none, `recorded` the digest of a case's answer or none, `record` keeps one.
    """

    def __init__(self, case: Callable[[int], str | None], recorded: Callable[[str], str | None], record: Callable[[str, str], None], done: int = 0, pending: bool = False, finished: bool = False):
        self.case, self.recorded, self.record = case, recorded, record
        self.done, self.pending, self.finished = done, pending, finished

    def step(self, kind: str, case_id: str | None, answer: str | None) -> tuple[str, str | None]:
        """The outcome of an event, and the case it is about."""
        now = self.case(self.done)
        if kind == "issue":
            self.pending = self.pending or (now is not None and not self.finished)
            return ("issued", now) if self.pending else ("complete", None)
        if kind == "finish":
            self.finished = self.finished or now is None
            return ("finished" if self.finished else "incomplete"), None
        if kind != "answer":
            return "unknown", case_id
        text = answer or ""
        if len(text) > ANSWER_LIMIT:
            return "too_long", case_id
        digest = hashlib.sha256(text.encode()).hexdigest()
        if (before := self.recorded(case_id)) is not None:
            return ("repeated" if before == digest else "conflict"), case_id
        if not self.pending or now != case_id:
            return "not_issued", case_id
        self.record(case_id, digest)
        self.done, self.pending = self.done + 1, False
        return "accepted", case_id


_STEPS = ("session", "seq", "kind", "case_id", "outcome")


def steps(log: DataFrame, plan: DataFrame) -> DataFrame:
    """The outcome of each event (`session`, `seq`, `kind`: issue, answer or finish, `case_id`, `answer`) of sessions with a plan (`session`, `place` from 0, `case_id`).

    issue: `issued` (the case that is out, again if it is already) or `complete`. answer: `accepted`, `repeated` (the
    same again), `conflict` (another answer to an answered case), `not_issued` (of any case but the one that is out) or
    `too_long`. finish: `finished` or `incomplete`. Other kinds are `unknown`; events of sessions without a plan are left out.

    A session's plan and events pass one task in order, sorted on its disk; it holds the plan and a digest for each answer.
    """
    plans = plan.select("session", F.lit(0).alias("stage"), F.col("place").cast("long").alias("seq"), F.lit(None).cast("string").alias("kind"), F.col("case_id").cast("string").alias("case_id"), F.lit(None).cast("string").alias("answer"))
    events = log.select("session", F.lit(1).alias("stage"), F.col("seq").cast("long").alias("seq"), "kind", F.col("case_id").cast("string").alias("case_id"), F.col("answer").cast("string").alias("answer"))
    own = plans.unionByName(events).repartition("session").sortWithinPartitions("session", "stage", "seq", "kind")
    out = T.StructType([plan.schema["session"], T.StructField("seq", T.LongType()), *(T.StructField(n, T.StringType()) for n in _STEPS[2:])])

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, cases, told, desk = object(), [], {}, None
        for frame in frames:
            found = []
            for s, stage, seq, kind, case, answer in frame.itertuples(index=False, name=None):
                if s != session:
                    session, cases, told = s, [], {}
                    desk = Desk(lambda k, cases=cases: cases[k] if k < len(cases) else None, told.get, told.__setitem__)
                if stage == 0:
                    cases.append(case)
                elif cases:
                    outcome, about = desk.step(kind, case, answer)
                    found.append((s, seq, kind, about, outcome))
            yield pd.DataFrame(found, columns=_STEPS)

    return own.mapInPandas(work, out)
