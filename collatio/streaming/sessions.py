"""Sessions as a stream: the first answer to a case wins, with state for each session and item."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.sessions import ANSWER_LIMIT, Desk

OUT = "session string, item string, seq long, answer string, outcome string"


def stream_answers(log: DataFrame) -> DataFrame:
    """The outcomes of `sessions.answers` as submissions arrive (`session`, `item` strings, `seq`, `answer`).

    Within a trigger submissions are taken in order of `seq`; across triggers, as they come. A session's item
    is open for good, so its state (the accepted answer) is kept without a timeout.
    """

    def step(key: tuple, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq")
        accepted = state.get[0] if state.exists else None
        out = []
        for seq, answer in zip(batch["seq"], batch["answer"], strict=True):
            text = answer or ""
            if len(text) > ANSWER_LIMIT:
                outcome = "too_long"
            elif accepted is None:
                accepted, outcome = text, "accepted"
            else:
                outcome = "repeated" if text == accepted else "conflict"
            out.append((*key, seq, answer, outcome))
        if accepted is not None:
            state.update((accepted,))
        yield pd.DataFrame(out, columns=["session", "item", "seq", "answer", "outcome"])

    return log.groupBy("session", "item").applyInPandasWithState(step, OUT, "accepted string", "append", "NoTimeout")


STEPS = "session string, seq long, kind string, case_id string, outcome string"


class _Desks(StatefulProcessor):
    """Of a session: its plan, where it stands, and digests of its answers."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.plan = handle.getMapState("plan", "place long", "case_id string")
        self.at = handle.getValueState("at", "done long, pending boolean, finished boolean")
        self.told = handle.getMapState("told", "case_id string", "digest string")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        for place, case in zip(initialState["place"], initialState["case_id"], strict=True):
            self.plan.updateValue((int(place),), (case,))

    def _of(self, state, key) -> str | None:
        return state.getValue((key,))[0] if key is not None and state.containsKey((key,)) else None

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        found = []
        if self.plan.containsKey((0,)):
            desk = Desk(lambda k: self._of(self.plan, k), lambda c: self._of(self.told, c), lambda c, d: self.told.updateValue((c,), (d,)), *(self.at.get() if self.at.exists() else ()))
            for seq, kind, case, answer in pd.concat(list(rows)).sort_values(["seq", "kind"])[["seq", "kind", "case_id", "answer"]].itertuples(index=False, name=None):
                outcome, about = desk.step(kind, case, answer)
                found.append((key[0], seq, kind, about, outcome))
            self.at.update((desk.done, desk.pending, desk.finished))
        yield pd.DataFrame(found, columns=["session", "seq", "kind", "case_id", "outcome"]).astype({"seq": "int64"})

    def close(self) -> None:
        pass


def stream_steps(log: DataFrame, plan: DataFrame) -> DataFrame:
    """The outcomes of `sessions.steps` as events arrive, each session's plan being its first state.

    Within a trigger events are taken in order of `seq`; across triggers, as they come. The session needs the
    RocksDB state store. A session is open for good, so its state stays: the plan, and a digest for each answer.
    """
    text = lambda c: F.col(c).cast("string").alias(c)
    own = log.select(text("session"), F.col("seq").cast("long").alias("seq"), "kind", text("case_id"), text("answer"))
    first = plan.select(text("session"), F.col("place").cast("long").alias("place"), text("case_id")).groupBy("session")
    return own.groupBy("session").transformWithStateInPandas(statefulProcessor=_Desks(), outputStructType=STEPS, outputMode="Append", timeMode="None", initialState=first)
