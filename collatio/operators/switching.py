"""Which trial a server stands at: begin, resume, progress and finish as a fold of maps between states.

A part of a server's log is a map from the state before it to the state behind it. Maps of parts are made by
themselves, each in time that grows with its part, and put together in order; then each part, told its
first state, judges its events. So a long log is many tasks' work, and the result is the same however it is cut.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Events of a part at most, where `seq` counts a server's events.
PART = 4096
#: How far a trial is: nothing asked yet, underway, or finished. Only one underway keeps others from being opened.
FRESH, BUSY, FINISHED = "fresh", "busy", "finished"
#: Outcomes that are faults.
FAULTS = ("settings_differ", "busy", "run_exists", "unknown_run", "no_trial", "incomplete")

#: A state: none, or run, settings and how far it is. A run of none in a map's results is the one before the part.
State = tuple[str | None, str | None, str] | None


@dataclass(frozen=True)
class Event:
    kind: str
    run: str | None = None
    settings: str | None = None
    saved: bool = False
    progress: str = FRESH  # of a saved trial that is resumed
    complete: bool = False  # at a finish: whether every case has an answer

    @property
    def opens(self) -> State:
        """The trial that the event opens if none is in its way."""
        if self.kind == "begin":
            return None if self.saved else (self.run, self.settings, FRESH)
        return (self.run, self.settings, self.progress) if self.kind == "resume" and self.saved else None


def step(state: State, e: Event) -> tuple[str, State]:
    """The outcome of an event, and the state behind it."""
    if e.kind in ("begin", "resume"):
        if state and state[0] == e.run:
            return ("settings_differ" if e.kind == "begin" and state[1] != e.settings else "same"), state
        if state and state[2] == BUSY:
            return "busy", state
        if not e.opens:
            return ("run_exists" if e.kind == "begin" else "unknown_run"), state
        return ("opened" if e.kind == "begin" else "resumed"), e.opens
    if not state:
        return "no_trial", state
    if e.kind == "progress":
        return ("done", state) if state[2] == FINISHED else ("progress", (*state[:2], BUSY))
    if state[2] == FINISHED:
        return "finished", state
    return ("finished", (*state[:2], FINISHED)) if e.complete else ("incomplete", state)


@dataclass
class Effect:
    """A part of a log as a map: the state behind it by how far the trial before it was, for some runs and for all others."""

    nothing: State = None  # behind a part before which no trial was open
    runs: dict[str, dict[str | None, State]] = field(default_factory=lambda: {s: {} for s in (FRESH, BUSY, FINISHED)})
    others: dict[str, State] = field(default_factory=lambda: {s: (None, None, s) for s in (FRESH, BUSY, FINISHED)})

    def of(self, state: State) -> State:
        if not state:
            return self.nothing
        run, settings, far = state
        found = self.runs[far].get(run, self.others[far]) if run is not None else self.others[far]
        return (run, settings, found[2]) if found and found[0] is None else found

    def after(self, e: Event) -> "Effect":
        """The effect of an event and then of this part."""
        out = Effect(self.nothing, dict(self.runs), dict(self.others))
        if e.kind in ("begin", "resume"):
            if opened := e.opens:
                behind = self.of(opened)
                out.nothing = behind
                for far in (FRESH, FINISHED):  # any other run gives way; the same one stays
                    out.runs[far] = {e.run: self.runs[far].get(e.run, self.others[far])}
                    out.others[far] = behind
        elif e.kind == "progress" or e.complete:
            to = BUSY if e.kind == "progress" else FINISHED
            for far in (FRESH, BUSY) if to == FINISHED else (FRESH,):
                out.runs[far], out.others[far] = self.runs[to], self.others[to]
        return out

    def dump(self) -> str:
        return json.dumps([self.nothing, {far: [[run, *to] for run, to in found.items()] for far, found in self.runs.items()}, self.others])

    @classmethod
    def load(cls, text: str) -> "Effect":
        nothing, runs, others = json.loads(text)
        return cls(nothing and tuple(nothing), {far: {run: tuple(to) for run, *to in found} for far, found in runs.items()}, {far: tuple(to) for far, to in others.items()})


def _events(part: pd.DataFrame) -> list[Event]:
    none = lambda x: None if x is None or x != x else x
    return [Event(kind, none(run), none(settings), bool(none(saved)), none(progress) or FRESH, bool(none(complete))) for kind, run, settings, saved, progress, complete in part[["kind", "run", "settings", "saved", "progress", "complete"]].itertuples(index=False, name=None)]


def effect(events: list[Event]) -> Effect:
    out = Effect()
    for e in reversed(events):
        out = out.after(e)
    return out


def judged(log: DataFrame, part: int = PART) -> DataFrame:
    """Events of servers with their outcome, and the run that was open behind each: `server`, `seq`, `kind`, `run`, `outcome`, `active`, `state`.

    `log` has `server`, `seq` (a count of its events, in order), `kind` (begin, resume, progress or finish), `run`,
    `settings`, `saved` (whether the run's trial was there), `progress` (how far a resumed one was) and
    `complete` (whether a finish found every case answered). Outcomes in `FAULTS` are faults and change nothing.
    """
    own = log.withColumn("part", F.floor(F.col("seq") / part).cast("long"))
    server = log.schema["server"]
    found = T.StructType([server, T.StructField("part", T.LongType()), T.StructField("effect", T.StringType())])

    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        return pd.DataFrame([(rows["server"].iloc[0], rows["part"].iloc[0], effect(_events(rows)).dump())], columns=found.names)

    def firsts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = object(), None
        for frame in frames:
            out = []
            for name, number, text in frame.itertuples(index=False, name=None):
                state, last = (state if name == last else None), name
                out.append((name, number, json.dumps(state)))
                state = Effect.load(text).of(state)
            yield pd.DataFrame(out, columns=found.names)

    parts = own.groupBy("server", "part").applyInPandas(summed, found)
    before = parts.repartition("server").sortWithinPartitions("server", "part").mapInPandas(firsts, found).withColumnRenamed("effect", "before")
    names = ["seq", "kind", "run", "outcome", "active", "state"]
    told = T.StructType([server, T.StructField("seq", T.LongType()), *(T.StructField(n, T.StringType()) for n in names[1:])])

    def judge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        state = json.loads(rows["before"].iloc[0])
        state, out = state and tuple(state), []
        for name, seq, e in zip(rows["server"], rows["seq"], _events(rows), strict=True):
            outcome, state = step(state, e)
            out.append((name, seq, e.kind, e.run, outcome, state and state[0], state and state[2]))
        return pd.DataFrame(out, columns=told.names)

    return own.join(before, ["server", "part"]).groupBy("server", "part").applyInPandas(judge, told)
