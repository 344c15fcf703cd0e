"""State over events: streams agree with their batch forms, also when they go on from a checkpoint; a log judges alike however it is cut."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from collatio.operators import ledger, sessions, switching
from collatio.streaming import ledger as ledger_stream
from collatio.streaming import sessions as session_stream

WAIT = 60_000


@pytest.fixture
def rocks(spark):
    """Timers and first states need this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(stream, folder, name) -> None:
    query = stream.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-at").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(200)
    assert not query.isActive


LOG = "run string, at timestamp, seq long, kind string, place int, case_id string, reserved long, observed long"


def requests_log():
    r, rows = random.Random(3), []
    for run_ in ("a", "b", "c"):
        at, seq = 1_700_000_000, 0
        for place in range(12):
            rows.append((run_, at, seq, "reserve", place, f"c{place}", 100 + place, None))
            fate = r.choice(["settled", "settled", "unknown", "never", "late", "resumed", "again"])
            if fate in ("settled", "unknown", "again"):
                rows.append((run_, at + 20, seq + 3, "settle", place, None, None, 90 if fate == "settled" else None))
            if fate == "late":
                rows.append((run_, at + 61, seq + 3, "settle", place, None, None, 50))
            if fate == "resumed":
                rows += [(run_, at + 5, seq + 1, "resume", None, None, None, None), (run_, at + 9, seq + 2, "settle", place, None, None, 7)]
            if fate == "again":
                rows.append((run_, at + 30, seq + 4, "reserve", place, f"c{place}", 999, None))
            at, seq = at + 40, seq + 10
        rows.append((run_, at, seq, "settle", 99, None, None, 5))
    return sorted(rows, key=lambda x: x[1])


def told(rows):
    return Counter((r.run, r.place, r.case_id, r.state, r.charged, r.reservation_retained, r.account, r.error) for r in rows)


def test_requests_of_a_log(spark):
    """Interrupted requests keep their reservation; an account is what is settled and reserved."""
    rows = [("x", 0, 0, "reserve", 0, "a", 100, None), ("x", 10, 1, "settle", 0, None, None, 70), ("x", 20, 2, "reserve", 1, "b", 100, None), ("x", 30, 3, "resume", None, None, None, None), ("x", 31, 4, "settle", 1, None, None, 1),
            ("x", 40, 5, "reserve", 2, "c", 50, None), ("x", 41, 6, "settle", 2, None, None, None), ("x", 50, 7, "reserve", 3, "d", 10, None), ("x", 200, 8, "settle", 3, None, None, 2)]
    log = spark.createDataFrame(rows, LOG.replace("timestamp", "long")).selectExpr("run", "timestamp_seconds(at) at", "seq", "kind", "place", "case_id", "reserved", "observed")
    found = {r.place: (r.state, r.charged, r.account, r.reservation_retained) for r in ledger.requests(log, WAIT).collect()}
    assert found == {0: ("settled", 70, 70, False), 1: ("interrupted", 100, None, True), 2: ("uncertain", 50, 220, True), 3: ("interrupted", 10, None, True)}
    assert ledger.requests(log.limit(0), WAIT).collect() == []


def test_interrupted_requests_as_a_stream(spark, rocks, tmp_path):
    rows = requests_log()
    frame = lambda some: spark.createDataFrame(some, LOG.replace("timestamp", "long")).selectExpr("run", "timestamp_seconds(at) at", "seq", "kind", "place", "case_id", "reserved", "observed")
    expected = told(ledger.requests(frame(rows), WAIT).collect())
    assert {s for _, _, _, s, *_ in expected} == {"settled", "uncertain", "interrupted"}
    stream = lambda: ledger_stream.stream_requests(spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), WAIT, "5 seconds")
    cut = len(rows) // 2
    frame(rows[:cut]).coalesce(1).write.parquet(str(tmp_path / "in"))
    run(stream(), tmp_path, "out")
    half = told(spark.read.parquet(str(tmp_path / "out")).collect())
    assert 0 < half.total() < expected.total() and half <= expected
    # The second half goes on from the checkpoint; an event far ahead moves the stream's time past every deadline.
    frame([*rows[cut:], ("end", rows[-1][1] + 1000, 0, "resume", None, None, None, None)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run(stream(), tmp_path, "out")
    assert told(spark.read.parquet(str(tmp_path / "out")).collect()) == expected


STEPS = "session string, seq long, kind string, case_id string, answer string"


def session_log():
    rows, plan = [], []
    for s in range(6):
        plan += [(f"s{s}", k, f"c{k}") for k in range(4)]
        r, seq = random.Random(s), 0
        for _ in range(40):
            kind = r.choice(["issue", "issue", "answer", "answer", "answer", "finish", "answer"])
            rows.append((f"s{s}", seq, kind, f"c{r.randint(0, 4)}" if kind == "answer" else None, r.choice(["one", "two", None, "", "z" * 20_000]) if kind == "answer" else None))
            seq += 1
    return rows, plan


def plain_steps(rows, plan):
    """The rules, spelled out."""
    out, state = [], {}
    for session, seq, kind, case, answer in sorted(rows, key=lambda r: (r[0], r[1])):
        cases = [c for s, _, c in plan if s == session]
        if not cases:
            continue
        own = state.setdefault(session, {"answers": {}, "out": False, "finished": False})
        done = len(own["answers"])
        if kind == "issue":
            own["out"] = own["out"] or (done < len(cases) and not own["finished"])
            out.append((session, seq, kind, cases[done] if own["out"] else None, "issued" if own["out"] else "complete"))
        elif kind == "finish":
            own["finished"] = own["finished"] or done == len(cases)
            out.append((session, seq, kind, None, "finished" if own["finished"] else "incomplete"))
        else:
            text = answer or ""
            if len(text) > 16_384:
                outcome = "too_long"
            elif case in own["answers"]:
                outcome = "repeated" if own["answers"][case] == text else "conflict"
            elif not own["out"] or cases[done] != case:
                outcome = "not_issued"
            else:
                outcome, own["out"] = "accepted", False
                own["answers"][case] = text
            out.append((session, seq, kind, case, outcome))
    return out


def test_sessions_in_batch_and_stream(spark, rocks, tmp_path):
    """Answers out of order are rejected alike, and a stream goes on from its checkpoint."""
    rows, plan = session_log()
    rows.append(("stranger", 0, "issue", None, None))
    plans = spark.createDataFrame(plan, "session string, place long, case_id string")
    log = spark.createDataFrame(rows, STEPS).repartition(3)
    expected = sorted(plain_steps(rows, plan), key=lambda r: (r[0], r[1]))
    assert {r[4] for r in expected} >= {"issued", "accepted", "repeated", "conflict", "not_issued", "too_long", "incomplete"}
    key = lambda rows_: sorted(rows_, key=lambda r: (r[0], r[1]))
    assert key([(r.session, r.seq, r.kind, r.case_id, r.outcome) for r in sessions.steps(log, plans).collect()]) == expected
    stream = lambda: session_stream.stream_steps(spark.readStream.schema(STEPS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), plans)
    for part in (lambda q: q < 15, lambda q: q >= 15):
        spark.createDataFrame([r for r in rows if part(r[1])], STEPS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run(stream(), tmp_path, "out")
    assert key([(r.session, r.seq, r.kind, r.case_id, r.outcome) for r in spark.read.parquet(str(tmp_path / "out")).collect()]) == expected
    assert sessions.steps(log.limit(0), plans).collect() == []


def events(seed, n):
    r = random.Random(seed)
    return [(f"v{r.randint(0, 1)}", k, r.choice(["begin", "resume", "progress", "progress", "finish"]), f"r{r.randint(0, 2)}", r.choice(["x", "y"]), r.random() < 0.4, r.choice(["fresh", "busy", "finished"]), r.random() < 0.6) for k in range(n)]


def test_effects_are_the_steps():
    """A part's map gives, for any state before it, what its events give one by one; maps of parts put together are the map of the whole."""
    states = [None] + [(run_, t, far) for run_ in ("r0", "r1", "r2", "q") for t in "xy" for far in ("fresh", "busy", "finished")]
    for seed in range(150):
        own = [switching.Event(*e[2:]) for e in events(seed, 14)]
        whole, halves = switching.effect(own), [switching.Effect.load(switching.effect(x).dump()) for x in (own[:6], own[6:])]
        for first in states:
            state = first
            for e in own:
                _, state = switching.step(state, e)
            assert whole.of(first) == state == halves[1].of(halves[0].of(first))


@pytest.mark.parametrize("part", [1, 7, 4096])
def test_a_log_is_judged_alike_however_it_is_cut(spark, part):
    rows = events(5, 200)
    log = spark.createDataFrame(rows, "server string, seq long, kind string, run string, settings string, saved boolean, progress string, complete boolean").repartition(5)
    expected = []
    for server in ("v0", "v1"):
        state = None
        for e in rows:
            if e[0] == server:
                outcome, state = switching.step(state, switching.Event(*e[2:]))
                expected.append((server, e[1], outcome, state and state[0], state and state[2]))
    found = sorted((r.server, r.seq, r.outcome, r.active, r.state) for r in switching.judged(log, part).collect())
    assert found == expected
    assert {r[2] for r in expected} >= set(switching.FAULTS) - {"no_trial"}
