"""Whole studies in one call: a trial's end, its audit, and the synthetic study; the same inputs give the same files."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from collatio.operators import audit, finish, runs, synthetic
from collatio.plans import fixture

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark):
    d = fixture.dataset(spark, SF)
    few = d.cases.select("ref_label").distinct().orderBy("ref_label").limit(8)
    cases = runs.settled(d.cases.join(few, "ref_label"))
    refs = runs.settled(d.references.join(cases.select("translation", "book", "chapter", "verse_start"), ["translation", "book", "chapter", "verse_start"], "left_semi"))
    return cases, refs, d.editions


def contents(folder):
    """Files by what they are: Spark's own names of parts differ between runs."""
    return sorted((str(p.relative_to(folder).parent) if p.name.startswith("part-") else str(p.relative_to(folder)), p.read_bytes()) for p in folder.rglob("*") if p.is_file() and not p.name.startswith((".", "_")))


def test_a_trial_is_finished_and_audited(spark, small, tmp_path):
    cases, refs, editions = small
    own = cases.filter("translation = 'ed_a'").drop("text", "pos")
    answers = own.join(refs.select("translation", "book", "chapter", "verse_start", "text"), ["translation", "book", "chapter", "verse_start"]).select("case_id", F.when(F.col("ord") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit(" and more"))).alias("output"))
    answers = runs.settled(answers)
    identity = {"run_id": "t-1", "model": "m"}
    found = finish.finish(identity, answers, own, refs, str(tmp_path / "one"))
    assert found["summary"]["responses"] == own.count() and set(found["summary"]["classifications"]) == {"exact_requested", "extraneous_text"}
    finish.finish(identity, answers.repartition(3), own.repartition(2), refs, str(tmp_path / "two"))
    assert contents(tmp_path / "one") == contents(tmp_path / "two")
    for odd in (answers.limit(2), answers.unionByName(answers.limit(1)), answers.unionByName(answers.limit(1).withColumn("case_id", F.lit("z")))):
        with pytest.raises(ValueError, match="one answer to every"):
            finish.finish(identity, odd, own, refs, str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    # What was written passes the audit, and does not once an output or a figure changes.
    trial, said = json.loads((tmp_path / "one/trial.json").read_text()), json.loads((tmp_path / "one/report.json").read_text())["overall"]
    read = lambda name: spark.read.json(str(tmp_path / "one" / name))
    order = spark.createDataFrame(list(enumerate(trial["identity"]["expected_case_ids"])), "place int, case_id string")
    placed = lambda df: df.join(order, "case_id").withColumn("trial", F.lit("t"))
    saved = spark.createDataFrame([("t", trial["identity"]["evidence"], trial["identity"]["expected_case_ids"], said["responses"], said["mean_word_accuracy"], said["exact_text_rate"])], "trial string, evidence string, expected_case_ids array<string>, responses long, mean_word_accuracy double, exact_text_rate double")
    scores = placed(read("scores.jsonl")).withColumn("verse_end", F.lit(None).cast("int"))
    audited = lambda responses, scores_: {(r.rule, r.subject) for r in audit.bundle_faults(saved, placed(own), responses, scores_, refs, editions).collect()}
    responses = placed(read("responses.jsonl"))
    assert audited(responses, scores) == set()
    first = trial["identity"]["expected_case_ids"][0]
    changed = F.col("case_id") == first
    assert audited(responses.withColumn("output", F.when(changed, "x").otherwise(F.col("output"))), scores) == {("commitment", first)}
    assert audited(responses, scores.withColumn("insertions", F.col("insertions") + F.when(changed, 1).otherwise(0))) == {("word_error_rate", first)}
    assert {r for r, _ in audited(responses.filter(~changed), scores)} == {"order"}


def test_tracks_of_a_pilot(spark, small):
    cases, refs, editions = small
    own, texts = (runs.settled(x) for x in synthetic.tracks(cases, refs, editions, 4))
    counts = {r.track: (r.n, r.last) for r in own.groupBy("track").agg(F.count(F.lit(1)).alias("n"), F.max("ord").alias("last")).collect()}
    assert {t: counts[t] for t in synthetic.VARIANTS} == {t: (12, 11) for t in synthetic.VARIANTS}
    assert counts["passage"][0] in (3, 6, 9, 12)
    found = {(r.track, r.model): r for r in synthetic.by_track(own, texts, synthetic.responses(own, texts), 100).collect()}
    assert {t for t, _ in found} == {*synthetic.VARIANTS, "passage"}
    assert [(k, r) for k, r in found.items() if not -1e-9 <= r.lower <= r.estimate + 1e-9 <= r.upper + 2e-9 <= 1 + 4e-9] == []
    assert min(r.estimate for (t, _), r in found.items() if t == "copy_control") > 0.7


@pytest.mark.skipif(not os.environ.get("COLLATIO_SLOW_TESTS"), reason="takes two minutes a track")
def test_the_synthetic_study(spark, small, tmp_path):
    cases, refs, editions = small
    own, texts = (runs.settled(x) for x in synthetic.tracks(cases, refs, editions, 4))
    found = synthetic.study(cases, refs, editions, str(tmp_path), 4, 100, only=("copy_control",))
    estimates = {(r.track, r.model): r.estimate for r in synthetic.by_track(own, texts, synthetic.responses(own, texts), 100).collect()}
    for track, s in found.items():
        for name, m in s["models"].items():
            assert abs(m["exact_text"]["estimate"] - estimates[track, name.split(" / ")[1]]) < 1e-12
            assert m["repetitions"] == 3
    assert sorted(x.name for x in tmp_path.iterdir()) == ["README.md", "copy_control", "index.html"]
    assert "| [copy_control](copy_control/analysis.md) |" in (tmp_path / "README.md").read_text()
