"""Manifests, run checks and the validated analysis: faults are found, and valid runs pass."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from collatio.functions import digests
from collatio.operators import export, runs, statistics, trials
from collatio.plans import fixture

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def study(spark):
    d = fixture.dataset(spark, SF)
    few = d.cases.select("ref_label").distinct().orderBy("ref_label").limit(6)
    cases, refs = d.cases.join(few, "ref_label").cache(), d.references.join(d.cases.join(few, "ref_label").select("translation", "book", "chapter", "verse_start"), ["translation", "book", "chapter", "verse_start"]).cache()
    responses = fixture.set_up(d.responses).join(cases.select("case_id"), "case_id").cache()
    return cases, refs, d.editions, responses, fixture.configs(responses)


def test_digests_as_json_gives_them(study):
    cases, refs, editions, responses, _ = study
    rows = [json.dumps({"case_id": r.case_id, "translation": r.translation, "reference": {"book": r.book, "chapter": r.chapter, "verse_start": r.verse_start}, "stratum": r.stratum, "prompt_variant": r.prompt_variant}, separators=(",", ":"), ensure_ascii=False) for r in cases.orderBy("ord").collect()]
    found = runs.dataset_digests(cases, refs, editions).first()
    assert found.cases_sha256 == hashlib.sha256(f"[{','.join(rows)}]".encode()).hexdigest()
    by_run = {r.run_id: r.responses_sha256 for r in runs.response_digests(responses).collect()}
    assert len(by_run) == 6 and len(set(by_run.values())) == 6


def test_digest_of_no_rows(spark):
    none = spark.createDataFrame([], "o int, v string")
    assert digests.ordered_digest(none, F.col("v"), F.col("o")).first()[0] == hashlib.sha256(b"[]").hexdigest()
    assert digests.ordered_digest(none, F.col("v"), F.col("o"), lines=True).first()[0] == hashlib.sha256(b"").hexdigest()
    files = spark.createDataFrame([("b", b"2"), ("a", b"1")], "path string, content binary")
    assert digests.file_set_digest(files).first()[0] == hashlib.sha256(b"a\0" + b"1\0" + b"b\0" + b"2\0").hexdigest()


def test_a_valid_study(study, tmp_path):
    cases, refs, editions, responses, configs = study
    manifests = runs.make_manifests(configs, cases, refs, editions, responses, "synthetic_fixture")
    assert runs.manifest_violations(manifests, responses, cases, refs, editions).collect() == []
    named = runs.identities(manifests, responses)
    assert runs.comparability_violations(named).collect() == []
    found = runs.analyze(cases, refs, editions, manifests, responses, 100)
    assert (found.track, found.evidence) == ("canonical", "synthetic_fixture")
    assert [r.repetitions for r in found.models.collect()] == [3, 3]
    assert all(0 <= r.exact_text_lower <= r.exact_text_estimate <= r.exact_text_upper <= 1 for r in found.models.collect())
    assert found.comparisons.count() == 1
    written = export.export_study(found, str(tmp_path))
    assert sorted(x.name for x in tmp_path.iterdir()) == ["analysis.html", "analysis.json", "analysis.md", "examples.jsonl"]
    assert json.loads((tmp_path / "analysis.json").read_text()) == json.loads(json.dumps(written))
    assert len((tmp_path / "examples.jsonl").read_text().splitlines()) == len(written["examples"])
    text = (tmp_path / "analysis.md").read_text()
    assert all(x in text for x in ("## Paired comparisons", "## Annotated failures", "### Stability", "3 complete repetitions"))
    assert "</script><script>" not in (tmp_path / "analysis.html").read_text().split('id="data">')[1].split("</script>")[0]
    assert export.artifact_faults(written) == []
    bad = {**written, "track": "?", "models": {"m": {"repetitions": 1, "cases_per_run": 1, "exact_text": {"estimate": 2, "lower": 0, "upper": 1, "clusters": 3}, "exact_words": written["models"][next(iter(written["models"]))]["exact_words"]}}}
    assert export.artifact_faults(bad) == ["unknown track or evidence", "m: invalid interval of exact_text"]
    with pytest.raises(ValueError, match="unknown track"):
        export.study_page([bad])


def test_faults_stop_the_analysis(study):
    cases, refs, editions, responses, configs = study
    manifests = runs.make_manifests(configs, cases, refs, editions, responses, "synthetic_fixture").cache()
    with pytest.raises(ValueError, match="resamples"):
        runs.analyze(cases, refs, editions, manifests, responses, 10)
    with pytest.raises(ValueError, match="incomplete"):
        runs.analyze(cases, refs, editions, manifests, responses.filter("run_id <> 'a-0'"), 100)
    changed = cases.withColumn("stratum", F.lit("random"))
    assert {(r.run_id, r.rule) for r in runs.manifest_violations(manifests, responses, changed, refs, editions).collect()} == {(f"{m}-{k}", "digest") for m in "ab" for k in range(3)}


def test_scoring_rejects(study):
    cases, refs, _, responses, _ = study
    with pytest.raises(ValueError, match="duplicate response"):
        runs.score_all(responses.unionByName(responses.limit(1)), cases, refs)
    with pytest.raises(ValueError, match="unknown case"):
        runs.score_all(responses.withColumn("case_id", F.concat("case_id", F.lit("?"))), cases, refs)
    assert runs.score_all(responses, cases, refs).count() == responses.count()


def test_settings_without_a_temperature_are_not_compared(spark):
    from collatio.operators import study

    models = spark.createDataFrame([("a", None, "none", 9), ("b", 0.5, "none", 9), ("c", 0.5, "none", 9), ("d", 0.5, "high", 9)], "model_key string, temperature float, reasoning_effort string, max_output_tokens int")
    found = {(r.left, r.right): r.reason for r in study.model_pairs(models).collect()}
    assert found[("a", "b")] == "effective sampling settings are unknown"
    assert found[("b", "c")] is None and found[("b", "d")] == "different requested generation settings"


def test_large_strata_draw_alike(spark):
    rows = spark.createDataFrame([(f"k{k % 2}", f"s{k % 3}", f"r{k:03}", (k * 37 % 11) / 11) for k in range(90)], "k string, stratum string, ref_label string, value double")
    one, other = (statistics.bootstrap(rows, 150, "k", most=most).orderBy("k").collect() for most in (1000, 0))
    assert [r.k for r in one] == [r.k for r in other] == ["k0", "k1"]
    assert all(abs(a[c] - b[c]) < 1e-12 for a, b in zip(one, other, strict=True) for c in ("estimate", "lower", "upper"))


def test_where_trials_go_on(spark):
    plan = spark.createDataFrame([(s, k, c) for s in "xyz" for k, c in enumerate("abc")], "session string, place int, case_id string")
    ledger = spark.createDataFrame([("x", 0, "a"), ("x", 1, "b"), ("y", 1, "b")], "session string, place int, case_id string")
    assert {r.session: (r.next, r.broken) for r in trials.resume_place(ledger, plan).collect()} == {"x": (2, False), "y": (1, True), "z": (0, False)}
    given = spark.createDataFrame([("x", "ab", (1, 2, 3)), ("x", None, None)], "session string, output string, execution struct<input_tokens:int,output_tokens:int,accounted_nanoeur:int>")
    assert [(r.answers, r.chars, int(r.accounted_nanoeur)) for r in trials.trial_totals(given).collect()] == [(2, 2, 3)]


def test_loaded_datasets_and_sinks(spark, tmp_path):
    from collatio.functions import text
    from collatio.operators import report, sampling, selection, validation
    from collatio.sources import records

    edition = {"id": "e", "name": "E", "abbreviation": "E", "edition": "1", "license_kind": "public_domain", "license_url": "u", "source_url": "u", "redistribute_reference_text": True}
    (tmp_path / "catalog.json").write_text(json.dumps({"schema_version": 1, "translations": [edition]}, indent=1))
    ref = {"book": "B", "chapter": 1, "verse_start": 2}
    (tmp_path / "cases.jsonl").write_text("\n" + json.dumps({"case_id": "c1", "translation": "e", "reference": ref, "stratum": "random"}) + "\n")
    (tmp_path / "refs.jsonl").write_text(json.dumps({"translation": "e", "reference": ref, "text": "words"}) + "\n")
    editions, cases, refs = records.load_dataset(spark, *(str(tmp_path / n) for n in ("catalog.json", "cases.jsonl", "refs.jsonl")))
    assert validation.dataset_violations(cases, refs, editions).collect() == []
    assert [(r.case_id, r.prompt_variant, r.verse_end, r.ord) for r in cases.collect()] == [("c1", "canonical", None, 2)]
    (tmp_path / "none.jsonl").write_text("\n")
    with pytest.raises(ValueError, match="no records"):
        records.load_dataset(spark, str(tmp_path / "catalog.json"), str(tmp_path / "none.jsonl"), str(tmp_path / "refs.jsonl"))
    rows = spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    records.write_jsonl(rows, str(tmp_path / "out"), ["k"])
    assert [json.loads(x) for f in (tmp_path / "out").glob("part-*") for x in f.read_text().splitlines()] == [{"k": 1, "v": "a"}, {"k": 2, "v": "b"}]
    records.write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2
    lines = spark.createDataFrame([('{"k":1,"x":2}',), ('{"k":1}',)], "line string")
    assert [r.unknown for r in records.unknown_keys(lines, records.schema_of("k int")).collect()] == [["x"]]
    assert rows.select(digests.json_digest(F.struct("k"))).first()[0] == hashlib.sha256(b'{"k":2}').hexdigest()
    assert len(spark.range(1).select(text.truncate_error(F.repeat(F.lit("x"), 3000))).first()[0]) == 1000
    classes = spark.createDataFrame([("m", "empty"), ("m", "empty"), ("m", "partial")], "model string, classification string")
    assert report.class_map(classes, "model").first().classifications == {"empty": 2, "partial": 1}
    picked = spark.createDataFrame([("B 1:2",), ("B 9:9",)], "ref_label string")
    assert [r.text for r in sampling.selected_records(refs, picked).collect()] == ["words"]
    assert selection.first_cases(cases, 1).count() == 1 and selection.first_cases(cases, 0).count() == 0


def test_locks_bind_the_corpus(spark):
    from collatio.sources import usfm

    files = spark.createDataFrame([("GEN.usfm", b"\\id GEN x\n\\c 1\n\\v 1 In the\n\\v 2-3 beginning.\n")], "path string, content binary")
    found = usfm.lock(files, usfm.import_edition(files, "e"), "e", "first", "https://example.org").first()
    lines = [{"translation": "e", "reference": {"book": "Genesis", "chapter": 1, "verse_start": 1}, "text": "In the"}, {"translation": "e", "reference": {"book": "Genesis", "chapter": 1, "verse_start": 2, "verse_end": 3}, "text": "beginning."}]
    assert found.corpus_sha256 == hashlib.sha256("".join(json.dumps(x, separators=(",", ":")) + "\n" for x in lines).encode()).hexdigest()
    assert (found.reference_count, found.edition, found.importer_version) == (2, "first", usfm.IMPORTER)


def test_null_answers_alike_in_batch_and_stream(spark, tmp_path):
    from collatio.operators import sessions
    from collatio.streaming.sessions import stream_answers

    log = spark.createDataFrame([("s", "i", 1, None), ("s", "i", 2, None), ("s", "i", 3, "x"), ("s", "j", 4, ""), ("s", "j", 5, None), ("s", "k", 6, "y" * 20_000), ("s", "k", 7, "z")], "session string, item string, seq long, answer string")
    batch = {r.seq: r.outcome for r in sessions.answers(log).collect()}
    assert batch == {1: "accepted", 2: "repeated", 3: "conflict", 4: "accepted", 5: "repeated", 6: "too_long", 7: "accepted"}
    log.coalesce(1).write.parquet(str(tmp_path / "log"))
    stream = stream_answers(spark.readStream.schema(log.schema).parquet(str(tmp_path / "log")))
    query = stream.writeStream.format("memory").queryName("null_answers").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.seq: r.outcome for r in spark.table("null_answers").collect()} == batch


def test_the_first_of_repeated_rows_counts(spark):
    """Where a run gives a case twice, the first by place in the file counts, not by its text."""
    from collatio.operators import report

    rows = [("p", "m", "m", "c", "r1", 1, "b", True), ("p", "m", "m", "c", "r1", 2, "a", False), ("p", "m", "m", "c", "r2", 3, "b", True)]
    scores = spark.createDataFrame([(*r, hashlib.sha256(r[6].encode()).hexdigest(), "partial") for r in rows], "provider string, model string, resolved_model string, case_id string, run_id string, line int, output string, exact_text boolean, response_sha256 string, classification string")
    found = report.stability(scores).first()
    assert (found.repeated_cases, found.mean_output_consistency, found.mean_exact_recall) == (1, 1.0, 1.0)


def test_pilot_gate(study, spark):
    from collatio.operators import pilot

    cases, _, editions, _, _ = study
    pilot.gate(cases, editions, 2)
    for odd, count, own in ((cases, 1, editions), (cases, 2, editions.withColumn("license_kind", F.lit("licensed_private"))), (cases.withColumn("case_id", F.lit("BQ-HID-1")), 2, editions)):
        with pytest.raises(ValueError, match="pilot needs"):
            pilot.gate(odd, own, count)
    with pytest.raises(ValueError, match="not enough"):
        pilot.gate(cases, editions, 7)
