"""Sources that are split: line numbers over splits, archives by entry, versions with several writers; and checks that carry places."""

from __future__ import annotations

import difflib
import json
import random
import threading
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from collatio.functions import align
from collatio.operators import bags, export, ledger, trials, validation
from collatio.sources import archives, records, usfm, versions


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_line_numbers_over_splits(spark, small_splits, tmp_path):
    r = random.Random(2)
    for name, ends in (("a.jsonl", "\n"), ("b.jsonl", "\r\n")):
        lines = ["" if r.random() < 0.1 else "  " if r.random() < 0.1 else json.dumps({"k": k, "x": "é" * r.randint(0, 60)}, ensure_ascii=False) for k in range(4000)]
        (tmp_path / name).write_bytes(ends.join(lines).encode())
        want = [(json.loads(x)["k"], n) for n, x in enumerate(lines, 1) if x.strip()]
        found = records.read_jsonl(spark, [str(tmp_path / name)], "k long, x string")
        assert found.rdd.getNumPartitions() > 1 and spark.read.text(str(tmp_path / name)).rdd.getNumPartitions() > 5
        assert sorted((x.k, x._ord.line_no) for x in found.collect()) == want
        assert found.filter("k >= 0").count() == len(want)
    both = records.read_jsonl(spark, [str(tmp_path / "b.jsonl"), str(tmp_path / "a.jsonl")], "k long, x string").groupBy("_ord.file").count().collect()
    assert sorted(x.file for x in both) == [0, 1]
    (tmp_path / "bad.jsonl").write_text('{"k": 1}\n' * 3000 + '\n{"k": "x"}\n' + '{"k": 1}\n' * 3000)
    with pytest.raises(Exception, match="invalid record at line 3002 of file 0"):
        records.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "k long").collect()
    (tmp_path / "none.jsonl").write_text("")
    assert records.read_jsonl(spark, str(tmp_path / "none.jsonl"), "k long").collect() == []


def test_archives_are_read_by_entry(spark, tmp_path):
    r, want = random.Random(4), {}
    for a in range(2):
        with zipfile.ZipFile(tmp_path / f"{a}.zip", "w") as z:
            for k in range(40):
                data = r.randbytes(r.randint(0, 3000)) if k % 3 else b"words " * 500
                name = f"d{k % 4}\\{k}.usfm" if k % 5 == 0 else f"d/é{k}.{'SFM' if k % 2 else 'txt'}"
                z.writestr(name, data, zipfile.ZIP_STORED if k % 4 == 0 else zipfile.ZIP_DEFLATED)
                if not name.endswith("txt"):
                    want[f"{tmp_path}/{a}.zip", name] = data
    paths = [str(tmp_path / f"{a}.zip") for a in range(2)]
    found = archives.read_entries(spark, paths, (".usfm", ".sfm"), 8000)
    assert found.rdd.getNumPartitions() > 6
    assert {(x.archive, x.path): bytes(x.content) for x in found.collect()} == want
    assert sorted(x.path for x in usfm.read_zip(spark, paths).select("path").collect()) == sorted(n.replace("\\", "/") for _, n in want)
    broken = bytearray((tmp_path / "0.zip").read_bytes())
    broken[60] ^= 0xFF
    (tmp_path / "broken.zip").write_bytes(broken)
    with pytest.raises(Exception, match="damaged|invalid|Error"):
        archives.read_entries(spark, str(tmp_path / "broken.zip")).collect()


def test_versions_have_one_writer_each(spark, tmp_path):
    store, folder = versions.Versions(spark, str(tmp_path / "v")), tmp_path / "v"
    assert store.read() == (0, None)
    assert store.commit({"n": 0}, 0) == 1
    with pytest.raises(versions.Conflict):
        store.commit({"n": 99}, 0)
    assert store.read() == (1, {"n": 0})
    (folder / ".left-behind.part").write_text("{")

    def work():
        own = versions.Versions(spark, str(folder))
        for _ in range(10):
            own.update(lambda d: {"n": d["n"] + 1, "text": "é" * 1000})

    writers = [threading.Thread(target=work) for _ in range(3)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert store.read() == (31, {"n": 30, "text": "é" * 1000})
    assert [store.read(k)[1]["n"] for k in range(1, 32)] == list(range(31))
    assert [x.name for x in folder.glob(".*.part")] == [".left-behind.part"]


def test_bags(spark):
    r = random.Random(1)
    sides = [[(k, r.choice(["a", "b", None]), r.choice([1, 2, None])) for k in range(n)] + [(1000 + k, "hot", 7) for k in range(300 + n)] for n in (120, 90)]
    left, right = (spark.createDataFrame(s, "id long, a string, b int").repartition(4) for s in sides)
    counts = [Counter((a, b) for _, a, b in s) for s in sides]
    keys = set(counts[0]) | set(counts[1])
    assert {((x.a, x.b), x.matched, x.left_surplus, x.right_surplus) for x in bags.balance(left, right, ["a", "b"]).collect()} == {(k, min(counts[0][k], counts[1][k]), max(0, counts[0][k] - counts[1][k]), max(0, counts[1][k] - counts[0][k])) for k in keys}
    pairs = bags.paired(left, right, ["a", "b"], "id", "id").collect()
    assert sorted(x.left_id for x in pairs if x.left_id is not None) == sorted(i for i, _, _ in sides[0])
    assert sorted(x.right_id for x in pairs if x.right_id is not None) == sorted(i for i, _, _ in sides[1])
    assert len(pairs) == sum(max(counts[0][k], counts[1][k]) for k in keys)
    names = dict((i, (a, b)) for i, a, b in sides[0])
    assert all(names[x.left_id] == (x.a, x.b) for x in pairs if x.left_id is not None)
    export_ = spark.createDataFrame([(1, 2, 3, 4, 10), (1, 2, 3, 4, 11), (1, None, 3, 4, 8)], "input_tokens int, output_tokens int, cache_read_tokens int, cache_write_tokens int, total_tokens int")
    assert sorted(x.total_tokens for x in bags.unbalanced_rows(export_).collect()) == [8, 11]


def test_display_alignment(spark):
    """The spans of the usual matcher, on random pairs."""
    r = random.Random(6)
    for k in range(1500):
        a, b = (r.choices("abcdefgh"[: r.randint(1, 8)], k=r.randint(0, 25)) for _ in "ab")
        blocks = [(m.a, m.b, m.size) for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size]
        merged: list[tuple[int, int, int]] = []
        for i, j, n in align.common_runs(a, b):
            if merged and merged[-1][0] + merged[-1][2] == i and merged[-1][1] + merged[-1][2] == j:
                merged[-1] = (*merged[-1][:2], merged[-1][2] + n)
            else:
                merged.append((i, j, n))
        assert merged == blocks
    rows = spark.createDataFrame([("the cat sat", "the dog sat"), (None, "x"), ("", "")], "e string, o string")
    found = rows.select(align.display_alignment("e", "o").alias("a")).collect()
    assert [(w.word, w.changed) for w in found[0].a.output] == [("the", False), ("dog", True), ("sat", False)]
    assert found[1].a.expected is None and found[2].a.expected == []
    words = [str(r.random()) for _ in range(30_000)]
    assert len(align.common_runs(words, words)) == 1


EDITION = "id string, edition string, license_kind string, license_url string, source_url string, redistribute_reference_text boolean, ord long"
REFERENCE = "translation string, book string, chapter int, verse_start int, verse_end int, text string, ord long"
CASE = "case_id string, translation string, book string, chapter int, verse_start int, verse_end int, stratum string, ord long"


def test_the_first_violation_in_the_order_of_files(spark):
    good = [("e1", "1", "public_domain", "u", "u", True), ("e2", "1", "public_domain", "u", "u", True)]
    refs = [("e1", "B", 1, k, None, f"text {k}") for k in range(1, 6)]
    own = [(f"c{k}", "e1", "B", 1, k, None, "random") for k in range(1, 6)]

    def first(editions=good, references=refs, cases=own, version=None):
        frames = [spark.createDataFrame([(*row, k) for k, row in enumerate(rows)], schema).coalesce(2) for rows, schema in ((editions, EDITION), (references, REFERENCE), (cases, CASE))]
        found = validation.first_violation(validation.dataset_violations(frames[2], frames[1], frames[0], version)).collect()
        return (found[0].rule, found[0].ord) if found else None

    put = lambda rows, at, **new: [tuple(new.get(str(j), v) for j, v in enumerate(row)) if k == at else row for k, row in enumerate(rows)]
    assert first() is None
    assert first(version=2) == ("catalog_version", 0)
    # A later file's fault waits for an earlier one's, an earlier record's comes first, and within a record the rules go in order.
    bad_case, bad_ref = put(own, 0, **{"0": " "}), put(refs, 4, **{"5": " padded"})
    assert first(cases=bad_case, references=put(bad_ref, 2, **{"5": "\\w x "})) == ("reference_edges", 2)
    assert first(references=[*refs[:3], refs[1], *put(refs[3:], 1, **{"5": ""})]) == ("reference_duplicate", 3)
    assert first(editions=[*good, ("e1", "", "public_domain", "u", "u", True)], references=bad_ref) == ("catalog_duplicate_id", 2)
    assert first(editions=[], cases=bad_case) == ("catalog_none", 0)
    with pytest.raises(ValueError, match="case_empty_id"):
        frames = [spark.createDataFrame([(*row, k) for k, row in enumerate(rows)], schema) for rows, schema in ((good, EDITION), (refs, REFERENCE), (bad_case, CASE))]
        validation.require_valid(validation.dataset_violations(frames[2], frames[1], frames[0]))


def test_totals_and_bounds(spark):
    scores = spark.createDataFrame([("m", 1, 2, None), ("m", 3, 0, 1)], "model string, insertions int, deletions int, substitutions int")
    assert [tuple(r) for r in trials.edit_totals(scores, "model").collect()] == [("m", 2, 4, 2, 1)]
    kept = spark.createDataFrame([("a", 5), ("a", 6), ("b", 20)], "run string, reserved long")
    assert sorted(tuple(r) for r in ledger.upper_bound(kept, 11, "run").collect()) == [("a", 2, 11, True), ("b", 1, 20, False)]
    assert [r.within for r in ledger.upper_bound(kept.limit(0), 0).collect()] == [True]
    most = spark.createDataFrame([("9" * 38,)] * 2, "reserved string").withColumn("reserved", F.col("reserved").cast("decimal(38,0)"))
    assert [(r.reserved, r.within) for r in ledger.upper_bound(most, 10**18).collect()] == [(None, False)]
    interval = {"estimate": 0.5, "lower": 0.4, "upper": 0.6, "clusters": 3, "resamples": 500}
    study = {"schema_version": 2, "track": "canonical", "evidence": "live_provider", "models": {"m": {"repetitions": 1, "cases_per_run": 1, "exact_text": interval, "exact_words": {**interval, "resamples": 99}}}}
    assert export.artifact_faults(study) == ["m: invalid interval of exact_words"]
