"""The stages one after another, each judged on its own input."""

from __future__ import annotations

import brute
import pytest

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path, tokenizer_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "secret_scans", "best_fit_packing"]
    seen = [docs]
    for name, stage in pipeline.STAGES:
        out = stage(spark, seen[-1], SF)
        out.write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
    for s in seen[1:-1]:
        assert s.columns == docs.columns
    rows = [{r.doc_id: r.text for r in s.select("doc_id", "text").collect()} for s in seen[:-1]]
    for i, t in rows[0].items():
        n, _, _, _, repeated = brute.quality(t)
        assert not (i in rows[1] and (n < 20 or 100 * repeated > 30 * n))
    ids = sorted(rows[1])
    roots = brute.components(ids, [brute.simhash(rows[1][i]) for i in ids])
    assert set(rows[2]) == set(roots)
    assert set(rows[3]) == {i for i, t in rows[2].items() if not brute.contamination(t, items)[1]}
    assert set(rows[4]) == set(rows[3])
    for i, t in rows[3].items():
        if not any(brute.secrets(t)[:3]):
            assert rows[4][i] == t
        else:
            assert not any(brute.secrets(rows[4][i])[:3])
    packed = seen[-1].collect()
    tokenizer = Tokenizer.from_file(tokenizer_path)
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == sorted((i, *p) for i, t in rows[4].items() for p in brute.pieces(t, tokenizer))


def test_prose_that_mentions_boilerplate_stays(spark):
    """Phrases inside of words, or in few of a line's words, do not fail a line; lines made of them go."""
    prose = "The mayor said on Tuesday that the privacy policy of the town library is to be read by all who borrow books there, and then went home."
    inside = "We oneshare onealy met and bread more often than that was baked in the old mill by the river, as people said, for many years."
    data = [(1, prose), (2, inside), (3, f"{prose}\nAll rights reserved.\nClick here to sign up!\n{inside}")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    found = {r.doc_id: r.text for r in pipeline.quality_rules(spark, docs, SF).collect()}
    assert found == {1: prose, 2: inside, 3: f"{prose}\n{inside}"}


PROSE = "The mayor of the old town said on Tuesday, after a long meeting, that a new bridge is to be built over the river by next spring."
ODD = [
    (None, PROSE, "en", None, 9), (1, None, None, "a", None), (2, "", "en", "a", 0), (3, PROSE, "en", "b", 1), (3, PROSE, "en", "b", 1), (4, f"{PROSE}\n\nIt was late.", None, None, None),
    (5, " ".join(f"word{k}, and" for k in range(30_000)), "en", "b", 5), (6, f"{PROSE} password = hunter22", "en", "c", 1), (None, None, None, None, None),
]
CLASHES = ("__id", "__h", "__words", "__lines", "__q_kept", "__key", "key", "id", "h", "words", "good", "kept", "best", "spans", "items", "n_words", "piece", "fp", "__c0")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, *(f"{n}-{k}" for n in CLASHES)) for k, r in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in CLASHES))


@pytest.mark.parametrize("stage", [f for _, f in pipeline.STAGES[:4]], ids=[n for n, _ in pipeline.STAGES[:4]])
def test_stages_on_odd_rows(spark, odd, stage, tmp_path):
    out = stage(spark, odd, SF)
    assert out.columns == odd.columns
    got = out.collect()
    by = {r["key"]: r for r in got}
    before = {f"key-{k}": r for k, r in enumerate(ODD)}
    assert set(by) <= set(before)
    for key, r in by.items():  # all columns of a row stay together
        assert all(r[n] == key.replace("key", n) for n in CLASHES)
        assert (r.doc_id, r.lang, r.source) == (before[key][0], *before[key][2:4])
    name = stage.__name__
    texts = sorted(((r.doc_id, r.text) for r in got), key=str)
    if name == "quality_rules":
        assert texts == sorted(((i, t) for i, t, *_ in ODD if t), key=str)
    elif name == "near_dedup":
        prints = [brute.simhash(t) for _, t, *_ in ODD]
        assert len(got) == len(set(brute.components(list(range(len(ODD))), prints)))
        assert {(3, PROSE), (1, None)} <= set(texts)  # null ids come last in their groups
    elif name == "decontaminate":
        assert texts == sorted(((i, t) for i, t, *_ in ODD), key=str)
    else:
        assert len(got) == len(ODD)
        assert (6, f"{PROSE} [secret]") in texts and (1, None) in texts
    assert stage(spark, odd.limit(0), SF).collect() == []


def test_packing_odd_rows(spark, odd, tokenizer_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    got = pipeline.pack(spark, odd, SF).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(((i, *p) for i, t, *_ in ODD for p in brute.pieces(t, tokenizer)), key=str)
    assert pipeline.pack(spark, odd.limit(0), SF).collect() == []
