"""Files of token ids: every document comes back by its key, and the hash is minimal and perfect."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from collatio.llm import tokenfiles

_R = random.Random(9)
TEXTS = [None, "", "one", "two words", "É Ünï", "w " * 40_000, "same", "same", "\n\t", "<|endoftext|> x"] + [" ".join(_R.choices(["alpha", "beta", "gamma,", "12"], k=_R.randint(0, 60))) for _ in range(200)]


@pytest.fixture(autouse=True)
def several_shards(spark):
    """Small tables would be put into one shard."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "f", 2) for i, t in rows], "doc_id long, text string, shard int, file string, copy int").repartition(5)


def ids_of(path):
    tokenizer = Tokenizer.from_file(path)
    return lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_documents_come_back(spark, tokenizer_path, tmp_path):
    rows = [(k * 7 - 300, t) for k, t in enumerate(TEXTS)]
    folder, ids = str(tmp_path / "f"), ids_of(tokenizer_path)
    tokenfiles.write(frame(spark, rows), tokenizer_path, folder)
    found = {r.id: (r.copy, r.start, r.n_tokens, r.ids_crc32, list(r.ids)) for r in tokenfiles.read(tokenfiles.keys(spark, folder), folder, with_ids=True).collect()}
    start, expected = 0, {}
    for key, text in sorted(rows):
        own = ids(text)
        expected[key] = (0, start, len(own), crc(own), own)
        start += len(own)
    assert found == expected
    shards = pq.read_table(f"{folder}/shards").to_pylist()
    assert len(shards) > 1 and sum((tmp_path / "f/data" / s["file"]).stat().st_size for s in shards) == 2 * start
    reader = tokenfiles.Reader(folder)
    assert all(reader.get(k).tolist() == v[4] for k, v in expected.items())
    assert reader.get(10**9) is None and reader.get(None) is None and reader.get(rows[0][0], 1) is None
    foreign = spark.createDataFrame([(k, 0) for k in range(5000, 5400)], "id long, copy long")
    assert tokenfiles.lookup(foreign, folder).filter("shard is not null").count() == 0


def test_repeated_and_null_ids(spark, tokenizer_path, tmp_path):
    """Copies of an id are numbered over all shards, whatever part of the rows they are; starts have no gap."""
    rows = [(4, TEXTS[3])] * 300 + [(None, t) for t in TEXTS[:40]] + [(4, t) for t in TEXTS[:40]] + [(9, "tail")]
    folder, ids = str(tmp_path / "f"), ids_of(tokenizer_path)
    tokenfiles.write(frame(spark, rows), tokenizer_path, folder)
    found = tokenfiles.read(tokenfiles.keys(spark, folder), folder).orderBy("start").collect()
    assert Counter((r.id, r.n_tokens, r.ids_crc32) for r in found) == Counter((i, len(ids(t)), crc(ids(t))) for i, t in rows)
    assert [r.start for r in found] == np.cumsum([0, *(r.n_tokens for r in found)])[:-1].tolist()
    assert [r.id for r in found] == [None] * 40 + [4] * 340 + [9]
    assert [r.copy for r in found] == [*range(40), *range(340), 0]


def test_no_rows_and_lost_attempts(spark, tokenizer_path, tmp_path):
    folder = str(tmp_path / "none")
    tokenfiles.write(frame(spark, []), tokenizer_path, folder)
    assert tokenfiles.read(tokenfiles.keys(spark, folder), folder).collect() == []
    assert tokenfiles.Reader(folder).get(1) is None
    folder = str(tmp_path / "some")
    tokenfiles.write(frame(spark, [(1, "a b")]), tokenizer_path, folder)
    (tmp_path / "some/data/of-a-lost-task.bin").write_bytes(b"x" * 99)
    assert [(r.start, r.n_tokens) for r in tokenfiles.read(tokenfiles.keys(spark, folder), folder).collect()] == [(0, 3)]


def test_names_of_other_types(spark, tokenizer_path, tmp_path):
    docs = spark.createDataFrame([("b", "one"), ("", "two"), (None, "three")], "name string, body string")
    folder = str(tmp_path / "f")
    tokenfiles.write(docs, tokenizer_path, folder, end_id=70_000, id_col="name", text_col="body")
    assert [r.id for r in tokenfiles.read(tokenfiles.keys(spark, folder), folder).orderBy("start").collect()] == [None, "", "b"]
    assert tokenfiles.Reader(folder).get("").tolist()[-1] == 70_000


@pytest.mark.parametrize("n", [0, 1, 2, 100, 40_000])
def test_minimal_perfect(n):
    rng = np.random.default_rng(n)
    h1, h2 = rng.integers(0, 1 << 63, n, dtype=np.uint64), rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
    values = [np.arange(n) % 1000, np.arange(n) * 3, np.arange(n) + 7]
    segment = tokenfiles.Segment.unpack(tokenfiles.Segment.build(h1, h2, values).pack())
    slots, there = segment._slots(h1, h2)
    assert there.all() and sorted(slots.tolist()) == list(range(n))
    there, found = segment.find(h1, h2)
    assert there.all() and all((a == b).all() for a, b in zip(found, values, strict=True))
    other = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    assert segment.find(other, other)[0].sum() == 0
    if n == 2:
        with pytest.raises(ValueError, match="equal hashes"):
            tokenfiles.Segment.build(np.array([5, 5], np.uint64), np.array([6, 6], np.uint64), [np.zeros(2, int)] * 3)


def test_hashes_are_alike_in_columns_and_python(spark):
    rows = spark.createDataFrame([(1, 0), (None, 3), (-5, 2)], "id long, copy long")
    for r in rows.select("id", "copy", *(v.alias(n) for n, v in tokenfiles._hashed(F.col("id"), F.col("copy")).items())).collect():
        assert (r.h1 % (1 << 64), r.h2 % (1 << 64)) == tokenfiles.key_hashes(tokenfiles.key_text(r.id, r.copy))
