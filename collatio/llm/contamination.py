"""Benchmark decontamination: Wu-Manber search for the windows of benchmark items in documents.

A text becomes its words, each with a space before and behind, in UTF-8. Patterns are the windows of
the items in that form, so occurrences start and end at words. The tables: how far a search may move
on for the block of bytes at hand, and, where it may not, the patterns that end in that block, which
are then compared directly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, shielded, small_batches, utf8, written

#: Lower-cases A-Z and makes a space of every ASCII byte that is no letter or digit.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))
#: Bytes of benchmark text whose tables are sent to the executors at once: a worker's tables take some 150 bytes for each.
TABLE_BYTES = 400_000


def spaced(text: bytes) -> bytes:
    words = text.translate(WORD_BYTES).split()
    return b" %s " % b" ".join(words) if words else b""


@dataclass
class Searcher:
    """Wu-Manber tables of the patterns whose shortest has `least` bytes."""

    least: int
    block: int
    shift: dict[bytes, int] = field(default_factory=dict)
    ends: dict[bytes, list[tuple[bytes, int]]] = field(default_factory=dict)

    @classmethod
    def of(cls, patterns: list[bytes]) -> "Searcher":
        least = min(map(len, patterns))
        self = cls(least, min(8, max(2, least // 2)))
        for number, p in enumerate(patterns):
            for end in range(self.block, least + 1):
                b = p[end - self.block : end]
                self.shift[b] = min(self.shift.get(b, least), least - end)
            self.ends.setdefault(p[least - self.block : least], []).append((p, number))
        return self

    def find(self, text: bytes) -> Iterator[tuple[int, int]]:
        """Every occurrence: (where it starts, number of the pattern)."""
        get, size, least, n, most = self.shift.get, self.block, self.least, len(text), self.least - self.block + 1
        at = least
        while at <= n:
            b = text[at - size : at]
            if move := get(b, most):
                at += move
                continue
            for p, number in self.ends[b]:
                if text.startswith(p, at - least):
                    yield at - least, number
            at += 1


@dataclass
class Windows:
    """The windows of some items: a searcher for each class of lengths, and the items of each window."""

    searchers: list[tuple[Searcher, list[bytes]]]
    items: dict[bytes, list[int]]
    ids: list

    @classmethod
    def of(cls, items: list[tuple[object, bytes]], words: int) -> "Windows":
        found: dict[bytes, list[int]] = {}
        for k, (_, text) in enumerate(items):
            own = text.translate(WORD_BYTES).split()
            for at in range(max(1, len(own) - words + 1) if own else 0):
                of = found.setdefault(b" %s " % b" ".join(own[at : at + words]), [])
                if not of or of[-1] != k:
                    of.append(k)
        classes: dict[int, list[bytes]] = {}
        for p in found:  # short patterns would shorten the moves of all others
            classes.setdefault(min(len(p), 32).bit_length(), []).append(p)
        return cls([(Searcher.of(ps), ps) for ps in classes.values()], found, [x for x, _ in items])

    def hits(self, text: bytes) -> tuple[int, int, set[int]]:
        """Of a spaced text: its words, its words inside an occurrence, the items that occur."""
        n, items, spans = max(0, text.count(b" ") - 1), set(), set()
        for searcher, patterns in self.searchers:
            for start, number in searcher.find(text):
                items.update(self.items[patterns[number]])
                spans.add((start, start + len(patterns[number])))
        if not spans:
            return n, [], items
        inside, till, first, at = [], 0, 0, 0
        for start, end in sorted(spans):
            if end > till:
                first, at = first + text.count(b" ", at, start), start
                inside.append((first, first + text.count(b" ", start, end) - 1))
                till = end
        return n, inside, items


def covered(spans: list[tuple[int, int]]) -> int:
    total = till = 0
    for start, end in sorted(spans):
        total += max(0, end - max(start, till))
        till = max(till, end)
    return total


def benchmark_blocks(benchmark: DataFrame, words: int, id_col: str, text_col: str, limit: int) -> Iterator[Windows]:
    """Tables for blocks of items of at most `limit` bytes, or one item; the driver holds a block at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).distinct().toLocalIterator():
        text = (row[1] or "").encode()
        if block and size + len(text) > limit:
            yield Windows.of(block, words)
            block, size = [], 0
        block.append((row[0], text))
        size += len(text)
    if block:
        yield Windows.of(block, words)


def search(docs: DataFrame, windows: Windows, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Each document's `n_words`, `spans` (first and end word of the places hit, flat) and `items` (ids of occurring items)."""
    kept = [id_col, *keep]
    out = T.StructType([*(docs.schema[c] for c in kept), T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))])
    shared = docs.sparkSession.sparkContext.broadcast(windows)

    def find(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        for batch in batches(rows):
            found = [windows.hits(spaced(t)) for t in utf8(batch.column(len(kept)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array([x[0] for x in found], pa.int64()), pa.array([[v for s in x[1] for v in s] for x in found], pa.list_(pa.int64())), pa.array([[windows.ids[k] for k in x[2]] for x in found], pa.list_(pa.string()))], names=out.names)

    small_batches(docs.sparkSession)
    return docs.select(*(F.col(c) for c in kept), F.col(text_col).cast("string").alias("__text")).mapInArrow(find, out)


_DIGEST = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def contamination(docs: DataFrame, benchmark: DataFrame, words: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", limit: int = TABLE_BYTES) -> DataFrame:
    """One row per document: words, words inside occurrences, items that occur.

    A benchmark over `limit` bytes is searched in blocks, each a pass over the documents, whose hits
    are then brought together. Null texts have no words. Items with a null id are found and count as
    words hit, but not as items. Repeated items count once, repeated documents each. Columns but the id
    and the text are left out. Texts without words are never hit; an empty benchmark hits nothing.
    """
    blocks = benchmark_blocks(benchmark, words, item_col, item_text_col, limit)
    first = next(blocks, Windows([], {}, []))
    own = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    more = next(blocks, None)
    if more is None:
        found = search(own, first, id_col)
        return _digest(found, id_col)
    # The same document is the same id and text; copies of a row get the same hits, and each gets its row back.
    keyed = own.withColumn("__key", _key(F.col(id_col), F.col("text")))
    counts = written(search(keyed, first, id_col, keep=("__key",)), "hits")
    hits = counts.filter(F.size("spans") > 0)
    for windows in chain((more,), blocks):
        hits = hits.unionByName(written(search(keyed, windows, id_col, keep=("__key",)).filter(F.size("spans") > 0), "hits"))
    counts = counts.select(id_col, "__key", "n_words")
    hits = hits.groupBy("__key").agg(F.flatten(F.collect_set("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    found = counts.join(hits, "__key", "left").select(id_col, "n_words", F.coalesce("spans", F.array().cast("array<bigint>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return _digest(found, id_col)


def _key(id_: Column, text: Column) -> Column:
    return F.sha2(F.to_json(F.struct(id_.cast("string").alias("id"), text.alias("text"))), 256)


def _digest(found: DataFrame, id_col: str) -> DataFrame:
    out = T.StructType([found.schema[id_col], *T._parse_datatype_string(_DIGEST).fields])

    def digest(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            hit = [covered(list(zip(s[::2], s[1::2], strict=True))) for s in batch.column(2).to_pylist()]
            items = [sorted({x for x in i if x is not None}) for i in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hit, pa.int64()), pa.array([len(i) for i in items], pa.int64()), pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in items]), pa.array(np.array(hit) > 0)], names=out.names)

    return found.select(id_col, "n_words", "spans", "items").mapInArrow(digest, out)


def decontaminated(docs: DataFrame, benchmark: DataFrame, words: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", limit: int = TABLE_BYTES) -> DataFrame:
    """`docs` without those that hold a window of a benchmark item.

    A benchmark over `limit` bytes is searched in blocks, each a pass over the documents; those hit by any are
    then left out at once. Null texts and texts without words stay, as do all of an empty benchmark or table;
    repeated rows stay or go alike. All columns stay, whatever their names.
    """
    own, names, back = shielded(docs)
    first, text, *others = names[id_col], names[text_col], *(n for c, n in names.items() if c not in (id_col, text_col))
    blocks = benchmark_blocks(benchmark, words, item_col, item_text_col, limit)
    windows, more = next(blocks, None), next(blocks, None)
    if windows is None:
        return docs
    if more is None:
        return back(search(own, windows, first, text, (text, *others)).filter(F.size("spans") == 0))
    keyed = own.withColumn("key", _key(F.col(first), F.col(text)))
    hits = [written(search(keyed, w, first, text, ("key",)).filter(F.size("spans") > 0).select("key").distinct(), "hits") for w in chain((windows, more), blocks)]
    return back(keyed.join(reduce(DataFrame.union, hits).distinct(), "key", "left_anti"))
