"""Best-fit packing planned over the histogram of lengths.

Only counts of lengths (at most `capacity` of them) reach the driver. The plan says, for each run of
ranks within a length, which sequences take them; documents then find their place by length and rank.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, small_batches, utf8, written

#: Parts whose ids a worker remembers, and their bytes, which take five times as much at most; beyond either it starts anew.
MEMORY_PARTS, MEMORY_BYTES = 600_000, 16_000_000
#: Parts of more characters are left to the library.
LONG_PART = 24


def byte_letters() -> list[str]:
    """The character by which byte-level tokenizers write each byte: its own where it is visible, else the next from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in visible else next(hidden)) for b in range(256)]


class Merges:
    """A tokenizer's byte pair merges, applied to many parts at once.

    In each round every part makes its one merge of lowest rank, the first of those; parts without one
    are done. Parts of one length are the rows of a matrix.
    """

    def __init__(self, model: dict):
        vocabulary = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pairs = np.array([(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in merges], np.int64)
        self.width = max(vocabulary.values()) + 1
        keys = pairs[:, 0] * self.width + pairs[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order, pairs[:, 2]
        self.letters = np.array([vocabulary[c] for c in byte_letters()], np.int64)
        self.ends = np.array([vocabulary[c + model["end_of_word_suffix"]] for c in byte_letters()], np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], len(self.made))

    def encode(self, parts: list[bytes]) -> list[bytes]:
        """Ids of each part (not empty) as little-endian unsigned 32-bit integers."""
        found: list[bytes] = [b""] * len(parts)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        for n in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == n)
            for at in range(0, len(rows), 8192):
                own = rows[at : at + 8192]
                data = np.frombuffer(b"".join([parts[k] for k in own.tolist()]), np.uint8).reshape(-1, n)
                for k, ids in zip(own.tolist(), self._merged(data), strict=True):
                    found[k] = ids
        return found

    def _merged(self, data: np.ndarray) -> list[bytes]:
        n, none = data.shape[1], len(self.made)
        ids = np.hstack([self.letters[data[:, :-1]], self.ends[data[:, -1:]]])
        ranks = np.full(ids.shape, none)
        ranks[:, :-1] = self.rank(ids[:, :-1], ids[:, 1:])
        sizes, open_ = np.full(len(ids), n), np.arange(len(ids))
        work_ids, work_ranks, place = ids, ranks, np.arange(n)
        while len(open_):
            at = work_ranks.argmin(axis=1)
            best = work_ranks[np.arange(len(at)), at]
            more = best < none
            if not more.all():
                done = ~more
                ids[open_[done], : work_ids.shape[1]] = work_ids[done]
                open_, work_ids, work_ranks, at, best = open_[more], work_ids[more], work_ranks[more], at[more], best[more]
                if not len(open_):
                    break
            row = np.arange(len(open_))
            work_ids[row, at] = self.made[best]
            from_ = np.minimum(place[None, : work_ids.shape[1]] + (place[None, : work_ids.shape[1]] > at[:, None]), work_ids.shape[1] - 1)
            work_ids, work_ranks = np.take_along_axis(work_ids, from_, 1), np.take_along_axis(work_ranks, from_, 1)
            sizes[open_] -= 1
            work_ranks[row, at] = none
            behind = at + 1 < sizes[open_]
            r, c = row[behind], at[behind]
            work_ranks[r, c] = self.rank(work_ids[r, c], work_ids[r, c + 1])
            r, c = row[at > 0], at[at > 0]
            work_ranks[r, c - 1] = self.rank(work_ids[r, c - 1], work_ids[r, c])
            keep = max(1, int(sizes[open_].max()))
            work_ids, work_ranks = work_ids[:, :keep], work_ranks[:, :keep]
        flat = ids.astype("<u4")
        return [x[:k].tobytes() for x, k in zip(flat, sizes.tolist(), strict=True)]


class WordIds:
    """Token ids of texts, by way of remembered ids of their lower-cased parts.

    Holds for tokenizers that never join text across ASCII white space and drop it. Where the tokenizer
    is a byte pair model with word ends behind the split `SPLIT`, words of ASCII and of the accented
    letters next to it are cut and merged here; the library encodes all others, word by word.
    """

    #: The tokenizer's split, as its file has it, and what it comes to in words encoded here.
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|[^\t-\r a-z0-9\u00df-\u00f6\u00f8-\u017f]+")
    #: What words encoded here are free of, besides special tokens: all but ASCII and the letters from U+00C0 to
    #: U+017F; of these, the one that becomes two when lower-cased.
    OTHER = "[^\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]|\u0130"

    held: dict[str, "WordIds"] = {}

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.size = Tokenizer.from_file(path), {}, 0
        told = json.loads(self.tokenizer.to_str())
        model, cut, steps = told["model"], told["pre_tokenizer"] or {}, (told["normalizer"] or {}).get("normalizers", [])
        first, *others = cut.get("pretokenizers", [{}])
        plain = [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and first.get("pattern") == {"Regex": self.SPLIT} and [x["type"] for x in others] == ["ByteLevel"]
        plain = plain and model["type"] == "BPE" and model["end_of_word_suffix"] and not (model["dropout"] or model["continuing_subword_prefix"] or model["ignore_merges"])
        self.merges = Merges(model) if plain else None
        self.aside = re.compile("|".join([self.OTHER, *sorted({re.escape(x["content"][:2]) for x in told["added_tokens"]})]) if plain else "[^\t-\r ]")

    @classmethod
    def of(cls, path: str) -> "WordIds":
        """The one of this worker, which later tasks use again."""
        if path not in cls.held:
            cls.held[path] = cls(path)
        return cls.held[path]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self._cut(t.decode("utf-8", "replace")) for t in texts]
        if len(self.known) > MEMORY_PARTS or self.size > MEMORY_BYTES:
            self.known, self.size = {}, 0
        if new := set().union(*cut).difference(self.known):
            self._learn(list(new))
        get = self.known.__getitem__
        return [b"".join(map(get, parts)) for parts in cut]

    def _cut(self, text: str) -> list[str]:
        """Parts of a text; words for the library come whole, behind a space that tells them apart."""
        if not self.aside.search(text):
            return self.PARTS.findall(text.lower())
        parts, aside = [], self.aside.search
        for other, words in groupby(re.findall("[^\t-\r ]+", text), lambda w: aside(w) is not None):
            parts += [" " + w for w in words] if other else self.PARTS.findall(" ".join(words).lower())
        return parts

    def _learn(self, parts: list[str]) -> None:
        self.size += sum(map(len, parts))
        own = [p for p in parts if p[0] != " " and len(p) <= LONG_PART]
        if own:
            self.known.update(zip(own, self.merges.encode([p.encode() for p in own]), strict=True))
        others = [p for p in parts if p[0] == " " or len(p) > LONG_PART]
        for at in range(0, len(others), 5_000):
            some = others[at : at + 5_000]
            found = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
            self.known.update((p, np.array(x.ids, "<u4").tobytes()) for p, x in zip(some, found, strict=True))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cuts each document's ids (with `end_id` behind them) into pieces of at most `capacity`.

    Besides the contract's columns: `task` and `nth`, the piece's rank among the task's pieces of that
    length. They are true only of one run of the task, so the result must be written before use.
    """
    end = np.array([end_id], "<u4").tobytes()
    out = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(n, t) for n, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("task", T.IntegerType()), ("nth", T.LongType())))])

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task, seen = WordIds.of(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches(rows):
            of, piece, start, length, crc, nth = [], [], [], [], [], []
            for i, ids in enumerate(words.encode(utf8(batch.column(1)))):
                ids += end
                for k, at in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * at : 4 * (at + capacity)]
                    n = len(part) // 4
                    of.append(i), piece.append(k), start.append(at), length.append(n), crc.append(zlib.crc32(part)), nth.append(seen[n])
                    seen[n] += 1
            columns = [batch.column(0).take(pa.array(of, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([task] * len(of), pa.int32()), pa.array(nth, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col)).mapInArrow(cut, out)


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Best fit over counts, longest first.

    Rows (length, first rank, pieces a sequence takes, first sequence, offset): ranks from the first on,
    up to the next row of that length, fill sequence after sequence. Sequences alike in room are held as
    one range, so the work and the rows depend on `capacity`, not on how many pieces there are.
    """
    rows: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens: ranges (first sequence, how many)
    rooms: list[int] = []  # the keys of room, sorted
    opened = 0

    def put(free: int, first: int, n: int) -> None:
        if free and n:
            if free not in room:
                room[free] = []
                insort(rooms, free)
            room[free].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0

        def fill(free: int, first: int, n: int, length: int = length) -> None:
            """Puts what is left into a range of sequences with `free` tokens each."""
            nonlocal left, rank
            k = free // length
            full = min(n, left // k)
            if full:
                rows.append((length, rank, k, first, capacity - free))
                put(free - k * length, first, full)
                rank, left = rank + full * k, left - full * k
            if full < n and left:
                rows.append((length, rank, left, first + full, capacity - free))
                put(free - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            put(free, first + full, n - full)

        while left and (at := bisect_left(rooms, length)) < len(rooms):
            free = rooms[at]
            first, n = room[free].pop(0)
            if not room[free]:
                del room[free], rooms[at]
            fill(free, first, n)
        if left:
            n = -(-left // (capacity // length))
            opened += n
            fill(capacity, opened - n, n)
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents into few sequences of at most `capacity` tokens; one row per piece.

    A null text counts as empty and gives one piece with the end id alone. Repeated rows, also with the
    same or a null id, are packed each. An empty table gives no rows. Other columns are left out,
    whatever their names.
    """
    cut = written(pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    counts = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = written(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "lengths")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    slots = plan(histogram, capacity)
    starts = slots[:, 0] << 44 | slots[:, 1]
    # A merge join, as there is a row for each length and task: it grows with the input, if slowly.
    ranked = cut.join(counts.select("length", "task", "before").hint("merge"), ["length", "task"]).select(F.col(id_col), "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    out = T.StructType([*ranked.schema.fields[:5], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            row = slots[np.searchsorted(starts, length << 44 | rank, "right") - 1]
            nth = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(row[:, 3] + nth // row[:, 2]), pa.array(row[:, 4] + nth % row[:, 2] * length)], names=out.names)

    return ranked.mapInArrow(place, out)
