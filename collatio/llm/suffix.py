"""Removal of byte strings that a corpus holds twice, by prefix doubling over positions.

Positions are ranked by what stands at them; a round compares twice the length, by pairs of ranks at a
position and at an offset behind it, and a position is done once its pair is unique or the compared
length has passed the threshold. Ranking every byte position would shuffle a hundred times the corpus, so:

* Positions are first dealt to anchors. The anchor of a string of `width` bytes is the place of the
  least hash among its strings of `core` bytes; equal strings have equal anchors at equal places.
  Neighbouring positions with the same anchor are one row.
* A row is known by its core, the bytes that all its strings share, and by its whole, all bytes that any of
  them covers. A core that is unique settles its positions as unrepeated; a whole that is repeated settles
  them as repeated. Of rows alike as a whole, one goes on to stand for all.
* What is left is cut so that cores get twice as long (32, 64, 128 bytes for strings of 200), and known by
  the ranks of both halves; the last lengths, no powers of two, by halves that overlap. In the end a row is
  a single position, and core and whole are the string itself.

Ranks are hashes of content rather than dense numbers, which saves a sort a round. Cores that clash are only
compared further. What is taken as repeated is alike in the whole's 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, discard, small_batches, utf8, written

#: Bytes hashed at once; about 60 bytes of memory each.
PART = 1 << 21
_MULTIPLIER = 0x9E3779B97F4A7C15
_PLACE = np.uint64(0xFFFFFF)
_RANGE = "a int, o int, n int"
_RANKED = f"h long, r1 long, r2 long, full long, more long, {_RANGE}"


class Anchors:
    """Finds the anchors of all strings of `width` bytes in a buffer of at most 16 MB."""

    def __init__(self, width: int, core: int):
        self.width, self.core = width, core
        self.letters = np.random.default_rng(5).integers(0, 2**64, 256, dtype=np.uint64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            for name, base in (("up", _MULTIPLIER), ("down", pow(_MULTIPLIER, -1, 2**64))):
                p = np.full(n, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p))

    def find(self, data: bytes) -> np.ndarray:
        """Where the anchor of the string at each position is."""
        n, w = len(data), self.width - self.core + 1
        self._powers(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.letters[np.frombuffer(data, np.uint8)] * self.up[:n], out=sums[1:])
        m = n - self.core + 1
        key = (sums[self.core :] - sums[: -self.core]) * self.down[:m]
        key ^= key >> np.uint64(32)
        key *= np.uint64(0xD6E8FEB86659FD93)
        key = (key & ~_PLACE) | np.arange(m, dtype=np.uint64)  # ties go to the first place
        blocks = -(-m // w)
        grid = np.full(blocks * w, np.uint64(2**64 - 1))
        grid[:m] = key
        grid = grid.reshape(blocks, w)
        before = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        strings = n - self.width + 1
        return (np.minimum(behind[:strings], before[w - 1 : w - 1 + strings]) & _PLACE).astype(np.int64)


def _parts(texts: list[bytes], width: int) -> Iterator[tuple[bytes, list[tuple[int, int, int]]]]:
    """Buffers of about PART bytes, with (number of the text, its place in the buffer, the buffer's place in the text)."""
    held, size, of = [], 0, []
    for k, t in enumerate(texts):
        for at in range(0, max(len(t) - width + 1, 0), PART):
            part = t[at : at + PART + width - 1]
            held.append(part), of.append((k, size, at))
            size += len(part)
            if size >= PART:
                yield b"".join(held), of
                held, size, of = [], 0, []
    if held:
        yield b"".join(held), of


def anchored(docs: DataFrame, width: int, core: int) -> DataFrame:
    """A row for each run of positions with one anchor: its document (`id`, `h`), the rank of its core (`r1`; `r2` is 0)
    and its whole's (`full` and `more`), the anchor `a`, the first position `o` (from the first that could have this anchor) and how many, `n`."""
    out = T.StructType([docs.schema["id"], *T._parse_datatype_string(_RANKED).fields])

    def find(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest as rank
        from xxhash import xxh3_128_digest as whole

        anchors = Anchors(width, core)
        for batch in batches(rows):
            for data, of in _parts(utf8(batch.column(2)), width):
                where = anchors.find(data)
                begin = np.array([x[1] for x in of] + [len(data)])
                text = np.searchsorted(begin, np.arange(len(where)), "right") - 1
                inside = np.arange(len(where)) + width <= begin[text + 1]
                cut = np.flatnonzero((where[1:] != where[:-1]) | (text[1:] != text[:-1]) | (inside[1:] != inside[:-1])) + 1
                first, end = np.concatenate(([0], cut)), np.concatenate((cut, [len(where)]))
                first, end = first[inside[first]], end[inside[first]]
                a, n = where[first], end - first
                o = first - a + width - core
                cores = np.array([rank(data[x : x + core]) for x in a.tolist()], np.uint64)
                fulls = np.frombuffer(b"".join([whole(data[x : y + width - 1], z) for x, y, z in zip(first.tolist(), end.tolist(), (o * width + n).tolist(), strict=True)]), np.int64).reshape(-1, 2)
                shift = np.array([x[2] - x[1] for x in of])[text[first]]
                number = pa.array(np.array([x[0] for x in of])[text[first]])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(number), batch.column(1).take(number), pa.array(cores.view(np.int64)), pa.array(np.zeros(len(a), np.int64)), pa.array(fulls[:, 0]), pa.array(fulls[:, 1]), pa.array((a + shift).astype(np.int32)), pa.array(o.astype(np.int32)), pa.array(n.astype(np.int32))], names=out.names)

    return docs.select("id", "h", "text").mapInArrow(find, out)


def shorter(docs: DataFrame, rows: DataFrame, step: int, width: int, core: int) -> DataFrame:
    """The rows cut into ranges of `step` positions (counted from the first that could have the anchor) and ranked
    again: the core, `width` - `step` + 1 bytes, by the pair of ranks of its first and last `half` bytes."""
    own = rows.groupBy("id", "h").agg(F.collect_list(F.struct("a", "o", "n")).alias("ranges"))
    once = docs.groupBy("id", "h").agg(F.first("text").alias("text"))
    joined = once.join(own.select(F.col("id").alias("__id"), F.col("h").alias("__h"), "ranges"), F.col("id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h")))
    out = T.StructType([docs.schema["id"], *T._parse_datatype_string(_RANKED).fields])
    base, half = width - core, 1 << (width - step).bit_length() - 1

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest as rank
        from xxhash import xxh3_128_digest as whole

        for batch in batches(rows):
            number, found, wholes = [], [], []
            for k, (text, ranges) in enumerate(zip(utf8(batch.column(2)), batch.column(3), strict=True)):
                for a, o, n in zip(*(x.tolist() for x in (ranges.values.field(c).to_numpy() for c in ("a", "o", "n"))), strict=True):
                    at = a - base
                    for b in range(o // step * step, o + n, step):
                        lo, hi = max(o, b), min(o + n, b + step)
                        begin, end = at + b + step - 1, at + b + width
                        number.append(k)
                        found.append((rank(text[begin : begin + half]), rank(text[end - half : end]), a, lo, hi - lo))
                        wholes.append(whole(text[at + lo : at + hi + width - 1], lo * width + hi - lo))
            if found:
                made = list(zip(*found, strict=True))
                fulls = np.frombuffer(b"".join(wholes), np.int64).reshape(-1, 2)
                ranks = [*(pa.array(np.array(x, np.uint64).view(np.int64)) for x in made[:2]), pa.array(fulls[:, 0]), pa.array(fulls[:, 1])]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(number)), batch.column(1).take(pa.array(number)), *ranks, *(pa.array(x, pa.int32()) for x in made[2:])], names=out.names)

    return joined.select("id", "h", "text", "ranges").mapInArrow(cut, out)


def refine(rows: DataFrame, width: int, core: int, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """Settles what can be settled. Returns the repeated byte ranges (`id`, `h`, `s`, `e`) and the rows to compare further."""
    pair, own = ["r1", "r2"], ["r1", "r2", "full", "more"]
    count = F.count(F.lit(1))
    rows = written(rows, "ranked")
    # Written, so that both sides of the join are plain shuffles, of which Spark can split a hot core's partition.
    twice = written(rows.groupBy(*pair).agg(count.alias("c")).filter("c > 1").select(*pair), "twice")
    open_ = written(rows.join(twice, pair, "left_semi"), "open")
    discard(rows, twice)
    alike = open_.groupBy(*own).agg(count.alias("m"), F.min(F.struct("id", "h", "a", "o", "n")).alias("one"))
    alike = written(alike, "alike")
    repeated = open_.join(alike.filter("m > 1").select(*own), own, "left_semi")
    start = F.col("a") - (width - core) + F.col("o")
    repeated = written(repeated.select("id", "h", start.alias("s"), (start + F.col("n") + width - 1).alias("e")).distinct(), "repeated")
    discard(open_)
    more = None
    if not last:
        several = written(alike.groupBy(*pair).agg(count.alias("c")).filter("c > 1").select(*pair), "several")
        more = written(alike.join(several, pair, "left_semi").select("one.*"), "more")
        discard(several)
    discard(alike)
    return repeated, more


def steps_of(width: int, core: int) -> list[int]:
    """How many positions a row has at most, round by round: fewer by as much as the compared length doubles,
    then, where it can double no more, an eighth, down to one."""
    found, length = [], core
    while (n := width - length + 1) > 1:
        length = 2 * length if 2 * length < width else width - max(1, n // 8) + 1
        found.append(width - length + 1)
    return found


def repeated_ranges(docs: DataFrame, width: int = 200, core: int = 32) -> tuple[DataFrame, list[DataFrame]]:
    """Byte ranges (`s`, `e`) of documents (`id`, `h`) whose strings of `width` bytes also start elsewhere, and the tables that hold them."""
    steps = steps_of(width, core)
    found, more = refine(anchored(docs, width, core), width, core, not steps)
    parts = [found]
    for step in steps:
        again, next_ = refine(shorter(docs, more, step, width, core), width, core, step == steps[-1])
        discard(more)
        parts.append(again)
        found, more = found.unionByName(again), next_
    return found, parts


def dedup_repeats(docs: DataFrame, width: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: `n_bytes`, `n_removed`, `n_spans`, `kept_sha256` and `kept` (the remaining bytes).

    A byte goes if a string of `width` bytes that covers it also starts anywhere else, in this document or
    another, in UTF-8. Null texts count as empty. Repeated rows, also with the same or a null id, repeat
    each other whole. Texts shorter than `width` stay. Other columns are left out, whatever their names.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    small_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    ranges, parts = repeated_ranges(own, width)
    ranges = written(ranges.groupBy("id", "h").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("ranges")), "ranges")
    discard(*parts)
    joined = own.join(ranges.select(F.col("id").alias("__id"), F.col("h").alias("__h"), "ranges"), F.col("id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h")), "left")
    out = T.StructType([docs.schema[id_col], *T._parse_datatype_string("n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary").fields])

    def remove(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            found = []
            for t, ranges in zip(utf8(batch.column(1)), batch.column(2), strict=True):
                kept, spans, at, done = [], 0, 0, -1
                pairs = zip(ranges.values.field("s").to_pylist(), ranges.values.field("e").to_pylist(), strict=True) if ranges.is_valid else ()
                for s, e in pairs:
                    if s > done:
                        spans += 1
                        kept.append(t[at:s])
                    done = at = max(done, e)
                kept = b"".join([*kept, t[at:]])
                found.append((len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, field.type) for x, field in zip(zip(*found, strict=True), _ARROW, strict=True))], names=out.names)

    return joined.select("id", "text", "ranges").mapInArrow(remove, out)


_ARROW = pa.schema([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
