"""Token ids as raw files with keyed access: a minimal perfect hash from documents' keys to places in shards.

A folder has `data/*.bin` (ids end to end, 16 or 32 bits each, little-endian), `index/*.mph` (segments of the
index) and the tables `shards`, `segments` and `keys`. Tasks write files under names of their own; what
counts is what the tables name, and Spark's writer commits those, so files of lost or repeated tasks lie unread.

A key is a document's id and copy number (0 for the first row of an id). Its segment comes from a hash;
inside, levels of bits send each key to a slot of its own, which holds a fingerprint, shard, place and length.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, small_batches, utf8, written
from .packing import WordIds

#: Keys of a segment, about; and ids of a block, the unit in which payloads are dealt to readers.
SEGMENT_KEYS, BLOCK_IDS = 1 << 15, 1 << 21
#: Bits of a level for each key that is still without a place, times two; levels at most.
ROOM, LEVELS = 3, 96
_SECOND = xxhash.xxh64_intdigest(b"second", 42)
_MAGIC = 0x1D5


def _files(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder and its path there; a folder without a scheme is local."""
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def key_text(key: object, copy: int) -> bytes:
    return f"{'null' if key is None else f'={key}'}#{copy}".encode()


def key_hashes(text: bytes) -> tuple[int, int]:
    return xxhash.xxh64_intdigest(text, 42), xxhash.xxh64_intdigest(text, _SECOND)


def _hashed(key: Column, copy: Column) -> dict[str, Column]:
    """The same of columns."""
    text = F.concat(F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("null")), F.lit("#"), copy.cast("string"))
    return {"h1": F.xxhash64(text), "h2": F.xxhash64(F.lit("second"), text)}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _place(h1: np.ndarray, h2: np.ndarray, level: int, bits: int) -> np.ndarray:
    salted = h2 + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % (1 << 64))
    return (_mixed(h1 ^ _mixed(salted)) % np.uint64(bits)).astype(np.int64)


class Segment:
    """A minimal perfect hash over keys known by two 64-bit hashes, and what its slots hold.

    On each level the keys left get a bit by hash; those alone at theirs keep it, the others go on to the
    next. A key's slot is the number of set bits before its own.
    """

    def __init__(self, sizes: list[int], words: np.ndarray, before: np.ndarray, fields: list[np.ndarray]):
        self.sizes, self.words, self.before, self.fields = sizes, words, before, fields

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, values: list[np.ndarray]) -> "Segment":
        """`values`: shard (32 bits), place and length (64) of each key."""
        left, sizes, parts = np.arange(len(h1)), [], []
        while len(left):
            if len(sizes) == LEVELS:
                raise ValueError("keys with equal hashes")
            bits = max(64, -(-len(left) * ROOM // 2))
            at = _place(h1[left], h2[left], len(sizes), bits)
            alone = np.bincount(at, minlength=bits) == 1
            sizes.append(bits)
            parts.append(alone)
            left = left[~alone[at]]
        flags = np.concatenate([*parts, np.zeros(64 + -sum(sizes) % 64, bool)])
        words = np.packbits(flags, bitorder="little").view("<u8")
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(words))])[:-1].astype("<u4")
        found = cls(sizes, words, before, [])
        slots = found._slots(h1, h2)[0]
        for value, kind in zip([(h2 >> np.uint64(32)), *values], ("<u4", "<u4", "<u8", "<u8"), strict=True):
            column = np.zeros(len(h1), kind)
            column[slots] = value
            found.fields.append(column)
        return found

    def _slots(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots, and which keys have one at all."""
        slot, open_, base = np.zeros(len(h1), np.int64), np.arange(len(h1)), 0
        for level, bits in enumerate(self.sizes):
            at = base + _place(h1[open_], h2[open_], level, bits)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            rank = self.before[at >> 6] + np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            slot[open_[hit]] = rank[hit]
            open_, base = open_[~hit], base + bits
            if not len(open_):
                break
        there = np.ones(len(h1), bool)
        there[open_] = False
        return slot, there

    def find(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Which keys are here, by slot and fingerprint, and their shard, place and length."""
        if not len(self.fields[0]):
            return np.zeros(len(h1), bool), [np.zeros(len(h1), np.int64)] * 3
        slot, there = self._slots(h1, h2)
        return there & (self.fields[0][slot] == h2 >> np.uint64(32)), [f[slot].astype(np.int64) for f in self.fields[1:]]

    def pack(self) -> bytes:
        head = struct.pack(f"<4I{len(self.sizes)}I", _MAGIC, len(self.fields[0]), len(self.sizes), len(self.words), *self.sizes)
        return b"".join([head, b"\0" * (-len(head) % 8), self.words.tobytes(), *(x.tobytes() for x in self.fields[2:]), self.before.tobytes(), *(x.tobytes() for x in self.fields[:2])])

    @classmethod
    def unpack(cls, data: bytes) -> "Segment":
        magic, n, levels, words = struct.unpack_from("<4I", data)
        if magic != _MAGIC:
            raise ValueError("no segment of an index")
        at, out = -(-(16 + 4 * levels) // 8) * 8, []
        for kind, count in (("<u8", words), ("<u8", n), ("<u8", n), ("<u4", words), ("<u4", n), ("<u4", n)):
            out.append(np.frombuffer(data, kind, count, at))
            at += out[-1].nbytes
        bits, place, length, before, print_, shard = out
        return cls(list(struct.unpack_from(f"<{levels}I", data, 16)), bits, before, [print_, shard, place, length])


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes all documents' ids, each with `end_id` behind, into a new folder, in order of id (nulls first; rows of one id by a hash of their text).

    Null texts count as empty and give the end id alone. Repeated rows, also with the same or a null id, are
    written each, as further copies of their id. An empty table gives a folder without files. Very long texts
    are encoded whole. Other columns are left out, whatever their names. The folder has to be one that
    executors share, in a store that Arrow's file systems know.
    """
    spark = docs.sparkSession
    words = WordIds.of(tokenizer)
    kind = "<u2" if max(words.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else "<u4"
    files, base = _files(folder)
    for sub in ("data", "index"):
        files.create_dir(f"{base}/{sub}", recursive=True)
    entries = written(_encoded(docs, tokenizer, folder, kind, end_id, id_col, text_col), "token-entries")
    rows = entries.groupBy("shard").agg(F.first("file").alias("file"), F.sum("length").alias("ids"), F.min_by(F.struct("id"), "nth").alias("first"), F.max_by(F.struct("id", "copy"), "nth").alias("last")).orderBy("shard").collect()  # a row a file
    start, base_copy, shards = 0, 0, []
    for before, r in pairwise([None, *rows]):
        base_copy = 0 if before is None or before["last"]["id"] != r["first"]["id"] else before["last"]["copy"] + 1 + (base_copy if before["first"]["id"] == before["last"]["id"] else 0)
        shards.append((r["shard"], r["file"], start, r["ids"], base_copy, r["first"]["id"]))
        start += r["ids"]
    table = spark.createDataFrame(shards, T.StructType([*(T.StructField(n, t) for n, t in (("shard", T.IntegerType()), ("file", T.StringType()), ("start", T.LongType()), ("ids", T.LongType()), ("more", T.LongType()))), T.StructField("first_id", entries.schema["id"].dataType)]))
    table.select("shard", "file", "start", "ids").write.parquet(f"{folder}/shards")
    copy = F.col("copy") + F.when(F.col("id").eqNullSafe(F.col("first_id")), F.col("more")).otherwise(0)
    keyed = entries.drop("file").join(table.select("shard", "more", "first_id"), "shard").select("id", copy.alias("copy"), "shard", "at", "length")
    segments = max(1, -(-entries.count() // SEGMENT_KEYS))
    written(_indexed(keyed, segments, folder), "token-segments").write.parquet(f"{folder}/segments")
    keyed.select("id", "copy").write.parquet(f"{folder}/keys")
    with files.open_output_stream(f"{base}/format.json") as out:
        out.write(json.dumps({"ids": kind, "end_id": end_id, "segments": segments}).encode())


def _encoded(docs: DataFrame, tokenizer: str, folder: str, kind: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """A row a document, whose ids its task has written: `shard`, `file`, `nth`, `id`, `copy` within the shard, `at`, `length`."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).select("id", "text", F.xxhash64("text").alias("h"), F.rand(11).alias("spread"))
    # The last column parts rows that are alike, so that many of them are more than one task's.
    own = own.repartitionByRange(F.col("id").asc_nulls_first(), "h", "spread").sortWithinPartitions(F.col("id").asc_nulls_first(), "h").select("id", "text")
    fields = (("shard", T.IntegerType()), ("file", T.StringType()), ("nth", T.LongType()), ("id", docs.schema[id_col].dataType), ("copy", T.LongType()), ("at", T.LongType()), ("length", T.LongType()))
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    end = np.array([end_id], "<u4").tobytes()

    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shard, name = WordIds.of(tokenizer), TaskContext.get().partitionId(), f"{uuid.uuid4().hex}.bin"
        files, base = _files(folder)
        out, at, nth, copy, last = None, 0, 0, -1, None
        for batch in batches(rows):
            out = out or files.open_output_stream(f"{base}/data/{name}")
            copies, places, lengths = [], [], []
            for key, ids in zip(batch.column(0).to_pylist(), words.encode(utf8(batch.column(1))), strict=True):
                copy, last = (copy + 1 if copy >= 0 and key == last else 0), key
                n = len(ids) // 4 + 1
                out.write(np.frombuffer(ids + end, "<u4").astype(kind).tobytes())
                copies.append(copy), places.append(at), lengths.append(n)
                at += n
            n = batch.num_rows
            columns = [pa.array([shard] * n, pa.int32()), pa.array([name] * n), pa.array(np.arange(nth, nth + n)), batch.column(0), *(pa.array(x, pa.int64()) for x in (copies, places, lengths))]
            nth += n
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        if out:
            out.close()

    small_batches(docs.sparkSession)
    return own.mapInArrow(work, schema)


def _segment(segments: int) -> Column:
    return F.pmod("h1", F.lit(segments)).cast("int")


def _groups(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Rows of sorted batches by their first column, a whole number; those of one value together."""
    held: list[pa.RecordBatch] = []
    for batch in batches(rows):
        values = batch.column(0).to_numpy()
        for at, to in pairwise([0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), batch.num_rows]):
            part = batch.slice(at, to - at)
            if held and held[0].column(0)[0] != part.column(0)[0]:
                yield held[0].column(0)[0].as_py(), pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield held[0].column(0)[0].as_py(), pa.Table.from_batches(held)


def _numbers(table: pa.Table, name: str, kind: type = np.int64) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64).view(kind)


def _indexed(keyed: DataFrame, segments: int, folder: str) -> DataFrame:
    """Writes the index; a row a segment: `segment`, `file`, `at`, `bytes`. A task holds one segment at a time."""
    own = keyed.select(*(v.alias(n) for n, v in _hashed(F.col("id"), F.col("copy")).items()), "shard", "at", "length").select(_segment(segments).alias("segment"), "*")

    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _files(folder)
        name, out, at, made = f"{uuid.uuid4().hex}.mph", None, 0, []
        for number, table in _groups(rows):
            out = out or files.open_output_stream(f"{base}/index/{name}")
            data = Segment.build(_numbers(table, "h1", np.uint64), _numbers(table, "h2", np.uint64), [_numbers(table, n) for n in ("shard", "at", "length")]).pack()
            out.write(data)
            made.append((number, name, at, len(data)))
            at += len(data)
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int32()), pa.array([m[1] for m in made]), pa.array([m[2] for m in made], pa.int64()), pa.array([m[3] for m in made], pa.int64())], names=["segment", "file", "at", "bytes"])

    return own.repartition("segment").sortWithinPartitions("segment").mapInArrow(work, "segment int, file string, at long, bytes long")


def _format(folder: str) -> dict:
    files, base = _files(folder)
    with files.open_input_stream(f"{base}/format.json") as f:
        return json.loads(f.read())


def lookup(keys: DataFrame, folder: str) -> DataFrame:
    """`keys` (`id`, `copy`) with `shard`, `at` and `length` by the index; null for keys it doesn't have.

    A foreign key passes a fingerprint of 32 bits by chance only.
    """
    spark, told = keys.sparkSession, _format(folder)
    own = keys.select("id", "copy", *(v.alias(n) for n, v in _hashed(F.col("id"), F.col("copy")).items())).select(_segment(told["segments"]).alias("segment"), "*")
    table = spark.read.parquet(f"{folder}/segments").select("segment", "file", F.col("at").alias("place"), "bytes")
    out = T.StructType([T.StructField("id", keys.schema["id"].dataType), T.StructField("copy", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("length", T.LongType())])

    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _files(folder)
        held, segment = None, None
        for batch in batches(rows):
            values = batch.column(0).to_numpy()
            for at, to in pairwise([0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), batch.num_rows]):
                part = pa.Table.from_batches([batch.slice(at, to - at)])
                number, name, place, size = (part.column(n)[0].as_py() for n in ("segment", "file", "place", "bytes"))
                if name is None:
                    there, found = np.zeros(to - at, bool), [np.zeros(to - at, np.int64)] * 3
                else:
                    if number != held:
                        with files.open_input_file(f"{base}/index/{name}") as f:
                            held, segment = number, Segment.unpack(f.read_at(size, place))
                    there, found = segment.find(_numbers(part, "h1", np.uint64), _numbers(part, "h2", np.uint64))
                columns = [pa.array(x, pa.int32() if k == 0 else pa.int64(), mask=~there) for k, x in enumerate(found)]
                yield pa.RecordBatch.from_arrays([part.column("id").combine_chunks(), part.column("copy").combine_chunks(), *columns], names=out.names)

    joined = own.join(table, "segment", "left").select("segment", "id", "copy", "h1", "h2", "file", "place", "bytes")
    return joined.repartition("segment").sortWithinPartitions("segment").mapInArrow(work, out)


def read(keys: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """What the files hold of `keys` (`id`, `copy`): `start` (ids of all documents before it), `n_tokens`, `ids_crc32`, and `ids` with `with_ids`.

    Keys that the index doesn't have are left out.
    """
    told, shards = _format(folder), keys.sparkSession.read.parquet(f"{folder}/shards").select("shard", "file", F.col("start").alias("before"))
    located = lookup(keys, folder).filter("shard is not null").join(shards, "shard").select("id", "copy", "file", (F.col("before") + F.col("at")).alias("start"), "at", "length")
    out = T.StructType([T.StructField("id", keys.schema["id"].dataType), *(T.StructField(n, T.LongType()) for n in ("copy", "start", "n_tokens", "ids_crc32")), *([T.StructField("ids", T.ArrayType(T.LongType()))] if with_ids else [])])
    width = np.dtype(told["ids"]).itemsize

    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _files(folder)
        name, f = None, None
        for batch in batches(rows):
            crcs, ids = [], []
            for own, at, n in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                if own != name:
                    if f:
                        f.close()
                    name, f = own, files.open_input_file(f"{base}/data/{own}")
                found = np.frombuffer(f.read_at(n * width, at * width), told["ids"]).astype("<u4")
                crcs.append(zlib.crc32(found.tobytes()))
                if with_ids:
                    ids.append(found)
            columns = [batch.column(0), batch.column(1), batch.column(3), batch.column(5), pa.array(crcs, pa.int64()), *([pa.array(ids, pa.list_(pa.int64()))] if with_ids else [])]
            yield pa.RecordBatch.from_arrays(columns, names=out.names)
        if f:
            f.close()

    small_batches(keys.sparkSession)
    return located.repartition("file", F.floor(F.col("at") / BLOCK_IDS)).sortWithinPartitions("file", "at").mapInArrow(work, out)


def keys(spark: SparkSession, folder: str) -> DataFrame:
    """The keys of all documents of a folder."""
    return spark.read.parquet(f"{folder}/keys")


class Reader:
    """Keyed access without Spark: a key's segment, its slot, and one read of the payload. Segments read once are kept."""

    def __init__(self, folder: str):
        import pyarrow.parquet as pq

        self.files, self.base = _files(folder)
        self.told = _format(folder)
        tables = [pq.read_table(f"{self.base}/{n}", filesystem=self.files).to_pylist() for n in ("shards", "segments")]
        self.shards, self.segments = {r["shard"]: r["file"] for r in tables[0]}, {r["segment"]: r for r in tables[1]}
        self.held: dict[int, Segment] = {}

    def get(self, key: object, copy: int = 0) -> np.ndarray | None:
        """The ids of a document, or none."""
        first, second = key_hashes(key_text(key, copy))
        number = (first - (1 << 64) if first >> 63 else first) % self.told["segments"]
        if number not in self.segments:
            return None
        if number not in self.held:
            row = self.segments[number]
            with self.files.open_input_file(f"{self.base}/index/{row['file']}") as f:
                self.held[number] = Segment.unpack(f.read_at(row["bytes"], row["at"]))
        there, (shard, at, length) = self.held[number].find(np.array([first], np.uint64), np.array([second], np.uint64))
        if not there[0]:
            return None
        width = np.dtype(self.told["ids"]).itemsize
        with self.files.open_input_file(f"{self.base}/data/{self.shards[int(shard[0])]}") as f:
            return np.frombuffer(f.read_at(int(length[0]) * width, int(at[0]) * width), self.told["ids"])
