"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits have a common variant within r bits of both. Every
fingerprint's variants within r bits are dealt out by a linear hash of their bits. As the hash is linear,
a task can tell from a fingerprint which of its variants have a given hash, so the shuffle carries the
fingerprint once a bucket (the hash's lower bits) and not every variant. A bucket puts its fingerprints in
the order of their hashes, on disk where they are many, and goes through its own hashes (the upper bits)
one by one: it sorts the variants of a hash, links the fingerprints that meet, and verifies each link.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, discard, shielded, small_batches, utf8, written

BITS = 64
#: Variants that a bucket holds at once, 40 bytes each while it sorts them.
BUCKET_VARIANTS = 2_000_000
#: Variants that a bucket goes through in all, about; there are at least and at most so many bits for the number of buckets as
#: long as a bucket can hold all fingerprints, which are 16 bytes each, in memory for so many and on its disk beyond.
BUCKET_WORK, BUCKET_BITS, HELD_PRINTS, BUCKET_PRINTS = 64_000_000, (6, 9), 4_000_000, 1_000_000_000
#: Fingerprints that are put in order at once.
CHUNK = 1 << 16
#: Parts into which the members of a group are dealt when they learn its name.
SALTS = 8


def shingle_hashes(text: bytes, width: int = 4, seed: int = 42) -> list[int]:
    """XXH64 of each shingle of `width` words, repeats included; a shorter text is one shingle."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return []
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()[width - 1 :] or [len(joined)]
    return [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends, strict=False)]


def fingerprint(hashes: list[int]) -> int:
    """Bits set in over half of the hashes; zero without hashes."""
    if not hashes:
        return 0
    ones = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id (a column of any type) and `fp`, its fingerprint as a signed long."""
    out = T.StructType([docs.schema[id_col], T.StructField("fp", T.LongType())])

    def make(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            found = np.array([fingerprint(shingle_hashes(t, width)) for t in utf8(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=out.names)

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col)).mapInArrow(make, out)


def ball(bits: int, radius: int, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The hash's column for each bit, and the flips within `radius` by their hash, `order` bits wide."""
    columns = np.random.default_rng(7).permutation(max(bits, 1 << order))[:bits].astype(np.int64) % (1 << order)
    by: list[list[int]] = [[] for _ in range(1 << order)]
    for n in range(radius + 1):
        for flipped in combinations(range(bits), n):
            h = 0
            for b in flipped:
                h ^= int(columns[b])
            by[h].append(sum(1 << b for b in flipped))
    return columns, [np.array(x, np.uint64) for x in by]


def linear_hash(fps: np.ndarray, columns: np.ndarray) -> np.ndarray:
    h = np.zeros(len(fps), np.int64)
    for b, c in enumerate(columns):
        h ^= np.where(fps >> np.uint64(b) & np.uint64(1), c, 0)
    return h


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest number each of `n` is linked to, links being pairs of a and b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


class Prints:
    """A bucket's fingerprints, to be put in the order of their hashes: counted as they come, then each put in its place."""

    def __init__(self, columns: np.ndarray, order: int, held: int = HELD_PRINTS):
        self.columns, self.held, self.n = columns, held, 0
        self.counts = np.zeros(1 << order, np.int64)
        self.fresh, self.waiting = [], 0  # not counted yet
        self.parts: list[np.ndarray] = []
        self.file = None

    def add(self, fps: np.ndarray) -> None:
        self.fresh.append(fps)
        self.waiting += len(fps)
        if self.waiting >= CHUNK:
            self._count()

    def _count(self) -> None:
        if not self.waiting:
            return
        fps = np.concatenate(self.fresh)
        self.fresh, self.waiting = [], 0
        self.counts += np.bincount(linear_hash(fps, self.columns), minlength=len(self.counts))
        self.n += len(fps)
        self.parts.append(fps)
        if self.file or self.n > self.held:
            self.file = self.file or tempfile.TemporaryFile()
            for part in self.parts:
                self.file.write(part.tobytes())
            self.parts = []

    def _chunks(self) -> Iterator[np.ndarray]:
        if self.file:
            self.file.seek(0)
            while data := self.file.read(8 * CHUNK):
                yield np.frombuffer(data, np.uint64)
        yield from self.parts

    def ordered(self) -> tuple[np.ndarray, np.ndarray]:
        """The fingerprints by hash, and where those of each hash begin."""
        self._count()
        at = np.concatenate(([0], np.cumsum(self.counts)))
        if self.file:
            with tempfile.TemporaryFile() as target:
                target.truncate(8 * self.n)
                out = np.memmap(target, np.uint64, "r+", shape=(self.n,))
        else:
            out = np.empty(self.n, np.uint64)
        free = at[:-1].copy()
        for part in self._chunks():
            hashes = linear_hash(part, self.columns)
            order = np.argsort(hashes, kind="stable")
            hashes = hashes[order]
            new = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
            sizes = np.diff(np.append(new, len(hashes)))
            out[np.repeat(free[hashes[new]] - new, sizes) + np.arange(len(hashes))] = part[order]
            free[hashes[new]] += sizes
        return out, at


def met(fps: np.ndarray, at: np.ndarray, bucket: int, bits: int, flips: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among distinct fingerprints (by hash, those of hash k from at[k] on) with a common variant in the bucket,
    as (fingerprint, one that its links lead to). What is held are the variants of one hash, and links."""
    filled = np.array([d for d, x in enumerate(flips) if len(x)])
    u = v = np.zeros(0, np.uint64)
    for target in range(bucket, len(flips), 1 << bits):
        made, owner, own = [], [], []
        near, n = target ^ filled, 0  # the fingerprints of these hashes have variants of the target's
        for d in filled[at[near] < at[near + 1]].tolist():
            some, masks = np.array(fps[at[target ^ d] : at[(target ^ d) + 1]]), flips[d]
            made.append((some[:, None] ^ masks[None, :]).ravel())
            owner.append(np.repeat(np.arange(n, n + len(some), dtype=np.int32), len(masks)))
            own.append(some)
            n += len(some)
        if not made:
            continue
        variants, owner, own = np.concatenate(made), np.concatenate(owner), np.concatenate(own)
        order = np.argsort(variants)
        variants, owner = variants[order], owner[order]
        new = np.concatenate(([True], variants[1:] != variants[:-1]))
        least = np.minimum.reduceat(owner, np.flatnonzero(new))[np.cumsum(new) - 1]
        linked = owner != least
        a, b = np.divmod(np.unique(owner[linked].astype(np.int64) * n + least[linked]), n)
        close = np.bitwise_count(own[a] ^ own[b]) <= most
        if close.any():
            u, v = forest(np.concatenate((u, own[a[close]])), np.concatenate((v, own[b[close]])))
    return u, v


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few links that connect the same: each node but the least of its group with the least."""
    nodes, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
    label = roots(ends[: len(u)], ends[len(u) :], len(nodes))
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[own], nodes[label[own]]


def links(fps: DataFrame, most: int = 4, prints: int = BUCKET_PRINTS, variants: int = BUCKET_VARIANTS, held: int = HELD_PRINTS) -> DataFrame:
    """Links (`u`, `v`) that connect the same distinct fingerprints as all pairs at `most` or fewer differing bits.

    Up to `prints` fingerprints, each is copied to 64 to 512 buckets, the more the more there are; a bucket keeps more than
    `held` on its disk. Beyond, buckets are as many as keep one at `prints`, so that a fingerprint is copied once for
    each of its variants, 2,081 for 4 bits: the method's own price.
    """
    radius, n = (most + 1) // 2, fps.count()
    flips_all = sum(1 for k in range(radius + 1) for _ in combinations(range(BITS), k))
    log = lambda x: int(np.ceil(np.log2(max(1, x))))
    order = max(4, log(n * flips_all / variants))
    fewest, largest = BUCKET_BITS
    bits = min(order, largest, max(fewest, log(n * flips_all / BUCKET_WORK))) if n <= prints else max(largest, log(n * flips_all / prints))
    order = max(order, bits)
    columns, flips = ball(BITS, radius, order)
    low = columns & ((1 << bits) - 1)
    filled = np.unique(np.array([d for d, x in enumerate(flips) if len(x)]) & ((1 << bits) - 1))

    def deal(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            own = batch.column(0).to_numpy().view(np.uint64)
            bucket = (linear_hash(own, low)[:, None] ^ filled[None, :]).ravel()
            sort = np.argsort(bucket, kind="stable")
            values, at = np.unique(bucket[sort], return_index=True)
            parts = np.split(np.repeat(own, len(filled))[sort], at[1:])
            for k in range(0, len(values), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(values[k : k + 4096]), pa.array([p.tobytes() for p in parts[k : k + 4096]], pa.binary())], names=["bucket", "fps"])

    def meet(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, own = None, None

        def found() -> pa.RecordBatch:
            u, v = met(*own.ordered(), bucket, bits, flips, most)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for batch in batches(rows):
            for key, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != bucket:
                    if own:
                        yield found()
                    bucket, own = key, Prints(columns, order, held)
                own.add(np.frombuffer(part, np.uint64))
        if own:
            yield found()

    dealt = fps.mapInArrow(deal, "bucket long, fps binary").repartition(min(1 << bits, 1 + n * flips_all // variants), "bucket")
    return dealt.sortWithinPartitions("bucket").mapInArrow(meet, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """The smallest node (`root`) that each `node` of the links (`u`, `v`) can reach; roots themselves are left out.

    Alternates the large star and the small star until nothing changes; every round is a few joins and
    sums by node, whatever a node's degree, and is written to the shared folder.
    """
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "links")
    state = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).union(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).filter("u <> v")
        before, edges = edges, written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
        discard(before)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def grouped(made: DataFrame, least: str, most: int = 4) -> DataFrame:
    """Each distinct fingerprint (`fp`) of `made` and `least`, the smallest value of that column it is linked with.

    Fingerprints without links keep their own. The members of a group learn its name in `SALTS` parts.
    """
    first = written(made.groupBy("fp").agg(F.min(least).alias("first")), "distinct")
    hangs = components(links(first.select("fp"), most))
    members = first.join(hangs, first["fp"] == hangs["node"]).select("fp", "first", "root")
    best = members.groupBy("root").agg(F.min("first").alias("best"))
    named = written(first.join(best, first["fp"] == best["root"]).select("root", F.least("first", "best").alias("least")), "named")
    salted = named.select("root", "least", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    told = members.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(salted, ["root", "salt"]).select("fp", "least")
    others = first.join(hangs.select(F.col("node").alias("fp")), "fp", "left_anti").join(named.select(F.col("root").alias("fp"), "least"), "fp", "left")
    return told.unionByName(others.select("fp", F.coalesce("least", "first").alias("least")))


def near_duplicates(docs: DataFrame, width: int = 4, most: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: `fingerprint` in hex and `component_id`, the smallest id it is linked with.

    Null texts and texts without words have fingerprint zero, which links like any other. Repeated rows
    stay; a null id never names a component unless all its documents have one. An empty table gives no
    rows. Other columns are left out, whatever their names.
    """
    made = written(fingerprints(docs, width, id_col, text_col), "fingerprints")
    named = grouped(made, id_col, most).select("fp", F.col("least").alias("component_id"))
    return made.join(named, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, width: int = 4, most: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each group of near duplicates: the one with the smallest id, null ids last.

    Null texts count as empty, and texts without words are alike. Rows of one id with different texts are
    told apart by a hash of the texts; of rows alike in both, one stays. An empty table stays empty. All columns
    stay, whatever their names.
    """
    own, names, back = shielded(docs)
    id_, text = F.col(names[id_col]), F.col(names[text_col])
    h = F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))
    key = F.struct(id_.isNull().alias("none"), id_.alias("id"), h.alias("h"))
    made = written(fingerprints(own.select(key.alias("key"), text), width, "key", names[text_col]), "fingerprints")
    best = grouped(made, "key", most).select("least.*").distinct().select(F.col("id").alias("best"), F.col("h").alias("best_h"))
    same = F.col("id").eqNullSafe(F.col("best")) & (F.col("h") == F.col("best_h"))
    kept = own.withColumns({"id": id_, "h": h}).join(best, same, "left_semi")
    return back(kept.dropDuplicates(["id", "h"]))
