"""Digests of canonical JSON."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sha256(value: Column) -> Column:
    return F.sha2(value, 256)


def json_text(value: Column) -> Column:
    """A string as JSON; null as `null`."""
    listed = F.to_json(F.array(value))
    return listed.substr(F.lit(2), F.length(listed) - 2)


def record_json(**fields: Column) -> Column:
    """Fields as compact JSON in the order given; absent ones are left out, inside of structs too."""
    return F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())))


def json_digest(value: Column, keep_nulls: bool = False) -> Column:
    """SHA-256 of compact JSON in declared field order; absent fields are left out unless `keep_nulls`."""
    return sha256(F.to_json(value, {"ignoreNullFields": str(not keep_nulls).lower()}))


def _running(rows: Iterator[pa.RecordBatch], marks: Callable[[tuple], tuple[bytes, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
    """Digests of the last column's values, a run of equal keys (the other columns) at a time; `marks` gives what stands before, between and behind the values of a key."""
    names, key, digest, first = None, None, None, True
    for batch in rows:
        names = names or [*batch.schema.names[:-1], "digest"]
        keys = list(zip(*(c.to_pylist() for c in batch.columns[:-1]), strict=True)) or [()] * batch.num_rows
        for own, value in zip(keys, batch.columns[-1].to_pylist(), strict=True):
            if digest is None or own != key:
                if digest is not None:
                    digest.update(end)
                    yield pa.RecordBatch.from_pylist([dict(zip(names, (*key, digest.hexdigest()), strict=True))], schema=schema)
                begin, between, end = marks(own)
                key, digest, first = own, hashlib.sha256(begin), True
                schema = pa.schema([*(batch.schema.field(n) for n in names[:-1]), pa.field("digest", pa.string())])
            digest.update((b"" if first else between) + value)
            first = False
    if digest is not None:
        digest.update(end)
        yield pa.RecordBatch.from_pylist([dict(zip(names, (*key, digest.hexdigest()), strict=True))], schema=schema)


def ordered_digest(rows: DataFrame, value: Column, order: Column, *keys: str, lines: bool = False, around: tuple[str, str] | dict[str, tuple[str, str]] = ("", "")) -> DataFrame:
    """`digest` (a row for each of `keys`; without keys one row, of no rows too): of a JSON array of JSON texts in order, or of them as lines;
    `around` stands before and behind; as a dictionary, it has them by the first key.

    Rows are sorted by Spark and hashed as they pass, so a task holds a batch. A digest of a file is one
    value over all its bytes in order, so the bytes of one meet in one task, as in any hash of a file.
    """

    def marks(key: tuple) -> tuple[bytes, bytes, bytes]:
        if lines:
            return b"", b"\n", b"\n"
        before, behind = around.get(key[0], ("", "")) if isinstance(around, dict) else around
        return (before + "[").encode(), b",", ("]" + behind).encode()

    own = rows.select(*keys, order.alias("__o"), F.encode(value, "UTF-8").alias("__v"))
    own = own.repartition(*keys).sortWithinPartitions(*keys, "__o") if keys else own.orderBy("__o").coalesce(1)
    out = T.StructType([*(rows.schema[k] for k in keys), T.StructField("digest", T.StringType())])
    found = own.drop("__o").mapInArrow(lambda batches: _running(batches, marks), out)
    if keys:
        return found
    nothing = hashlib.sha256(b"" if lines else b"".join(marks(())[::2])).hexdigest()
    return found.agg(F.coalesce(F.max("digest"), F.lit(nothing)).alias("digest"))


def deterministic_key(seed: str | Column, purpose: str, label: Column) -> Column:
    """Rank of a label in a seeded order: SHA-256 of seed, purpose and label, NUL between them."""
    nul = F.decode(F.unhex(F.lit("00")), "UTF-8")
    return sha256(F.concat(F.lit(seed) if isinstance(seed, str) else seed, nul, F.lit(purpose), nul, label))


def file_set_digest(files: DataFrame) -> DataFrame:
    """Of `path` and `content` (binary): path NUL bytes NUL, in order of path; one row `digest`."""
    nul = F.unhex(F.lit("00"))
    own = files.orderBy("path").select(F.concat(F.encode("path", "UTF-8"), nul, F.col("content"), nul).alias("v")).coalesce(1)
    found = own.mapInArrow(lambda batches: _running(batches, lambda key: (b"", b"", b"")), "digest string")
    return found.agg(F.coalesce(F.max("digest"), F.lit(hashlib.sha256(b"").hexdigest())).alias("digest"))
