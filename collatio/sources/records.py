"""Typed record files: strict JSON and JSON lines, unions of files, and sinks."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import CASE, CATALOG, REFERENCE_RECORD


def schema_of(ddl: str | T.StructType) -> T.StructType:
    return T._parse_datatype_string(ddl) if isinstance(ddl, str) else ddl


def read_json(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One document; a wrong type is an error."""
    return spark.read.schema(schema_of(schema)).json(path, multiLine=True, mode="FAILFAST")


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Non-blank lines with their file's place in `paths`, and their physical number from 1.

    Files are split like any others. A split's lines are counted, blank ones too; a line's number is its place in
    the split behind the lines of the splits before it. Only a row a split is sorted and joined.
    """
    out = None
    for k, p in enumerate(paths):
        read = spark.read.option("lineSep", "\n").text(p)
        own = read.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("nth"), F.regexp_replace("value", "\r$", "").alias("line"))
        splits = own.groupBy("path", "begin").agg(F.min("nth").alias("first"), F.count(F.lit(1)).alias("lines"))
        earlier = Window.partitionBy("path").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
        splits = splits.select("path", "begin", (F.coalesce(F.sum("lines").over(earlier), F.lit(0)) - F.col("first") + 1).alias("shift"))
        one = own.join(splits, ["path", "begin"]).select(F.lit(k).alias("file"), (F.col("nth") + F.col("shift")).alias("line_no"), "line").filter(F.trim("line") != "")
        out = one if out is None else out.unionByName(one)
    return out


def unknown_keys(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """Lines with top-level keys that the schema lacks; Spark's reader would ignore them."""
    keys = F.array_except(F.coalesce(F.json_object_keys("line"), F.array().cast("array<string>")), F.array(*(F.lit(n) for n in schema.fieldNames())))
    return lines.withColumn("unknown", keys).filter(F.size("unknown") > 0)


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: str | T.StructType) -> DataFrame:
    """Records of files in the order given, with `_ord` (file, line). A bad line or an unknown key raises an error that names the line."""
    shape, paths = schema_of(schema), [paths] if isinstance(paths, str) else paths
    lines = _lines(spark, paths)
    parsed = lines.withColumn("r", F.from_json("line", T.StructType([*shape.fields, T.StructField("_bad", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    where = F.concat(F.lit("line "), F.col("line_no"), F.lit(" of file "), F.col("file"))
    extra = F.array_except(F.coalesce(F.json_object_keys("line"), F.array().cast("array<string>")), F.array(*(F.lit(n) for n in shape.fieldNames())))
    # Spark may look at a filter of the caller's, and so parse, before it leaves out blank lines: those are no fault here.
    fault = F.when(F.trim("line") == "", None).when(F.col("r").isNull() | F.col("r._bad").isNotNull(), F.concat(F.lit("invalid record at "), where)).when(F.size(extra) > 0, F.concat(F.lit("unknown field at "), where))
    checked = F.when(fault.isNotNull(), F.raise_error(fault).cast(shape)).otherwise(F.struct(*(F.col(f"r.{n}").alias(n) for n in shape.fieldNames())))
    return parsed.select("file", "line_no", checked.alias("r")).select("r.*", F.struct("file", "line_no").alias("_ord"))


def read_records(spark: SparkSession, paths: str | list[str], schema: str | T.StructType) -> DataFrame:
    """Records of any number of large files, split over tasks; strict in types, without line numbers."""
    return spark.read.schema(schema_of(schema)).json(paths, mode="FAILFAST")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} has no records")
    return df


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Compact JSON lines; with `order`, one file in that order."""
    (df.orderBy(*order).coalesce(1) if order else df).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_json(value: object, path: str) -> None:
    """A small result as an indented document with a newline at its end, put in place by a rename."""
    write_text(json.dumps(value, indent=2, ensure_ascii=False) + "\n", path)


def write_text(text: str, path: str) -> None:
    target = Path(path)
    part = target.with_name(f".{target.name}.part")
    part.write_text(text, encoding="utf-8")
    part.replace(target)


def load_dataset(spark: SparkSession, catalog: str, cases: str | list[str], references: str | list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Editions, cases and references of a dataset's three files, with references' fields as columns and their place in the files (`ord`)."""
    editions = read_json(spark, catalog, CATALOG).select(F.posexplode("translations").alias("ord", "t")).select("t.*", "ord")
    flat = lambda df: df.select("*", "reference.*").drop("reference")
    numbered = lambda df: df.withColumn("ord", F.col("_ord.file").cast("long") * 2**40 + F.col("_ord.line_no")).drop("_ord")
    own = numbered(flat(require_rows(read_jsonl(spark, cases, CASE), "cases"))).fillna("canonical", ["prompt_variant"])
    return editions, own, numbered(flat(require_rows(read_jsonl(spark, references, REFERENCE_RECORD), "references")))
