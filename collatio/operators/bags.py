"""Matching of two exports as bags: rows that are alike are told apart by copy, and what one side has more of is surplus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts into which the copies of a key are numbered by themselves.
PARTS = 64


def _same(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return out


def balance(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """By key: `matched` copies, and the `left_surplus` and `right_surplus`. Null keys are alike. Both sides are counted before any shuffle."""
    sides = [df.select(*keys, F.lit(n).alias("l"), F.lit(1 - n).alias("r")) for df, n in ((left, 1), (right, 0))]
    both = sides[0].unionByName(sides[1]).groupBy(*keys).agg(F.sum("l").cast("long").alias("l"), F.sum("r").cast("long").alias("r"))
    return both.select(*keys, F.least("l", "r").alias("matched"), F.greatest(F.col("l") - F.col("r"), F.lit(0)).alias("left_surplus"), F.greatest(F.col("r") - F.col("l"), F.lit(0)).alias("right_surplus"))


def numbered(rows: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """`rows` with `copy`, from 0, of their key. Copies are numbered in `PARTS` by a hash of the id, each behind those before it,
    so that a key of many rows is many tasks' work. Ids are distinct within a key."""
    own = rows.withColumn("__part", F.pmod(F.xxhash64(id_col), F.lit(PARTS)).cast("int"))
    counts = own.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    nth = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(id_col)) - 1
    joined = own.withColumn("__nth", nth).alias("l").join(counts.alias("r"), _same([*keys, "__part"]))
    return joined.select(*(F.col(f"l.{c}") for c in rows.columns), (F.col("l.__nth") + F.col("r.__before")).alias("copy"))


def paired(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str) -> DataFrame:
    """Rows of both sides, copy by copy: the keys, `copy`, `left_id` and `right_id`; one of them is null in a surplus row."""
    a = numbered(left.select(*keys, F.col(left_id).alias("left_id")), keys, "left_id")
    b = numbered(right.select(*keys, F.col(right_id).alias("right_id")), keys, "right_id")
    joined = a.alias("l").join(b.alias("r"), _same([*keys, "copy"]), "full_outer")
    there = F.col("l.copy").isNotNull()
    return joined.select(*(F.when(there, F.col(f"l.{c}")).otherwise(F.col(f"r.{c}")).alias(c) for c in [*keys, "copy"]), "left_id", "right_id")


#: The counters by which rows of an account's export are matched with what a client reports.
COUNTERS = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens"]


def unbalanced_rows(export: DataFrame, total: str = "total_tokens") -> DataFrame:
    """Rows of an export whose total is not the sum of their counters; missing counters are unknown, so such rows count too."""
    counted = sum((F.col(c) for c in COUNTERS[1:]), F.col(COUNTERS[0]))
    return export.filter(~F.coalesce(counted == F.col(total), F.lit(False)))
