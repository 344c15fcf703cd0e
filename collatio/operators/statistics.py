"""Stratified cluster bootstrap with counter-mode draws."""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the draws are SHA-256 of this and a counter.
STREAM = "bqb/bootstrap/v1/"
_STREAM = STREAM.encode()
#: Clusters of a stratum that a task may hold, 16 bytes each and some, and tasks among which a stratum's resamples are dealt.
STRATUM, PARTS = 2_000_000, 16


def draw(counter: Column) -> Column:
    """The counter's 64-bit value: the first eight bytes of its digest, little-endian, as decimal(20,0)."""
    digest = F.sha2(F.concat(F.lit(STREAM), counter.cast("string")), 256)
    swapped = F.concat(*(F.substring(digest, at, 2) for at in range(15, 0, -2)))
    return F.conv(swapped, 16, 10).cast("decimal(20,0)")


def cluster_means(scores: DataFrame, flag: str = "exact_text", *keys: str) -> DataFrame:
    """Mean of a flag by stratum and reference, over editions and repetitions."""
    return scores.groupBy(*keys, "stratum", "ref_label").agg(F.avg(F.col(flag).cast("double")).alias("value"))


def paired_differences(scores: DataFrame, left: Column, right: Column, flag: str = "exact_text") -> DataFrame:
    """Left mean less right mean of each cluster; a cluster that only one side has gives null."""
    side = lambda c, n: cluster_means(scores.filter(c), flag).withColumnRenamed("value", n)
    joined = side(left, "l").join(side(right, "r"), ["stratum", "ref_label"], "full_outer")
    return joined.select("stratum", "ref_label", (F.col("l") - F.col("r")).alias("value"))


def _sums(keys: list[str], resamples: int):
    """Of a stratum's values (`idx`, `value`): the sum of each resample of a part, by the same draws as rows would have."""

    def sums(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        values, size, offset, all_, part = table["value"].to_numpy(), *(table[c][0].as_py() for c in ("size", "offset", "all", "part"))
        ceiling, found = 2**64 - 1 - (2**64 - 1) % size, []
        numbers = range(part, resamples, PARTS)
        for r in numbers:
            first = r * all_ + offset
            drawn = np.frombuffer(b"".join([sha256(b"%s%d" % (_STREAM, n)).digest()[:8] for n in range(first, first + size)]), "<u8")
            if (drawn >= np.uint64(ceiling)).any():
                raise ValueError("a draw was at the ceiling")
            found.append(float(values[(drawn % np.uint64(size)).astype(np.int64)].sum()))
        same = {k: pa.array([table[k][0].as_py()] * len(found), table[k].type) for k in keys}
        return pa.table({**same, "r": pa.array(numbers, pa.int64()), "all": pa.array([all_] * len(found), pa.int64()), "total": pa.array(found, pa.float64())})

    return sums


def bootstrap(clusters: DataFrame, resamples: int, *keys: str, most: int = STRATUM) -> DataFrame:
    """Percentile interval of the mean of `value` by `keys`: `estimate`, `lower`, `upper`, `clusters`, `resamples`.

    Each resample draws, stratum by stratum in order of name, as many clusters as the stratum has. Draw
    number p of resample r uses counter r*K + p, K being all clusters, so draws need no loop over resamples.
    A draw at or above the largest multiple of the stratum's size would shift all later ones; that has a
    chance under 1e-17, and raises an error. `keys` of equal stratum sizes share draws.

    A stratum of up to `most` clusters is sent to each of `PARTS` parts of the resamples, whose sums alone are
    shuffled; in a larger one draws are rows of a join with its values.
    """
    if not 100 <= resamples <= 100_000:
        raise ValueError("resamples must be from 100 to 100000")
    by, own = Window.partitionBy(*keys, "stratum"), [*keys, "stratum"]
    indexed = clusters.withColumns({"idx": (F.row_number().over(by.orderBy("ref_label")) - 1).cast("long"), "size": F.count(F.lit(1)).over(by), "value": F.col("value").cast("double")})
    strata = clusters.groupBy(*own).agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy(*keys).orderBy("stratum").rowsBetween(Window.unboundedPreceding, -1)
    strata = strata.withColumns({"offset": F.coalesce(F.sum("size").over(before), F.lit(0)), "all": F.sum("size").over(Window.partitionBy(*keys))})
    same = F.lit(True)
    for c in own:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    named = strata.select(*(F.col(c).alias(f"__{c}") for c in own), "offset", "all")
    small = indexed.filter(F.col("size") <= most).join(named, same).select(*own, "idx", "value", "size", "offset", "all", F.explode(F.sequence(F.lit(0), F.lit(min(PARTS, resamples) - 1))).alias("part"))
    out = T.StructType([*(clusters.schema[k] for k in keys), *T._parse_datatype_string("r long, all long, total double").fields])
    sums = small.groupBy(*own, "part").applyInArrow(_sums(list(keys), resamples), out)
    slots = strata.filter(F.col("size") > most).withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)))
    draws = slots.withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(resamples - 1).cast("long"))))
    value, size = draw(F.col("r") * F.col("all") + F.col("offset") + F.col("slot")), F.col("size").cast("decimal(20,0)")
    largest = F.lit(str(2**64 - 1)).cast("decimal(20,0)")
    ceiling = (largest - largest % size).cast("decimal(20,0)")
    idx = F.when(value >= ceiling, F.raise_error(F.lit("a draw was at the ceiling")).cast("long")).otherwise((value % size).cast("long"))
    drawn = draws.select(*own, "r", "all", idx.alias("idx"))
    values = indexed.filter(F.col("size") > most).select(*own, "idx", "value")
    sums = sums.unionByName(drawn.join(values, [*own, "idx"]).groupBy(*keys, "r", "all").agg(F.sum("value").alias("total")))
    means = sums.groupBy(*keys, "r", "all").agg((F.sum("total") / F.col("all")).alias("mean"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("mean", "r")) - 1
    low, high = resamples * 25 // 1000, min(resamples * 975 // 1000, resamples - 1)
    pick = lambda at: F.max(F.when(F.col("rank") == at, F.col("mean")))
    bounds = means.withColumn("rank", rank).groupBy(*keys).agg(pick(low).alias("lower"), pick(high).alias("upper"))
    estimate = clusters.groupBy(*keys).agg(F.avg("value").alias("estimate"), F.count(F.lit(1)).alias("clusters"))
    joined = estimate.join(bounds, list(keys)) if keys else estimate.crossJoin(bounds)  # two single rows
    return joined.select(*keys, "estimate", "lower", "upper", "clusters", F.lit(resamples).cast("long").alias("resamples"))
