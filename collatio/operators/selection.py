"""Proportional short trials: whole reference groups, strata filled by largest deficit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scoring import KEY


def ref_json() -> Column:
    return F.to_json(F.struct(*KEY))


def _key(seed: str, purpose: str, json: Column) -> Column:
    quoted = F.to_json(F.struct(F.lit(seed).alias("s")))
    head = F.concat(F.lit("["), F.substring(quoted, 6, F.length(quoted) - 6), F.lit(f',"{purpose}",'))
    return F.sha2(F.concat(head, json, F.lit("]")), 256)


def groups(cases: DataFrame) -> DataFrame:
    """Reference groups: `key`, `json`, `stratum`, `editions`; faulty ones have several strata or copy controls."""
    rows = cases.withColumns({"json": ref_json()}).withColumn("key", F.sha2("json", 256))
    return rows.groupBy("key", "json").agg(F.min("stratum").alias("stratum"), F.countDistinct("stratum").alias("strata"), F.array_sort(F.collect_list("translation")).alias("editions"), F.count_if(F.col("prompt_variant") == "copy_control").alias("copies"))


def select(cases: DataFrame, seed: str, limit: int | None = None, translation: str | None = None) -> DataFrame:
    """The chosen cases with `presented`, their place in the seeded order.

    Filling the largest deficit again and again is the same as taking, of all (stratum, k), those with the
    largest deficit at k, because a stratum's deficit falls with k. So quotas are one ordered limit.
    """
    if not seed.strip() or len(seed) > 256:
        raise ValueError("a seed has 1 to 256 characters")
    if limit == 0:
        raise ValueError("case_limit must be positive")
    own = cases if translation is None else cases.filter(F.col("translation") == translation)
    grouped = groups(own)
    shape = grouped.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("editions").alias("shapes"), F.max("strata").alias("strata"), F.sum("copies").alias("copies"), F.max(F.size("editions")).alias("size"), F.count_distinct("stratum").alias("names")).first()
    if not shape["n"]:
        raise ValueError("no cases to select from")
    if shape["copies"] or shape["shapes"] > 1 or shape["strata"] > 1:
        raise ValueError("selection needs matched editions and strata, and no copy controls")
    target = shape["n"] if limit is None else min(limit // shape["size"], shape["n"])
    if not target:
        raise ValueError(f"the limit must fit a group of {shape['size']} editions")
    floor = int(target >= shape["names"])
    sizes = grouped.groupBy("stratum").agg(F.count(F.lit(1)).alias("b"))
    steps = sizes.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b") - 1))).filter(F.col("k") >= floor)
    deficit = F.lit(target) * F.col("b") - F.col("k") * F.lit(shape["n"])
    extra = steps.orderBy(deficit.desc(), _key(seed, "stratum", F.to_json(F.struct("stratum")).substr(F.lit(12), F.length(F.to_json(F.struct("stratum"))) - 12)), "k").limit(target - floor * shape["names"])
    quota = sizes.join(extra.groupBy("stratum").agg(F.count(F.lit(1)).alias("more")), "stratum", "left").select("stratum", (F.coalesce("more", F.lit(0)) + floor).alias("quota"))
    rank = F.row_number().over(Window.partitionBy("stratum").orderBy(_key(seed, "reference", F.col("json"))))
    chosen = grouped.withColumn("rank", rank).join(quota, "stratum").filter("rank <= quota").select("json")
    kept = own.withColumn("json", ref_json()).join(chosen, "json", "left_semi")
    order = Window.orderBy(_key(seed, "presentation", F.col("json")), "translation")  # a trial is some hundred cases
    return kept.withColumn("presented", F.row_number().over(order)).drop("json")


def first_cases(cases: DataFrame, n: int, order: str = "ord") -> DataFrame:
    return cases.orderBy(order).limit(n)
