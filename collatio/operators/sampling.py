"""Deterministic stratified sampling of references present in every edition.

Each step is a ranked pick by seeded digests. The picks are bounded by the sample's quotas, which are
parameters, so pools and picks go through ordered limits and anti-joins.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digests import deterministic_key
from ..functions.text import ref_label, space_tokens, word_distance
from .scoring import KEY


@dataclass(frozen=True)
class SamplingConfig:
    release_id: str
    seed: str
    total_references: int
    dev_references: int
    famous_references: int
    translation_sensitive_references: int
    short_references: int
    long_references: int
    schema_version: int = 2

    def check(self, editions: list[str], locked: list[str]) -> None:
        if self.schema_version not in (1, 2):
            raise ValueError(f"unsupported schema_version {self.schema_version}")
        if self.dev_references >= self.total_references:
            raise ValueError("dev_references must be smaller than total_references")
        if self.famous_references + self.translation_sensitive_references + self.short_references + self.long_references > self.total_references:
            raise ValueError("quotas exceed total_references")
        if len(editions) < 2:
            raise ValueError("sampling needs two editions or more")
        if missing := sorted(set(editions) - set(locked)):
            raise ValueError(f"missing lock for {missing[0]}")

    def part(self, public: bool) -> "SamplingConfig":
        """The quotas of the public part, or of what it leaves."""
        share = lambda v: v * self.dev_references // self.total_references if public else v - v * self.dev_references // self.total_references
        names = ("famous_references", "translation_sensitive_references", "short_references", "long_references")
        total = self.dev_references if public else self.total_references - self.dev_references
        return replace(self, total_references=total, dev_references=0, **{n: share(getattr(self, n)) for n in names})


def common_universe(references: DataFrame, editions: list[str]) -> DataFrame:
    """Single-verse references that every edition has: `KEY`, `ref_label`."""
    own = references.filter(F.col("translation").isin(editions) & F.col("verse_end").isNull())
    shared = own.groupBy(*KEY).agg(F.countDistinct("translation").alias("n")).filter(F.col("n") == len(editions))
    return shared.select(*KEY, ref_label(*(F.col(k) for k in KEY)).alias("ref_label"))


def disagreement(references: DataFrame) -> DataFrame:
    """By reference: mean over pairs of editions of word distance by the longer text's words."""
    own = references.select(*KEY, ref_label(*(F.col(k) for k in KEY)).alias("ref_label"), "translation", space_tokens(F.col("text")).alias("tokens"))
    right = own.select("ref_label", F.col("translation").alias("other"), F.col("tokens").alias("theirs"))
    pairs = own.join(right, "ref_label").filter("translation < other")
    share = word_distance(F.col("tokens"), F.col("theirs")) / F.greatest(F.size("tokens"), F.size("theirs"), F.lit(1))
    found = pairs.groupBy("ref_label").agg(F.avg(share).alias("disagreement"))
    return own.select("ref_label").distinct().join(found, "ref_label", "left").select("ref_label", F.coalesce("disagreement", F.lit(0.0)).alias("disagreement"))


def mean_length(references: DataFrame) -> DataFrame:
    """By reference: mean words of its editions, as an integer division."""
    own = references.select(ref_label(*(F.col(k) for k in KEY)).alias("ref_label"), F.size(space_tokens(F.col("text"))).alias("n"))
    return own.groupBy("ref_label").agg(F.expr("sum(n) div count(*)").alias("mean_length"))


def _take(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def _pooled(rows: DataFrame, order: list[Column], n: int, pool: Column, version: int) -> DataFrame:
    """The first n; from version 2 on, a pool of 5n in order, then n of it by another digest."""
    if version == 2:
        return _take(_take(rows, order, 5 * n), [pool], n)
    return _take(rows, order, n)


def require_pool(rows: DataFrame, n: int, what: str) -> None:
    if n and rows.limit(2 * n).count() < 2 * n:
        raise ValueError(f"{what}: the pool must hold twice the quota")


def select_partition(config: SamplingConfig, universe: DataFrame, references: DataFrame, curated: DataFrame, strict: bool = False) -> DataFrame:
    """`ref_label` and `stratum` of the picks: curated, edition-sensitive, short, long, then at random.

    `curated` has `ref_label` and `stratum`. `strict` checks that pools are large enough (an action each).
    Each step's picks, no more than its quota, are fetched before the next step leaves them out; a plan of
    all steps at once would hold the first ones many times over.
    """
    spark = universe.sparkSession
    key = lambda purpose: deterministic_key(config.seed, purpose, F.col("ref_label"))
    left = universe.select("ref_label")
    picked: list[tuple[str, str]] = []

    def frame() -> DataFrame:
        return spark.createDataFrame(picked, "ref_label string, stratum string")

    def add(chosen: DataFrame) -> None:
        picked.extend((r[0], r[1]) for r in chosen.select("ref_label", "stratum").collect())

    def step(pool: DataFrame, order: list[Column], n: int, purpose: str, stratum: str) -> None:
        open_ = pool.join(left, "ref_label", "left_semi").join(frame(), "ref_label", "left_anti")
        if strict and config.schema_version == 2:
            require_pool(open_, n, stratum)
        add(_pooled(open_, order, n, key(purpose), config.schema_version).withColumn("stratum", F.lit(stratum)))

    famous = curated.filter(F.col("stratum").isin("extremely_famous", "well_known")).join(left, "ref_label", "left_semi")
    if strict:
        require_pool(famous, config.famous_references, "famous")
    add(_take(famous, [key("famous")], config.famous_references))
    own = references.withColumn("ref_label", ref_label(*(F.col(k) for k in KEY))).join(left, "ref_label", "left_semi").drop("ref_label")
    step(disagreement(own), [F.desc("disagreement"), key("sensitive")], config.translation_sensitive_references, "sensitive-pool", "translation_sensitive")
    lengths = mean_length(own)
    step(lengths, [F.asc("mean_length"), key("length")], config.short_references, "length-pool", "short_verse")
    step(lengths, [F.desc("mean_length"), key("length").desc()], config.long_references, "length-pool", "long_verse")
    rest = left.join(frame(), "ref_label", "left_anti")
    add(_take(rest, [key("random")], config.total_references - len(picked)).withColumn("stratum", F.lit("random")))
    return frame()


def sample(config: SamplingConfig, private_seed: str, references: DataFrame, editions: list[str], curated: DataFrame, strict: bool = False) -> DataFrame:
    """`split` (dev or hid), `ref_label`, `stratum`: the public part first, then the private one from what is left."""
    universe = common_universe(references, editions)
    public = select_partition(config.part(True), universe, references, curated, strict)
    rest = universe.join(public, "ref_label", "left_anti")
    private = select_partition(replace(config.part(False), seed=private_seed), rest, references, curated, strict)
    return public.withColumn("split", F.lit("dev")).unionByName(private.withColumn("split", F.lit("hid"))).select("split", "ref_label", "stratum")


#: Fixed value: how ids of cases begin.
PREFIX = "BQ"


def build_cases(config: SamplingConfig, picked: DataFrame, editions: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """A case for each pick and edition (`translation`, `pos`), in order of label and edition."""
    rows = picked.crossJoin(editions.select("translation", "pos"))  # editions are a handful
    digest = F.substring(F.sha2(F.concat_ws("|", F.lit(config.release_id), "split", "translation", "ref_label"), 256), 1, 16)
    return rows.select(F.upper(F.concat(F.lit(prefix), F.lit("-"), "split", F.lit("-"), digest)).alias("case_id"), "split", "translation", "pos", "ref_label", "stratum", F.lit("canonical").alias("prompt_variant"))


def selected_records(references: DataFrame, picked: DataFrame) -> DataFrame:
    own = references.withColumn("ref_label", ref_label(*(F.col(k) for k in KEY)))
    return own.join(picked, "ref_label", "left_semi")


def stratum_counts(picked: DataFrame) -> DataFrame:
    return picked.groupBy("split", "stratum").agg(F.count(F.lit(1)).alias("n"))
