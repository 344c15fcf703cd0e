"""Pilot datasets: anchors round robin over strata, and passages of consecutive verses that do not overlap."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ref_label
from ..schemas import STRATA, VARIANTS, camel
from .scoring import KEY


def variant_name(column: str = "stratum"):
    """A stratum as its variant's name, by which strata take turns."""
    names = F.create_map(*(F.lit(x) for s in STRATA for x in (s, camel(s))))
    return F.element_at(names, F.col(column))


def anchors(cases: DataFrame, count: int) -> DataFrame:
    """The first `count` references: one of each stratum a round, in order of label inside."""
    refs = cases.select(ref_label(*(F.col(k) for k in KEY)).alias("ref_label"), "stratum").distinct()
    turn = F.row_number().over(Window.partitionBy("stratum").orderBy("ref_label"))
    return refs.withColumns({"round": turn, "variant": variant_name()}).orderBy("round", "variant").limit(count)


def variants(cases: DataFrame, chosen: DataFrame) -> DataFrame:
    """The anchors' cases in all prompt variants."""
    base = cases.withColumn("ref_label", ref_label(*(F.col(k) for k in KEY))).join(chosen.select("ref_label"), "ref_label", "left_semi")
    rows = base.withColumn("prompt_variant", F.explode(F.array(*map(F.lit, VARIANTS))))
    return rows.withColumn("case_id", F.concat_ws("-", "case_id", "prompt_variant"))


def passage_candidates(cases: DataFrame, references: DataFrame, editions: int, length: int = 3) -> DataFrame:
    """Starts of `length` verses that every edition has: `ref_label` and, by edition, the joined text."""
    starts = cases.select("book", "chapter", F.col("verse_start").alias("start"), ref_label(*(F.col(k) for k in KEY)).alias("ref_label"), "translation", "case_id").filter("start is not null")
    each = starts.withColumn("verse", F.explode(F.sequence("start", F.col("start") + length - 1)))
    texts = references.filter("verse_end is null").select("translation", "book", "chapter", F.col("verse_start").alias("verse"), "text")
    joined = each.join(texts, ["translation", "book", "chapter", "verse"])
    whole = joined.groupBy("book", "chapter", "start", "ref_label", "translation", "case_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("verse", "text"))), lambda x: x["text"]), " ").alias("text")).filter(F.col("n") == length)
    return whole.groupBy("book", "chapter", "start", "ref_label").agg(F.countDistinct("translation").alias("n"), F.collect_list(F.struct("translation", "case_id", "text")).alias("texts")).filter(F.col("n") == editions).drop("n")


def passages(candidates: DataFrame, count: int, length: int = 3) -> DataFrame:
    """Candidates in order of label, each kept if none of its verses is taken; then the first `count`.

    What is kept in a chapter depends on that chapter alone, so chapters are worked through side by side.
    """

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        taken: set[int] = set()
        out = []
        for label, start in rows.sort_values("ref_label")[["ref_label", "start"]].itertuples(index=False):
            own = set(range(start, start + length))
            if not own & taken:
                taken |= own
                out.append(label)
        return pd.DataFrame({"ref_label": pd.Series(out, dtype=object)})

    kept = candidates.select("book", "chapter", "start", "ref_label").groupBy("book", "chapter").applyInPandas(keep, "ref_label string")
    first = kept.orderBy("ref_label").limit(count)
    chosen = candidates.join(first, "ref_label", "left_semi").select("book", "chapter", F.col("start").alias("verse_start"), (F.col("start") + length - 1).alias("verse_end"), F.explode("texts").alias("t"))
    return chosen.select("book", "chapter", "verse_start", "verse_end", "t.translation", F.concat("t.case_id", F.lit("-passage")).alias("case_id"), "t.text", F.lit("passage").alias("stratum"), F.lit("canonical").alias("prompt_variant"))


#: How ids of development cases and of hidden cases begin.
DEV, HIDDEN = "BQ-DEV-", "BQ-HID-"


def gate(cases: DataFrame, editions: DataFrame, count: int) -> None:
    """Raises unless a pilot of `count` references may be drawn: two or more, public editions, development cases only, and enough of them."""
    private = editions.filter((F.col("license_kind") != "public_domain") | ~F.col("redistribute_reference_text"))
    if count < 2 or not private.isEmpty() or not cases.filter(~F.col("case_id").startswith(DEV)).isEmpty():
        raise ValueError("a pilot needs at least two public development references and editions that may be redistributed")
    if cases.select("ref_label").distinct().limit(count).count() < count:
        raise ValueError("not enough public references for the pilot")


def public_only(rows: DataFrame, editions: DataFrame, case_id: str = "case_id", hidden: str = HIDDEN) -> DataFrame:
    """`rows`, or none of them unless all editions are public and no case id is hidden."""
    gate = editions.agg(F.bool_and((F.col("license_kind") == "public_domain") & F.col("redistribute_reference_text")).alias("public"))
    ids = rows.agg(F.coalesce(F.bool_and(~F.col(case_id).startswith(hidden)), F.lit(True)).alias("shown"))
    return rows.crossJoin(gate.crossJoin(ids)).filter("public and shown").drop("public", "shown")  # one row beside each
