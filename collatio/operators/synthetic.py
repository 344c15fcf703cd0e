"""Made-up responses, and the study of five tracks over them, which needs no provider."""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ref_label
from ..schemas import VARIANTS
from ..sources.records import write_text
from . import export, pilot, runs
from .scoring import KEY, other_key, same_reference, score
from .statistics import bootstrap, cluster_means

#: Settings of a made-up run.
SETTINGS = {"temperature": 0.0, "reasoning_effort": None, "max_output_tokens": 512, "endpoint": "http://synthetic.invalid"}


def synthetic_responses(own: DataFrame) -> DataFrame:
    """Responses of two made-up models in three runs each, in eleven categories by place (`ord`), run and model.

    `own` are cases with their `text` and their edition's place in the catalog (`pos`). They measure nothing; they exercise
    exact recall, punctuation, other editions, mixed wording, refusals, empty output and failures.
    """
    others = other_key(own.select(*KEY, F.col("pos").alias("o_pos"), F.col("text").alias("o_text")))
    other = own.join(others, same_reference() & (F.col("text") != F.col("o_text")), "left").groupBy("case_id").agg(F.min(F.struct("o_pos", "o_text")).alias("o"))
    rows = own.join(other, "case_id").withColumn("alt", F.coalesce("o.o_text", "text"))
    rows = rows.withColumn("m", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("r", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    category = (F.col("ord") + F.col("r") + 3 * F.col("m")) % 11
    tokens = lambda c: F.filter(F.split(c, r"\s+"), lambda x: x != "")
    half = lambda c: F.floor(F.size(tokens(c)) / 2).cast("int")
    spliced = F.concat(F.array_join(F.slice(tokens("text"), F.lit(1), half("text")), " "), F.lit(" "), F.array_join(F.slice(tokens("alt"), half("alt") + 1, F.size(tokens("alt")) - half("alt")), " "))
    copied = (F.col("prompt_variant") == "copy_control") & (category != 8)
    output = (
        F.when(copied | (category < 4), F.col("text"))
        .when(category == 4, F.translate("text", ",.;:!?", ""))
        .when(category == 5, F.col("alt"))
        .when(category == 6, spliced)
        .when(category == 7, "I cannot provide that passage.")
        .when(category == 8, F.concat(F.lit("Here is the passage: "), "text"))
        .otherwise("")
    )
    name = F.when(F.col("m") == 0, "a").otherwise("b")
    return rows.select(
        "case_id", F.concat(name, F.lit("-"), "r").alias("run_id"), F.lit("synthetic").alias("provider"), F.concat(F.lit("synthetic-"), name).alias("model"),
        F.concat(F.lit("synthetic-"), name).alias("resolved_model"), output.alias("output"), F.when((category == 10) & ~copied, "synthetic provider failure").alias("error"), category.cast("int").alias("category"), "ord",
    )


def tracks(cases: DataFrame, references: DataFrame, editions: DataFrame, count: int, length: int = 3) -> tuple[DataFrame, DataFrame]:
    """Cases and references of a pilot's five tracks, told apart by `track`: the prompt variants of `count` anchors, and up to as many passages.

    `editions` has `pos`; cases have `ord`, their place within the track.
    """
    pilot.gate(cases, editions, count)
    place = editions.select(F.col("id").alias("translation"), "pos")
    label = ref_label(*(F.col(k) for k in KEY))
    single = pilot.variants(cases.drop("pos", "text", "ord", "ref_label"), pilot.anchors(cases, count)).withColumn("track", F.col("prompt_variant"))
    found = pilot.passages(pilot.passage_candidates(cases, references, editions.count(), length), count, length)
    passages = found.select("case_id", "translation", *KEY, "stratum", "prompt_variant", F.lit("passage").alias("track"))
    own = single.select(*passages.columns).unionByName(passages).withColumn("ref_label", label)
    texts = references.select("translation", *KEY, "text").crossJoin(references.sparkSession.createDataFrame([(v,) for v in VARIANTS], "track string"))  # four names
    wanted = other_key(own.select(F.col("track").alias("__track"), F.col("translation").alias("__edition"), *KEY))
    used = texts.join(wanted, (F.col("track") == F.col("__track")) & (F.col("translation") == F.col("__edition")) & same_reference(), "left_semi")
    refs = used.select("track", "translation", *KEY, "text").unionByName(found.select(F.lit("passage").alias("track"), "translation", *KEY, "text"))
    placed = own.join(place, "translation")
    order = F.transform(F.array_sort(F.collect_list(F.struct("ref_label", "pos", "case_id"))), lambda x: x["case_id"])
    numbers = placed.groupBy("track").agg(order.alias("ids")).select("track", F.posexplode("ids").alias("ord", "case_id"))  # a pilot has some hundred cases
    return placed.join(numbers, ["track", "case_id"]).withColumn("ord", F.col("ord").cast("long")), refs


def responses(cases: DataFrame, references: DataFrame) -> DataFrame:
    """The made-up responses of all tracks in one pass, with the settings of their runs. A reference's alternatives are those of its track."""
    same = (F.col("track") == F.col("__track")) & (F.col("translation") == F.col("__edition")) & same_reference()
    texts = other_key(references.select(F.col("track").alias("__track"), F.col("translation").alias("__edition"), *KEY, "text"))
    own = cases.join(texts, same).select(cases["*"], "text")
    # A reference's texts are the same in each track that has it, and none is single in one track and a passage in another.
    told = synthetic_responses(own).join(cases.select("case_id", "track"), "case_id")
    return told.withColumns({"temperature": F.lit(SETTINGS["temperature"]).cast("float"), "reasoning_effort": F.lit(SETTINGS["reasoning_effort"]).cast("string"), "seed": F.lit(None).cast("decimal(20,0)"), "system_fingerprint": F.lit(None).cast("string")})


def by_track(cases: DataFrame, references: DataFrame, given: DataFrame, resamples: int = 2000) -> DataFrame:
    """Exact text by track and model, with its interval, all tracks in one pass: `track`, `model`, `cases`, `estimate`, `lower`, `upper`, `clusters`, `resamples`."""
    mark = lambda df, name: df.withColumn(name, F.concat("track", F.lit("|"), name))
    # A track's editions are apart from another's, so that its cases are scored against its own texts.
    scores = score(mark(given, "case_id"), mark(mark(cases, "case_id"), "translation"), mark(references, "translation"))
    scores = scores.withColumn("track", F.substring_index("case_id", "|", 1))
    counts = scores.groupBy("track", "model").agg(F.countDistinct("case_id").alias("cases"))
    return counts.join(bootstrap(cluster_means(scores, "exact_text", "track", "model"), resamples, "track", "model"), ["track", "model"])


def study(cases: DataFrame, references: DataFrame, editions: DataFrame, folder: str, count: int, resamples: int = 2000, only: tuple[str, ...] = export.TRACKS) -> dict[str, dict]:
    """Builds a pilot, makes responses, and runs the validated analysis of each track; writes each study's files, one page for all, and a summary. Returns the studies by track."""
    own, refs = tracks(cases, references, editions, count)
    own, refs = runs.settled(own), runs.settled(refs)  # a pilot has some hundred cases, and every track's analysis reads them
    given = runs.settled(responses(own, refs))
    at, found = Path(folder), {}
    for track in only:
        mine = lambda df, track=track: df.filter(F.col("track") == track).drop("track")
        some, texts, said = mine(own), mine(refs), mine(given)
        configs = said.select("provider", "model", "run_id").distinct().withColumns({n: F.lit(v).cast("float" if n == "temperature" else "int" if n == "max_output_tokens" else "string") for n, v in SETTINGS.items()})
        manifests = runs.make_manifests(configs, some, texts, editions, said, "synthetic_fixture")
        found[track] = export.export_study(runs.analyze(some, texts, editions, manifests, said, resamples), str(at / track))
    write_text(export.study_page(list(found.values())), str(at / "index.html"))
    lines = ["# Synthetic pilot", "", "Made-up responses; they measure no model. No paid calls were made.", "", "| Track | Cases/run | Reference clusters | Exact text, first | Exact text, second |", "| --- | ---: | ---: | ---: | ---: |"]
    for track, s in found.items():
        models = list(s["models"].values())
        lines.append(f"| [{track}]({track}/analysis.md) | {models[0]['cases_per_run']} | {models[0]['exact_text']['clusters']} | " + " | ".join(f"{100 * m['exact_text']['estimate']:.2f}%" for m in models) + " |")
    write_text("\n".join(lines) + "\n", str(at / "README.md"))
    return found
