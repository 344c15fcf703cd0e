"""A training corpus from `documents`: rules, near-dedup, decontamination, secrets, packing.

Each stage takes what its predecessor wrote. All but the last return the columns of `documents`, further
columns included, whatever their names. An empty table stays empty, texts of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from collatio.llm import contamination, packing, quality, secrets, simhash
from collatio.llm.common import table, written


def _counted(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """`changed` with `n_chars`, where `docs` has it, as the texts now have them."""
    if "n_chars" not in docs.columns:
        return changed
    return changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; of the others, lines that failed go, and all else stays as it is.

    Null and empty texts have no words and are rejected. Repeated rows are judged alike.
    """
    return _counted(docs, quality.cleaned(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id, null ids last; of rows alike in id and text, one.

    Texts without words are alike.
    """
    return simhash.representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages go. Null texts and texts without words have none; an empty benchmark takes none away."""
    return contamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, repeated ones too; secrets in their texts are replaced by a mark. Null texts stay null; null sources are one owner."""
    return _counted(docs, secrets.redacted(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences. A null or empty text is one piece with the end id alone."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("secret_scans", redact_secrets),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs


#: SQL cannot express the near-duplicate groups or the token ids over whole tables.
ORACLE_SQL = None
