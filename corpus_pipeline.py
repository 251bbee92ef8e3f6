"""Cleaning a corpus in stages, each on all that its predecessor kept.

A stage takes the session, documents and the folder of the tables, and returns the
documents that it keeps, in the columns they came in. The last one, the mix, returns the
documents that are taken, with how many of their words are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.decontaminate import drop_contaminated
from tidemark.llm.language import keep_identified
from tidemark.llm.mixing import take_mix
from tidemark.llm.secrets import redact
from tidemark.llm.simhash import keep_one_of_each_group
from tidemark.plans.staging import drop, scratch, stage, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents whose language cannot be told: null texts and those without a letter.

    No text with letters is rejected, however far from all languages it is; where no
    document has a language to learn from, all of them stay.
    """
    return keep_identified(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near copies."""
    return keep_one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents of which one word in twenty or more is inside benchmark windows."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts marks in the place of secrets, [credential] for live ones and [example] for copied ones."""
    return redact(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents, up to three times, so that sources come near their target weights."""
    return take_mix(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("mixing", mixing),
]

# SQL cannot express language profiles or SimHash; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of `sf_dir`, each written and read again by the next.

    What a stage has staged is dropped once its result is written, and that once the next
    one's is; what the last one reads stays.
    """
    docs, former = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, apply in STAGES[:-1]:
        with scratch(spark):
            docs = stage(apply(spark, docs, sf_dir), name)
        if former:
            drop(spark, former)
        former = written(spark)[-1]
    return STAGES[-1][1](spark, docs, sf_dir)
