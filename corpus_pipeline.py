"""Corpus pipeline over ``documents``: each stage is one operator of ``pulsegrid.llm``, written as Parquet before the next one reads it.

Stages: quality rules (rejected documents go), n-gram Jaccard join (one document of each group stays), secret scan (secrets become a mark), mixing to target
weights (documents are repeated or left out), best-fit packing (the result: one row per piece).  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid.llm import jaccard, mixing, packing, quality, secrets
from pulsegrid.llm.common import table, write_once

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
NEAR_DUPLICATE = jaccard.Rule(size=5, per_cent=80)

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed rules or the trees reject go."""
    return quality.keep(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays, that of the least id (rows without an id last), repeated rows included; rows without words stay.

    Five-word shingles at similarity 0.8; different texts under one id are judged one by one.
    """
    return jaccard.keep_one(docs, "doc_id", "text", NEAR_DUPLICATE).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in a text becomes a mark; no document goes. ``n_chars`` stays the length of the source text."""
    return secrets.redact(secrets.scan(docs)).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a repeated document is as many rows."""
    identity = [F.col("doc_id"), F.crc32(F.coalesce("text", F.lit("")).cast("binary"))]
    return mixing.repeated(mixing.mix(docs, F.array("source"), identity), "copies").select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its sequence and place there."""
    return packing.pack(docs, "doc_id", "text")


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scan", secret_scan),
    ("mixing sources", source_mix),
    ("best-fit packing", best_fit_packing),
]

#: The stages train trees, solve a flow and pack greedily: no SQL expresses their rows, so tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_once(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
