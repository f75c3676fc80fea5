"""A training corpus from raw documents: five stages, each over all its predecessor kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from liveops.llm import decontam, langid, linedup, neardup, packing
from liveops.session import shared_folder


def language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents in one of the learned languages; those without text or letters go."""
    return langid.in_a_language(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts without later copies of line runs; documents of which nothing is left go."""
    return linedup.without_repeats(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies."""
    return neardup.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no benchmark item, also not with other numbers, names or units."""
    return decontam.without_leaks(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Places of all token pieces in sequences of 2,048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: The trained and searching stages have no SQL form; tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """The stages applied to ``documents``, each written as Parquet and read as the next one's."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    place = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, folder).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
    return docs
