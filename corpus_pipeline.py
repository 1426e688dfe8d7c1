"""Corpus preparation: five stages, each written as Parquet and read again by the next.

Documents of low quality and toxic ones go, one document of each near-duplicate group stays, sources are brought to
their target shares (documents may then occur up to three times), and what is left is encoded and decoded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panemill.llm import queries, quality, toxicity
from panemill.llm.common import table, written
from panemill.llm.minhash_dedup import deduplicated
from panemill.llm.mixing import mixed_documents

#: Words of a shingle in the near-duplicate stage.
WIDTH = 5

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained quality classifiers don't reject."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel machine doesn't find toxic."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each near-duplicate group."""
    return deduplicated(docs, width=WIDTH)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document's ids and of the text decoded from them."""
    return queries.byte_bpe(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("toxicity", keep_clean),
    ("near_duplicates", keep_one_of_each),
    ("mixing", mix),
    ("byte_bpe", encode),
]

#: The classifiers and the near-duplicate search can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
