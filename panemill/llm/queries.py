"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panemill.llm import ann, mixing, phrases, resampling, warc, word_bpe
from panemill.llm.byte_bpe import round_trip
from panemill.llm.common import table
from panemill.llm.language_id import identify
from panemill.llm.media import documents_as_media
from panemill.llm.minhash_dedup import near_duplicates
from panemill.llm.quality import quality
from panemill.llm.quotations import as_mail, link_quotes
from panemill.llm.toxicity import toxicity

Query = Callable[[SparkSession, str], DataFrame]


def byte_bpe(docs: DataFrame) -> DataFrame:
    import public_tokenizers  # where it is used: without it the other queries still work

    return round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe(table(spark, sf_dir, "documents"))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(as_mail(table(spark, sf_dir, "conversations")))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_as_media(table(spark, sf_dir, "documents"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return word_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_minhash, op2_mixing, op3_quality, op4_toxicity, op5_warc, op6_quotations, op7_language, op8_byte_bpe, op9_neighbours, op10_media, op11_phrases, op12_resampling, op13_word_bpe)}

#: DuckDB SQL for the queries that SQL can express.
ORACLE: dict[str, str] = {"op2_mixing": mixing.ORACLE, "op11_phrases": phrases.ORACLE, "op12_resampling": resampling.ORACLE}
