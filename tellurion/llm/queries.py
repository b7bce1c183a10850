"""The registered queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellurion.llm import _spark

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tellurion.llm.substring import removed

    return removed(_spark.documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tellurion.llm.rules import quality_rules

    return quality_rules(_spark.documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tellurion.llm.simhash import near_duplicates

    return near_duplicates(_spark.documents(spark, sf_dir), shingle=3, radius=2).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op4_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tellurion.llm.packing import pack_matrices

    return pack_matrices(_spark.documents(spark, sf_dir), tokenizer(), capacity=2048)


@query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tellurion.llm.packing import pack_by_configurations

    return pack_by_configurations(_spark.documents(spark, sf_dir), tokenizer(), capacity=2048).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tellurion.llm.encoding import encode_documents

    return encode_documents(_spark.documents(spark, sf_dir), tokenizer(), with_ids=False)


@query
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tellurion.llm.sketch import fingerprints

    return fingerprints(_spark.documents(spark, sf_dir))


@query
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tellurion.llm.classifier import classify

    return classify(_spark.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op7_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tellurion.llm.chat import perspectives

    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m["start"], m["end"])), " ")
    return perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet")).withColumn("mask", spans)


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tellurion.llm.langid import identify

    return identify(_spark.documents(spark, sf_dir))


def _oracles() -> None:
    from tellurion.llm import chat

    ORACLE_SQL["op7_chat_perspectives"] = chat.ORACLE


_oracles()
