"""The queries of the training-data operators over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_run_length_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import removed_spans

    return removed_spans(_read(spark, sf_dir, "documents"))


def op2_kk_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_by_bytes

    return shard_by_bytes(_read(spark, sf_dir, "documents"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import new_store_path, read_digest, write_store

    path = write_store(_read(spark, sf_dir, "documents"), new_store_path(spark), _tokenizer("byte_bpe_50k.json"), end_id=0)
    return read_digest(spark, path)


def op4_licence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licences import find_licences

    return find_licences(_read(spark, sf_dir, "documents"))


def op5_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repetition import judge_repetition

    return judge_repetition(_read(spark, sf_dir, "documents"))


def op6_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_read(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end_id=1)


def op7_signature_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import link_documents

    return link_documents(_read(spark, sf_dir, "documents"))


def op8_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import find_contamination

    return find_contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op9_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_reputation import judge_urls

    labels = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("bad"))
    return judge_urls(_read(spark, sf_dir, "pages"), labels)


def op10_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify_held_out

    return identify_held_out(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from .url_reputation import oracle

    return {"op9_url_reputation": oracle()}
