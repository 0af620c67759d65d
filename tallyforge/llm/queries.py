"""One query for each operator of this subpackage, over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, embed_dedup, jaccard_join, lexical_search, paragraph_dedup, quality, quality_rules, secrets, spelling, suffix_dedup, token_store, toxicity
from .common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents")).drop("live")


def op6_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.remove_repeated_paragraphs(table(spark, sf_dir, "documents")).drop("kept_text")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.read_shards(token_store.write_shards(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeated_bytes(table(spark, sf_dir, "documents")).drop("kept")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(spelling.word_counts(table(spark, sf_dir, "documents")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_bpe, op2_toxicity, op3_decontamination, op4_embedding_dedup, op5_secrets, op6_paragraph_dedup, op7_jaccard_join, op8_quality, op9_token_store, op10_suffix_dedup, op11_quality_rules, op12_lexical_search, op13_spelling, pipeline)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": decontaminate.ORACLE, "op4_embedding_dedup": embed_dedup.ORACLE, "op7_jaccard_join": jaccard_join.ORACLE, "op10_suffix_dedup": suffix_dedup.ORACLE, "op11_quality_rules": quality_rules.ORACLE, "op12_lexical_search": lexical_search.ORACLE, "op13_spelling": spelling.ORACLE}
