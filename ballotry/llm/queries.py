"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversations, cover_tree, filter_audit, licenses, main_text, mixing, ngram_join, posting_lists, repeats, tokens, toxicity, warc

#: Vocabulary files of the public tokenizers that the contracts name; change to use others.
TOKENIZER_JSON = "byte_bpe_50k.json"
TOKENIZER_RANKS = "byte_bpe_50k.tiktoken"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.weighted_fair_mix(_read(spark, sf_dir, "documents"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(_read(spark, sf_dir, "documents"), width=3, percent=90)


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(_read(spark, sf_dir, "embeddings"), cosine=0.9)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.suffix_dedup(_read(spark, sf_dir, "documents"), length=400, texts=True)


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posting_lists.nearest_neighbours(_read(spark, sf_dir, "embeddings"), k=20, every=20)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_read(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER_JSON), public_tokenizers.PATTERN)


def op7_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = tokens.load_ranks(public_tokenizers.path(TOKENIZER_RANKS))
    return tokens.encode_decode(_read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract_main_text(_read(spark, sf_dir, "pages"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_read(spark, sf_dir, "pages"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.interaction_audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(_read(spark, sf_dir, "conversations"), damage=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_nearest_neighbours": op4_nearest_neighbours,
    "op5_license_scan": op5_license_scan,
    "op6_token_counts": op6_token_counts,
    "op7_bpe_encode_decode": op7_bpe_encode_decode,
    "op8_mix_sources": op8_mix_sources,
    "op9_toxicity": op9_toxicity,
    "op10_main_text": op10_main_text,
    "op11_warc": op11_warc,
    "op12_filter_audit": op12_filter_audit,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLES: dict[str, str] = {
    "op5_license_scan": licenses.license_sql(),
    "op8_mix_sources": mixing.MIX_SQL,
    "op11_warc": warc.WARC_SQL,
    "op12_filter_audit": filter_audit.AUDIT_SQL,
    "op13_conversation_repair": conversations.REPAIR_SQL,
}
