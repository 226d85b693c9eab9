"""A corpus pipeline in five stages, each one of the operators in ballotry.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballotry.llm import mixing, ngram_join, repeats, tokens, toxicity
from ballotry.llm.common import Scratch

#: Near copies share 80 % of their five-word shingles or more.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
#: Bytes of a repeated passage: 50 words have more.
PASSAGE_BYTES = 200
#: Text of a block of the encoding and buckets of words at least: executors have served four stages before it, so
#: its tasks hold less than by the operator's defaults.
BLOCK_BYTES, BUCKETS = 4_000_000, 256


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic; the model learns from the labelled rows of folds 1 to 4."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.toxicity_scores(docs, toxicity.train(docs, labels))
    return scored.where("predicted = 0").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the smallest id."""
    return ngram_join.one_of_each_component(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the passages that occur again anywhere."""
    got = repeats.without_repeats(docs, PASSAGE_BYTES)
    changed = F.col("__removed") > 0
    text = F.when(changed, F.col("__rest")).otherwise(F.col("text"))
    n_chars = F.when(changed, F.char_length("__rest")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return got.withColumn("n_chars", n_chars).withColumn("text", text).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, twice where it takes them twice."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, token_ids) of every document."""
    ranks = tokens.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tokens.encode_decode(docs, ranks, public_tokenizers.PATTERN, packed=True, block_bytes=BLOCK_BYTES, buckets=max(BUCKETS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("bpe_encode_decode", encode),
]

#: Learned dictionaries and encodings are beyond SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.table(docs)
            scratch.drop(before)
    return docs
