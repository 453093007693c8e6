"""A training-data pipeline over ``documents``, five stages of the llm operators in a row.

Each stage is a function of (spark, docs, sf_dir); what it returns is written as Parquet and
read again as the docs of the next. All but the last return the columns of documents.

1. language ID: documents whose language is rejected go.
2. n-gram Jaccard join: of linked documents, the one of the smallest id stays.
3. secret scans: secrets are masked in the text, and n_chars follows.
4. mixing: every document appears as often as the mix takes it, in training order.
5. SentencePiece: token ids with an end id, their byte spans in the text, and the decoded text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siftwell.llm import jaccard, langid, mixing, secret_scan, shared, spm


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.mask_secrets(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return spm.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=("lang", "source"))


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", tokens),
]

ORACLE_SQL = None  # training, merging and link components are not SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = shared.stored(docs, "stage")
    return docs
