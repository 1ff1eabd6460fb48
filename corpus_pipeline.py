"""A training-data pipeline over `documents`: each stage reads what its predecessor kept, as Parquet.

1. language ID: documents without a recognisable language (no text, no letter) go;
2. exact dedup: of equal texts one document stays;
3. MinHash near-dedup: of each group of near copies one document stays;
4. mixing: documents are taken, left out or repeated so that the sources meet their target weights;
5. byte-level BPE: the token ids of what is left, checked by decoding.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeloom.llm import bpe, exact_dedup, language_id, minhash, mixing
from gradeloom.llm.common import shared_path
from gradeloom.llm.queries import RANK_FILE

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sample = language_id.learn(docs.where(language_id.fold_number() != 0))
    found = language_id.identify(docs.select(*COLUMNS), sample, lang_out="lang_pred", score_out="lang_score")
    return found.where(F.col("lang_pred") != language_id.UNKNOWN).select(*COLUMNS)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(docs).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.dedup(docs.select(*COLUMNS)).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document that the mix takes twice or three times is as many rows."""
    copies = F.aggregate("mix_takes", F.lit(0), lambda n, take: n + take["copies"])
    mixed = mixing.mix_by_source(docs.select(*COLUMNS)).withColumn("mix_copies", copies).where("mix_copies > 0")
    return mixed.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).select(*COLUMNS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(RANK_FILE)
    whole = bpe.round_trip(docs.select("doc_id", "source", "text"), path, public_tokenizers.PATTERN, decoded=None)
    return whole.select("doc_id", "source", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids", "same")


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("source mixing", mix_sources),
    ("byte-level BPE", encode_tokens),
]

#: language identification and the tokenizer can't be said in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = shared_path(spark, f"pipeline-{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
