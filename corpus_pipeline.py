"""A training corpus from raw documents: filters, near-duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read
again as the next one's docs. What nulls, empty texts, ties, repeated rows and extra columns
give is said at each; an empty table gives an empty one in all of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from keyloom.deploy import ship
from keyloom.llm import bpe, mixing, quality, simhash, toxicity
from keyloom.llm.common import cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity operator lets pass; only texts count, so null and repeated ids are no matter."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier lets pass; only texts count, null ones as empty."""
    return quality.drop_poor(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that of the smallest doc_id; texts without words are one class."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it: by rows, whatever their ids; a null source is one of its own, texts without words go."""
    return mixing.take(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with doc_id and source, null or not; a null text is an empty one."""
    outputs = ("ids", "n_tokens", "ids_sha256", "decoded_sha256")
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), outputs, keep=("doc_id", "source"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("tokens", encode_tokens),
]

#: Nearest neighbours, SimHash components and BPE are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
