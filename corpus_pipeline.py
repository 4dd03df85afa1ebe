"""Documents to token ids: quality filter, near-duplicate removal, source mixing, SentencePiece encoding."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from varibreak.llm import mixing, quality, simhash
from varibreak.llm.pieces import PieceCodec
from varibreak.llm.queries import PIECES
from varibreak.session import checkpoint_folder, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: the documents that the quality classifier keeps."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: one document of each group of its fingerprints' groups and of near copies (five-word Jaccard similarity 0.8 or more)."""
    return simhash.keep_one_per_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: the words each source adds to the mix, as documents; a second pass is a second row."""
    return mixing.mix_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: ids of each text, and whether decoding gives the text back."""
    coded = docs.select("doc_id", "source", "lang", PieceCodec(spark, PIECES).encode_checked(F.coalesce("text", F.lit(""))).alias("coded"))
    return coded.select("doc_id", "source", "lang", F.size("coded.ids").cast("long").alias("n_ids"), "coded.ids", "coded.round_trip")


STAGES = [
    ("quality classifier", keep_good), ("simhash near-dedup", drop_near_copies), ("source mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

# No SQL states the fitted classifier, XXH64 or the segmentation; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again."""
    folder = f"{checkpoint_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{place}")
        docs = spark.read.parquet(f"{folder}/{place}")
    return docs
