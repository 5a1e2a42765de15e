"""The corpus pipeline: language ID, near-duplicates, personal data, mixing, packing.

``STAGES`` lists (name, function) in order; each function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid, mixing, overlap, packing, pii
from tidemark.llm.common import crc_remainder, scratch_path
from tidemark.llm.queries import byte_bpe

#: Least share of letters in the main language that a document needs to be kept.
LEAST_SHARE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that have a language; it is learned from the labelled ones of them."""
    model = langid.train(docs.where(crc_remainder(F.col("doc_id"), 4) != 2))
    return langid.keep_known(docs, model, least=LEAST_SHARE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the one with the smallest id, of each group whose five-word shingles overlap by 0.8 or more."""
    return overlap.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask personal data in the texts."""
    return pii.mask(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that the sources come near their target weights."""
    return mixing.mix(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' token ids into windows."""
    packed = packing.pack(packing.pieces(docs, byte_bpe()))
    return packed.withColumnRenamed("id", "doc_id")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixture", mixture), ("sequences", sequences)]

#: SQL can't express the stages' models, hashes and vocabulary; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written to and read from the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
