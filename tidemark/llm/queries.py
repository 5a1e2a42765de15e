"""The registered queries of the training-data operators: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, mixing, multiset, ngram, packing, pii, quality, reputation, simhash, webp
from .common import crc_remainder


def byte_bpe() -> str:
    """The public byte-level BPE vocabulary that the queries use; the operators take any path."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op2_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset.edited(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))
    count = lambda kind: F.regexp_count("base", F.lit(f"{kind}:")).cast("long").alias(f"n_{kind}")
    return found.select(F.col("id").alias("doc_id"), *map(count, pii.BASE), F.sha2("base", 256).alias("base_sha256"), "spans")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    learned = lambda doc_id: crc_remainder(doc_id, 5) != 0
    found = quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), learned)
    return found.select(F.col("id").alias("doc_id"), (crc_remainder(F.col("id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    named = pages.select(reputation.host_of(F.col("url")).alias("host"), F.expr("try_cast(regexp_extract(url, '://[^/?#]*/[^/?#]*/([0-9]+)', 1) as bigint)").alias("doc_id"))
    labels = _table(spark, sf_dir, "labels").where("quality is not null or toxic is not null").select("doc_id", F.when((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1), 1).otherwise(0).alias("bad"))
    outcomes = named.join(labels, "doc_id").select("host", "bad")
    return reputation.judge(pages, outcomes, reputation.RULES).select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def op6_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    trie = ngram.train(docs.where(crc_remainder(F.col("doc_id"), 10) != 0))
    found = ngram.score(docs, trie)
    return found.select(F.col("id").alias("doc_id"), (crc_remainder(F.col("id"), 10) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(trie.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op7_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.digests(webp.store_texts(_table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(_table(spark, sf_dir, "documents"), byte_bpe())).withColumnRenamed("id", "doc_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.copies(_table(spark, sf_dir, "documents"))
    return taken.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = crc_remainder(F.col("doc_id"), 4) == 2
    model = langid.train(docs.where(~held_out))
    return langid.predict(docs, model).select(F.col("id").alias("doc_id"), (crc_remainder(F.col("id"), 4) == 2).alias("held_out"), "lang_pred", "score", "spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_multiset": op2_multiset,
    "op3_pii": op3_pii,
    "op4_quality": op4_quality,
    "op5_reputation": op5_reputation,
    "op6_ngram": op6_ngram,
    "op7_webp": op7_webp,
    "op8_packing": op8_packing,
    "op9_mixing": op9_mixing,
    "op10_langid": op10_langid,
}
ORACLES: dict[str, str] = {"op5_reputation": reputation.JUDGED_SQL, "op9_mixing": mixing.COPIES_SQL}
