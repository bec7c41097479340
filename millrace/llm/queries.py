"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, common, fingerprint, media, mixing, ngram_join, packing, secrets, toxicity, warc, wavelet


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("score_").alias("score"), (F.col("score_") >= 0.3).cast("int").alias("predicted"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    packed = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), payload={"ids_crc32": F.crc32("ids")})
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents"), size=4, percent=85)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.new_folder(spark, "media")
    media.write_archives(_table(spark, sf_dir, "documents"), folder)
    return media.describe(media.read_archives(spark, folder))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), mixing.WEIGHTS, domain=F.expr(mixing.DOMAIN))
    return mixed.select("doc_id", F.col("mix_domain").alias("domain"), "lang", "source", F.col("mix_epoch").alias("epoch"), F.col("mix_tokens").alias("n_tokens"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(_table(spark, sf_dir, "conversations"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.new_folder(spark, "warc")
    runs = warc.write(_table(spark, sf_dir, "pages"), folder)
    records = warc.read(warc.merge(spark, runs, folder))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    shards = wavelet.write_shards(docs, public_tokenizers.path("word_bpe_49k.json"), 1, common.new_folder(spark, "tokens"))
    return wavelet.read_shards(shards, sums=True)


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = secrets.find(docs, secrets.fit(docs))
    counts = [secrets.count_of("spans", k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secrets.joined("spans", ["assign", "access", "hex"]), 256).alias("base_sha256"), secrets.joined("spans").alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_fingerprints": op4_fingerprints,
    "op5_media_columns": op5_media_columns,
    "op6_mixing": op6_mixing,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_warc": op8_warc,
    "op9_token_ids": op9_token_ids,
    "op10_secret_scans": op10_secret_scans,
}
ORACLE_SQL: dict[str, str] = {
    "op3_ngram_jaccard_join": ngram_join.ORACLE,
    "op6_mixing": mixing.oracle(),
    "op7_chat_formatting": chat.ORACLE,
    "op8_warc": warc.ORACLE,
}
