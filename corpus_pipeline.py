"""From documents to packed training sequences: five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and returns the documents it kept, with the
columns of documents; the last returns packed pieces. Other columns of docs are left
out, whatever their names. Texts are read whole at any length, empty tables give
empty results, and null lang and source are names of their own. What stages make of
null texts and ids and of repeated rows is told at each.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common, mixing, ngram_join, packing, secrets, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.3.

    A text that is null or has no words has the score of the labels' mean, and stays
    null. Rows are judged one by one, so repeated rows and null ids all stay or go.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select(*COLUMNS), model).filter("score_ < 0.3").select(*COLUMNS)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity 0.8 or more, the smallest doc_id stays.

    Of rows of one doc_id the first text stays. Rows with a null id are compared as
    documents of their own, after all others. Null and empty texts are like none.
    """
    return ngram_join.keep_one(docs.select(*COLUMNS), size=5, percent=80).select(*COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and n_chars counted anew. Null texts become empty; repeated rows and null ids stay."""
    clean = secrets.redact(docs.select(*COLUMNS), secrets.fit(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, shared out to target weights; scarce leaves give a document up to twice.

    Null names of lang and source are the empty name; null and empty texts have no
    tokens and go with their leaf. Null ids have an order like any other; repeated
    rows count each, in the order of their texts.
    """
    return mixing.mix(docs.select(*COLUMNS), mixing.WEIGHTS, epochs=2, domain=F.expr(mixing.DOMAIN)).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences of at most 2048. Null and empty texts are their end id alone; repeated rows and null ids have pieces of their own."""
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), payload={"ids_crc32": F.crc32("ids")})
    return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", not_toxic),
    ("n-gram Jaccard join", distinct),
    ("secret scans", without_secrets),
    ("mixing sources to target weights", mixed),
    ("best-fit packing", packed),
]
#: SQL can't express the learned stages; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
