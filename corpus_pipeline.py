"""From `documents` to a mixed, encoded training corpus: five stages, each written as Parquet and read again by the next.

Each stage works on every document that the one before kept. Repeated rows, null texts and null sources are defined by the operators. Texts that are null or without
a letter leave in the first stage; an empty table goes through as one. Columns beyond those of documents are carried to the last stage, whatever their names.
A stage's table is deleted when the next stage has read it; the last one's stays, as the result is read from it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.llm import bpe, jaccard, langid, mixing, secrets
from provenant.llm.common import bounded_batches, discard, few, table, unused, written

#: A language is taken as known from this share of a text's words on.
LEAST_SCORE = 0.3
#: Near duplicates: shingles of five words, similarity of 0.8.
SHINGLE_WORDS, PERCENT = 5, 80
RANK_FILE = "byte_bpe_50k.tiktoken"


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model, fitted on the labelled ones, can tell."""
    bounded_batches(spark)
    label, score = unused(docs, "lang_pred"), unused(docs, "score")
    found = langid.identify(docs, langid.train(docs), keep=True, names=(label, score))
    return found.filter((F.col(label) != langid.UNKNOWN) & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id."""
    bounded_batches(spark)
    return jaccard.one_of_each(docs, jaccard.classes(docs, width=SHINGLE_WORDS, percent=PERCENT))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked; n_chars follows."""
    bounded_batches(spark)
    found = secrets.scan(docs, secrets.fresh_ledger(docs))
    found = few(written(found.filter(F.size("findings") > 0).select("blob", "findings").dropDuplicates(["blob"]), "findings"), rows=50_000)
    masked = secrets.redact_found(docs, found)
    return masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.taken_rows(docs, mixing.mix(docs))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with their count and digests."""
    bounded_batches(spark)
    rows = bpe.encode(docs, public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN, decoded=True)
    return rows.select("doc_id", bpe.token_count().alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "token_ids")


STAGES = [
    ("language", known_language),
    ("near_copies", one_of_near_copies),
    ("secrets", without_secrets),
    ("mix", mixed_sources),
    ("encode", encoded),
]

#: Two of the stages draw or learn, which SQL can't say; tests hold the pipeline against a plain version of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return docs
