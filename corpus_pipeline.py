"""Corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that the next
stage gets as ``docs`` after it has been written as Parquet and read again:

1. ``language_id``   documents without a recognisable language go: null or
   letterless text, or text unlike all texts of its best language (``strange`` of
   ``langid.identify``), whatever the number of labels.
2. ``exact_dedup``   of texts equal but for white space the longest row stays.
3. ``near_dedup``    one document of each near-duplicate class stays.
4. ``secret_scan``   secrets are masked in the text; no document goes.
5. ``packing``       what is left is packed into sequences of 2048 token ids.

All but the last return the columns of ``documents``. ``run`` applies them.

Defined results of every stage: an empty table stays empty; a null text counts as empty and goes
in the first stage; texts are read whole, however long; repeated rows are rows like others (one of
them stays in the second stage); rows with null or repeated ids are judged by row; null labels,
sources and counts pass; other columns are dropped first, whatever their names.

The stages are samplers, tries and tokenizers that SQL cannot express, so there
is no SQL twin; a test holds the whole run against a brute-force version.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonon.llm import langid, minhash, packing, secret_scan
from phonon.llm.exact_dedup import exact_dedup
from phonon.session import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = "byte_bpe_50k.json"

ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the labels and the text stay as they are."""
    model = langid.fit_documents(docs)
    judged = langid.identify(docs.select(*COLUMNS), model)
    return judged.where((F.col("lang_pred") != langid.UNKNOWN) & ~F.col("strange")).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text (equal but for white space)."""
    return exact_dedup(docs.select(*COLUMNS))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the least document id."""
    return minhash.near_dedup(docs.select(*COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their secrets masked and the character count brought up to date."""
    masked = secret_scan.redact(docs.select(*COLUMNS))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: document, piece, place in it, length, checksum, sequence, offset."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near),
          ("secret_scan", secrets), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch_path(spark, f"pipeline-{uuid.uuid4().hex}")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
